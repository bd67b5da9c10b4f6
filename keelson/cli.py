"""Commands: analyze, violations, tree, diff, report. Exit 1 for usage and input errors, 2 when the gate fails."""

from __future__ import annotations

import argparse
import json
import sys

from keelson import render
from keelson.errors import KeelsonError
from keelson.sources import config, results


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("keelson").getOrCreate()


def _config(args: argparse.Namespace) -> dict:
    cfg = config.load_config(args.config) if args.config else config.defaults()
    if args.mode:
        cfg["analysis"]["profiles"] = {"both": ["anchored", "greenfield"]}.get(args.mode, [args.mode])
    for name in cfg["analysis"]["profiles"]:
        for key in ("candidates", "seed"):
            if getattr(args, key) is not None:
                cfg["profiles"][name][key] = getattr(args, key)
    return config.validate(cfg)


def gate(found: list[dict], fail_on: list[str]) -> int:
    """2 if a hard finding matches kind or kind:severity; borderline ones never do."""
    for rule in fail_on:
        kind, _, severity = rule.partition(":")
        if severity.lower() in ("", "violation") and any(f["kind"].lower() == kind.replace("-", "").lower() and f["severity"] == "Violation" for f in found):
            return 2
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="keelson")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("analyze", "violations"):
        p = sub.add_parser(name)
        p.add_argument("root")
        p.add_argument("--config")
        p.add_argument("--mode", choices=("anchored", "greenfield", "both"))
        p.add_argument("--candidates", type=int)
        p.add_argument("--seed", type=int)
        p.add_argument("--json")
        if name == "violations":
            p.add_argument("--fail-on", action="append", default=[])
    p = sub.add_parser("tree")
    p.add_argument("result")
    p.add_argument("--of", default="current")
    p.add_argument("--depth", type=int)
    p = sub.add_parser("diff")
    p.add_argument("result")
    p.add_argument("left")
    p.add_argument("right")
    p = sub.add_parser("report")
    p.add_argument("result")
    try:
        args = top.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    try:
        if args.command in ("analyze", "violations"):
            from keelson.plans import analysis

            cfg = _config(args)
            spark = _session()
            s = analysis.snapshot_from_path(spark, args.root, cfg)
            if args.command == "violations":
                found = [r.asDict() for name in cfg["analysis"]["profiles"] for r in analysis.structural(s, cfg, name).collect()]
                found = [dict(t) for t in dict.fromkeys(tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in f.items()) for f in found)]
                print(json.dumps(found, indent=2) if args.json else "\n".join(map(render.finding_line, found)) or "no findings")
                return gate(found, args.fail_on)
            result = analysis.analyze(s, cfg)
            if args.json:
                results.write_json(result, args.json)
            print(render.summary(result))
            return 0
        result = results.read_result(args.result)
        if args.command == "tree":
            ref = results.parse_reference(args.of)
            rows = result["profiles"][0]["current"]["tree"] if ref is None else results.candidate_at(result, *ref)["tree"]
            print(render.tree(rows, args.depth))
        elif args.command == "diff":
            print(render.diff(result, args.left, args.right))
        else:
            print(render.markdown(result))
        return 0
    except KeelsonError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
