"""Text faces of a result: summary, Markdown, findings table, tree, diff."""

from __future__ import annotations

import textwrap

from keelson.sources import results

SHOWN = 5  # fixed value: rows that a list shows before it counts the rest


def findings_of(result: dict, profile: str | None = None) -> list[dict]:
    own = [f for p in result["profiles"] if profile in (None, p["name"]) for f in p["findings"]]
    return [*result["sharedFindings"], *own]


def finding_line(f: dict) -> str:
    return f"{f['kind']} [{f['severity']}] {', '.join(f['location'])} :: {f['detail']}"


def violations(result: dict) -> str:
    return "\n".join(map(finding_line, findings_of(result))) or "no findings"


def limited(lines: list[str], shown: int | None = SHOWN) -> list[str]:
    return lines if shown is None or len(lines) <= shown else [*lines[:shown], f"... {len(lines) - shown} more"]


def summary(result: dict, shown: int | None = SHOWN) -> str:
    s = result["summary"]
    langs = ", ".join(f"{k} {v}" for k, v in sorted(s["languages"].items()))
    out = [f"files {s['files']} ({langs})", f"symbols {s['nodes']}", f"edges {s['edges']}"]
    if result["sharedFindings"]:
        out += ["", "findings of all profiles:", *limited([f"  {finding_line(f)}" for f in result["sharedFindings"]], shown)]
    for p in result["profiles"]:
        out += ["", f"{p['name']}: J {p['current']['score']:.4f}, {p['current']['standing'].lower()}"]
        out += limited([f"  {finding_line(f)}" for f in p["findings"]], shown)
        for i, c in enumerate(p["candidates"], 1):
            out.append(f"  candidate {i}: J {c['score']:.4f}, {len(c['moves'])} moves")
            out += limited([f"    {m['file']}: {m['from']} -> {m['to']}" for m in c["moves"]], shown)
            out += limited([f"    {m['kind'].lower()} {m['symbol']}: {m['from']} -> {m['to']}" for m in c.get("symbolMoves", ())], shown)
    if result["advice"]:
        out += ["", "advice:", *limited([f"  {a['subject']} -> {a['destination']}" + ("" if a["recommended"] else f" (review: {', '.join(a['reasons'])})") for a in result["advice"]], shown)]
    return "\n".join(w for line in out for w in (textwrap.wrap(line, 100, subsequent_indent="      ", drop_whitespace=False, break_long_words=False) or [""]))


def markdown(result: dict) -> str:
    return f"# Structure report\n\n```text\n{summary(result, None)}\n```\n"


def tree(rows: list[dict], depth: int | None = None, symbols: dict[str, list[str]] | None = None) -> str:
    """Packages, domains, folders and files; synthetic levels are left out."""
    top: dict = {}
    for r in rows:
        at = top
        path = [r["package"]]
        inner = r["folder"].removeprefix(r["package"]).strip("/")
        path += [] if inner in ("", "workspace") else inner.split("/")
        for p in [*path, r["path"].rpartition("/")[2]]:
            at = at.setdefault(p, {})
        for s in (symbols or {}).get(r["path"], ()):
            at.setdefault(s, {})
    out: list[str] = []

    def walk(node: dict, at: int) -> None:
        if depth is None or at < depth:
            for k in sorted(node, key=lambda k: (not node[k], k)):
                out.append("  " * at + k + ("/" if node[k] else ""))
                walk(node[k], at + 1)

    walk(top, 0)
    return "\n".join(out)


def diff(result: dict, left: str, right: str) -> str:
    """Moves between two layouts; for two candidates of one profile also their distance."""
    a, b = results.parse_reference(left), results.parse_reference(right)

    def rows(ref):
        if ref is None:
            return result["profiles"][0]["current"]["tree"]
        return results.candidate_at(result, *ref)["tree"]

    before, after = ({r["path"]: r["folder"] for r in rows(x)} for x in (a, b))
    out = [f"{p}: {before.get(p, '-')} -> {after.get(p, '-')}" for p in sorted({*before, *after}) if before.get(p) != after.get(p)]
    if a and b and a[0] == b[0]:
        out.append(f"distance {results.profile_of(result, a[0])['distances'][a[1] - 1][b[1] - 1]:.4f}")
    return "\n".join(out) or "no difference"
