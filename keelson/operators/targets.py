"""Machine-checked expectations on a layout: each returns None, or says what is wrong."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from keelson.operators.search import Layout, physical_entries

Where = Mapping[str, str]


def preserve_dir(before: Where, after: Where, folder: str, share: float = 1.0) -> str | None:
    own = [f for f, d in before.items() if d == folder]
    stay = Counter(after.get(f) for f in own).most_common(1)
    return None if own and stay[0][1] >= share * len(own) else f"{folder} was torn"


def keep_together(after: Where, files: Sequence[str]) -> str | None:
    return None if len({after[f] for f in files}) == 1 else f"{', '.join(files)} are apart"


def separate(after: Where, a: Sequence[str], b: Sequence[str]) -> str | None:
    both = {after[f] for f in a} & {after[f] for f in b}
    return f"{', '.join(sorted(both))} mixes both" if both else None


def size_band(after: Where, most: int, least: int = 1) -> str | None:
    bad = sorted(d for d, n in Counter(after.values()).items() if not least <= n <= most)
    return f"{', '.join(bad)} outside {least} to {most}" if bad else None


def move_budget(before: Where, after: Where, most: int) -> str | None:
    n = sum(before[f] != after.get(f) for f in before)
    return f"{n} moves, {most} allowed" if n > most else None


def no_synthetic_bucket(before: Where, after: Where) -> str | None:
    grown = sorted(f for f, d in after.items() if d.endswith("/workspace") and before.get(f) != d)
    return f"{', '.join(grown)} fell into a bucket" if grown else None


def name_alignment(after: Where, tokens: Mapping[str, frozenset], folder_tokens: Mapping[str, frozenset], least: float) -> str | None:
    hit = sum(bool(tokens[f] & folder_tokens.get(d, frozenset())) for f, d in after.items())
    return None if not after or hit >= least * len(after) else f"{hit} of {len(after)} are aligned"


def capacity_relief(x: Layout, cap: int) -> str | None:
    bad = sorted(d for d, n in physical_entries(x).items() if n > cap)
    return f"{', '.join(bad)} above {cap}" if bad else None


def non_inversion(current: float, candidates: Sequence[float]) -> str | None:
    worse = [s for s in candidates if s > current]
    return f"{len(worse)} candidates are worse than the current layout" if worse else None


def preserve_symbol_home(before: Mapping[int, str], after: Mapping[int, str], ids: Sequence[int]) -> str | None:
    gone = [i for i in ids if before[i] != after.get(i)]
    return f"{gone} left home" if gone else None


KINDS = {f.__name__: f for f in (preserve_dir, keep_together, separate, size_band, move_budget, no_synthetic_bucket, name_alignment, capacity_relief, non_inversion, preserve_symbol_home)}
