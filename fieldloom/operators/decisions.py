"""Decision rules on a few aggregated numbers; what cannot be computed fails."""

from __future__ import annotations

import math
from collections.abc import Mapping


def _finite(*xs) -> bool:
    return all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in xs)


def prefer(delta_lo: float, new: Mapping[str, float], old: Mapping[str, float], counts=("over_nulls", "false_fills")) -> dict[str, bool]:
    """The new system is taken if the interval of its gain is above zero and none of the counts
    rises; each clause by name, and ``take``."""
    out = {"gain": _finite(delta_lo) and delta_lo > 0}
    for c in counts:
        out[c] = _finite(new.get(c), old.get(c)) and new[c] <= old[c]
    return out | {"take": all(out.values())}


def ship_rule(lo: float, broken: int, group_nets: Mapping[str, float] | None = None) -> bool:
    ok = _finite(lo, broken) and lo > 0 and broken == 0
    return ok and all(_finite(v) and v >= 0 for v in (group_nets or {}).values())


def keep_step(lo: float, hi: float, false_fill_delta: float, overall_delta: float) -> bool:
    """The interval excludes zero, or false fills fall and the overall score holds."""
    return _finite(lo, hi) and (lo > 0 or (_finite(false_fill_delta, overall_delta) and false_fill_delta < 0 and overall_delta >= 0))


def choose_batch(results: Mapping[int, Mapping[str, float]], limit: float, agree: float = 0.99) -> int:
    """The fastest batch size within the memory limit whose outputs agree with size 1."""
    ok = [b for b, r in results.items() if _finite(r.get("memory"), r.get("seconds"), r.get("agreement")) and r["memory"] <= limit and r["agreement"] >= agree]
    return min(ok, key=lambda b: (results[b]["seconds"], b), default=1)


def checks(rows: Mapping[str, tuple[object, object]]) -> list[tuple[str, str, str, bool]]:
    """(name, expected, found, ok) of each check; a missing value is never ok."""
    return [(n, str(want), str(got), want is not None and want == got) for n, (want, got) in rows.items()]
