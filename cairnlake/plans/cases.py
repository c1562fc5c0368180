"""Benchmark cases: pairs of queries whose results must agree, with digests and medians of repeated runs."""

from __future__ import annotations

import hashlib
import json
import statistics
import time
from dataclasses import dataclass

from cairnlake.plans.engine import Engine


@dataclass(frozen=True)
class Case:
    """``ordered`` compares rows as a sequence, otherwise as a bag."""

    id: str
    baseline: str
    candidate: str | None = None
    ordered: bool = False


def digest(rows: list[list], ordered: bool) -> str:
    """SHA-256 of the rows as canonical JSON, sorted unless the case is ordered."""
    lines = [json.dumps(r, sort_keys=True, ensure_ascii=False) for r in rows]
    return hashlib.sha256("\n".join(lines if ordered else sorted(lines)).encode()).hexdigest()


def run(engine: Engine, case: Case, repeats: int = 3) -> dict:
    """Times baseline and candidate alternately; ``equal`` says whether their results agree each time."""
    times: dict[str, list[float]] = {"baseline": [], "candidate": []}
    seen = set()
    for k in range(repeats):
        names = ("baseline", "candidate") if k % 2 == 0 else ("candidate", "baseline")
        for name in names:
            sql = getattr(case, name)
            if sql is None:
                continue
            began = time.perf_counter()
            r = engine.execute(sql)
            times[name].append(time.perf_counter() - began)
            seen.add((digest(r.rows, case.ordered), tuple(r.columns), r.truncated))
    return {"id": case.id, "equal": len(seen) == 1, **{f"{n}_s": statistics.median(t) for n, t in times.items() if t}}
