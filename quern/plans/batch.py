"""Scripts: many statements, with latencies."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .session import Result, Session


@dataclass
class BatchStats:
    total: int = 0
    ok: int = 0
    errors: int = 0
    elapsed_ms: float = 0.0
    mean_ms: float = 0.0
    p50_ms: float = 0.0
    p95_ms: float = 0.0
    p99_ms: float = 0.0
    max_ms: float = 0.0
    results: list[tuple[str, Result]] = field(default_factory=list)


def statements(script: str) -> list[str]:
    """One a line; blank lines, ``--`` and ``#`` lines and closing semicolons go."""
    lines = (x.strip().removesuffix(";").strip() for x in script.splitlines())
    return [x for x in lines if x and not x.startswith(("--", "#"))]


def run_batch(session: Session, script: str) -> BatchStats:
    """Every statement in turn, reads carried out to the last row and column; an error ends none."""
    out, took = BatchStats(), []
    for s in statements(script):
        begun = time.perf_counter()
        result = session.execute(s)
        if result.ok and result.df is not None:
            seen = Observation()
            result.df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            result.count = seen.get["n"]
        took.append((time.perf_counter() - begun) * 1000)
        out.results.append((s, result))
        out.ok += result.ok
        out.errors += not result.ok
    out.total = len(took)
    if took:
        ranked = sorted(took)
        at = lambda q: ranked[min(len(ranked) - 1, int(q * len(ranked)))]
        out.elapsed_ms, out.mean_ms, out.max_ms = sum(took), sum(took) / len(took), ranked[-1]
        out.p50_ms, out.p95_ms, out.p99_ms = at(0.5), at(0.95), at(0.99)
    return out


def run_file(session: Session, path: str) -> BatchStats:
    """A script that lies in any store."""
    return run_batch(session, "\n".join(r["value"] for r in session.spark.read.text(path, wholetext=True).collect()))
