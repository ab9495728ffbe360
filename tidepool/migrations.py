"""Ordered steps that bring a root's tables to the form that the engine expects; each is applied once and remembered."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import TYPE_CHECKING

from pyspark.sql import Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .engine import Engine


@dataclass(frozen=True)
class Step:
    number: int
    name: str
    text: str  # what the checksum is of
    run: Callable[[Engine], None]

    @property
    def checksum(self) -> str:
        return hashlib.sha256(f"{self.number}:{self.name}:{self.text}".encode()).hexdigest()


def _backfill_keys(engine: Engine) -> None:
    """Tasks without a key take their source reference, where no other task of the project has it."""
    tasks = engine.documents("task").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("project", "source_ref")))
    rows = tasks.where("external_key IS NULL AND source_ref IS NOT NULL AND _n = 1").withColumn("external_key", F.col("source_ref")).drop("_n", "version", "op")
    if not rows.isEmpty():
        engine.commit("documents", rows)


def _quarantine(engine: Engine) -> None:
    """Links with an end that is gone or of another project are recorded and removed."""
    from .operators import graph

    ends = engine.documents().select("id", "project", "kind")
    bad = graph.misplaced(engine.latest("links").withColumn("relation", F.col("kind")).drop("kind"), ends).withColumnRenamed("relation", "kind")
    for r in bad.groupBy("reason").count().collect():
        engine.record("links", r.reason, "quarantined", {"count": r["count"]})
    if not bad.isEmpty():
        engine.commit("links", bad.drop("reason", "version", "op"), op="D")


STEPS = [
    Step(1, "task_keys", "external_key := source_ref where unique in the project", _backfill_keys),
    Step(2, "quarantine_links", "links need both ends live in one project", _quarantine),
]


def _applied(engine: Engine) -> dict[int, str]:
    return {r.number: r.checksum for r in engine.latest("migrations").collect()}  # as many as there are steps


def missing(engine: Engine) -> list[str]:
    done = _applied(engine)
    return [s.name for s in STEPS if s.number not in done]


def apply(engine: Engine) -> list[str]:
    done, out = _applied(engine), []
    for step in sorted(STEPS, key=lambda s: s.number):
        if step.number in done:
            if done[step.number] != step.checksum:
                from .engine import EngineError

                raise EngineError("conflict", f"migration {step.name} was applied with another text")
            continue
        step.run(engine)  # may be run again after a failure: each finds only what is left to do
        engine.commit("migrations", [{"number": step.number, "name": step.name, "checksum": step.checksum, "applied_at": datetime.now(UTC).isoformat()}])
        out.append(step.name)
    return out
