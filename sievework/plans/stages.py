"""Ordered, resumable stages over batch tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """run takes the session and the results so far, by stage id; on_failure: STOP or CONTINUE."""

    id: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    on_failure: str = "STOP"
    max_attempts: int = 1


class Pipeline:
    """Runs stages in order and writes each result as a table below `folder`; finished stages are read, not run again."""

    def __init__(self, stages: list[Stage]):
        ids = [s.id for s in stages]
        if not stages or not all(ids) or len(set(ids)) != len(ids):
            raise ValueError("stages need ids, each its own")
        if bad := [s.id for s in stages if s.on_failure not in ("STOP", "CONTINUE") or s.max_attempts < 1]:
            raise ValueError(f"stages with a bad policy: {bad}")
        self.stages = stages

    def run(self, spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], list[dict]]:
        """(results by stage, a log row for every stage). Never raises for a stage: its log row says why it failed."""
        results: dict[str, DataFrame] = {}
        log: list[dict] = []
        for position, stage in enumerate(self.stages):
            path, row = f"{folder}/{stage.id}", {"stage_id": stage.id, "position": position, "status": "PENDING", "attempt": 0, "error": None}
            log.append(row)
            if any(r["status"] == "FAILED" and s.on_failure == "STOP" for r, s in zip(log, self.stages)):
                continue
            if _done(spark, path):
                results[stage.id] = spark.read.parquet(path)
                row["status"] = "COMPLETED"
                continue
            while row["attempt"] < stage.max_attempts and row["status"] != "COMPLETED":
                row["attempt"] += 1
                try:
                    stage.run(spark, dict(results)).write.mode("overwrite").parquet(path)
                    results[stage.id] = spark.read.parquet(path)
                    row |= {"status": "COMPLETED", "error": None}
                except Exception as e:  # whatever a plug-in raises is its stage's outcome
                    row |= {"status": "FAILED", "error": f"{type(e).__name__}: {e}"[:300]}
        return results, log


@dataclass(frozen=True)
class Domain:
    """A plug-in: its versions, its stages, what their results come to, and what of that is recommended.

    finalize takes the session and the results by stage; its columns must be `result`. to_recommendation may be left out.
    """

    name: str
    versions: dict[str, str]
    stages: list[Stage]
    result: list[str]
    finalize: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    to_recommendation: Callable[[DataFrame], DataFrame] | None = None

    def evaluate(self, spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None, list[dict]]:
        """(result, recommendation, log); without a result where a stage is left."""
        results, log = Pipeline(self.stages).run(spark, folder)
        if outcome(log) != "COMPLETED":
            return None, None, log
        final = self.finalize(spark, results)
        if final.columns != self.result:
            raise ValueError(f"{self.name}: the result has the columns {final.columns}, not {self.result}")
        final.write.mode("overwrite").parquet(f"{folder}/result")
        final = spark.read.parquet(f"{folder}/result")
        return final, self.to_recommendation(final) if self.to_recommendation else None, log


def outcome(log: list[dict]) -> str:
    left = [r["stage_id"] for r in log if r["status"] != "COMPLETED"]
    return f"FAILED: {', '.join(left)}" if left else "COMPLETED"


def _done(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
