"""A staged runner: each stage is a function of tables; its output is reused if the stage's key and the output's digest
still match, and later stages are skipped after a failure."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.ids import dataset_digest
from ..sources import writers
from ..sources.readers import json_object


@dataclass
class Stage:
    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)
    version: str = "1"


def _read_json(spark: SparkSession, path: str) -> dict | None:
    fs, at = writers._fs(spark, path)
    return json_object(spark, path) if fs.exists(at) else None


class Runner:
    """Inputs and stage outputs are tables by name; outputs lie under ``folder``/name with a state file beside them."""

    def __init__(self, spark: SparkSession, folder: str, deadline_s: float | None = None):
        self.spark, self.folder, self.deadline_s = spark, folder.rstrip("/"), deadline_s

    def run(self, stages: list[Stage], inputs: dict[str, DataFrame], config: dict | None = None) -> dict:
        known = {"stop_on_failure"}
        if config and (extra := set(config) - known):
            raise ValueError(f"unknown settings: {sorted(extra)}")
        tables, began, report, failed = dict(inputs), time.monotonic(), [], False
        digests = {k: dataset_digest(v).first()["digest"] for k, v in inputs.items()}
        for s in stages:
            if failed:
                report.append({"stage": s.name, "status": "skipped"})
                continue
            if missing := [n for n in s.needs if n not in tables]:
                raise ValueError(f"{s.name} needs {missing}")
            key = hashlib.sha256(json.dumps([s.name, s.version, s.config, [digests[n] for n in s.needs]], sort_keys=True).encode()).hexdigest()
            path, state_path = f"{self.folder}/{s.name}", f"{self.folder}/{s.name}.state.json"
            state = _read_json(self.spark, state_path)
            t = time.monotonic()
            try:
                if self.deadline_s is not None and t - began > self.deadline_s:
                    raise TimeoutError("pipeline_deadline")
                reused = False
                if state and state["key"] == key:
                    tables[s.name] = self.spark.read.parquet(path)
                    reused = dataset_digest(tables[s.name]).first()["digest"] == state["digest"]
                if not reused:
                    s.run(*[tables[n] for n in s.needs], **s.config).write.mode("overwrite").parquet(path)
                    self.spark.catalog.refreshByPath(path)
                    tables[s.name] = self.spark.read.parquet(path)
                    row = dataset_digest(tables[s.name]).first()
                    state = {"key": key, "digest": row["digest"], "rows": row["rows"], "attempts": (state or {}).get("attempts", 0) + 1}
                    writers.write_text(self.spark, state_path, json.dumps(state, sort_keys=True), overwrite=True)
                digests[s.name] = state["digest"]
                report.append({"stage": s.name, "status": "reused" if reused else "succeeded", "rows": state["rows"], "seconds": round(time.monotonic() - t, 3)})
            except Exception as e:  # a stage's failure is a result of the run
                failed = True
                report.append({"stage": s.name, "status": "failed", "retryable": isinstance(e, (TimeoutError, OSError)), "reason": f"{type(e).__name__}: {str(e)[:200]}"})
        return {"status": "failed" if failed else "succeeded", "stages": report, "tables": tables}
