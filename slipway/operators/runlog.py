"""Append-only run log. Every record is one JSON file with the next number, created only if nobody else took
it, so versions never collide and nothing is rewritten; the state of a version is what the records say.

Records: ``run`` (model, params, metrics), ``register`` (a model version for a run), ``stage`` (a version becomes
Production, Archived ...). Registering a run's best model promotes it and archives the version that was in
production, as later records.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slipway.sources.tables import Conflict, Files

RECORD = ("number long, kind string, run_id string, model string, params string, metrics map<string,double>, "
          "version int, stage string")


class RunLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _add(self, record: dict, tries: int = 20) -> dict:
        for _ in range(tries):
            number = int((self.files.names("records") or ["0"])[-1].split(".")[0]) + 1
            try:
                made = {"number": number, **record}
                if record["kind"] == "register":
                    made["version"] = self.last_version() + 1
                self.files.create(f"records/{number:010d}.json", json.dumps(made))
                return made
            except Conflict:
                continue
        raise Conflict(self.root)

    def records(self) -> DataFrame:
        if not self.files.names("records"):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).json(f"{self.root}/records")

    def last_version(self) -> int:
        return self.records().filter("kind = 'register'").agg(F.max("version")).first()[0] or 0

    def log_run(self, run_id: str, model: str, params: dict, metrics: dict[str, float]) -> None:
        """One record per model of a run."""
        self._add({"kind": "run", "run_id": run_id, "model": model, "params": json.dumps(params, sort_keys=True),
                   "metrics": {k: float(v) for k, v in metrics.items() if v is not None}})

    def best_of(self, run_id: str, metric: str = "pr_auc") -> str:
        """The run's model of highest metric (ties: the later name)."""
        r = (self.records().filter((F.col("kind") == "run") & (F.col("run_id") == run_id))
             .agg(F.max_by("model", F.struct(F.col("metrics")[metric], F.col("model")))).first())
        if r[0] is None:
            raise LookupError(f"run {run_id} has no model")
        return r[0]

    def register_best(self, run_id: str, metric: str = "pr_auc") -> int:
        """Register the run's best model, archive what is in production and promote the new version."""
        before = [r["version"] for r in self.stages().filter("stage = 'Production'").select("version").collect()]
        version = self._add({"kind": "register", "run_id": run_id, "model": self.best_of(run_id, metric), "stage": "None"})["version"]
        for v in before:
            self._add({"kind": "stage", "version": v, "stage": "Archived"})
        self._add({"kind": "stage", "version": version, "stage": "Production"})
        return version

    def stages(self) -> DataFrame:
        """(version, run_id, model, stage): every registered version and its newest stage."""
        rec = self.records()
        last = (rec.filter("version is not null").groupBy("version")
                .agg(F.max_by("stage", "number").alias("stage")))
        return rec.filter("kind = 'register'").select("version", "run_id", "model").join(last, "version")

    def runs(self) -> DataFrame:
        """(run_id, model, params, metrics, version, stage): all runs; version and stage of those registered."""
        # the newest record counts if a run logs a model twice; a run holds a handful of models
        newest = Window.partitionBy("run_id", "model").orderBy(F.desc("number"))
        runs = self.records().filter("kind = 'run'").withColumn("n", F.row_number().over(newest)).filter("n = 1")
        return runs.select("run_id", "model", "params", "metrics").join(self.stages(), ["run_id", "model"], "left")

    def live(self) -> DataFrame:
        """X11: the version in production, if there is one."""
        return self.stages().filter("stage = 'Production'")
