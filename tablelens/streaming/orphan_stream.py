"""Orphan references kept up to date from a stream of arrivals.

Each micro-batch holds references and parents together and adds its part to the
state's logs, under its number, in a folder that all executors share. A batch that is
run again after a failure replaces what it had written. From time to time the logs
are made one; the parts of before are deleted one such time later, so that no batch
that may be run again lacks them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablelens.operators.orphans import PARENT, REFERENCE, OrphanState, compact, drop, step

_REFERENCE_DDL = "ref_kind string, table_uuid string, record_key string, target_kind string, target_id bigint, first_seen timestamp_ntz"
#: The columns of the stream: those of a reference or of a parent, the others null.
ARRIVALS = f"is_reference boolean, {_REFERENCE_DDL}, arrived timestamp_ntz, deleted timestamp_ntz"


class OrphanTracker:
    """Keeps the state, and a list of its parts after each batch, under a folder."""

    def __init__(self, spark: SparkSession, folder: str, returns: bool = False, compact_every: int = 16):
        self.spark, self.folder, self.returns, self.every = spark, folder.rstrip("/"), returns, compact_every

    def state(self, version: int) -> OrphanState:
        """The state after batch number version; the empty one before the first."""
        if version < 0:
            return OrphanState.new(self.spark, self.folder, self.returns)
        text = "".join(r[0] for r in self.spark.read.text(f"{self.folder}/state-{version}").collect())  # one row
        kept = json.loads(text)
        return OrphanState(self.folder, kept["buckets"], kept["returns"], {int(n): p for n, p in kept["batches"].items()})

    def step(self, batch: DataFrame, version: int) -> None:
        """Takes one batch of arrivals up."""
        new = step(self.state(version - 1), batch.filter("is_reference").select(*REFERENCE), batch.filter(~F.col("is_reference")).select(*PARENT), version)
        if self.every and version % self.every == self.every - 1:
            new = compact(self.spark, new)
            for n in range(version - 2 * self.every + 1, version - self.every + 1):
                drop(self.spark, new, f"batch-{n}")
            drop(self.spark, new, f"whole-{version - 2 * self.every}")
        kept = json.dumps({"buckets": new.buckets, "returns": new.returns, "batches": new.batches})
        self.spark.createDataFrame([(kept,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/state-{version}")

    def start(self, arrivals: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over a stream of arrivals (ARRIVALS) until what is there is taken up."""
        return arrivals.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
