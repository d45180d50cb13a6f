"""Near-duplicates found on arrival: a stateful stream over band keys (2.11 with J5).

A hash within ``threshold`` of another equals it on one of ``threshold + 1`` bands, so every arriving row is
sent to its (band, value) keys.  A key's state is the list of rows that came before with that value; a new
row is compared with them, and a pair is reported at the first band on which the two agree, so
each pair comes out once.  State has a time to live: a row stops being found when it has expired.

State is kept per key in RocksDB, checkpointed by the stream, and rebuilt after a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from imprint._ship import ship_with_tasks
from imprint.operators.hamming import N_BITS, _signed, band_plan

ship_with_tasks(__name__)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAIRS = "path string, h long, earlier_path string, earlier_h long, distance int"


class _Seen(StatefulProcessor):
    """Compares the rows of one (band, value) key with those that came before."""

    def __init__(self, threshold: int, masks: list[int], ttl_ms: int | None) -> None:
        self.threshold, self.masks, self.ttl_ms = threshold, masks, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "path string, h long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        band = int(key[0])
        before = [(p, h) for p, h in self.seen.get()] if self.seen.exists() else []
        paths, hashes = [p for p, _ in before], np.array([h for _, h in before], np.int64).view(np.uint64)
        fresh = pd.concat(list(rows)).drop_duplicates(["path", "h"]).sort_values(["path", "h"])
        known = {*before}
        out = []
        for path, h in zip(fresh["path"], fresh["h"]):
            if (path, int(h)) in known:
                continue
            known.add((path, int(h)))
            x = hashes ^ np.uint64(int(h) & (1 << N_BITS) - 1)
            near = np.bitwise_count(x) <= self.threshold
            for mask in self.masks[:band]:  # reported at an earlier band
                near &= (x & np.uint64(mask)) != 0
            out += [(path, int(h), paths[i], int(hashes[i].view(np.int64)), int(np.bitwise_count(x[i]))) for i in np.flatnonzero(near)]
            paths.append(path)
            hashes = np.append(hashes, np.uint64(int(h) & (1 << N_BITS) - 1))
            self.seen.appendValue((path, int(h)))
        yield pd.DataFrame(out, columns=["path", "h", "earlier_path", "earlier_h", "distance"])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Stateful streams of this kind need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def duplicates_on_arrival(stream: DataFrame, threshold: int = 5, ttl_ms: int | None = None) -> DataFrame:
    """A stream of pairs (path, h, earlier_path, earlier_h, distance) from a stream (path, h).

    Rows of one micro-batch are compared with each other too, in the order of path and hash.  A
    row that comes again with the same hash is not reported anew; rows without a hash have no part.
    """
    plan = band_plan(threshold, threshold + 1)
    keys = [F.col("h").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in plan.masks]
    rows = stream.select("path", "h").where("h is not null")
    rows = rows.select("path", "h", F.posexplode(F.array(*keys)).alias("band", "value"))
    return rows.groupBy("band", "value").transformWithStateInPandas(
        statefulProcessor=_Seen(threshold, list(plan.masks), ttl_ms),
        outputStructType=PAIRS,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
