"""Mixture burden and exact lower median kept per key while evidence streams in.

The state of a key is its depth histogram, packed into one or a few values, so it grows with the depths seen and not with
the positions. Keys that never expire are kept by a streaming aggregate (four sums and an exact discrete percentile, whose buffer is the
histogram), without a Python call per key. Keys that expire need timers: there positions of a batch are folded to (key, depth)
counts, and a processor adds them to four counts per depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cohortloom.functions.numeric import per_million
from cohortloom.operators.evidence import decode_rows, position_flags
from cohortloom.sources.records import evidence_fields

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPAN = 4096
COUNTS = ("positions", "callable", "mixed_wide", "mixed_narrow")
METRICS = "total_positions bigint, callable_positions bigint, median_depth bigint, mixed_wide bigint, mixed_narrow bigint"


def lower_median(histogram: dict[int, int]) -> int:
    """Depth at rank (n + 1) div 2 of the counted depths; 0 for none."""
    middle, run = (sum(histogram.values()) + 1) // 2, 0
    for depth in sorted(d for d, n in histogram.items() if n):
        run += histogram[depth]
        if run >= middle:
            return depth
    return 0


class BurdenState(StatefulProcessor):
    """Adds (depth, counts) rows to the key's histogram and emits its row of metrics.

    The histogram is held in pieces of ``SPAN`` depths, each one entry of the map state: an array of four counts per depth. A key
    of a usual depth has one piece, so a batch costs it one scan and one write, however many depths it has.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.depths = handle.getMapState("depths", "piece bigint", "counts binary")

    def _add(self, key, depths: np.ndarray, counts: np.ndarray, timer_values) -> tuple:
        pieces = {int(p[0]): np.frombuffer(bytes(c[0]), dtype=np.int64).reshape(-1, 4) for p, c in self.depths.iterator()}
        of = depths // SPAN
        for piece in np.unique(of):
            mine = of == piece
            at = depths[mine] - piece * SPAN
            old = pieces.get(int(piece), np.zeros((0, 4), dtype=np.int64))
            new = np.zeros((max(len(old), int(at.max()) + 1), 4), dtype=np.int64)
            new[: len(old)] = old
            np.add.at(new, at, counts[mine])
            pieces[int(piece)] = new
            self.depths.updateValue((int(piece),), (new.tobytes(),))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        totals = [int(x) for x in sum((c.sum(axis=0) for c in pieces.values()), np.zeros(4, dtype=np.int64))]
        median = lower_median({p * SPAN + int(i): int(c[i, 1]) for p, c in pieces.items() for i in np.flatnonzero(c[:, 1])})
        return (*key, totals[0], totals[1], median, totals[2], totals[3])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = np.concatenate([part[["depth", *COUNTS]].to_numpy(dtype=np.int64) for part in rows])
        yield pd.DataFrame([self._add(key, new[:, 0], new[:, 1:], timer_values)])

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
        self.depths.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _fold(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = pa.Table.from_batches([batch]).group_by([*keys, "depth"]).aggregate([(c, "sum") for c in COUNTS])
                yield from sums.rename_columns([*keys, "depth", *COUNTS]).combine_chunks().to_batches()

    return run


def stream_burden(lines: DataFrame, keys: list[str], idle_ms: int = 0) -> DataFrame:
    """Streaming rows (keys, metrics): a key's burden so far, each time a batch adds to it (update mode).

    ``lines`` has the evidence text as ``value`` and the key columns. Positions of no depth count as positions. A key without
    input for ``idle_ms`` (0: never; the state is then that of a streaming aggregate) loses its state and starts from zero if it returns; this is for queries that run on, since
    Spark looks for idle keys in batch after batch without data. The session needs the RocksDB state store (``STATE_STORE``).
    """
    flags = position_flags(decode_rows(evidence_fields(lines)), keys)
    if not idle_ms:
        return flags.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("total_positions"),
            F.count_if("_c").alias("callable_positions"),
            F.coalesce(F.expr("percentile_disc(0.5) within group (order by depth) filter (where _c)").cast("bigint"), F.lit(0).cast("bigint")).alias("median_depth"),
            F.count_if("_w").alias("mixed_wide"),
            F.count_if("_n").alias("mixed_narrow"),
        )
    one = [F.lit(1).cast("bigint").alias("positions"), *[F.col(f).cast("bigint").alias(c) for f, c in zip(("_c", "_w", "_n"), COUNTS[1:], strict=True)]]
    rows = flags.select(*keys, F.col("depth").cast("bigint").alias("depth"), *one)
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    folded = rows.mapInArrow(_fold(keys), named)
    key_schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return folded.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=BurdenState(idle_ms), outputStructType=f"{key_schema}, {METRICS}", outputMode="Update", timeMode="ProcessingTime"
    )


def run_burden(burdens: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Run over all available input. Every batch is written to a folder of its own number, so one that runs again after a failure replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return (
        burdens.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    )


def latest(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of every key, with the rates per million callable positions."""
    columns = [c for c in stored.columns if c not in (*keys, "batch")]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_n")).select(*keys, "_n.*")
    return newest.withColumns({f"{s}_per_million": per_million(f"mixed_{s}", "callable_positions") for s in ("wide", "narrow")})
