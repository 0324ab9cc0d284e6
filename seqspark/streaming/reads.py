"""Structured Streaming forms: chunks and records that arrive over time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD_FIELDS = ("signal", "seq", "seq_len", "signal_len")


def stream_assemble(chunk_calls: DataFrame, time: str = "ts", gap: str = "10 minutes", delay: str = "10 minutes", key: str = "read_id") -> DataFrame:
    """key, seq, n_chunks: a read is emitted once, when no chunk of it has come for ``gap``; later chunks are dropped.

    ``chunk_calls(read_id, chunk_no, seq, ts)``; append mode.
    """
    own = chunk_calls.withWatermark(time, delay).groupBy(key, F.session_window(time, gap)).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "seq"))).alias("x"))
    return own.select(key, F.array_join(F.transform("x", lambda c: c["seq"]), "").alias("seq"), F.size("x").cast("long").alias("n_chunks"))


def complete_records(records: DataFrame) -> DataFrame:
    """Records that have all of signal, seq, seq_len and signal_len."""
    if missing := [c for c in RECORD_FIELDS if c not in records.columns]:
        raise ValueError(f"records lack {missing}")
    return records.dropna(subset=list(RECORD_FIELDS))


def stream_to_dataset(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet dataset, then stop.  A batch that is tried again overwrites its own folder alone, so nothing is written twice."""
    good = complete_records(records)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return good.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_balance(records: DataFrame, cap: int, bin_size: int, key: str = "read_id", ref: str = "contig", start: str = "r_start") -> DataFrame:
    """Records accepted while the bin of their first base has taken fewer than ``cap``.  State: one count for each bin."""
    schema = f"bin long, {ref} {records.schema[ref].dataType.simpleString()}, {key} {records.schema[key].dataType.simpleString()}"

    def accept(bin_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = state.get[0] if state.exists else 0
        for batch in batches:
            kept = batch.sort_values(key).head(max(cap - taken, 0))
            taken += len(kept)
            yield pd.DataFrame({"bin": bin_[1], ref: bin_[0], key: kept[key].to_numpy()})
        state.update((taken,))

    binned = records.withColumn("bin", F.floor(F.col(start) / bin_size))
    return binned.select(ref, "bin", key).groupBy(ref, "bin").applyInPandasWithState(accept, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def stream_site_coverage(hits: DataFrame, keys: tuple[str, ...] = ("contig", "refpos"), modified: str = "modified") -> DataFrame:
    """keys, coverage, modified_prob, kept up to date; update or complete mode."""
    return hits.groupBy(*keys).agg(F.count("*").alias("coverage"), F.avg(F.col(modified).cast("double")).alias("modified_prob"))
