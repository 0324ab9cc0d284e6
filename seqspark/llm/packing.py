"""Best-fit packing of documents into sequences of several permitted lengths.

Documents over the largest capacity are cut into pieces of that capacity and a rest.  Pieces are dealt
by a hash of their row to as many parts as the table has blocks of ``block`` pieces, so the packing
follows from the rows alone, not from how they came.  A part packs its pieces in the order of their
hash, ``block`` at a time: longest first, into the open bin with the least room that still holds the
piece.  Where none does, the bin size of least cost for each token it can hold is opened: the tokens are
the piece and as many of the smaller unplaced ones as could fill the rest.  At the end each bin shrinks
to the smallest permitted capacity that holds its contents.  Only ids and lengths leave the text's task.

Defined results: a text without words (null, empty) gets one row of length 0 with null bin and
capacity; repeated rows and null ids are packed each; of equally long pieces the one with the smaller
hash comes first; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seqspark.llm import bytesops as B
from seqspark.llm.components import stored

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its length, in tokens.
OVERHEAD = 64
BLOCK = 1 << 15


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the capacity of each bin."""
    order = np.argsort(-lengths, kind="stable")
    # tokens of unplaced pieces by length, to see what could fill a new bin
    sizes = np.sort(lengths)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[tuple[int, int]] = []
    filled: list[int] = []
    for rank, piece in enumerate(order.tolist()):
        need = int(lengths[piece])
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            unplaced = len(order) - rank - 1
            best = None
            for c in capacities:
                if c >= need:
                    fits = min(unplaced, int(np.searchsorted(sizes, c - need, side="right")))
                    key = ((c + overhead) / min(c, need + int(sums[fits])), c)
                    best = key if best is None or key < best else best
            left, b = best[1], len(filled)
            filled.append(0)
        bins[piece], offsets[piece] = b, filled[b]
        filled[b] += need
        if left > need:
            insort(room, (left - need, b))
    return bins, offsets, [min(c for c in capacities if c >= n) for n in filled]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in B.blocks(batch.column(2)):
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(2)), pa.array(np.diff(B.words(data, offsets)[2]))], names=["doc_id", "h", "words"])


def _pack(capacities: tuple[int, ...], overhead: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        waiting: list[pa.RecordBatch] = []

        def close(table: pa.Table) -> pa.RecordBatch:
            nonlocal base
            length = table.column("n_tokens").to_numpy()
            held = np.flatnonzero(length > 0)
            bins, offsets, caps = best_fit(length[held], capacities, overhead)
            out = [np.full(len(length), -1, np.int64) for _ in range(3)]
            if len(held):
                out[0][held], out[1][held], out[2][held] = bins + base, offsets, np.array(caps, np.int64)[bins]
            base += len(caps)
            columns = [table.column(c).combine_chunks() for c in ("doc_id", "piece", "first_token", "n_tokens")]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, mask=length == 0) for x in out)], names=["doc_id", "piece", "first_token", "n_tokens", "bin_id", "bin_offset", "capacity"])

        for batch in batches:
            waiting.append(batch)
            while (rows := sum(b.num_rows for b in waiting)) >= block:
                table = pa.Table.from_batches(waiting)
                yield close(table.slice(0, block))
                waiting = table.slice(block).to_batches() if rows > block else []
        if sum(b.num_rows for b in waiting):
            yield close(pa.Table.from_batches(waiting))

    return run


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin_id, bin_offset, capacity of every piece; tokens are words."""
    largest = max(capacities)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = stored(rows.mapInArrow(_counts, f"doc_id {kind}, h long, words long"), "lengths")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("words") / largest)).cast("long")
    total = counts.agg(F.coalesce(F.sum(pieces), F.lit(0))).first()[0]
    # equal rows are numbered, so that many of them do not go to one part
    rows = counts.groupBy("doc_id", "h", "words").agg(F.count("*").alias("n")).select("doc_id", "h", "words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    rows = rows.select("doc_id", "h", "words", "copy", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    first = F.col("piece") * largest
    rows = rows.select("doc_id", "h", "copy", "piece", first.alias("first_token"), F.least(F.lit(largest).cast("long"), F.col("words") - first).alias("n_tokens"))
    rows = rows.repartition(max(1, -(-total // block)), "h", "copy", "piece").sortWithinPartitions("h", "doc_id", "copy", "piece").select("doc_id", "piece", "first_token", "n_tokens")
    return rows.mapInArrow(_pack(tuple(sorted(capacities)), overhead, block), f"doc_id {kind}, piece long, first_token long, n_tokens long, bin_id long, bin_offset long, capacity long")
