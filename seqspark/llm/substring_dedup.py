"""Substring dedup by seed and extend.

A word goes if a window of ``WINDOW`` words that covers it also starts in a document with a smaller id.
Seeds are winnowed: of the ``SEED``-word sequences in each window, the one with the smallest hash (the
last such) is the window's anchor, so equal windows have their anchor at the same place.

1. Anchors (seed hash, text, place) are joined on the seed; seeds that stand in one text alone go.
   Frequent seeds are told by a sample beforehand and stay out of this join.
2. Each text extends its remaining anchors both ways, to the windows that have this anchor.
3. Around each seed, texts come in the order of their ids; a window goes where a smaller id has shown it.
   Seeds with over ``GROUP`` anchors are split by window: counted with partial minima, and joined back.
4. Windows that go join to maximal runs, which are at least WINDOW words long, and leave the texts.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` unchanged; a null text has none; ids are of any type that has an order; a null id is larger than
any other (the integer 2**63 - 1 is as large) and equal to itself; rows with equal ids do not delete from each other; further columns are ignored.
Words and windows are compared by 64-bit hashes beside the 64-bit hash of their seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from seqspark.llm import bytesops as B
from seqspark.llm.components import stored
from seqspark.operators.ranks import numbered

WINDOW = 13
SEED = 4
#: Anchors of one seed that one task takes in order; seeds with more are split by window.
GROUP = 20_000
#: One text in ``HOT_SAMPLE`` is asked for frequent seeds, and at most ``HOT_SEEDS`` of them are broadcast; this decides the way, not the result.
HOT_SAMPLE, HOT_SEEDS = 64, 100_000
#: Texts whose rests a task holds at once.
CUT_ROWS = 512
_PLACE = (1 << 24) - 1


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each text, and the words' hashes."""
    start, end, first = B.words(data, offsets)
    return first, B.span_hashes(data, start, end)


def word_anchors(hashes: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """anchor, first window, number of windows, seed hash; in words of the block; no window crosses a text's border."""
    n = len(hashes)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = B.sequence_hashes(hashes, seed)
    at = np.arange(len(h))
    place = np.uint64(_PLACE)
    least = B.sliding_min((h & ~place) | (place - (at.astype(np.uint64) & place)), window - seed + 1)
    ends = np.repeat(first[1:], np.diff(first))
    windows = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= window)
    if not len(windows):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    anchor = windows + (((place - (least[windows] & place)).astype(np.int64) - windows) & _PLACE)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(windows)]]) - 1
    return anchor[lo], windows[lo], hi - lo + 1, h[anchor[lo]].view(np.int64)


def _seeds(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in B.blocks(batch.column(1)):
                first, hashes = _word_hashes(data, offsets)
                at, _, _, key = word_anchors(hashes, first, window, seed)
                row = np.searchsorted(first, at, side="right") - 1
                # one row for each seed of a text, however often the text repeats it
                order = np.lexsort((at, key, row))
                row, key, at = row[order], key[order], at[order]
                begin = np.flatnonzero(np.concatenate([np.ones(min(len(row), 1), bool), (row[1:] != row[:-1]) | (key[1:] != key[:-1])]))
                bounds = pa.array(np.concatenate([begin, [len(row)]]).astype(np.int32))
                places = pa.ListArray.from_arrays(bounds, pa.array((at - first[row]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(key[begin]), batch.column(0).take(pa.array(row[begin] + lo)), places], names=["key", "rk", "at"])

    return run


def _extend(window: int, seed: int):
    """The windows around the listed anchors of each text: their first word, and their hashes as 8 bytes each."""
    schema = pa.schema([("key", pa.int64()), ("did", pa.int64()), ("rk", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("first", pa.int32()), ("windows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("items")
            for lo, hi, data, offsets in B.blocks(batch.column("text")):
                first, hashes = _word_hashes(data, offsets)
                at, start, count, key = word_anchors(hashes, first, window, seed)
                items = batch.column(column).slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), np.diff(items.offsets.to_numpy()))
                own = items.flatten()
                asked, n = first[owner] + own.field("at").to_numpy(), own.field("n").to_numpy()
                slot = np.searchsorted(at, asked)
                # a place that holds no anchor comes from another text with the same row hash
                good = (slot < len(at)) & (at[np.minimum(slot, max(len(at) - 1, 0))] == asked) if len(at) else np.zeros(len(asked), dtype=bool)
                slot, owner, n = slot[good], owner[good], n[good]
                count, start, key = count[slot], start[slot], key[slot]
                begin = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                h = B.sequence_hashes(hashes, window)[begin]
                bounds = np.concatenate([[0], np.cumsum(count) * 8]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(h.tobytes())])
                take = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c).take(take) for c in ("did", "rk", "th")), pa.array(n), pa.array((start - first[owner]).astype(np.int32)), packed], schema=schema)

    return run


def _flat(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every window of a batch."""
    column = table.column("windows")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = column.buffers()
    bounds = np.frombuffer(raw[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    h = np.frombuffer(raw[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]].view(np.uint64)
    return np.repeat(np.arange(len(column)), np.diff(bounds) // 8), h


_RANGES = pa.schema([("rk", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _in_order(window: int):
    """Rows sorted by seed and id: a window goes where its seed has shown it with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what the seed at a batch's end has shown: sorted window hashes and their smallest ids
        last, known, ids = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, did = batch.column("key").to_numpy(), batch.column("did").to_numpy()
            row, h = _flat(batch)
            mixed = B.mix(h ^ key[row].view(np.uint64))
            pool, pool_ids = (np.concatenate([known, mixed]), np.concatenate([ids, did[row]])) if last == key[0] else (mixed, did[row])
            order = np.lexsort((pool_ids, pool))
            fresh = np.concatenate([[True], pool[order][1:] != pool[order][:-1]])
            shown, least = pool[order][fresh], pool_ids[order][fresh]
            gone = least[np.searchsorted(shown, mixed)] < did[row]
            last = key[-1]
            tail = np.isin(shown, mixed[key[row] == last])
            if key[0] == last and len(known):
                tail |= np.isin(shown, known)
            known, ids = shown[tail], least[tail]
            place = np.arange(len(row)) - np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])[row]
            begin = gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])])
            stop = gone & np.concatenate([~gone[1:] | (row[1:] != row[:-1]), [True]])
            start, own = batch.column("first").to_numpy(), pa.array(row[begin])
            yield pa.RecordBatch.from_arrays([batch.column("rk").take(own), batch.column("th").take(own), pa.array((start[row[begin]] + place[begin]).astype(np.int32)), pa.array((start[row[stop]] + place[stop] + window).astype(np.int32))], schema=_RANGES)

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window."""
    for batch in batches:
        row, h = _flat(batch)
        place = np.arange(len(row)) - np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])[row]
        own = pa.array(row)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("key", "did", "rk", "th")), pa.array((batch.column("first").to_numpy()[row] + place).astype(np.int32)), pa.array(h.view(np.int64))], names=["key", "did", "rk", "th", "lo", "h"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    # what is kept is gathered for a part of a batch at a time
    for batch in (whole.slice(at, CUT_ROWS) for whole in batches for at in range(0, whole.num_rows, CUT_ROWS)):
        out: list[tuple] = []
        for text, starts, ends in zip(batch.column("text"), batch.column("lo"), batch.column("hi"), strict=True):
            words = text.as_buffer().to_pybytes().split()
            spans: list[tuple[int, int]] = []
            kept = words
            if starts.is_valid and len(starts):
                lo, hi = starts.values.to_numpy(), ends.values.to_numpy()
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                spans = list(zip(lo[new].tolist(), hi[np.concatenate([new[1:], [len(lo)]]) - 1].tolist(), strict=True))
                at, kept = 0, []
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
            rest = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode(), [a for a, _ in spans], [b for _, b in spans]))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "run_starts", "run_ends"])


def drop_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, the kept text, and the removed runs in words, of each row of ``docs``."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64("text").alias("th"), "doc_id", "text")
    did = F.col("doc_id").cast("long")
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        # ids of other types are compared by their places in their order
        places = numbered(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", name="did")
        docs, did = docs.join(places, "doc_id", "left"), F.col("did")
    # both joins below ask for the same rows of the same columns, so Spark deals the texts out once
    texts = docs.repartition("rk")

    anchors = docs.select("rk", "text").mapInArrow(_seeds(window, seed), "key long, rk long, at array<int>")
    # seeds that are frequent in a sample of the texts are not gathered by seed: they are known to stand in several texts
    seen = docs.where(F.pmod("rk", F.lit(HOT_SAMPLE)) == 0).select("rk", "text").mapInArrow(_seeds(window, seed), "key long, rk long, at array<int>")
    seen = seen.groupBy("key").agg(F.count("*").alias("texts"), F.min("rk").alias("a"), F.max("rk").alias("b")).where(f"texts >= {max(2, group // HOT_SAMPLE)} AND a <> b")
    hot = stored(seen.orderBy(F.desc("texts"), "key").limit(HOT_SEEDS).select("key", F.lit(True).alias("hot")), "hot-seeds")
    by_seed = Window.partitionBy("key", "salt")
    shared = anchors.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("hot"), F.col("rk")))
    shared = shared.select("*", F.sum(F.size("at")).over(by_seed).alias("own_n"), F.min("rk").over(by_seed).alias("a"), F.max("rk").over(by_seed).alias("b")).where("hot OR a <> b")
    shared = shared.select("rk", "at", F.when(F.col("hot"), group + 1).otherwise(F.col("own_n")).alias("n"))
    items = F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda x: F.transform(x["at"], lambda a: F.struct(a.alias("at"), x["n"].alias("n")))))
    asked = shared.groupBy("rk").agg(items.alias("items"))
    kept = texts.join(asked, "rk").select(F.coalesce(did, F.lit((1 << 63) - 1)).alias("did"), "rk", "th", "text", "items")
    extended = kept.mapInArrow(_extend(window, seed), "key long, did long, rk long, th long, n long, first int, windows binary")

    usual = extended.where(F.col("n") <= group).repartition("key").sortWithinPartitions("key", "did").mapInArrow(_in_order(window), "rk long, th long, lo int, hi int")
    single = extended.where(F.col("n") > group).mapInArrow(_single, "key long, did long, rk long, th long, lo int, h long")
    least = single.groupBy("key", "h").agg(F.min("did").alias("least"), F.max("did").alias("most")).where("least < most").select("key", "h", "least")
    split = single.join(least, ["key", "h"]).where("least < did").select("rk", "th", "lo", (F.col("lo") + window).alias("hi"))
    ranges = usual.unionByName(split).groupBy("rk", "th").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    # the rows were dealt by rk alone; th is a further condition, not a further key
    ranges = ranges.select(F.col("rk").alias("own_rk"), F.col("th").alias("own_th"), "lo", "hi")
    rows = texts.join(ranges, (F.col("rk") == F.col("own_rk")) & (F.col("th").bitwiseXOR(F.col("own_th")) == 0), "left").select("doc_id", "text", "lo", "hi")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), "lo", "hi").mapInArrow(_cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string, run_starts array<long>, run_ends array<long>")
