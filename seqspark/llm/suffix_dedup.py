"""Exact substring dedup over suffixes sorted deep and shallow.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere else, in the same text or
another.  Bytes covered by a repeated string of ``PASSAGE`` bytes, some fifty short words, are counted
besides.  Equal strings hold equal winnowing anchors: in each window of PASSAGE bytes the seed of
``SEED`` bytes with the smallest hash (the last such) is the window's anchor, so equal windows have
their anchor at the same place; a longer string has the anchor of its first PASSAGE bytes.  Only suffixes
at anchors are sorted.

1. The hashes of the seeds at anchors (``key``) are counted; anchors with a key of their own go (frequent seeds
   are told by a sample beforehand and stay out of this join).  The others
   go to a table, with the range of windows that each serves and the hash of all bytes of these windows (``ctx``).
2. Anchors are counted by (key, ctx), and contexts by key.  Contexts that occur twice are repeated as a whole.
3. For keys with several contexts, one text of each context supplies its bytes.  In a task, the suffixes
   right of the anchors are sorted by multikey quicksort on 8-byte words down to a shallow depth; what
   still shares that prefix is put in order by blind tries.  The reversed bytes left of the anchors
   likewise.  The two orders with their common-prefix lengths tell, for each offset, which windows are equal.
4. A key with over ``GROUP`` contexts is not sorted in one task: the hashes of its windows are counted
   instead, with partial sums before the shuffle; this gives the same windows.
5. Repeated windows return to the anchors, and to the texts.

Defined results: a null text is the empty text; texts shorter than PASSAGE bytes lose and count nothing; rows
that repeat a text repeat its windows, whatever their ids, null ones included; further columns are ignored.
Keys, contexts and the windows of large keys are told apart by 64-bit hashes, contexts and windows inside their key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqspark.llm import bytesops as B
from seqspark.llm.components import stored

LENGTH = 400
PASSAGE = 256
SEED = 50
GROUP = 4096
#: One text in ``HOT_SAMPLE`` is asked for frequent seeds, those seen ``HOT_SEEN`` times there; at most ``HOT_SEEDS`` of them are broadcast.  This decides the way, not the result.
HOT_SAMPLE, HOT_SEEN, HOT_SEEDS = 64, 16, 100_000
#: Words of 8 bytes that the quicksort looks at before the tries take over.
SHALLOW_WORDS = 4
CHUNK_BYTES = 4 << 20
#: Texts whose rests a task holds at once.
CUT_ROWS = 512
_PLACE = (1 << 24) - 1
#: A text is read in pieces of this size, so that a place in a piece fits 24 bits.
PIECE_BYTES = 4 << 20


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int, passage: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, key, context hash, anchor, first window, last window and end of the context (all inside the row's text), for the texts of a block.

    Windows have ``passage`` bytes; a context reaches ``length`` bytes from its last window's start, or to the text's end.
    """
    for base in range(0, max(len(data), 1), PIECE_BYTES):
        lone = len(offsets) == 2
        part = data[base : base + PIECE_BYTES + length - 1] if lone else data
        if len(part) < passage:
            return
        ends = np.full(len(part), len(part)) if lone else np.repeat(offsets[1:], np.diff(offsets))
        h = B.sequence_hashes(part, seed)
        at = np.arange(len(h))
        place = np.uint64(_PLACE)
        least = B.sliding_min((h & ~place) | (place - at.astype(np.uint64)), passage - seed + 1)
        windows = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= passage)
        if lone:
            windows = windows[windows < PIECE_BYTES]
        if len(windows):
            anchor = (place - (least[windows] & place)).astype(np.int64)
            cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
            lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(windows)]]) - 1
            first, last, anchor = windows[lo], windows[hi], anchor[lo]
            stop = np.minimum(last + length, ends[first])
            ctx = B.mix(B.span_hashes(part, first, stop) + ((anchor - first) * (1 << 20) + last - first).astype(np.uint64))
            row = np.searchsorted(offsets, first + base, side="right") - 1
            shift = base - offsets[row]
            yield row, h[anchor].view(np.int64), ctx.view(np.int64), anchor + shift, first + shift, last + shift, stop + shift
        if not lone or base + PIECE_BYTES + length - 1 >= len(data):
            return


_ANCHORS = "rk long, th long, key long, ctx long, at int, first int, last int, stop int"


def _anchors(length: int, passage: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.blocks(batch.column(2)):
                for row, key, ctx, *places in window_anchors(data, offsets, length, passage, seed):
                    take = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(key), pa.array(ctx), *(pa.array(x.astype(np.int32)) for x in places)], names=["rk", "th", "key", "ctx", "at", "first", "last", "stop"])

    return run


def _keys(length: int, passage: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in B.blocks(batch.column(0)):
                for _, key, *_ in window_anchors(data, offsets, length, passage, seed):
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts listed with each text."""
    schema = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("m", pa.int64()), ("left", pa.int32()), ("windows", pa.int32()), ("bytes", pa.binary())])
    for batch in batches:
        for text, items in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            own = items.values
            at, first, last, stop = (own.field(x).to_numpy() for x in ("at", "first", "last", "stop"))
            cut = pa.array([raw[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(own.field(x) for x in ("key", "ctx", "m")), pa.array((at - first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), cut], schema=schema)


def _trie_order(strings: list[bytes]) -> list[int]:
    """Order of the strings by a blind trie: descend by branching bytes alone, compare once, insert."""
    root: list = [None, 0]  # a leaf: [None, member, ...]; a branch: [depth, {byte: node}]
    for i in range(1, len(strings)):
        s = strings[i]
        path, node = [], root
        while node[0] is not None:
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = strings[node[1]]
        if s == t:
            node.append(i)
            continue
        differ = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
        depth = len(s) - (differ.bit_length() + 7) // 8
        above = next((p for p in path if p[0] >= depth), node)
        if above[0] == depth:
            above[1][s[depth]] = [None, i]
        else:
            above[:] = [depth, {t[depth]: list(above), s[depth]: [None, i]}]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1:]
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def _three_ways(segment: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of multikey quicksort for all segments at once: the order that parts each segment into values under, equal to and over its pivot, and each place's part (0, 1, 2).

    The pivot is the median of a segment's first, middle and last value; places keep their order inside a part.
    """
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    size = np.diff(np.concatenate([first, [len(segment)]]))
    a, b, c = value[first], value[first + size // 2], value[first + size - 1]
    pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
    part = np.where(value < pivot, 0, np.where(value == pivot, 1, 2))
    start = np.repeat(first, size)
    target = np.empty(len(value), dtype=np.int64)
    below = np.zeros(len(first), dtype=np.int64)
    for which in range(3):
        own = part == which
        seen = np.concatenate([[0], np.cumsum(own)])
        count = seen[first + size] - seen[first]
        target[own] = (start + np.repeat(below - seen[first], size) + seen[:-1])[own]
        below += count
    order = np.empty(len(value), dtype=np.int64)
    order[target] = np.arange(len(value))
    return order, part[order]


def suffix_order(strings: np.ndarray, group: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of zero-padded strings (rows of bytes, a multiple of 8 wide) by group and content, and the common prefix of each with the one before (-1 at a group's first).

    Multikey quicksort on 8-byte words: a segment is parted in three ways around a pivot; its equal part goes on with the next word, down
    to ``SHALLOW_WORDS`` words.  All open segments take a step together.  What is still tied then is put in order by blind tries.  The first
    ``skip`` words are known to be equal inside a group.
    """
    wide = strings.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    segment = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]])) if len(order) else order
    last = min(skip + SHALLOW_WORDS, wide.shape[1])
    word = np.full(len(order), skip)
    while True:
        tied = np.zeros(len(order), dtype=bool)
        same = segment[1:] == segment[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        open_ = np.flatnonzero(tied & (word < last))
        if not len(open_):
            break
        inner, part = _three_ways(segment[open_], wide[order[open_], word[open_]])
        order[open_] = order[open_][inner]
        word[open_] += part == 1
        parts = np.zeros(len(order), dtype=np.int64)
        parts[open_] = part
        segment = np.cumsum(np.concatenate([[0], (segment[1:] != segment[:-1]) | (parts[1:] != parts[:-1])]))
    bounds = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
    for lo in np.flatnonzero(np.diff(bounds) > 1).tolist():
        members = order[bounds[lo] : bounds[lo + 1]]
        order[bounds[lo] : bounds[lo + 1]] = members[_trie_order([strings[i].tobytes() for i in members.tolist()])]
    common = np.full(len(order), -1)
    if len(order) > 1:
        differ = strings[order[1:]] != strings[order[:-1]]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], lcp, -1)
    return order, common


def repeated_windows(group: np.ndarray, left: np.ndarray, windows: np.ndarray, contexts: list[bytes], lengths: tuple[int, int], seed: int) -> list[np.ndarray]:
    """For each length, context, and distance of a window's start left of the anchor: whether another context of the group has the same window there."""
    n, longest, reach = len(group), max(lengths), min(lengths) - seed + 1
    right_bytes = np.zeros((n, -(-longest // 8) * 8), dtype=np.uint8)
    left_bytes = np.zeros((n, -(-reach // 8) * 8), dtype=np.uint8)
    for i, c in enumerate(contexts):
        raw = np.frombuffer(c, dtype=np.uint8)
        right_bytes[i, : len(c) - left[i]] = raw[left[i] :]
        left_bytes[i, : left[i]] = raw[: left[i]][::-1]
    right_order, right_common = suffix_order(right_bytes, group, seed // 8)
    left_order, left_common = suffix_order(left_bytes, group)
    near, far = left - windows + 1, left
    held = np.array([len(c) for c in contexts]) - left
    out = [np.zeros((n, reach), dtype=bool) for _ in lengths]
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(reach):
        served = (near <= d) & (d <= far)
        if served.sum() < 2:
            continue
        left_class[left_order] = np.cumsum(left_common < d)
        for hit, length in zip(out, lengths, strict=True):
            own = np.flatnonzero(served & (held >= length - d))
            if len(own) < 2:
                continue
            right_class[right_order] = np.cumsum(right_common < length - d)
            pair = right_class[own] * (n + 1) + left_class[own]
            order = np.argsort(pair)
            same = pair[order][1:] == pair[order][:-1]
            hit[own[order[1:][same]], d] = True
            hit[own[order[:-1][same]], d] = True
    return out


_RANGES = ("lo", "hi", "plo", "phi")


def _sorted_groups(length: int, passage: int, seed: int):
    schema = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), *((c, pa.list_(pa.int32())) for c in _RANGES)])

    def solve(table: pa.Table) -> pa.RecordBatch:
        key, ctx = table.column("key").to_numpy(), table.column("ctx").to_numpy()
        # a text that stands in several rows supplies its contexts as often
        fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])]))
        table, key, ctx = table.take(pa.array(fresh)), key[fresh], ctx[fresh]
        left, windows = table.column("left").to_numpy().astype(np.int64), table.column("windows").to_numpy().astype(np.int64)
        lengths, lists = (length, passage), []
        hits = repeated_windows(key, left, windows, table.column("bytes").to_pylist(), lengths, seed)
        for hit, size in zip(hits, lengths, strict=True):
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, start = np.nonzero(edge == 1)
            stop = np.nonzero(edge == -1)[1]
            bounds = pa.array(np.searchsorted(row, np.arange(len(key) + 1)).astype(np.int32))
            lists += [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (1 - stop, size - start)]
        some = pa.array(np.flatnonzero(hits[0].any(axis=1) | hits[1].any(axis=1)))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx), *lists], schema=schema).take(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if sum(b.nbytes for b in waiting) >= CHUNK_BYTES:
                # a key's contexts stay together: those of the last key wait for more
                table = pa.Table.from_batches(waiting)
                key = table.column("key").to_numpy()
                done = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                lo = 0
                while lo < done:
                    hi = min(done, lo + max(1, CHUNK_BYTES * table.num_rows // max(1, table.nbytes)))
                    while hi < done and key[hi] == key[hi - 1]:
                        hi += 1
                    yield solve(table.slice(lo, hi - lo))
                    lo = hi
                waiting = [b for b in table.slice(done).to_batches() if b.num_rows]
        if waiting:
            yield solve(pa.Table.from_batches(waiting))

    return run


def _window_hashes(length: int, passage: int):
    """Every window of each context, of both lengths: its length, its distance from the anchor and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column("bytes")[i].as_buffer(), dtype=np.uint8)
                left, windows = batch.column("left")[i].as_py(), batch.column("windows")[i].as_py()
                for size in (length, passage):
                    h = B.sequence_hashes(raw, size)[:windows].view(np.int64)
                    own = pa.array(np.full(len(h), i))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("key", "ctx")), pa.array(np.full(len(h), size, np.int32)), pa.array((left - np.arange(len(h))).astype(np.int32)), pa.array(h)], names=["key", "ctx", "size", "d", "h"])

    return run


def _union(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges, ascending."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[new].tolist(), hi[np.concatenate([new[1:], [len(lo)]]) - 1].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the ranges listed with each text, and what is left; bytes and number of the repeated passages."""
    # what is kept is gathered for a part of a batch at a time
    for batch in (whole.slice(at, CUT_ROWS) for whole in batches for at in range(0, whole.num_rows, CUT_ROWS)):
        out: list[tuple] = []
        for text, *ranges in zip(*(batch.column(c) for c in ("text", *_RANGES)), strict=True):
            raw = text.as_buffer().to_pybytes()
            lo, hi, plo, phi = (x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in ranges)
            spans, passages = _union(lo, hi), _union(plo, phi)
            at, kept = 0, []
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), sum(b - a for a, b in passages), len(passages), rest, [a for a, _ in spans], [b for _, b in spans]))
        columns = list(zip(*out, strict=True)) or [[]] * 9
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages", "kept", "span_starts", "span_ends"])


def drop_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, group: int = GROUP, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes, n_passages, the kept bytes, and the removed runs, of each row of ``docs``.

    ``passage``, from ``seed`` to ``length``, is the length of the shorter repeats that are counted but not removed (PASSAGE / LENGTH of ``length`` unless given).
    """
    passage = max(seed, length * PASSAGE // LENGTH) if passage is None else passage
    if not 8 <= seed <= passage <= length < 1 << 19:
        raise ValueError("seed, passage and length must ascend from 8")
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64("text").alias("th"), "doc_id", "text")
    # the anchors are found twice, which costs less than to keep or to deal out those with a key of their own
    keys = docs.select("text").mapInArrow(_keys(length, passage, seed), "key long").groupBy("key").agg(F.count("*").alias("all")).where(F.col("all") > 1).select("key")
    # seeds that are frequent in a sample of the texts are known to be shared: their anchors are not dealt by seed
    seen = docs.where(F.pmod("rk", F.lit(HOT_SAMPLE)) == 0).select("text").mapInArrow(_keys(length, passage, seed), "key long").groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {HOT_SEEN}")
    hot = stored(seen.orderBy(F.desc("n"), "key").limit(HOT_SEEDS).select("key", F.lit(True).alias("hot")), "hot-seeds")
    anchors = docs.select("rk", "th", "text").mapInArrow(_anchors(length, passage, seed), _ANCHORS).join(F.broadcast(hot), "key", "left")
    dealt = F.when(F.col("hot"), F.col("rk")).otherwise(F.col("key"))
    anchors = anchors.withColumn("dealt", dealt).join(keys.select(F.col("key").alias("dealt"), F.lit(True).alias("shared")), "dealt", "left").where("hot OR shared")
    anchors = stored(anchors.select("rk", "th", "key", "ctx", "at", "first", "last", "stop"), "anchors")
    classes = anchors.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("rk", "th", "at", "first", "last", "stop")).alias("rep"))
    several = anchors.groupBy("key").agg(F.count_distinct("ctx").alias("m"))
    classes = stored(classes.join(several, "key").where("n > 1 OR m > 1").select("key", "ctx", "n", "m", "rep.*"), "contexts")

    texts = docs.select("rk", "th", "doc_id", F.col("text").cast("binary").alias("text"))
    asked = classes.where("m > 1").groupBy("rk", "th").agg(F.collect_list(F.struct("key", "ctx", "m", "at", "first", "last", "stop")).alias("items"))
    # doc_id goes along unread: both joins of the texts ask for the same columns, so Spark deals the texts out once
    contexts = texts.join(asked, ["rk", "th"]).select("text", "items", "doc_id").mapInArrow(_contexts, "key long, ctx long, m long, left int, windows int, bytes binary")
    lists = ", ".join(f"{c} array<int>" for c in _RANGES)
    found = contexts.where(F.col("m") <= group).repartition("key").sortWithinPartitions("key", "ctx").mapInArrow(_sorted_groups(length, passage, seed), f"key long, ctx long, {lists}")
    if classes.where(F.col("m") > group).limit(1).count():
        windows = contexts.where(F.col("m") > group).mapInArrow(_window_hashes(length, passage), "key long, ctx long, size int, d int, h long")
        twice = windows.groupBy("key", "size", "d", "h").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("a <> b").select("key", "size", "d", "h")
        split = windows.join(twice, ["key", "size", "d", "h"]).groupBy("key", "ctx").agg(*(F.collect_set(F.when(F.col("size") == n, F.col("d"))).alias(c) for n, c in ((length, "ds"), (passage, "ps"))))
        found = found.unionByName(split.selectExpr("key", "ctx", "transform(ds, d -> -d) AS lo", f"transform(ds, d -> {length} - d) AS hi", "transform(ps, d -> -d) AS plo", f"transform(ps, d -> {passage} - d) AS phi"))
    none = "CAST(array() AS ARRAY<INT>)"
    places = [f"transform({c}, x -> x + at) AS {c}" for c in _RANGES]
    parts = anchors.join(found, ["key", "ctx"]).selectExpr("rk", "th", *places)
    whole = anchors.join(classes.where("n > 1").select("key", "ctx"), ["key", "ctx"]).selectExpr("rk", "th", f"IF(stop - first >= {length}, array(first), {none}) AS lo", f"IF(stop - first >= {length}, array(stop), {none}) AS hi", "array(first) AS plo", f"array(last + {passage}) AS phi")
    ranges = parts.unionByName(whole).groupBy("rk", "th").agg(F.collect_set(F.struct(*_RANGES)).alias("x")).selectExpr("rk", "th", *(f"flatten(x.{c}) AS {c}" for c in _RANGES))
    rows = texts.join(ranges, ["rk", "th"], "left").select("doc_id", "text", *_RANGES)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long, kept binary, span_starts array<long>, span_ends array<long>")
