"""Maximal periodic runs of words, found with minimizers on several scales.

A run is a stretch of words with a smallest period q, at least ``COPIES`` times as long (and ``LEAST``
words), that no neighbouring word extends keeping the period.

Periods from w to 2w - 1, for w = ``SHORT``, 2 ``SHORT``, .., are searched with window minima of hashes of 2w words.  Inside
a run of such a period, a window of w hashes is met again one period on, so its minimum is; and as 2w
words hold a whole period, equal hashes inside the run stand whole periods apart.  So two following
occurrences of one minimum, from w to 2w - 1 words apart, are found in each run of four periods, and
nowhere else but by chance or in other repeats: each such pair is a seed, which is extended word by word to both sides.
Seeds grow with the words, not with their pairs.  Periods under ``SHORT`` are scanned lag by lag.

The words of a block of texts are numbered by a dictionary, so equal numbers are equal words, and each
text ends with a number of its own, so no run crosses it.

Defined results: null and wordless texts have no runs and the hash of the empty string; rows with null or
repeated ids are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqspark.llm import bytesops as B

COPIES, LEAST = 4, 6
#: The least period that minimizers search; two words of it and more are scanned directly below.
SHORT = 16
#: Words compared in the first step of an extension.
STEP = 64
COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli")


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values of at least ``least``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    return start[long], end[long]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the first on are equal; compared in growing steps."""
    at, step, n = 0, STEP, min(len(a), len(b))
    while at < n:
        part = a[at : at + step] != b[at : at + step] if at + step <= n else a[at:n] != b[at:n]
        if part.any():
            return at + int(part.argmax())
        at, step = min(at + step, n), 2 * step
    return n


def _smaller_period(block: np.ndarray) -> bool:
    """Whether a block is a repetition of a shorter one: for one of the primes of its length, it has the period length / prime."""
    n, rest, p = len(block), len(block), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            own = n // p
            if np.array_equal(block[own:], block[:-own]):
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def seeds(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(w, places, distances): pairs of following equal minima on each scale whose periods fit ``longest`` words."""
    hashes, size, w = B.mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, SHORT
    while COPIES * w <= longest:
        while size < 2 * w:
            # from hashes of ``size`` words to twice as many
            hashes = B.mix(hashes[:-size] * np.uint64(0xD1342543DE82EF95) + hashes[size:])
            size *= 2
        least = B.sliding_min(hashes, w)
        # a hash is some window's minimum if it equals the greatest of the minima of its windows
        edge = np.zeros(w - 1, dtype=np.uint64)
        most = ~B.sliding_min(~np.concatenate([edge, least, edge]), w)
        chosen = np.flatnonzero(hashes == most)
        chosen = chosen[np.argsort(hashes[chosen], kind="stable")]
        near = np.flatnonzero((hashes[chosen[1:]] == hashes[chosen[:-1]]) & (np.diff(chosen) >= w) & (np.diff(chosen) < 2 * w))
        yield w, chosen[near], chosen[near + 1] - chosen[near]
        w *= 2


def runs(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, length, period) of every run of a sequence of numbers, by start, then period; no run is longer than ``longest``."""
    longest = len(words) if longest is None else longest
    found: list[tuple[int, int, int]] = []

    def add(start: int, end: int, period: int) -> None:
        if not _smaller_period(words[start : start + period]):
            found.append((start, end - start, period))

    for lag in range(1, min(SHORT, longest // COPIES + 1)):
        for start, end in zip(*(x.tolist() for x in _stretches(words[lag:] == words[:-lag], max(LEAST, COPIES * lag) - lag)), strict=True):
            add(start, end + lag, lag)
    for _, places, distances in seeds(words, longest):
        order = np.lexsort((places, distances))
        lag, covered = 0, 0
        for place, distance in zip(places[order].tolist(), distances[order].tolist(), strict=True):
            if distance == lag and place < covered:
                continue
            ahead = _reach(words[place:], words[place + distance :])
            behind = _reach(words[:place][::-1], words[distance : place + distance][::-1])
            start, end = place - behind, place + ahead + distance
            lag, covered = distance, place + ahead
            if end - start >= COPIES * distance:
                add(start, end, distance)
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)


def _strongest(own: np.ndarray) -> tuple[int, int, int]:
    """The run of the greatest length / period, exactly; then smallest start, then period."""
    return min((tuple(r) for r in own.tolist()), key=cmp_to_key(lambda x, y: y[1] * x[2] - x[1] * y[2] or (x[0], x[2]) > (y[0], y[2]) or -1))


def _block(texts: list[bytes]) -> Iterator[tuple]:
    """For each text: the strongest run's numbers, both hashes, and the text without repeated periods."""
    words = [t.split() for t in texts]
    size = np.array([len(own) for own in words], dtype=np.int64)
    first: dict[bytes, int] = {}
    codes = np.empty(int(size.sum()) + len(texts), dtype=np.int64)
    stop = np.cumsum(size + 1)
    at = 0
    for i, own in enumerate(words):
        codes[at : at + len(own)] = np.fromiter(map(first.setdefault, own, range(at, at + len(own))), np.int64, len(own))
        codes[at + len(own)] = -1 - i
        at += len(own) + 1
    every = runs(codes, int(size.max(initial=0)))
    bounds = np.searchsorted(every[:, 0], np.concatenate([[0], stop]))
    for i, own in enumerate(words):
        mine = every[bounds[i] : bounds[i + 1]] - np.array([stop[i] - len(own) - 1, 0, 0])
        kept = own
        best: tuple = (None,) * 4
        if len(mine):
            edge = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
            np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
            kept = [w for w, d in zip(own, np.cumsum(edge[:-1]).tolist(), strict=True) if not d]
            start, length, period = _strongest(mine)
            best = (start, length, period, 1000 * length // period)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in mine.tolist())
        text = b" ".join(kept)
        yield (len(mine), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text.decode())


def _found(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.blocks(batch.column(1)):
                raw = data.tobytes()
                columns = list(zip(*_block([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]), strict=True))
                arrays = [*(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5 : 8 if with_text else 7])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *arrays], names=["doc_id", *COLUMNS, "runs_sha256", "collapsed_sha256", *(["text"] if with_text else [])])

    return run


def find_runs(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256; ``with_text`` adds the collapsed text."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COLUMNS)}, runs_sha256 string, collapsed_sha256 string" + (", text string" if with_text else "")
    return rows.mapInArrow(_found(with_text), schema)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text: the words of each text joined by single spaces, without those that a run repeats after its first period."""
    return find_runs(docs, with_text=True).select("doc_id", "text")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in the text of each tenth document (by the CRC-32 of its decimal id): the test case of the ``op12_periodic`` query."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.withColumn("_g", F.floor(h / 10)).withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    # a generator is a border: the words are not taken anew for each use
    words = words.withColumn("_w", F.explode(F.array("_w"))).withColumn("_n", F.size("_w").cast("long"))
    a = F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))
    words = words.withColumn("_a", F.explode(F.array(a)))
    p = 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))
    turned = F.transform("_w", lambda x, i: F.when(i < F.col("_a"), x).otherwise(F.get("_w", (F.col("_a") + (i - F.col("_a")) % p).cast("int"))))
    return words.withColumn("text", F.when(F.col("_n") > 0, F.array_join(turned, " ")).otherwise(F.col("text"))).select(docs.columns)
