"""Quality rules: base statistics of every whole text, and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word unigrams and bigrams and hashed
character n-grams.  It is trained on a bounded sample of the labelled rows
(``sample_rows``) in one task, calibrated on a held-out part of that sample, and applied to all rows
in Arrow batches against a fixed threshold.  A second one rejects toxic texts: a sparse
logistic regression over which words a text holds (a few words make a text toxic, however
long it is), trained on the column ``toxic`` of the same sample and calibrated with both
classes of equal weight.

Defined results: a null text is the empty text (no words, base_failed); without labelled rows
of both kinds there is no classifier and the base rules alone decide; of a labelled id that repeats in
the documents, the smallest text is trained on, those of over ``SAMPLE_TEXT`` bytes aside; repeated rows are scored each; columns of the input other than the id and the text pass
through in ``keep_quality``, whatever their names.  A very long text is a block of its own; its memory follows its words, not its characters.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from seqspark.llm import bytesops as B

BUCKETS = 1 << 16
CHAR_N = (3, 5)
SAMPLE_ROWS = 2048
SAMPLE_BYTES = 16 << 20
#: The sample leaves out texts of more bytes than this, so that no text takes the place of others: 64 rows fit at least.
SAMPLE_TEXT = SAMPLE_BYTES >> 6
#: Bytes of a text that one step of the character n-grams looks at.
SLICE = 1 << 18
THRESHOLD = 0.5
WINDOW = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


# bytes of words without case: ASCII punctuation parts words
_BARE = np.arange(256, dtype=np.uint8)
_BARE[[i for i in range(128) if not chr(i).isalnum()]] = 32
_BARE[65:91] += 32


@dataclass(frozen=True)
class ToxicModel:
    """Weights by word bucket, and slope and intercept of the calibrated logit."""

    weights: np.ndarray
    slope: float
    intercept: float

    def toxic(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        owner, bucket = _held_words(data, offsets)
        raw = np.bincount(owner, self.weights[bucket], minlength=len(offsets) - 1)
        return self.slope * raw + self.intercept >= 0


@dataclass(frozen=True)
class QualityModel:
    """Weights by bucket, slope and intercept of the calibrated logit, and what rejects toxic texts."""

    weights: np.ndarray
    slope: float
    intercept: float
    toxic: ToxicModel | None = None

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.intercept, -30, 30)))


def _features(data: np.ndarray, offsets: np.ndarray, words: tuple) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the kind, and text and bucket of each occurrence, for each kind of n-gram; character n-grams in slices."""
    lone, first = words[2], words[3]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    yield 0, owner, (lone >> np.uint64(48)).astype(np.int32)
    if len(lone) > 1:
        # no pair crosses a text's border
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        yield 1, owner[inside], (B.sequence_hashes(lone, 2)[inside] >> np.uint64(48)).astype(np.int32)
    for kind, n in enumerate(CHAR_N, 2):
        for lo in range(0, len(data) - n + 1, SLICE):
            part = data[lo : lo + SLICE + n - 1].astype(np.uint64)
            gram = np.zeros(len(part) - n + 1, dtype=np.uint64)
            for j in range(n):
                gram = (gram << np.uint64(8)) | part[j : j + len(gram)]
            at = np.arange(lo, lo + len(gram))
            own = np.searchsorted(offsets, at, side="right") - 1
            kept = np.flatnonzero(at + n <= offsets[own + 1])
            yield kind, own[kept], (B.mix(gram[kept] + np.uint64(n << 56)) >> np.uint64(48)).astype(np.int32)


_KINDS = 2 + len(CHAR_N)


def _held_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each distinct word bucket of each text."""
    data = _BARE[data]
    start, end, first = B.words(data, offsets)
    bucket = (B.span_hashes(data, start, end) >> np.uint64(48)).astype(np.int64)
    held = np.unique(np.repeat(np.arange(len(offsets) - 1), np.diff(first)) * BUCKETS + bucket)
    return held // BUCKETS, held % BUCKETS


def _raw_scores(weights: np.ndarray, data, offsets, words) -> np.ndarray:
    """Mean weight of each kind of n-gram, added over the kinds."""
    texts = len(offsets) - 1
    total, count = np.zeros((_KINDS, texts)), np.zeros((_KINDS, texts))
    for kind, owner, bucket in _features(data, offsets, words):
        total[kind] += np.bincount(owner, weights[bucket], minlength=texts)
        count[kind] += np.bincount(owner, minlength=texts)
    return (total / np.maximum(count, 1)).sum(axis=0)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of small values between consecutive bounds; empty segments give 0."""
    out = np.zeros(len(bounds) - 1, dtype=np.int64)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        out[filled] = np.add.reduceat(values.view(np.int8) if values.dtype == bool else values, bounds[filled], dtype=np.int64)
    return out


def _twice(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes another of the same text equals, and which are not the first such; owners ascend."""
    order = np.lexsort((np.arange(len(hashes)), hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice, again = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again


def _base(data: np.ndarray, offsets: np.ndarray, words: tuple) -> dict[str, np.ndarray]:
    start, end, lone, first = words
    texts = len(offsets) - 1
    # code points: bytes that do not continue one
    inside = (data & 0xC0) != 0x80
    inside &= ~B.SPACE[data]
    word_chars = _sums(inside, offsets)
    symbols = _sums(_SYMBOL[data], offsets)
    # lines: between texts' borders and newlines
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_text = np.concatenate([np.arange(texts), np.searchsorted(offsets, breaks, side="right") - 1])
    # a newline that ends a text opens its last line at the next text's start: texts decide first
    order = np.lexsort((line_start, line_text))
    line_start, line_text = line_start[order], line_text[order]
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:] - 1
    line_end[-1:] = offsets[-1]
    last = np.ones(len(line_start), dtype=bool)
    last[:-1] = line_text[1:] != line_text[:-1]
    line_end[last] = offsets[line_text[last] + 1]
    filled = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_text = line_start[filled], line_end[filled], line_text[filled]
    again = _twice(line_text, B.span_hashes(data, line_start, line_end))[1]
    n_dup = np.bincount(line_text[again], minlength=texts)
    # windows of words
    repeated = np.zeros(len(start), dtype=bool)
    if len(start) >= WINDOW:
        h = B.sequence_hashes(lone, WINDOW)
        at = np.arange(len(h))
        owner = np.searchsorted(first, at, side="right") - 1
        own = np.flatnonzero(at + WINDOW <= first[owner + 1])
        at = own[_twice(owner[own], h[own])[0]]
        edge = np.zeros(len(start) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        repeated = np.cumsum(edge)[:-1] > 0
    return {"n_words": np.diff(first), "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": n_dup, "n_repeat_words": _sums(repeated, first)}


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes of the words, and the first word of each text."""
    start, end, first = B.words(data, offsets)
    return start, end, B.span_hashes(data, start, end), first


def _judged(model: QualityModel | None, threshold: float, column: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(first row, last row + 1, columns of ``_SCORES``) for each block of a column of texts."""
    for lo, hi, data, offsets in B.blocks(column):
        words = _words(data, offsets)
        out = _base(data, offsets, words)
        out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
        out["quality_score"] = np.ones(hi - lo) if model is None else model.probability(_raw_scores(model.weights, data, offsets, words))
        out["kept"] = ~out["base_failed"] & (out["quality_score"] >= threshold)
        if model is not None and model.toxic is not None:
            out["kept"] &= ~model.toxic.toxic(data, offsets)
        yield lo, hi, out


def _score_batches(model: QualityModel | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, scores in _judged(model, threshold, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(v) for v in scores.values())], names=["doc_id", *scores])

    return run


def _kept_batches(model: QualityModel | None, threshold: float, text: int):
    """The rows that pass, unchanged: a text crosses to Python once, and only kept ones come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [scores["kept"] for _, _, scores in _judged(model, threshold, batch.column(text))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return run


_SCORES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, label and toxic, the text's buckets with their mean counts, one value list per text, and its word buckets."""
    for batch in batches:
        for lo, hi, data, offsets in B.blocks(batch.column("text")):
            texts = hi - lo
            key, share = [np.zeros(0, np.int64)], [np.zeros(0)]
            found: list[list[np.ndarray]] = [[] for _ in range(_KINDS)]
            for kind, owner, bucket in _features(data, offsets, _words(data, offsets)):
                found[kind].append(owner * BUCKETS + bucket)
            for parts in found:
                own, n = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]), return_counts=True)
                total = np.bincount(own // BUCKETS, n, minlength=texts)
                key.append(own)
                share.append(n / np.maximum(total, 1)[own // BUCKETS])
            own, at = np.unique(np.concatenate(key), return_inverse=True)
            value = np.bincount(at, np.concatenate(share), minlength=len(own))
            bounds = pa.array(np.searchsorted(own // BUCKETS, np.arange(texts + 1)).astype(np.int32))
            owner, held = _held_words(data, offsets)
            words = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(texts + 1)).astype(np.int32)), pa.array(held.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, texts) for c in ("h", "label", "toxic")), pa.ListArray.from_arrays(bounds, pa.array((own % BUCKETS).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(value.astype(np.float32))), words],
                names=["h", "label", "toxic", "buckets", "shares", "words"],
            )


def _held_out(h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Every fifth row of each class in the order of ``h``, the hash of the id; none if a class would be left without rows on a side."""
    held = np.zeros(len(y), dtype=bool)
    for kind in (0, 1):
        own = np.flatnonzero(y == kind)
        if len(own) >= 10:
            held[own[np.argsort(h[own], kind="stable")][::5]] = True
    return held if (held & (y == 1)).any() and (held & (y == 0)).any() else np.zeros(len(y), dtype=bool)


def _train_toxic(rows: pa.Table, epochs: int = 200, sparse: float = 0.002) -> ToxicModel | None:
    """Fit on the sample's words and ``toxic``; a fifth of each class is held out and calibrates.  Null without rows of both classes."""
    rows = rows.filter(pc.is_valid(rows.column("toxic")))
    y = (rows.column("toxic").to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    words = rows.column("words").combine_chunks()
    lengths, bucket = np.diff(words.offsets.to_numpy()), words.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), lengths)
    held = _held_out(rows.column("h").to_numpy(), y)
    weight = np.where(y == 1, 0.5 / (y[~held] == 1).sum(), 0.5 / (y[~held] == 0).sum())
    weight[held] = 0
    w, bias, grad2 = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8)
    for _ in range(epochs):
        logit = np.bincount(row, w[bucket], minlength=len(y)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        gradient = np.bincount(bucket, error[row], minlength=BUCKETS)
        grad2 += gradient**2
        step = 0.1 / np.sqrt(grad2)
        w -= step * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)  # most words say nothing
        bias -= 0.5 * error.sum()
    raw = np.bincount(row, w[bucket], minlength=len(y))
    use = held if held.any() else ~held
    x, target = raw[use], y[use]
    share = np.where(target == 1, 0.5 / (target == 1).sum(), 0.5 / (target == 0).sum())
    centre, scale = x.mean(), x.std() or 1.0
    z, a, b = (x - centre) / scale, 1.0, 0.0
    for _ in range(500):
        error = share * (1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - target)
        a -= 0.5 * (error * z).sum()
        b -= 0.5 * error.sum()
    return ToxicModel(w.astype(np.float32), a / scale, b - a * centre / scale)


def _fit(rows: pa.Table, epochs: int, rate: float) -> QualityModel | None:
    """The models of a table of ``_bucket_batches``."""
    rejects = _train_toxic(rows)
    rows = rows.filter(pc.is_valid(rows.column("label")))
    label = rows.column("label").to_numpy().astype(float)
    if not len(label) or label.min() == label.max():
        return None if rejects is None else QualityModel(np.zeros(BUCKETS, np.float32), 0.0, 30.0, rejects)
    held = _held_out(rows.column("h").to_numpy(), label)
    # features row after row, as small as they go: the driver holds nothing larger
    lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in rows.column("buckets").chunks])
    bucket = np.concatenate([c.flatten().to_numpy().astype(np.uint16) for c in rows.column("buckets").chunks])
    share = np.concatenate([c.flatten().to_numpy() for c in rows.column("shares").chunks])
    del rows
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    step = max(1, int(len(label) * (1 << 18) / max(1, len(bucket))))
    steps = [(np.arange(lo, min(lo + step, len(label))), slice(bounds[lo], bounds[min(lo + step, len(label))])) for lo in range(0, len(label), step)]

    def scores(w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(label))
        for own, p in steps:
            out[own] = np.bincount(np.repeat(np.arange(len(own)), lengths[own]), w[bucket[p]] * share[p], minlength=len(own))
        return out

    weight = np.where(label == 1, 0.5 / max(1, (label[~held] == 1).sum()), 0.5 / max(1, (label[~held] == 0).sum()))
    weight[held] = 0
    w, bias, grad2 = np.zeros(BUCKETS, np.float32), 0.0, np.full(BUCKETS, 1e-8)
    for _ in range(epochs):
        logit = scores(w) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
        gradient = sum((np.bincount(bucket[p], np.repeat(error[own], lengths[own]) * share[p], minlength=BUCKETS) for own, p in steps), np.zeros(BUCKETS))
        grad2 += gradient**2
        w -= (rate * 0.05 * gradient / np.sqrt(grad2)).astype(np.float32)
        bias -= 0.5 * error.sum()
    raw = scores(w)
    use = held if held.any() else ~held
    x, y = raw[use], label[use]
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    centre, scale = x.mean(), x.std() or 1.0
    z, a, b = (x - centre) / scale, 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a -= 0.5 * ((p - target) * z).mean()
        b -= 0.5 * (p - target).mean()
    return QualityModel(w.astype(np.float32), a / scale, b - a * centre / scale, rejects)


def _fit_batches(epochs: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(_bucket_batches(batches))
        model = _fit(pa.Table.from_batches(found), epochs, rate) if found else None
        if model is not None:
            toxic = model.toxic
            row = {"weights": model.weights.tobytes(), "slope": model.slope, "intercept": model.intercept}
            row |= {"toxic": toxic and toxic.weights.tobytes(), "toxic_slope": toxic and toxic.slope, "toxic_intercept": toxic and toxic.intercept}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.binary() if k in ("weights", "toxic") else pa.float64()) for k in row]))

    return run


def train_quality_model(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, epochs: int = 60, rate: float = 20.0, sample_text: int = SAMPLE_TEXT) -> QualityModel | None:
    """Fit on at most ``sample_rows`` labelled rows, those with the smallest hash of doc_id, while their texts hold at most ``sample_bytes``.

    Texts of over ``sample_text`` bytes are not trained on (they are scored like any other), and take no room from the rows behind them.
    Every fifth row of a class is held out and calibrates the logit (Platt's scaling).
    Null, with a warning, without rows of both classes.
    """
    toxic = F.col("toxic").cast("int") if "toxic" in labels.columns else F.lit(None).cast("int")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label"), toxic.alias("toxic")).where("doc_id IS NOT NULL AND (label IS NOT NULL OR toxic IS NOT NULL)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("toxic").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_text).groupBy("doc_id", "h", "label", "toxic").agg(F.min("text").alias("text"))
    # at most ``sample_rows`` rows stand in this window, whose order is also that of all sums below
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(Window.orderBy("h", "doc_id"))).where(F.col("bytes") <= sample_bytes)
    # the window leaves the sample in one task, which fits; the driver receives weights alone
    fitted = rows.select("h", "label", "toxic", "text").mapInArrow(_fit_batches(epochs, rate), "weights binary, slope double, intercept double, toxic binary, toxic_slope double, toxic_intercept double").collect()
    if not fitted:
        warnings.warn("no labelled rows of both classes: base rules alone decide", stacklevel=2)
        return None
    own = fitted[0]
    rejects = None if own.toxic is None else ToxicModel(np.frombuffer(own.toxic, np.float32), own.toxic_slope, own.toxic_intercept)
    return QualityModel(np.frombuffer(own.weights, np.float32), own.slope, own.intercept, rejects)


def score_quality(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the five base statistics, base_failed, quality_score and kept of every row of ``docs``; other columns are ignored."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score_batches(model, threshold), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SCORES}")


def keep_quality(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; ``text`` is a string."""
    return docs.mapInArrow(_kept_batches(model, threshold, docs.columns.index("text")), docs.schema)
