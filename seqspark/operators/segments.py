"""Windows and segmentation over ordered points, bases and chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqspark.functions.sequence import as_column, let, partition_bounds
from seqspark.operators.ranks import numbered


def runs(path: DataFrame, key: str = "read_id", order: str = "pos", state: str = "state", *more: Column) -> DataFrame:
    """key, state, start, end, length: consecutive equal states as one row; ``end`` is the last place.  ``more`` are aggregates of each run."""
    by = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(state).over(by).eqNullSafe(F.col(state)) & F.lag(order).over(by).isNotNull(), 0).otherwise(1)
    numbered = path.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_run", state).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"), *more).drop("_run")


def base_positions(frames: DataFrame, stride: int, key: str = "read_id", order: str = "t", move: str = "move") -> DataFrame:
    """key, pos, base_index: each frame's base, repeated ``stride`` times; frames before the first move are left out."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = frames.select(key, order, (F.sum(move).over(by) - 1).alias("base_index")).where("base_index >= 0")
    return own.select(key, F.explode(F.sequence(F.col(order) * stride, F.col(order) * stride + (stride - 1))).alias("pos"), "base_index")


def signal_extent(moves: DataFrame, lengths: DataFrame, stride: int, key: str = "read_id", order: str = "t", move: str = "move") -> DataFrame:
    """key, base_index, sig_start, sig_end: each base's part of the signal.

    ``lengths(key, sig_len, trim, is_reverse, n_frames)``.  On reversed reads places count from the signal's
    end and bases from the last.
    """
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = moves.select(key, order, (F.sum(move).over(by) - 1).alias("base_index")).where("base_index >= 0")
    bases = own.groupBy(key, "base_index").agg(F.min(order).alias("a"), (F.max(order) + 1).alias("b")).join(lengths, key)
    bases = bases.withColumn("s", F.col("a") * stride + F.col("trim")).withColumn("e", F.col("b") * stride + F.col("trim"))
    last = F.max("base_index").over(Window.partitionBy(key))
    rev = F.col("is_reverse")
    return bases.select(key, F.when(rev, last - F.col("base_index")).otherwise(F.col("base_index")).alias("base_index"), F.when(rev, F.col("sig_len") - F.col("e")).otherwise(F.col("s")).alias("sig_start"), F.when(rev, F.col("sig_len") - F.col("s")).otherwise(F.col("e")).alias("sig_end"))


def chunk_fixed(values: Column | str, length: int, pad: Column | float | int = 0.0) -> Column:
    """array<struct<chunk_no, values, duration>>: cuts of ``length``; the last is padded and keeps its true length."""
    filler = pad if isinstance(pad, Column) else F.lit(pad)

    def padded(part: Column, i: Column) -> Column:
        return F.struct(i.alias("chunk_no"), F.concat(part, F.array_repeat(filler, length - F.size(part))).alias("values"), F.size(part).alias("duration"))

    def cuts(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / length), F.lit(0)).cast("int")), lambda i: i * length < F.size(v))
        return F.transform(starts, lambda i: let(F.slice(v, i * length + 1, F.lit(length)), lambda part: padded(part, i)))

    return let(as_column(values), cuts)


def chunk_overlap(values: Column | str, length: int, overlay: int) -> Column:
    """array<struct<chunk_no, values, duration>>: cuts of ``length`` that step by length - overlay up to n - overlay; one cut if n is at most the overlay."""
    step = length - overlay

    def cuts(v: Column) -> Column:
        n = F.size(v)
        starts = F.when(n <= overlay, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0)), F.lit(step)), lambda s: s < n - overlay))
        own = lambda part, i: F.struct(i.alias("chunk_no"), part.alias("values"), F.size(part).alias("duration"))
        return F.transform(starts, lambda s, i: let(F.slice(v, s + 1, F.lit(length)), lambda part: own(part, i)))

    return let(as_column(values), cuts)


def label_chunks(chunks: DataFrame, bases: DataFrame, min_quality: float, max_gap: int, tail_at: Column | None = None, key: str = "read_id") -> DataFrame:
    """key, chunk_no, label of each chunk.

    ``chunks(key, chunk_no, first_base, last_base, longest_base)``, ``bases(key, ord, base_index, base, quality)``.
    The bases whose index falls into the chunk's range, in order; Y past the tail, X for low mean quality, P when one
    base lasts over ``max_gap`` points, empty when no base falls in.
    """
    inside = (F.col("base_index") >= F.col("first_base")) & (F.col("base_index") <= F.col("last_base"))
    held = chunks.join(bases, key).where(inside).groupBy(key, "chunk_no").agg(F.avg("quality").alias("q"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "base"))), lambda x: x["base"]), "").alias("bases"))
    rows = chunks.join(held, [key, "chunk_no"], "left")
    label = F.when(F.lit(False) if tail_at is None else tail_at, "Y").when(F.col("q").isNull(), "").when(F.col("q") <= min_quality, "X").when(F.col("longest_base") > max_gap, "P").otherwise(F.col("bases"))
    return rows.select(key, "chunk_no", label.alias("label"))


def exon_offsets(exons: DataFrame, tx: str = "tx_id", order: str = "ord", start: str = "g_start", end: str = "g_end") -> DataFrame:
    """``exons`` with tx_start and tx_end: 0-based places in the transcript, in file order, both ends included."""
    by = Window.partitionBy(tx).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    length = F.col(end) - F.col(start) + 1
    before = F.coalesce(F.sum(length).over(by), F.lit(0))
    return exons.withColumn("tx_start", before).withColumn("tx_end", F.col("tx_start") + length - 1)


def tx_ranges(exons: DataFrame, known: DataFrame | None = None, tx: str = "tx_id") -> DataFrame:
    """The transcript map as ranges, one row for each exon; with ``known(tx)``, transcripts outside it are left out."""
    out = exon_offsets(exons, tx)
    return out if known is None else out.join(known.select(tx).distinct(), tx, "left_semi")


def build_tx_map(exons: DataFrame, known: DataFrame | None = None, tx: str = "tx_id", strand: str = "strand", start: str = "g_start", end: str = "g_end") -> DataFrame:
    """tx, tx_pos, g_pos (and the exons' other columns): each genomic place of each exon."""
    rows = tx_ranges(exons, known, tx).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col(end) - F.col(start))))
    return rows.withColumn("g_pos", F.col(start) + F.col("d")).withColumn("tx_pos", F.when(F.col(strand) == "+", F.col("tx_start") + F.col("d")).otherwise(F.col("tx_end") - F.col("d"))).drop("d")


def balance_by_reference(records: DataFrame, reference: DataFrame, size: int, k: float, key: str = "read_id", ref: str = "contig", start: str = "r_start", end: str = "r_end") -> DataFrame:
    """Records from a reference whose coverage is evened out.

    The reference (ref, length) is cut into bins; a bin takes at most mean + k * max(std, 1) of the bins' counts, in the
    order of the keys, and a record stays if all the bins it touches take it.  A record's place in its bin comes from ranges of bins and keys, so
    a bin that holds most of the records is many tasks.
    """
    bins = reference.select(ref, F.posexplode(partition_bounds("length", size)).alias("bin", "bin_end"))
    bins = bins.withColumn("bin_start", F.coalesce(F.lag("bin_end").over(Window.partitionBy(ref).orderBy("bin")), F.lit(0)))
    # a record's bins follow from its places; the last bin may be longer
    last = bins.groupBy(ref).agg(F.max("bin").alias("last_bin"))
    lo, hi = (F.least(F.floor(c / size), F.col("last_bin").cast("long")) for c in (F.col(start), F.col(end) - 1))
    own = records.join(last, ref).withColumn("bin", F.explode(F.sequence(lo, F.greatest(lo, hi)))).withColumn("bin", F.col("bin").cast("int"))
    counts = bins.select(ref, "bin").join(own.groupBy(ref, "bin").agg(F.count("*").alias("n")), [ref, "bin"], "left").na.fill(0, ["n"])
    # rounded, so that the order of summation does not decide at a whole number
    cap = counts.agg(F.round(F.avg("n") + k * F.greatest(F.stddev_pop("n"), F.lit(1.0)), 9).alias("cap"))
    ranked = numbered(own.select(key, ref, "bin"), key, (ref, "bin"), "rank")
    kept = ranked.withColumn("ok", F.col("rank") <= cap.scalar()).groupBy(key).agg(F.bool_and("ok").alias("ok")).where("ok").select(key)
    return records.join(kept, key, "left_semi")


def batch_number(df: DataFrame, order: str, size: int = 4000) -> DataFrame:
    """``df`` with batch: rows in the order of ``order``, ``size`` to a batch.

    Rows are ranged over partitions first, so no task sees all rows.
    """
    return numbered(df, order).withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def last_at(df: DataFrame, value: Column, upto: Column, at: Column, key: str, falling: bool = False) -> DataFrame:
    """``df`` with _found: the ``value`` of the last row of the same key, by ``at``, whose ``at`` is at most ``upto``; or of the first whose ``at`` is at least ``upto`` if ``falling``.

    Values and questions are rows of one order, so a read costs a sort and one pass.  Rows whose value is null are no answers; of several at one
    place, the greatest value is the last (``falling``: the least the first).
    """
    both = F.array(F.struct(at.alias("place"), F.lit(0).alias("asks"), value.alias("value")), F.struct(upto.alias("place"), F.lit(1).alias("asks"), F.lit(None).alias("value")))
    rows = df.withColumn("_x", F.explode(both))
    turn = F.desc if falling else F.asc
    by = Window.partitionBy(key).orderBy(turn("_x.place"), "_x.asks", turn("_x.value")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_found", F.last("_x.value", ignorenulls=True).over(by)).where("_x.asks = 1").drop("_x")


def _visited():
    """Places that a walk over each row's pointers meets, from its first; a pointer is a later place, and ends the walk behind the last."""

    @F.pandas_udf("array<int>")
    def walk(pointers: pd.Series) -> pd.Series:
        def places(own: np.ndarray) -> list[int]:
            steps, at, out = own.tolist(), 0, []
            while at < len(steps):
                out.append(at)
                at = steps[at]
            return out

        return pointers.map(places)

    return walk


def chain(df: DataFrame, order: str, pointer: str, key: str = "read_id") -> DataFrame:
    """The rows that a walk meets which starts at each key's first row and goes on from row to row by ``pointer``.

    ``order`` numbers a key's rows from 0; ``pointer`` is a later number, or null at the end.  Of each key one array of numbers goes through the
    walk, in Arrow batches; its time is that of the steps.
    """
    steps = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(pointer, F.lit(2**31 - 1)).cast("int").alias("p")))), lambda x: x["p"]).alias("steps"))
    met = steps.select(key, F.explode(_visited()("steps")).alias("_met")).select(key, F.col("_met").cast("long").alias(order))
    return df.join(met, [key, order], "left_semi")


def invariant_segments(path: DataFrame, invariant: Callable[[Column], Column], min_len: int = 500, key: str = "read_id", order: str = "pos", state: str = "state") -> DataFrame:
    """key, start, end, first, last: spans between runs of invariant states, at least ``min_len`` points long.

    A span runs from one invariant run to the first later one that makes it long enough; ends are exclusive, and the states
    at both ends are recorded.  Each run knows the first that is far enough; the greedy walk follows these pointers.
    """
    cuts = runs(path, key, order, state).where(invariant(F.col(state))).select(key, F.col("start").cast("long").alias("start"), F.col(state).cast("string").alias("first"))
    cuts = cuts.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("start")).cast("long") - 1)
    to = last_at(cuts, F.struct("n", F.col("start").alias("end"), F.col("first").alias("last")), F.col("start") + max(min_len, 1), F.col("start"), key, falling=True)
    spans = chain(to.withColumn("next", F.col("_found.n")), "n", "next", key)
    return spans.where("_found IS NOT NULL").select(key, "start", "_found.end", "first", "_found.last")


def stick(calls: DataFrame, key: str = "read_id", order: str = "chunk_no", seq: str = "seq") -> DataFrame:
    """``calls`` with offset: each call begins where those before end."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("offset", F.coalesce(F.sum(F.length(seq)).over(by), F.lit(0)).cast("long"))


def glue_overlap(before: Column | str, after: Column | str) -> Column:
    """The overlap i that maximises 2 * matches - i, for 1 <= i < min(floor(len(before) / 10), len(after)); 0 if none gains; the least on ties."""
    before, after = as_column(before), as_column(after)
    limit = F.least(F.floor(F.length(before) * 0.1), F.length(after)).cast("int")

    def gain(i: Column) -> Column:
        tail, head = F.split(F.right(before, i), ""), F.split(F.left(after, i), "")
        same = F.aggregate(F.zip_with(tail, head, lambda a, b: ((a == b) & (a != "")).cast("int")), F.lit(0), lambda s, x: s + x)
        return F.struct((2 * same - i).alias("gain"), (-i).alias("less"))

    best = F.array_max(F.transform(F.when(limit > 1, F.sequence(F.lit(1), limit - 1)).otherwise(F.array().cast("array<int>")), gain))
    return F.when(best["gain"] > 0, -best["less"]).otherwise(F.lit(0))


def glue(calls: DataFrame, key: str = "read_id", order: str = "chunk_no", seq: str = "seq") -> DataFrame:
    """``calls`` with offset: each call overlaps the one before where their ends match best."""
    by = Window.partitionBy(key).orderBy(order)
    step = F.length(F.lag(seq).over(by)) - glue_overlap(F.col("_before"), F.col(seq))
    rows = calls.withColumn("_before", F.lag(seq).over(by)).withColumn("_step", F.coalesce(step, F.lit(0)))
    return rows.withColumn("offset", F.sum("_step").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_before", "_step")


#: Kernels by name; users may add their own.
STITCH: dict[str, Callable[[DataFrame], DataFrame]] = {"stick": stick, "glue": glue}


def stitch(calls: DataFrame, kernel: str = "stick") -> DataFrame:
    if kernel not in STITCH:
        raise ValueError(f"no stitching kernel {kernel!r}; there are {sorted(STITCH)}")
    return STITCH[kernel](calls)


def distill(bases: DataFrame, chunk_len: int, keep: Callable[[Column, Column], Column] | None = None, skip: int = 5, key: str = "read_id") -> DataFrame:
    """key, first_base, last_base, ref_start, ref_end, sig_start, sig_end, seq: training records of each read.

    ``bases(key, base_index, base, sig_start, sig_end, ref_pos)``.  From each base the walk takes the longest run of bases
    whose signal ends within ``chunk_len`` and both ends of which are mapped, and goes on behind it; where nothing fits, or
    ``keep(bases, points)`` of the numbers of its bases and signal points turns the record down, it moves on by ``skip`` bases.

    Each base's record is found by order of the signal, for all bases alike; the walk follows pointers.
    """
    keep = keep or (lambda n_bases, n_points: n_bases >= 3)
    own = bases.select(key, "base_index", "base", "sig_start", "sig_end", "ref_pos").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("base_index")).cast("long") - 1)
    end = F.when(F.col("ref_pos").isNotNull(), F.struct("n", F.col("base_index").alias("last_base"), F.col("ref_pos").alias("ref_end"), F.col("sig_end").alias("end")))
    rows = last_at(own, end, F.col("sig_start") + chunk_len, F.col("sig_end"), key)
    good = F.col("ref_pos").isNotNull() & (F.col("_found.n") > F.col("n")) & keep(F.col("_found.n") - F.col("n") + 1, F.col("_found.end") - F.col("sig_start"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("next", F.when(F.col("good"), F.col("_found.n") + 1).otherwise(F.col("n") + skip))
    records = chain(rows, "n", "next", key).where("good").select(key, F.col("n").alias("_lo"), F.col("_found.n").alias("_hi"), F.col("base_index").alias("first_base"), "_found.last_base", F.col("ref_pos").alias("ref_start"), "_found.ref_end", "sig_start", F.col("_found.end").alias("sig_end"))
    # records do not overlap: each base belongs to the last that begins at or before it
    spans = records.select(key, "_lo", "_hi", F.lit(None).cast("string").alias("base"), F.col("_lo").alias("n"), F.lit(0).alias("kind"))
    spans = spans.unionByName(own.select(key, F.lit(None).cast("long").alias("_lo"), F.lit(None).cast("long").alias("_hi"), "base", "n", F.lit(1).alias("kind")))
    by = Window.partitionBy(key).orderBy("n", "kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = spans.withColumn("_x", F.last(F.when(F.col("kind") == 0, F.struct("_lo", "_hi")), ignorenulls=True).over(by)).where("kind = 1 AND n <= _x._hi")
    seqs = inside.groupBy(key, F.col("_x._lo").alias("_lo")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "base"))), lambda x: x["base"]), "").alias("seq"))
    return records.join(seqs, [key, "_lo"]).select(key, *(F.col(c).cast("long").alias(c) for c in ("first_base", "last_base", "ref_start", "ref_end", "sig_start", "sig_end")), "seq")
