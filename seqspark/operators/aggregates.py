"""Aggregations over reads, sites, k-mers, calls and scores."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqspark.functions.distance import edit_distance
from seqspark.functions.sequence import as_column, cigar_ops, kmers, letters
from seqspark.operators.segments import runs
from seqspark.shared import stored

NAN = float("nan")
#: Training steps that are smoothed in one row.
BLOCK_STEPS = 4096


def count_letter(seq: Column | str, letter: str) -> Column:
    seq = as_column(seq)
    return F.length(seq) - F.length(F.translate(seq, letter, ""))


def m6a_ratio(reads: DataFrame, seq: str = "seq", key: str = "read_id", per_read: bool = False) -> DataFrame:
    """n_m, n_am and ratio of M among A and M, pooled or for each read; NaN without A or M."""
    n_m, n_am = count_letter(seq, "M"), count_letter(seq, "AM")
    ratio = F.when(F.col("n_am") > 0, F.col("n_m") / F.col("n_am")).otherwise(F.lit(NAN)).alias("ratio")
    if per_read:
        return reads.select(key, n_m.alias("n_m"), n_am.alias("n_am")).select(key, "n_m", "n_am", ratio)
    return reads.agg(F.coalesce(F.sum(n_m), F.lit(0)).alias("n_m"), F.coalesce(F.sum(n_am), F.lit(0)).alias("n_am")).select("n_m", "n_am", ratio)


def site_statistics(prob: str = "prob", modified: str = "modified") -> list[Column]:
    """coverage, share of modified reads, and one minus the geometric mean of (1 - p)."""
    return [F.count("*").alias("coverage"), F.avg(F.col(modified).cast("double")).alias("modified_prob"), (1 - F.exp(F.avg(F.ln(1 - F.col(prob) + 1e-6)))).alias("modified_prob_geometric")]


def site_summary(hits: DataFrame, keys: tuple[str, ...] = ("contig", "refpos"), prob: str = "prob", modified: str = "modified", with_array: bool = False) -> DataFrame:
    """One row for each site.  ``with_array`` also keeps each read's probability: its size follows the coverage."""
    more = [F.sort_array(F.collect_list(prob)).alias("read_prob_array")] if with_array else []
    return hits.groupBy(*keys).agg(*site_statistics(prob, modified), *more)


def roc_sweep(scores: DataFrame, positive: str = "positive", score: str = "score", steps: int = 500) -> DataFrame:
    """threshold, tp, fp: the shares of positives and negatives over each of ``steps`` + 1 thresholds from 0 to 1.

    Scores are counted in the bucket of the number of thresholds below them; a reverse running sum over the
    fixed set of buckets gives the counts.
    """
    below = F.greatest(F.least(F.ceil(F.col(score) * steps), F.lit(steps + 1)), F.lit(0)).cast("int")
    # the product may round across a threshold: compare with the quotients themselves
    exact = F.when((below > 0) & ~(F.col(score) > (below - 1) / F.lit(steps)), below - 1).when((below <= steps) & (F.col(score) > below / F.lit(steps)), below + 1).otherwise(below)
    counts = scores.groupBy(exact.alias("bucket")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    every = scores.sparkSession.range(steps + 2).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").na.fill(0, ["p", "n"])
    # steps + 2 rows, whatever the input
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = filled.select("bucket", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"over_{c}") for c in "pn"), *(F.sum(c).over(whole).alias(f"all_{c}") for c in "pn"))
    share = lambda c: F.when(F.col(f"all_{c}") > 0, F.col(f"over_{c}") / F.col(f"all_{c}")).otherwise(F.lit(NAN))
    return out.where(F.col("bucket") <= steps).select((F.col("bucket") / steps).alias("threshold"), share("p").alias("tp"), share("n").alias("fp"))


def auc(roc: DataFrame) -> DataFrame:
    """One row: the area under the curve by trapezoids, with the corners (0, 0) and (1, 1)."""
    corners = roc.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "tp double, fp double")
    by = Window.orderBy("fp", "tp")  # as many rows as thresholds
    points = roc.select("tp", "fp").unionByName(corners).select("tp", "fp", F.lag("tp").over(by).alias("tp0"), F.lag("fp").over(by).alias("fp0"))
    return points.agg(F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2).alias("auc"))


def kmer_profile(path: DataFrame, state: str = "state", value: str = "value") -> DataFrame:
    """Mean and population deviation of the signal for each state."""
    return path.groupBy(state).agg(F.count("*").alias("n"), F.avg(value).alias("level_mean"), F.stddev_pop(value).alias("level_stdv"))


def kmer_dwell(path: DataFrame, key: str = "read_id", order: str = "pos", state: str = "state") -> DataFrame:
    """state, length, n: how often each run length occurs."""
    return runs(path, key, order, state).groupBy(state, "length").agg(F.count("*").alias("n"))


def transition_weights(path: DataFrame, key: str = "read_id", order: str = "pos", state: str = "state") -> DataFrame:
    """state, next_base, n_runs, weight: runs over their summed length; the last run of each path does not count.

    The next base is the last letter of the following state.
    """
    by = Window.partitionBy(key).orderBy("start")
    own = runs(path, key, order, state).withColumn("next_state", F.lead(state).over(by)).where("next_state IS NOT NULL")
    return own.groupBy(state, F.right("next_state", F.lit(1)).alias("next_base")).agg(F.count("*").alias("n_runs"), (F.count("*") / (F.sum("length") + 1e-6)).alias("weight"))


def outcome_report(df: DataFrame, reason: Column | str) -> DataFrame:
    """Rows for each outcome; null is ``passed``."""
    return df.groupBy(F.coalesce(as_column(reason), F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def sequence_kinds(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: sequences with A alone, with M alone, with neither, and with both."""
    a, m = F.contains(F.col(seq), F.lit("A")), F.contains(F.col(seq), F.lit("M"))
    return df.agg(F.count_if(a & ~m).alias("n_a"), F.count_if(m & ~a).alias("n_m"), F.count_if(~a & ~m).alias("n_none"), F.count_if(a & m).alias("n_both"))


def check_kinds(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``sequence_kinds``, with an error if a sequence has both."""
    return sequence_kinds(df, seq).withColumn("n_both", F.when(F.col("n_both") > 0, F.raise_error("sequences with A and M").cast("long")).otherwise(F.col("n_both")))


def length_histogram(df: DataFrame, seq: str = "seq", width: int = 100) -> DataFrame:
    """lo, n: sequences by length."""
    return df.groupBy((F.floor(F.length(seq) / width) * width).alias("lo")).agg(F.count("*").alias("n"))


def mean_ignoring_nan(column: str) -> Column:
    return F.avg(F.when(~F.isnan(column), F.col(column)))


def m_kmer_counts(reads: DataFrame, k: int = 5, seq: str = "seq") -> DataFrame:
    """kmer, n of the k-mers that start with M."""
    return reads.select(F.explode(kmers(seq, k)).alias("kmer")).where(F.startswith("kmer", F.lit("M"))).groupBy("kmer").agg(F.count("*").alias("n"))


def position_frequency(segments: DataFrame, half: int, segment: str = "segment", alphabet: str = "ACGTM") -> DataFrame:
    """Counts of each base at each offset, over segments of exactly 2 * half + 1 bases."""
    whole = segments.where(F.length(segment) == 2 * half + 1)
    long = whole.select(F.posexplode(letters(segment)).alias("offset", "base"))
    return long.groupBy("offset").pivot("base", list(alphabet)).count().na.fill(0)


def consensus(calls: DataFrame, keys: tuple[str, ...] = ("read_id",), pos: str = "pos", base: str = "base", logp: str = "logp") -> DataFrame:
    """seq and quality of each read: at each place the base with most votes, the lowest base index on ties.

    The quality is -10 times the winner's mean log probability over ln 10, cut to an integer.
    """
    votes = calls.groupBy(*keys, pos, base).agg(F.count("*").alias("votes"), F.sum(logp).alias("logp"))
    best = votes.groupBy(*keys, pos).agg(F.max_by(F.struct(base, "logp", "votes"), F.struct("votes", (-F.col(base)).alias("b"))).alias("x"))
    letter = F.substring(F.lit("ACGTM"), F.col(f"x.{base}").cast("int"), F.lit(1))
    quality = F.least((-10 * F.col("x.logp") / F.col("x.votes") / F.ln(F.lit(10.0))).cast("int"), F.lit(93))
    ordered = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, letter.alias("c"), F.chr(quality + 33).alias("q")))).alias("x"))
    return ordered.select(*keys, F.array_join("x.c", "").alias("seq"), F.array_join("x.q", "").alias("quality"))


def edit_error(pairs: DataFrame, pred: str = "pred", ref: str = "ref", reduction: dict[str, str] | None = None) -> DataFrame:
    """One row: mean of edit distance over reference length; the reduction applies to both sides, empty references are left out."""
    reduce_ = lambda c: F.translate(c, "".join(reduction), "".join(reduction.values())) if reduction else F.col(c)
    own = pairs.select(reduce_(pred).alias("p"), reduce_(ref).alias("r")).where("length(r) > 0")
    return own.agg(F.count("*").alias("n"), F.avg(edit_distance("p", "r") / F.length("r")).alias("error"))


def count_bound(pred: dict[str, Column], ref: dict[str, Column], alphabet: str, written: str) -> Column:
    """``letter_bound`` from the counts of each letter in both texts."""
    more = [pred[c] - ref[w] for c, w in zip(alphabet, written, strict=True)]
    over, under = (reduce(add, (F.greatest(sign * m, F.lit(0)) for m in more)) for sign in (1, -1))
    return F.greatest(over, under)


def letter_bound(pred: Column | str, ref: Column | str, alphabet: str, written: str) -> Column:
    """At most the edit distance of ``ref`` and ``pred`` with the letters of ``alphabet`` written as those of ``written``: each edit changes one letter's count, and another's."""
    return count_bound({c: count_letter(pred, c) for c in alphabet}, {w: count_letter(ref, w) for w in written}, alphabet, written)


def permute_error(pairs: DataFrame, alphabet: str = "ACGT", pred: str = "pred", ref: str = "ref", slices: int = 16) -> DataFrame:
    """One row: the permutation of the predictions' letters with the least mean error, the first in order on ties.

    Branch and bound: the distances of one slice of the pairs, and for the others bounds from counts of letters, give each permutation a mean that
    it cannot fall below.  Permutations are finished in the order of these, until no other can be better; wrong ones mostly end with
    the first slice.  Runs when called; some numbers for each permutation reach the driver.
    """
    orders = ["".join(p) for p in permutations(alphabet)]
    own = pairs.where((F.length(ref) > 0) & F.col(pred).isNotNull()).select(F.col(pred).alias("p"), F.col(ref).alias("r"), F.pmod(F.xxhash64(pred, ref), F.lit(slices)).alias("slice"))
    # read several times; letters are counted once, not for each permutation
    counts = {c: {x: f"_{c}{i}" for i, x in enumerate(alphabet)} for c in ("p", "r")}
    own = stored(own.select("*", *(count_letter(c, x).alias(name) for c in counts for x, name in counts[c].items())), "pairs")
    held = [{x: F.col(name) for x, name in counts[c].items()} for c in counts]

    def errors(rows: DataFrame, chosen: list[str]) -> dict[str, float]:
        written = F.array(*(F.struct(F.lit(o).alias("permutation"), F.translate("p", alphabet, o).alias("p")) for o in chosen))
        rows = rows.select(F.explode(written).alias("x"), "r").select("x.permutation", (edit_distance("x.p", "r") / F.length("r")).alias("error"))
        return {r["permutation"]: r["error"] for r in rows.groupBy("permutation").agg(F.sum("error").alias("error")).collect()}

    rest = own.where("slice > 0")
    bounds = rest.agg(*(F.coalesce(F.sum(count_bound(*held, alphabet, o) / F.length("r")), F.lit(0.0)).alias(o) for o in orders)).first()
    first = errors(own.where("slice = 0"), orders)
    n = own.count()
    done: dict[str, float] = {}
    least = {o: (bounds[o] + first.get(o, 0.0)) / max(n, 1) for o in orders}
    for o in sorted(orders, key=lambda o: (least[o], o)):
        # sums are rounded: a bound that is met but for that is not over it
        if done and least[o] > min(done.values()) + 1e-9:
            break
        done[o] = round((errors(rest, [o]).get(o, 0.0) + first.get(o, 0.0)) / max(n, 1), 12)
    best = min(done, key=lambda o: (done[o], o))
    return pairs.sparkSession.createDataFrame([(best, done[best] if n else None)], "permutation string, error double")


def identity_score(cigar: Column | str, mismatches: Column | str, query_len: Column | str) -> Column:
    """(aligned bases - mismatches) / query length; 0 when unaligned."""
    matched = F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"] == "M"), F.lit(0), lambda a, x: a + x["n"])
    return F.coalesce((matched - as_column(mismatches)) / F.nullif(as_column(query_len), F.lit(0)), F.lit(0.0))


def weighted_identity(df: DataFrame, score: str, query_len: str, min_len: int) -> DataFrame:
    """One row: scores weighted with max(length - min_len, 0)."""
    weight = F.greatest(F.col(query_len) - min_len, F.lit(0))
    return df.agg((F.sum(F.col(score) * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("identity"))


def emission_update(weights: DataFrame, means: DataFrame, trainable: Column | None = None) -> DataFrame:
    """state, mean, variance: weighted moments of the values under each state; states not trainable, or without weight, keep their mean.

    ``weights(state, value, weight)``, ``means(state, mean, variance)``.
    """
    total, first, second = F.sum("weight"), F.sum(F.col("weight") * F.col("value")), F.sum(F.col("weight") * F.col("value") * F.col("value"))
    moments = weights.groupBy("state").agg(total.alias("w"), (first / (total + 1e-6)).alias("m"), first.alias("wx"), second.alias("wxx"))
    moves = (F.col("w") > 0) & (F.lit(True) if trainable is None else trainable)
    variance = (F.col("wxx") - 2 * F.col("m") * F.col("wx") + F.col("m") * F.col("m") * F.col("w")) / (F.col("w") + 1e-6)
    return means.join(moments, "state", "left").select("state", F.when(moves, F.col("m")).otherwise(F.col("mean")).alias("mean"), F.when(moves, variance).otherwise(F.col("variance")).alias("variance"))


def consensus_test(roc: DataFrame, n: int) -> DataFrame:
    """The curve after a vote of n reads: P(Binomial(n, x) > n // 2) of both rates."""
    choose = [1]
    for k in range(n):
        choose.append(choose[-1] * (n - k) // (k + 1))
    vote = lambda x: sum((choose[k] * F.pow(x, F.lit(k)) * F.pow(1 - F.col(x), F.lit(n - k)) for k in range(n // 2 + 1, n + 1)), F.lit(0.0))
    return roc.select("threshold", vote("tp").alias("tp"), vote("fp").alias("fp"))


def am_ratio_decode(posteriors: DataFrame, thresholds: tuple[float, ...], keys: tuple[str, ...] = ("read_id",), frame: str = "t", kmer: str = "kmer", p: str = "p") -> DataFrame:
    """keys, threshold, share: of the frames whose best k-mer has A or M in the middle, those with ln(pA / pM) below the threshold."""
    best = posteriors.groupBy(*keys, frame).agg(F.max_by(kmer, F.struct(p, kmer)).alias("best"))
    middle = F.substring("best", F.floor(F.length("best") / 2).cast("int") + 1, F.lit(1))
    mid = F.floor(F.length("best") / 2).cast("int")
    swap = lambda c: F.concat(F.substring("best", F.lit(1), mid), F.lit(c), F.substring("best", mid + 2, F.length("best")))
    own = best.where(middle.isin("A", "M")).select(*keys, frame, swap("A").alias("a"), swap("M").alias("m"))
    pair = posteriors.join(own, [*keys, frame]).where((F.col(kmer) == F.col("a")) | (F.col(kmer) == F.col("m")))
    ratio = pair.groupBy(*keys, frame).agg(F.ln(F.max(F.when(F.col(kmer) == F.col("a"), F.col(p))) / F.max(F.when(F.col(kmer) == F.col("m"), F.col(p)))).alias("ratio"))
    shares = ratio.groupBy(*keys).agg(*(F.avg((F.col("ratio") < t).cast("double")).alias(f"t{i}") for i, t in enumerate(thresholds)))
    return shares.select(*keys, F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("share")) for i, t in enumerate(thresholds)))).alias("x")).select(*keys, "x.*")


def training_curve(errors: DataFrame, smooth: float) -> DataFrame:
    """step, mean, std over the runs (NaN ignored), and the exponential mean of the means from the first.

    A step without a number starts the smoothing anew.  Steps are smoothed in blocks of ``BLOCK_STEPS``: what a block makes of the value
    before it is linear, so the values between blocks follow from one row for each block, and each block is then smoothed apart.
    """
    clean = F.when(~F.isnan("error"), F.col("error"))
    steps = errors.groupBy("step").agg(F.avg(clean).alias("mean"), F.stddev_pop(clean).alias("std"))
    none = F.lit(None).cast("double")

    def step(a: Column, x: Column) -> Column:
        now = F.coalesce(a["last"] * smooth + (1 - smooth) * x["mean"], x["mean"])
        return F.struct(now.alias("last"), F.array_append(a["out"], now).alias("out"))

    def smoothed(first: Column) -> Column:
        return F.aggregate("x", F.struct(first.alias("last"), F.array().cast("array<double>").alias("out")), step, lambda a: a["out"])

    # a block's last value is share * (value before it) + rest; share is 0 behind a step without a number, where rest may be null
    def linear(a: Column, x: Column) -> Column:
        cut = x["mean"].isNull()
        fresh = (a["share"] == 0) & a["rest"].isNull()
        rest = F.when(cut, none).when(fresh, x["mean"]).otherwise(a["rest"] * smooth + (1 - smooth) * x["mean"])
        return F.struct(F.when(cut | fresh, 0.0).otherwise(a["share"] * smooth).alias("share"), rest.alias("rest"))

    blocks = steps.groupBy(F.floor(F.col("step") / BLOCK_STEPS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("step", "mean", "std"))).alias("x"))
    made = blocks.select("block", F.aggregate("x", F.struct(F.lit(1.0).alias("share"), F.lit(0.0).alias("rest")), linear).alias("line"), F.element_at(smoothed(none), -1).alias("alone"))
    follow = lambda a, b: F.when(a.isNull(), b["alone"]).when(b["line"]["share"] == 0, b["line"]["rest"]).otherwise(b["line"]["share"] * a + b["line"]["rest"])
    row = made.agg(F.array_sort(F.collect_list(F.struct("block", "line", "alone"))).alias("b"))
    ends = F.aggregate("b", F.array(none), lambda a, x: F.array_append(a, follow(F.element_at(a, -1), x)))
    before = row.select(F.explode(F.arrays_zip("b", F.slice(ends, F.lit(1), F.size("b")).alias("first"))).alias("z")).select("z.b.block", "z.first")
    rows = blocks.join(before, "block").select(F.explode(F.arrays_zip("x", smoothed(F.col("first")).alias("s"))).alias("z"))
    return rows.select("z.x.step", "z.x.mean", "z.x.std", F.col("z.s").alias("smooth"))


def segment_mse(path: DataFrame, model: DataFrame, key: str = "read_id", state: str = "state", value: str = "value") -> DataFrame:
    """Mean squared difference of the signal and the model's mean of its state, for each read."""
    rows = path.join(model.select(F.col("kmer").alias(state), "level_mean"), state)
    return rows.groupBy(key).agg(F.avg(F.pow(F.col(value) - F.col("level_mean"), F.lit(2.0))).alias("mse"))


def path_difference(left: DataFrame, right: DataFrame, key: str = "read_id", order: str = "pos", state: str = "state") -> DataFrame:
    """Share of the points of each read where two paths differ."""
    both = left.select(key, order, F.col(state).alias("a")).join(right.select(key, order, F.col(state).alias("b")), [key, order])
    return both.groupBy(key).agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("different"))
