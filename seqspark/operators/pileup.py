"""The modification pileup: one row for each canonical base of each read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqspark.functions.sequence import evaluated, hard_clips, let, letters, ref_places, span
from seqspark.functions.tags import expand_mm, pad_ml, parse_mm
from seqspark.operators.filters import REVERSE, motif_pattern
from seqspark.operators.joins import SLICE, reference_slices

# The code of each modification.
CODES = {"5mC": "C+m", "5hmC": "C+h", "5fC": "C+f", "5caC": "C+c", "5hmU": "T+g", "5fU": "T+e", "5caU": "T+b", "m6A": "A+a", "8oxoG": "G+o", "Xao": "N+n"}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}


def _decoded(alignments: DataFrame, mod: str) -> DataFrame:
    """Alignments with ``values``, one for each canonical base in the read's own direction, and ``reason`` where there are none."""
    code = CODES.get(mod, mod)
    base = code.split("+")[0]
    own = alignments.withColumn("is_reverse", F.col("flag").bitwiseAND(REVERSE) != 0)
    own = evaluated(own, "_mod", F.try_element_at(parse_mm("mm", "ml"), F.lit(code)))
    here = F.when(F.col("is_reverse"), F.lit(COMPLEMENT[base])).otherwise(F.lit(base))
    own = own.withColumn("seq", F.upper("seq")).withColumn("_n", F.length("seq") - F.length(F.replace("seq", here, F.lit(""))))
    own = evaluated(own, "values", pad_ml(expand_mm("_mod.gaps", "_mod.likelihoods"), "_n"))
    reason = F.when(F.col("_mod").isNull(), "Corrupted_MM").when(F.col("values").isNull(), "Inconsistent_ML")
    return own.withColumn("reason", reason).withColumn("_base", here)


def pileup_report(alignments: DataFrame, mod: str = "m6A") -> DataFrame:
    """Reads by outcome: Passed, Corrupted_MM, Inconsistent_ML."""
    return _decoded(alignments, mod).groupBy(F.coalesce("reason", F.lit("Passed")).alias("reason")).agg(F.count("*").alias("n"))


def meth_pileup(alignments: DataFrame, reference: DataFrame, mod: str = "m6A", motif: str | None = None, reach: int = 5, threshold: int = 0, anchor: str = "start") -> DataFrame:
    """contig, refpos, qpos, refbase, qbase, read_id, likelihood, direction, refseq, motif.

    ``alignments(read_id, flag, contig, pos, cigar, seq, mm, ml)`` with 0-based positions; ``reference(contig, seq, length)``.
    On reverse reads the canonical base is complemented and the likelihoods are turned around.  qpos counts leading hard clips.
    Bases without a reference place are left out, and so are likelihoods under the threshold.  The motif is matched at the start
    of the window, or with its middle on the base (``anchor='center'``).  A read's bases join the reference in short slices, one row
    for each read and slice, and become rows of their own behind that join.
    """
    own = _decoded(alignments, mod).where("reason IS NULL")
    values = F.when(F.col("is_reverse"), F.reverse("values")).otherwise(F.col("values"))
    places = let(letters("seq"), lambda own: F.filter(span(F.size(own)), lambda i: F.get(own, i) == F.col("_base")))
    bases = let(ref_places("pos", "cigar"), lambda at: F.zip_with(places, values, lambda q, v: F.struct(q.alias("q"), v.alias("likelihood"), F.get(at, q).alias("refpos"))))
    own = evaluated(own, "_bases", F.filter(bases, lambda x: (x["likelihood"] >= threshold) & x["refpos"].isNotNull()))
    own = own.select("contig", "read_id", F.when(F.col("is_reverse"), "-").otherwise("+").alias("direction"), F.col("_base").alias("qbase"), hard_clips("cigar")["leading"].alias("_clip"), "_bases")
    # bases come in the order of their places, so those of a slice stand together
    own = evaluated(own.where(F.size("_bases") > 0), "_bins", F.transform("_bases", lambda x: F.floor(x["refpos"] / SLICE)))
    own = evaluated(own, "_at", F.transform(F.array_distinct("_bins"), lambda b: F.struct(b.alias("bin"), F.array_position("_bins", b).cast("int").alias("first"))))
    part = lambda b, i: F.struct(b["bin"].alias("bin"), F.slice("_bases", b["first"], F.coalesce(F.get("_at", i + 1)["first"], F.size("_bases") + 1) - b["first"]).alias("bases"))
    rows = own.select("contig", "read_id", "direction", "qbase", "_clip", F.explode(F.transform("_at", part)).alias("x")).select("contig", "read_id", "direction", "qbase", "_clip", "x.*")
    slices = reference_slices(reference, reach, reach + 1).withColumn("slice", F.upper("slice"))
    # behind the join a base is a row: nothing is shuffled any more, and plain columns are faster than those of arrays
    rows = rows.join(slices, ["contig", "bin"]).select("contig", "read_id", "direction", "qbase", "_clip", "slice_start", "slice", F.explode("bases").alias("x"))
    cut = lambda at, n: F.substring("slice", (at - F.col("slice_start") + 1).cast("int"), n)
    lo = F.greatest(F.col("x.refpos") - reach, F.lit(0))
    rows = rows.select("contig", "x.refpos", (F.col("x.q") + F.col("_clip")).alias("qpos"), cut(F.col("x.refpos"), F.lit(1)).alias("refbase"), "qbase", "read_id", "x.likelihood", "direction", cut(lo, (F.col("x.refpos") + reach + 1 - lo).cast("int")).alias("refseq"))
    if motif is not None:
        rows = rows.where(F.col("refseq").rlike(motif_pattern(motif, anchor, reach)))
    return rows.withColumn("motif", F.lit(motif).cast("string"))
