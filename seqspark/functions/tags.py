"""Column functions over modification tags (MM gaps and ML likelihoods) and qualities.  All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from seqspark.functions.sequence import as_column, let, letters, span

GROUP = "struct<gaps:array<int>,likelihoods:array<int>>"


def _ints(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast("int"))


def parse_mm(mm: Column | str, ml: Column | str) -> Column:
    """map<code, struct<gaps, likelihoods>> of an MM text and its ML values.

    The likelihoods are dealt out in the order of the groups; null where their number differs from the
    gaps' or a tag is missing.  A code of several letters is an error.
    """

    def group(parts: Column) -> Column:
        code = F.regexp_replace(F.get(parts, F.lit(0)), "[.?]+$", "")
        checked = F.when(F.length(F.regexp_extract(code, r"\+(.*)$", 1)) > 1, F.raise_error(F.concat(F.lit("several modification letters in "), code)).cast("string")).otherwise(code)
        return F.struct(checked.alias("code"), _ints(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("gaps"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<key:string,value:{GROUP}>>").alias("out"))

    def deal(groups: Column, values: Column) -> Column:
        def step(a: Column, g: Column) -> Column:
            n = F.size(g["gaps"])
            own = F.struct(g["code"].alias("key"), F.struct(g["gaps"].alias("gaps"), F.slice(values, a["at"] + 1, n).alias("likelihoods")).alias("value"))
            return F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], own).alias("out"))

        total = F.aggregate(groups, F.lit(0), lambda a, g: a + F.size(g["gaps"]))
        return F.when(total == F.size(values), F.map_from_entries(F.aggregate(groups, start, step, lambda a: a["out"])))

    groups = F.transform(F.filter(F.split(as_column(mm), ";"), lambda g: g != ""), lambda g: let(F.split(g, ","), group))
    return let(as_column(ml), lambda values: let(groups, lambda gs: deal(gs, values)))


def expand_mm(gaps: Column | str, likelihoods: Column | str) -> Column:
    """For each gap, as many zeros, then the likelihood."""
    return F.flatten(F.zip_with(as_column(gaps), as_column(likelihoods), lambda g, v: F.concat(F.array_repeat(F.lit(0), g), F.array(v))))


def pad_ml(values: Column | str, n: Column | str) -> Column:
    """Padded with zeros to the number of canonical bases; null if there are more values than bases."""
    n = as_column(n)
    return let(as_column(values), lambda v: F.when(F.size(v) <= n, F.concat(v, F.array_repeat(F.lit(0), (n - F.size(v)).cast("int")))))


def encode_mm(values: Column | str, merged: bool = True) -> Column:
    """struct(gaps, likelihoods): of the non-zero values alone, or (not merged) all values with zero gaps."""
    values = as_column(values)
    if not merged:
        return let(values, lambda v: F.struct(F.transform(v, lambda _: F.lit(0)).alias("gaps"), v.alias("likelihoods")))
    return let(values, lambda v: F.struct(_gaps(v, lambda x: x != 0).alias("gaps"), F.filter(v, lambda x: x != 0).alias("likelihoods")))


def _gaps(values: Column, marked: Callable[[Column], Column]) -> Column:
    """Between the marked values, the number of others."""
    places = F.filter(F.transform(values, lambda v, i: F.when(marked(v), i)), lambda i: i.isNotNull())
    return let(places, lambda p: F.transform(p, lambda x, i: x - F.when(i == 0, F.lit(-1)).otherwise(F.get(p, i - 1)) - 1))


def mm_from_seq(seq: Column | str, quality: Column | str, code: str = "A+a") -> Column:
    """struct(seq, gaps, likelihoods) of a sequence with M as modified base.

    M becomes the canonical base; gaps count canonical bases since the last M; a likelihood is
    256 * 10 ** (-q / 10), cut to an integer.
    """
    base = code.split("+")[0]

    def parts(bases: Column, text: Column) -> Column:
        gaps = let(F.filter(bases, lambda b: b.isin(base, "M")), lambda own: _gaps(own, lambda b: b == "M"))
        places = F.filter(span(F.size(bases)), lambda i: F.get(bases, i) == "M")
        likelihood = lambda q: F.floor(256 * F.pow(F.lit(10.0), -(F.ascii(q) - 33) / 10.0)).cast("int")
        values = let(letters(text), lambda own: F.transform(places, lambda i: likelihood(F.get(own, i))))
        return F.struct(F.replace(as_column(seq), F.lit("M"), F.lit(base)).alias("seq"), gaps.alias("gaps"), values.alias("likelihoods"))

    return let(as_column(quality), lambda text: let(letters(seq), lambda bases: parts(bases, text)))


def mm_text(gaps: Column | str, code: str = "A+a") -> Column:
    """The MM text of one group."""
    text = lambda g: F.concat(F.lit(f"{code}?"), F.when(F.size(g) > 0, F.concat(F.lit(","), F.array_join(g.cast("array<string>"), ","))).otherwise(F.lit("")), F.lit(";"))
    return let(as_column(gaps), text)


def int8_encode(p: Column | str) -> Column:
    """Probability as 0..255; 1.0 saturates."""
    return F.least(F.floor(as_column(p) * 256), F.lit(255)).cast("int")


def phred_string(q: Column | str) -> Column:
    return F.array_join(F.transform(as_column(q), lambda x: F.chr(x + 33)), "")


def phred_ints(text: Column | str) -> Column:
    return F.transform(letters(text), lambda x: F.ascii(x) - 33)
