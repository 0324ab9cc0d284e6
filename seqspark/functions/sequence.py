"""Column functions over base sequences, k-mers, state paths and alignments.  All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

ALPHABET = "ACGTM"
# IUPAC codes as character classes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "U", "R": "[AG]", "Y": "[CT]", "M": "[AC]", "K": "[GT]", "S": "[GC]", "W": "[AT]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it; inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def evaluated(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later columns read instead of repeating its expression: a generator is a border that the optimizer does not merge across."""
    return df.withColumn(name, F.explode(F.array(value)))


def letters(seq: Column | str) -> Column:
    """The letters of a string; none of the empty one."""
    return F.array_remove(F.split(as_column(seq), ""), "")


def span(n: Column, first: int = 0) -> Column:
    """first, first + 1, ... of n values; none if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(first), n.cast("int") + (first - 1))).otherwise(F.array().cast("array<int>"))


def reverse_complement(seq: Column | str, rna: bool = False) -> Column:
    """Upper case, reversed and complemented; N and other letters stay."""
    turned = F.reverse(F.upper(as_column(seq)))
    return F.translate(turned, "ACGTU", "UGCAA") if rna else F.translate(turned, "ACGT", "TGCA")


def clean_repr(seq: Column | str) -> Column:
    """``ins`` as 0, M as A, U as T."""
    return F.translate(F.replace(as_column(seq), F.lit("ins"), F.lit("0")), "MU", "AT")


def a_to_m(seq: Column | str) -> Column:
    return F.translate(as_column(seq), "A", "M")


def m_to_a(seq: Column | str) -> Column:
    return F.translate(as_column(seq), "M", "A")


#: Letters in a slice that k-mers are cut from: ``substring`` counts from the start of its text, so texts are short.
KMER_SLICE = 32


def slices(seq: Column | str, size: int, after: int = 0) -> Column:
    """The sequence in pieces of ``size`` letters, each followed by up to ``after`` (at most ``size``) letters of the next; linear in its length."""
    pieces = F.regexp_extract_all(as_column(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return let(pieces, lambda p: F.transform(p, lambda own, i: F.concat(own, F.coalesce(F.left(F.get(p, i + 1), F.lit(after)), F.lit("")))))


def kmers(seq: Column | str, k: int) -> Column:
    """All k-mers in order; none of a shorter sequence.  The time is linear in the sequence."""
    own = lambda s: F.transform(span(F.length(s) - (k - 1), 1), lambda i: F.substring(s, i, F.lit(k)))
    return F.flatten(F.transform(slices(seq, max(KMER_SLICE, k), k - 1), own))


def kmer_index(kmer: Column | str, alphabet: str = ALPHABET) -> Column:
    """Place value code of a k-mer, first base most significant; null with a letter outside the alphabet."""
    digit = lambda b: F.nullif(F.instr(F.lit(alphabet), b), F.lit(0)) - 1
    return F.aggregate(letters(kmer), F.lit(0).cast("long"), lambda a, b: a * len(alphabet) + digit(b))


def kmer_codes(seq: Column | str, k: int, alphabet: str = ALPHABET) -> Column:
    """Codes of all k-mers; -1 alone for a sequence shorter than k; null where a letter is outside the alphabet.

    Each letter becomes a digit once, and a code is a sum over k digits, so no k-mer is written out.
    """
    digits = F.transform(letters(seq), lambda b: (F.nullif(F.instr(F.lit(alphabet), b), F.lit(0)) - 1).cast("long"))
    code = lambda d, i: reduce(add, (F.get(d, i + j) * len(alphabet) ** (k - 1 - j) for j in range(k)))
    rolled = let(digits, lambda d: F.transform(span(F.size(d) - (k - 1)), lambda i: code(d, i)))
    return F.when(F.length(as_column(seq)) < k, F.array(F.lit(-1).cast("long"))).otherwise(rolled)


def index_kmer(code: Column | str, k: int, alphabet: str = ALPHABET) -> Column:
    """The k-mer of a code."""
    code, n = as_column(code), len(alphabet)
    return F.concat(*[F.substring(F.lit(alphabet), (F.floor(code / n ** (k - 1 - i)) % n).cast("int") + 1, F.lit(1)) for i in range(k)])


def encode_bases(seq: Column | str, length: int | None = None, alphabet: str = ALPHABET) -> Column:
    """1-based letters of the alphabet, 0 for others; padded with 0 to ``length``."""
    codes = F.transform(letters(seq), lambda b: F.instr(F.lit(alphabet), b))
    return codes if length is None else F.concat(codes, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(codes), F.lit(0))))


def decode_bases(codes: Column | str, alphabet: str = ALPHABET) -> Column:
    """Letters of non-zero codes."""
    return F.array_join(F.transform(F.filter(as_column(codes), lambda c: c > 0), lambda c: F.substring(F.lit(alphabet), c, F.lit(1))), "")


def find_all(seq: Column | str, letter: str) -> Column:
    """0-based places of a letter."""
    found = F.transform(letters(seq), lambda b, i: F.when(b == letter, i))
    return F.filter(found, lambda i: i.isNotNull())


def collapse(path: Column | str) -> Column:
    """An array without repeats of the value before."""
    return let(as_column(path), lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))


def ctc_collapse(path: Column | str, alphabet: str = ALPHABET, blank: int = 0) -> Column:
    """struct(seq, moves): repeats merged, blanks dropped; a move marks the first frame of each run that is not blank."""

    def parts(p: Column) -> Column:
        new = lambda x, i: (x != blank) & ((i == 0) | (x != F.get(p, i - 1)))
        seq = F.array_join(F.transform(F.filter(p, new), lambda c: F.substring(F.lit(alphabet), c.cast("int"), F.lit(1))), "")
        return F.struct(seq.alias("seq"), F.transform(p, lambda x, i: new(x, i).cast("int")).alias("moves"))

    return let(as_column(path), parts)


def path_to_seq(states: Column | str) -> Column:
    """First letters of the collapsed k-mers, and the rest of the last."""

    def join(kept: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        return F.concat(F.array_join(F.transform(kept, lambda s: F.substring(s, 1, 1)), ""), F.coalesce(F.substring(last, F.lit(2), F.length(last)), F.lit("")))

    return let(collapse(states), join)


def path_from_alignment(seq: Column | str, starts: Column | str, n: Column | str, k: int) -> Column:
    """The k-mer of each of ``n`` signal points, from each base's first point.

    A base without points gets one from the longest dwell over one (the first such on ties), so that each
    k-mer shows; with too few points for that, dwells stay as they are.
    """

    def dwells(at: Column, count: Column) -> Column:
        return F.transform(F.slice(at, F.lit(1), count), lambda s, i: F.coalesce(F.get(at, i + 1), as_column(n).cast("int")) - s)

    def spend(d: Column) -> Column:
        least, most = F.array_position(d, F.array_min(d)) - 1, F.array_position(d, F.array_max(d)) - 1
        moved = let(F.struct(least.alias("a"), most.alias("b")), lambda x: F.transform(d, lambda v, i: v + F.when(i == x["a"], 1).otherwise(0) - F.when(i == x["b"], 1).otherwise(0)))
        return F.when((F.array_min(d) < 1) & (F.array_max(d) > 1), moved).otherwise(d)

    def spread(names: Column) -> Column:
        own = let(as_column(starts), lambda at: dwells(at, F.size(names)))
        even = let(own, lambda d: F.aggregate(F.filter(d, lambda x: x < 1), d, lambda e, _: spend(e)))
        return F.flatten(F.zip_with(names, even, lambda name, d: F.array_repeat(name, F.greatest(d, F.lit(0)))))

    return let(kmers(seq, k), spread)


def kmer_alternatives(kmer: Column | str, base: str = "A", other: str = "M") -> Column:
    """Every way to write each ``base`` as itself or ``other``; in order of the letters' places, ``base`` first."""
    grow = lambda done, b: F.when(b == base, F.flatten(F.transform(done, lambda p: F.array(F.concat(p, F.lit(base)), F.concat(p, F.lit(other)))))).otherwise(F.transform(done, lambda p: F.concat(p, b)))
    return F.aggregate(letters(kmer), F.array(F.lit("")), grow)


def max_loop(seq: Column | str, limit: int = 10) -> Column:
    """Tandem repeats: for each loop size from 2, the least over its phases of the longest run of one letter in every size-th base; the greatest of these."""
    def strided(plain: Column, size: int, phase: int) -> Column:
        # a base and up to size - 1 more that are skipped
        return F.regexp_replace(F.substring(plain, F.lit(phase + 1), F.length(plain)), f"(?s)(.).{{0,{size - 1}}}", "$1")

    def longest(text: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*+)"), 1), lambda run: F.length(run))), F.lit(0))

    def sizes(plain: Column) -> Column:
        return F.greatest(*[F.array_min(F.array(*[longest(strided(plain, size, phase)) for phase in range(size)])) for size in range(2, limit)])

    return let(m_to_a(seq), sizes)


_OPS = r"([0-9]+)([MIDNSHP=X])"


def cigar_ops(cigar: Column | str) -> Column:
    """array<struct<n, op>> of a CIGAR string."""
    cigar = as_column(cigar)
    return F.zip_with(F.regexp_extract_all(cigar, F.lit(_OPS), 1), F.regexp_extract_all(cigar, F.lit(_OPS), 2), lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))


def count_cigar(cigar: Column | str, op: str) -> Column:
    """Sum of the lengths of one operation."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"] == op), F.lit(0), lambda a, x: a + x["n"])


def hard_clips(cigar: Column | str) -> Column:
    """struct(leading, trailing) lengths of hard clips."""
    cigar = as_column(cigar)
    number = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("int"), F.lit(0))
    return F.struct(number("^([0-9]+)H").alias("leading"), number("[^0-9]([0-9]+)H$").alias("trailing"))


def aligned_pairs(pos: Column | str, cigar: Column | str) -> Column:
    """array<struct<qpos, refpos>> from a 0-based position: M, = and X on both sides; I and S without refpos; D and N without qpos."""
    none = F.lit(None).cast("int")
    pair = "array<struct<qpos:int,refpos:int>>"
    start = F.struct(F.lit(0).alias("q"), as_column(pos).cast("int").alias("r"), F.array().cast(pair).alias("out"))

    def step(a: Column, x: Column) -> Column:
        on_q, on_r = x["op"].isin("M", "=", "X", "I", "S"), x["op"].isin("M", "=", "X", "D", "N")
        made = F.transform(F.when(on_q | on_r, span(x["n"])).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.when(on_q, a["q"] + i).otherwise(none).alias("qpos"), F.when(on_r, a["r"] + i).otherwise(none).alias("refpos")))
        return F.struct((a["q"] + F.when(on_q, x["n"]).otherwise(0)).alias("q"), (a["r"] + F.when(on_r, x["n"]).otherwise(0)).alias("r"), F.concat(a["out"], made).alias("out"))

    return F.aggregate(cigar_ops(cigar), start, step, lambda a: a["out"])


def ref_places(pos: Column | str, cigar: Column | str) -> Column:
    """The reference place of each query base, as in ``aligned_pairs``; null for I and S.  Runs are written out as a whole, not base by base."""
    start = F.struct(as_column(pos).cast("int").alias("r"), F.array().cast("array<struct<n:int,r:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        on_q, on_r = x["op"].isin("M", "=", "X", "I", "S"), x["op"].isin("M", "=", "X", "D", "N")
        own = F.struct(x["n"].alias("n"), F.when(on_r, a["r"]).alias("r"))
        return F.struct((a["r"] + F.when(on_r, x["n"]).otherwise(0)).alias("r"), F.when(on_q, F.array_append(a["out"], own)).otherwise(a["out"]).alias("out"))

    none = F.lit(None).cast("int")
    run = lambda x: F.when(x["r"].isNull() | (x["n"] < 1), F.array_repeat(none, x["n"])).otherwise(F.sequence(x["r"], x["r"] + x["n"] - 1))
    return F.flatten(F.transform(F.aggregate(cigar_ops(cigar), start, step, lambda a: a["out"]), run))


def ref_index(cigar: Column | str, first: Column | str | int = 0) -> Column:
    """array<struct<idx, quality>>: the query index of each reference base.

    A match has quality 1, a deletion 0; a long deletion points half left, half right.
    """
    first = F.lit(first) if isinstance(first, int) else as_column(first)
    item = "array<struct<idx:int,quality:int>>"
    start = F.struct(first.cast("int").alias("q"), F.array().cast(item).alias("out"))

    def step(a: Column, x: Column) -> Column:
        op, n = x["op"], x["n"]
        match = F.transform(span(n), lambda i: F.struct((a["q"] + i).alias("idx"), F.lit(1).alias("quality")))
        gap = F.transform(span(n), lambda i: F.struct((a["q"] - F.when((n > 1) & (i < F.floor(n / 2)), 1).otherwise(0)).alias("idx"), F.lit(0).alias("quality")))
        made = F.when(op == "M", match).when(op == "D", gap).otherwise(F.array().cast(item))
        return F.struct((a["q"] + F.when(op.isin("M", "I", "S"), n).otherwise(0)).alias("q"), F.concat(a["out"], made).alias("out"))

    return F.aggregate(cigar_ops(cigar), start, step, lambda a: a["out"])


def softmax(values: Column | str) -> Column:
    """Exponentials over their sum, taken from the largest value."""

    def scaled(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))

    exps = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(let(as_column(values), exps), scaled)


def length_mask(length: Column | str, n: int) -> Column:
    """n booleans: i < length."""
    length = as_column(length)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < length)


def parse_qr_index(text: Column | str) -> Column:
    """struct(query, reference) of ``q0:q1:..|r0:r1:..``."""
    halves = F.split(as_column(text), "\\|")
    ints = lambda i: F.transform(F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != ""), lambda x: x.cast("int"))
    return F.struct(ints(0).alias("query"), ints(1).alias("reference"))


def format_qr_index(query: Column | str, reference: Column | str) -> Column:
    return F.concat(F.array_join(as_column(query).cast("array<string>"), ":"), F.lit("|"), F.array_join(as_column(reference).cast("array<string>"), ":"))


def site_segment(seq: Column | str, pos: Column | str, reverse: Column | str, reach: int) -> Column:
    """The bases around a place; on the reverse strand the place counts from the end."""
    seq, pos = as_column(seq), as_column(pos)
    i = F.when(as_column(reverse), F.length(seq) - pos - 1).otherwise(pos).cast("int")
    lo = F.greatest(i - reach, F.lit(0))
    return F.substring(seq, lo + 1, F.greatest(i + reach + 1 - lo, F.lit(0)))


def modified(segment: Column | str) -> Column:
    return F.contains(as_column(segment), F.lit("M"))


def partition_bounds(length: Column | str, size: int) -> Column:
    """Ends of bins of ``size``; a last bin shorter than half of it joins the one before."""
    length = as_column(length).cast("long")
    full, rest = F.floor(length / size), length % size
    ends = F.when(full > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(full, F.lit(1))), lambda i: i * size)).otherwise(F.array().cast("array<bigint>"))
    merged = F.when((rest > 0) & (rest < size // 2) & (full > 0), F.concat(F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))), F.array(length)))
    return F.coalesce(merged, F.when(rest > 0, F.concat(ends, F.array(length))).otherwise(ends))


def iupac_to_regex(motif: str) -> str:
    """Character classes of a motif; a pattern for the start of a window."""
    return "".join(IUPAC[c] for c in motif)
