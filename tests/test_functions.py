"""Column functions on small, hand-worked values."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqspark.functions import sequence as S, tags as T


@pytest.fixture(scope="module")
def one(spark):
    return lambda column, **values: spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'array<int>'}" for k, v in values.items()) or "x int").select(column.alias("y")).first().y


def test_sequences(one):
    assert one(S.reverse_complement(F.lit("acGTN"))) == "NACGT" and one(S.reverse_complement(F.lit("AACU"), rna=True)) == "AGUU"
    assert one(S.clean_repr(F.lit("AMUins"))) == "AAT0" and one(S.a_to_m(F.lit("ACA"))) == "MCM"
    assert one(S.kmers(F.lit("ACGT"), 3)) == ["ACG", "CGT"] and one(S.kmers(F.lit("AC"), 3)) == []
    assert one(S.kmer_codes(F.lit("ACM"), 2)) == [1, 9] and one(S.kmer_codes(F.lit("A"), 2)) == [-1]
    assert one(S.kmer_index(F.lit("AN"))) is None and one(S.index_kmer(F.lit(9), 2)) == "CM"
    assert one(S.encode_bases(F.lit("AN$M"), 6)) == [1, 0, 0, 5, 0, 0] and one(S.decode_bases(F.array(F.lit(1), F.lit(0), F.lit(5)))) == "AM"
    assert one(S.find_all(F.lit("MAM"), "M")) == [0, 2] and one(S.find_all(F.lit(""), "M")) == []
    assert one(S.length_mask(F.lit(2), 3)) == [True, True, False]


def test_alternatives_and_loops(one):
    assert one(S.kmer_alternatives(F.lit("AACCG"))) == ["AACCG", "AMCCG", "MACCG", "MMCCG"]
    assert one(S.max_loop(F.lit("ACACACACAC"))) == 5 and one(S.max_loop(F.lit("MCACMCACAC"))) == 5
    assert one(S.iupac_to_regex("DRACH") and F.lit(S.iupac_to_regex("DRACH"))) == "[AGT][AG]AC[ACT]"


def test_paths(one):
    assert one(S.ctc_collapse("p")["seq"], p=[0, 1, 1, 0, 1, 5]) == "AAM"
    assert one(S.ctc_collapse("p")["moves"], p=[0, 1, 1, 0, 1, 5]) == [0, 1, 0, 0, 1, 1]
    assert one(S.path_to_seq(F.array(*map(F.lit, ["ACG", "ACG", "CGT"])))) == "ACGT"
    # bases at points 0, 2, 2, 5 of 7: the second has no point and takes one from the longest dwell
    assert one(S.path_from_alignment(F.lit("ACGT"), F.array(*map(F.lit, [0, 2, 2, 5])), F.lit(7), 1)) == list("AACGGTT")


def test_alignments(one):
    assert one(S.hard_clips(F.lit("5H10M3H"))) == (5, 3) and one(S.hard_clips(F.lit("10M"))) == (0, 0)
    assert one(S.count_cigar(F.lit("5H10M2D3M"), "M")) == 13
    assert [tuple(p) for p in one(S.aligned_pairs(F.lit(10), F.lit("1S2M1I1D1M")))] == [(0, None), (1, 10), (2, 11), (3, None), (None, 12), (4, 13)]
    # two reference bases without query, four aligned, three deleted, the rest aligned
    assert [tuple(p) for p in one(S.ref_index(F.lit("2S2M3D2M")))] == [(2, 1), (3, 1), (3, 0), (4, 0), (4, 0), (4, 1), (5, 1)]
    assert [tuple(p) for p in one(S.ref_index(F.lit("1M1D1M")))] == [(0, 1), (1, 0), (1, 1)]


def test_windows_and_text(one):
    assert one(S.site_segment(F.lit("ACGTM"), F.lit(0), F.lit(True), 1)) == "TM" and one(S.site_segment(F.lit("ACGTM"), F.lit(0), F.lit(False), 1)) == "AC"
    assert one(S.partition_bounds(F.lit(250), 100)) == [100, 200, 250] and one(S.partition_bounds(F.lit(249), 100)) == [100, 249] and one(S.partition_bounds(F.lit(30), 100)) == [30]
    assert one(S.format_qr_index(F.array(F.lit(1), F.lit(2)), F.array(F.lit(7)))) == "1:2|7"
    assert tuple(one(S.parse_qr_index(F.lit("1:2|7")))) == ([1, 2], [7]) and tuple(one(S.parse_qr_index(F.lit("|")))) == ([], [])
    assert [round(x, 6) for x in one(S.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))] == [0.5, 0.5]


def test_tags(one):
    assert one(T.expand_mm("g", "v"), g=[3, 2, 3], v=[24, 125, 33]) == [0, 0, 0, 24, 0, 0, 125, 0, 0, 0, 33]
    assert one(T.pad_ml("v", F.lit(3)), v=[1]) == [1, 0, 0] and one(T.pad_ml("v", F.lit(0)), v=[1]) is None
    parsed = one(T.parse_mm(F.lit("A+a?,3,2;C+m.,1;"), "v"), v=[24, 125, 7])
    assert {k: tuple(v) for k, v in parsed.items()} == {"A+a": ([3, 2], [24, 125]), "C+m": ([1], [7])}
    assert one(T.parse_mm(F.lit("A+a?,3;"), "v"), v=[1, 2]) is None
    assert {k: tuple(v) for k, v in one(T.parse_mm(F.lit("A+a?;"), F.array().cast("array<int>"))).items()} == {"A+a": ([], [])}
    with pytest.raises(PySparkException):
        one(T.parse_mm(F.lit("C+mh,1;"), "v"), v=[1])
    assert tuple(one(T.encode_mm("v"), v=[0, 5, 0, 0, 7])) == ([1, 2], [5, 7]) and tuple(one(T.encode_mm("v", merged=False), v=[0, 5])) == ([0, 0], [0, 5])
    found = one(T.mm_from_seq(F.lit("CATTATGGCTMTGCCA"), F.lit("(((*.12///035654")))
    assert (found.seq, found.gaps, found.likelihoods) == ("CATTATGGCTATGCCA", [2], [8])
    assert one(T.mm_text(F.array(F.lit(2)))) == "A+a?,2;" and one(T.mm_text(F.array().cast("array<int>"))) == "A+a?;"
    assert [one(T.int8_encode(F.lit(p))) for p in (0.0, 0.5, 1.0)] == [0, 128, 255]
    assert one(T.phred_string("q"), q=[0, 40]) == "!I" and one(T.phred_ints(F.lit("!I"))) == [0, 40]
