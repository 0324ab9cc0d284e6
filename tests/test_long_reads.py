"""Operators on reads, references and bins of production size, and against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_operators import _levenshtein, rows

from seqspark.functions import distance as E, sequence as S
from seqspark.operators import aggregates as A, joins as J, ranks, segments as G
from seqspark.sources import text as X


def _seq(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def _edited(rng, seq, share):
    out = []
    for c in seq:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(c if x >= share else rng.choice("ACGT") if x < 2 * share / 3 else c + rng.choice("ACGT"))
    return "".join(out)


def test_kmers_of_long_reads(spark):
    rng = random.Random(1)
    texts = [_seq(rng, 200_000, "ACGTM"), "", "AC", "ACG", _seq(rng, 64), _seq(rng, 65), _seq(rng, 130), "é😀\nACGT" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(1).cache()
    for k in (1, 3, 5, 70):
        got = {r.i: r.x for r in df.select("i", S.kmers("s", k).alias("x")).collect()}
        assert got == {i: [t[j : j + k] for j in range(len(t) - k + 1)] for i, t in enumerate(texts)}, k
    code = {c: i for i, c in enumerate(S.ALPHABET)}
    want = {i: [None if any(c not in code for c in t[j : j + 4]) else sum(code[c] * 5 ** (3 - d) for d, c in enumerate(t[j : j + 4])) for j in range(len(t) - 3)] or [-1] for i, t in enumerate(texts)}
    assert {r.i: r.x for r in df.select("i", S.kmer_codes("s", 4).alias("x")).collect()} == want
    # linear: five times the bases in far less than 25 times the time
    long = spark.createDataFrame([(1, _seq(rng, 1_000_000))], "i int, s string").cache()
    spent = []
    for own in (df.where("i = 0"), long):
        own.count()
        start = time.time()
        assert own.select(F.size(S.kmers("s", 5)).alias("n")).first().n == own.select(F.length("s").alias("n")).first().n - 4
        spent.append(time.time() - start)
    assert spent[1] < 15 * max(spent[0], 1.0)


def test_edit_distance_of_short_long_and_odd_texts(spark):
    rng = random.Random(2)
    pairs = [(None, "A"), ("A", None), ("", ""), ("", "ACG"), ("ACG", ""), ("é漢😀a", "é漢a"), ("AAAA", "TTTT"), ("ACGT" * 5, "CGTA" * 5), ("A" * 30, "A" * 9)]
    for _ in range(150):
        a = _seq(rng, rng.randrange(40), "ACGTé" if rng.random() < 0.2 else "ACGT")
        pairs.append((a, _edited(rng, a, rng.choice([0.05, 0.3, 0.9])) if rng.random() < 0.8 else _seq(rng, rng.randrange(40))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    want = {i: None if a is None or b is None else _levenshtein(a, b) for i, (a, b) in enumerate(pairs)}
    for long in (0, 100, E.LONG):
        assert {r.i: r.d for r in df.select("i", E.edit_distance("a", "b", long).alias("d")).collect()} == want, long


def test_edit_distance_of_20000_bases(spark):
    rng = random.Random(3)
    a = _seq(rng, 20_000)
    b = _edited(rng, a, 0.05)
    df = spark.createDataFrame([(a, b)], "a string, b string").cache()
    want = df.select(F.levenshtein("a", "b", 1500).alias("d")).first().d
    start = time.time()
    assert df.select(E.edit_distance("a", "b").alias("d")).first().d == want > 500
    assert time.time() - start < 20
    # few edits: the time follows the length
    far = _seq(rng, 1_000_000)
    near = far[:300_000] + "AC" + far[300_000:700_001] + far[700_003:]
    assert spark.createDataFrame([(far, near)], "a string, b string").select(E.edit_distance("a", "b").alias("d")).first().d in (3, 4)


def test_bounds_of_permutations(spark):
    rng = random.Random(4)
    pairs = [(_seq(rng, rng.randrange(1, 30), "ACGTM"), _seq(rng, rng.randrange(1, 30), "ACGTN")) for _ in range(80)]
    df = spark.createDataFrame(pairs, "pred string, ref string")
    for o in ("ACGT", "TGCA", "CATG"):
        assert df.where(A.letter_bound("pred", "ref", "ACGT", o) > F.levenshtein(F.translate("pred", "ACGT", o), "ref")).count() == 0
    assert df.where(A.letter_bound("pred", "ref", "ACGT", "ACGT") > 3).count() > 5


@pytest.mark.parametrize("n", [0, 1, 60])
def test_best_permutation(spark, n):
    from itertools import permutations

    rng = random.Random(n)
    pairs = []
    for _ in range(n):
        ref = _seq(rng, rng.randrange(1, 50))
        pairs.append((_edited(rng, ref, 0.2).translate(str.maketrans("GTCA", "ACGT")), ref))
    pairs += [("AC", ""), (None, "ACG")]
    own = [(p, r) for p, r in pairs if r and p is not None]
    means = {"".join(o): round(sum(_levenshtein(p.translate(str.maketrans("ACGT", "".join(o))), r) / len(r) for p, r in own) / max(len(own), 1), 9) for o in permutations("ACGT")}
    got = A.permute_error(spark.createDataFrame(pairs, "pred string, ref string")).first()
    best = min(means, key=lambda o: (means[o], o))
    assert got.permutation == best and (got.error is None if not own else got.error == pytest.approx(means[best], abs=1e-8))


def test_one_bin_with_most_records_is_many_tasks(spark):
    rng = random.Random(5)
    records = [(i, "c", at, at + 5) for i, at in enumerate([10] * 4500 + [rng.randrange(995) for _ in range(500)])]
    df = spark.createDataFrame(records, "read_id int, contig string, r_start long, r_end long")
    ref = spark.createDataFrame([("c", 1000)], "contig string, length long")
    bins = {i: range(s // 100, (e - 1) // 100 + 1) for i, _, s, e in records}
    counts = [sum(b in own for own in bins.values()) for b in range(10)]
    mean = sum(counts) / 10
    cap = mean + 0.5 * max((sum((c - mean) ** 2 for c in counts) / 10) ** 0.5, 1)
    place, kept = [0] * 10, set()
    for i in sorted(bins):
        ok = True
        for b in bins[i]:
            place[b] += 1
            ok &= place[b] <= cap
        if ok:
            kept.add(i)
    assert {r.read_id for r in G.balance_by_reference(df, ref, 100, 0.5).collect()} == kept and len(kept) < 3000
    # the bin's records come to all partitions
    hot = df.withColumn("bin", F.floor(F.col("r_start") / 100))
    shares = [r["count"] for r in hot.repartitionByRange(4, "contig", "bin", "read_id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < 0.4 * 5000
    got = ranks.numbered(hot, "read_id", ("contig", "bin"), "n").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.read_id):
        by.setdefault((r.contig, r.bin), []).append(r.n)
    assert all(n == list(range(1, len(n) + 1)) for n in by.values()) and len(got) == 5000


def test_transcripts_of_many_exons(spark):
    rng = random.Random(6)
    exons, want = [], []
    for tx in range(6):
        at, place, strand = 0, 0, rng.choice("+-")
        for i in range(rng.choice([1, 3, 300])):
            n = rng.choice([1, 7, 900])
            at += rng.randrange(1, 50)
            exons.append((f"t{tx}", i, strand, at, at + n - 1))
            want += [(f"t{tx}", place + d, at + d if strand == "+" else at + n - 1 - d) for d in range(n)]
            at, place = at + n, place + n
    df = spark.createDataFrame(exons, "tx_id string, ord int, strand string, g_start long, g_end long")
    asked = [(t, p) for t, p, _ in want] + [("t0", -1), ("t0", 10**6), ("no", 1), (None, 1), ("t1", None)]
    places = spark.createDataFrame(asked, "tx_id string, tx_pos long")
    got = J.transcript_to_genome(places, G.tx_ranges(df))
    assert rows(got.select("tx_id", "tx_pos", "g_pos")) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "collect_list" in plan


def test_sides_of_unequal_length_without_numbers(spark):
    left = spark.createDataFrame([(f"l{i:03}", -i) for i in range(70)], "l string, at int").repartition(5)
    right = spark.createDataFrame([(f"r{i:03}",) for i in range(101)], "r string").repartition(3)
    got = J.zip_truncate(left, right, orders=("at", "r")).collect()
    assert sorted((r.row, r.l, r.r) for r in got) == [(i, f"l{69 - i:03}", f"r{i:03}") for i in range(70)]
    assert J.zip_truncate(left, right.limit(0), orders=("at", "r")).count() == 0


def test_walks_over_long_reads(spark):
    n = 200_000
    path = spark.range(n).select(F.lit(1).alias("read_id"), F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "C").otherwise("A").alias("state"))
    start = time.time()
    got = G.invariant_segments(path, lambda s: s == "C", 1)
    assert got.agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("end").alias("b"), F.max(F.col("end") - F.col("start")).alias("d")).first()[:] == (n // 2 - 1, 0, n - 2, 2)
    bases = spark.range(n).select(F.lit(1).alias("read_id"), F.col("id").alias("base_index"), F.lit("A").alias("base"), (F.col("id") * 3).alias("sig_start"), (F.col("id") * 3 + 3).alias("sig_end"), F.col("id").alias("ref_pos"))
    got = G.distill(bases, 30, keep=lambda n_bases, n_points: (n_bases >= 10) & (n_points == 30))
    assert got.agg(F.count("*").alias("n"), F.min(F.length("seq")).alias("m"), F.max("last_base").alias("b")).first()[:] == (n // 10, 10, n - 1)
    assert time.time() - start < 90


def test_tags_keep_their_types(spark, tmp_path):
    line = "r1\t0\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:3\tmv:B:c,5,1,0\tMM:Z:A+a?,1;\tde:f:0.5\tML:B:C,9\tXX:Z:a:b c\ttp:A:P\tNM:i:4\tbad"
    (tmp_path / "a.sam").write_text(f"@HD\tVN:1.6\n{line}\nr0\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    back = X.read_sam(spark, str(tmp_path / "a.sam")).orderBy("line_no")
    first, second = back.collect()
    assert {k: tuple(v) for k, v in first.tags.items()} == {"NM": ("i", "3"), "mv": ("B", "c,5,1,0"), "MM": ("Z", "A+a?,1;"), "de": ("f", "0.5"), "ML": ("B", "C,9"), "XX": ("Z", "a:b c"), "tp": ("A", "P")}
    assert second.tags == {} and second.pos == -1
    own = back.select(X.tag_value("tags", "NM", "int").alias("nm"), X.tag_value("tags", "mv", "array<int>").alias("mv"), X.tag_value("tags", "NM", "array<int>").alias("no")).collect()
    assert [tuple(r) for r in own] == [(3, [5, 1, 0], None), (None, None, None)]
    tagged = back.withColumn("mm", F.when(F.col("read_id") == "r1", "A+a?,0;")).withColumn("ml", F.array(F.lit(7)))
    new = line.replace("A+a?,1;", "A+a?,0;").replace("C,9", "C,7").removesuffix("\tNM:i:4\tbad")
    assert [r.line for r in X.sam_lines(tagged).orderBy("line_no").collect()] == [new, "r0\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]
    assert [r.line.split("\t")[-2:] for r in X.sam_lines(tagged.withColumn("mm", F.lit("A+a?;")).drop("tags").withColumn("ml", F.array().cast("array<int>"))).collect()] == [["MM:Z:A+a?;", "ML:B:C"]] * 2
    many = spark.range(300).select(F.format_string("r%03d", "id").alias("read_id"), *(F.lit(0).alias(c) for c in ("flag", "pos", "mapq", "pnext", "tlen")), *(F.lit("*").alias(c) for c in ("contig", "cigar", "rnext", "seq", "quality")), ((F.col("id") * 7) % 300).alias("line_no")).repartition(5)
    X.write_sam_tagged(many, ["@HD\tVN:1.6"], str(tmp_path / "out"), "me", "VN:1")
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[:2] == ["@HD\tVN:1.6", "@PG\tID:me\tVN:1"] and [x.split("\t")[0] for x in lines[2:]] == [f"r{i:03}" for i in sorted(range(300), key=lambda i: i * 7 % 300)]


@pytest.mark.parametrize("block", ["64", "700", "1000000"])
def test_fasta_lines_over_splits(spark, tmp_path, block):
    rng = random.Random(7)
    want = {}
    for name in ("a", "b"):
        text = "stray\n" if name == "a" else ""
        for i in range(5):
            seq, width = _seq(rng, rng.choice([0, 1, 90, 1500])), rng.choice([7, 60, 10_000])
            want[f"{name}{i}"] = seq
            text += f">{name}{i} more words\n" + "".join(seq[k : k + width] + rng.choice(["\n", "\r\n"]) for k in range(0, len(seq), width)) + rng.choice(["", "\n"])
        (tmp_path / f"{name}.fa").write_text(text + ">\nACGT\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        lines = X.read_fasta_lines(spark, str(tmp_path), longest=500).cache()
        got = {}
        for r in sorted(lines.collect()):
            assert len(got.setdefault(r.contig, "")) == r.start and 0 < len(r.seq) <= 500
            got[r.contig] += r.seq
        assert got == {k: v for k, v in want.items() if v}
        whole = spark.createDataFrame(list(want.items()), "contig string, seq string").where("seq <> ''")
        assert rows(J.reference_slices(lines, 5, 7, 16).select("contig", "bin", "slice_start", "slice")) == rows(J.reference_slices(whole, 5, 7, 16))
        if block == "64":
            assert X._numbered_lines(spark, str(tmp_path))[1].count() > 20  # blocks, each a task of its own
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sam_lines_keep_the_order_of_a_folder_whatever_its_files_sizes(spark, tmp_path):
    line = "{}\t0\tc\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\n"
    (tmp_path / "sam").mkdir()
    names = [f"r{i}" for i in range(60)]
    for part, (lo, hi) in enumerate([(0, 2), (2, 50), (50, 60)]):
        (tmp_path / "sam" / f"part-{part}.txt").write_text(("@HD\tVN:1.6\n" if part == 0 else "") + "".join(map(line.format, names[lo:hi])))
    assert [r.read_id for r in X.read_sam(spark, str(tmp_path / "sam")).orderBy("line_no").collect()] == names


def test_distances_of_unlike_long_reads_go_by_columns(spark):
    rng = random.Random(11)
    for letters in ("AC", "ACGT", "ACGTé\U0001f600"):
        for _ in range(300):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2))
            assert E.by_columns(a, b) == E._along_diagonals()(a, b, 1 << 30) == E._measured()(a, b)
    pairs = [(s := _seq(rng, 12_000), s[::-1]) for _ in range(12)]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(1)
    start = time.time()
    got = [r[0] for r in df.select(E.edit_distance("a", "b")).collect()]
    assert time.time() - start < 30  # along the diagonals alone, some 50 s
    assert sorted(got) == sorted(E.by_columns(b, a) for a, b in pairs)


def test_pairs_of_a_permutation_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(s):
        seen.add(1)
        return s

    df = spark.createDataFrame([("ACGT" * i,) for i in range(1, 41)], "own string")
    got = A.permute_error(df.select(F.translate("own", "ACGT", "CATG").alias("pred"), counted("own").alias("ref"))).first()
    # once for the filter and once for the table at most, not again for each permutation
    assert got.error == 0.0 and "".join(got.permutation["ACGT".index(c)] for c in "CATG") == "ACGT"
    assert seen.value <= 80
