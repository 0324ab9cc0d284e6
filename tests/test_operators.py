"""Operators on small tables: edge cases that the comparison with SQL does not reach."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqspark.functions import sequence as S
from seqspark.operators import aggregates as A, datasets as D, filters as P, joins as J, pileup as L, segments as G, signal as N
from seqspark.sources import text as X


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_and_transitions(spark):
    path = spark.createDataFrame([(1, i, s) for i, s in enumerate("AABBBA")] + [(2, 0, "C")], "read_id int, pos int, state string")
    assert rows(G.runs(path)) == [(1, "A", 0, 1, 2), (1, "A", 5, 5, 1), (1, "B", 2, 4, 3), (2, "C", 0, 0, 1)]
    assert {(r.state, r.next_base): round(r.weight, 4) for r in A.transition_weights(path).collect()} == {("A", "B"): 0.5, ("B", "A"): 0.3333}


def test_quiet_and_short_signals(spark):
    points = spark.createDataFrame([(1, i, 5.0) for i in range(20)] + [(2, 0, 1.0)], "read_id int, pos int, value double")
    # without any noise the tail behind the last full window still counts as noisy
    assert rows(N.noisiest_range(points, samples=8)) == [(1, 15, 18)]
    assert all(r.norm is None for r in N.norm_med_mad(points).collect())
    assert N.diff_norm_fixed(points).count() == 19


def test_rescale_needs_five_effective_dwells(spark):
    path = spark.createDataFrame([(1, i, s, float(i)) for i, s in enumerate("AABBAABB")], "read_id int, pos int, state string, value double")
    model = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "kmer string, level_mean double")
    assert all(r.fitted for r in N.rescale_dwell(path, model, min_dwell=2).collect())
    few = N.rescale_dwell(path, model, min_dwell=2, effective=lambda s: s == "A").collect()
    assert not any(r.fitted for r in few) and all(r.rescaled == r.value for r in few)
    own = N.rescale_dwell(path, model, min_dwell=2, no_scale=True, statistic=F.max).where("pos = 0").first()
    assert own.rescaled == pytest.approx(1.5 - 4.0)  # mean level less mean of the runs' maxima


def test_chunks_of_short_reads(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "v array<double>")
    got = [[tuple(c) for c in r.x] for r in df.select(G.chunk_fixed("v", 2).alias("x")).collect()]
    assert got == [[(0, [1.0, 2.0], 2), (1, [3.0, 0.0], 1)], []]
    got = [[tuple(c) for c in r.x] for r in df.select(G.chunk_overlap("v", 2, 1).alias("x")).collect()]
    assert got == [[(0, [1.0, 2.0], 2), (1, [2.0, 3.0], 2)], [(0, [], 0)]]


def test_stitching_kernels(spark):
    calls = spark.createDataFrame([(1, 0, "ACGT" * 10), (1, 1, "CGTT"), (2, 0, "AC")], "read_id int, chunk_no int, seq string")
    assert [r.offset for r in G.stitch(calls).orderBy("read_id", "chunk_no").collect()] == [0, 40, 0]
    assert [r.offset for r in G.stitch(calls, "glue").orderBy("read_id", "chunk_no").collect()] == [0, 37, 0]
    G.STITCH["first"] = lambda df: df.withColumn("offset", F.lit(0).cast("long"))
    assert {r.offset for r in G.stitch(calls, "first").collect()} == {0}
    with pytest.raises(ValueError):
        G.stitch(calls, "none")


def test_index_and_sites(spark):
    reads, index = spark.createDataFrame([(1,), (2,)], "read_id int"), spark.createDataFrame([(1, "f")], "read_id int, file string")
    assert rows(J.keep_indexed(reads, index)) == [(1,)]
    with pytest.raises(PySparkException):
        J.require_index(reads, index).collect()
    pairs = spark.sql("SELECT array(named_struct('qpos', 0, 'refpos', 5), named_struct('qpos', CAST(NULL AS INT), 'refpos', 6), named_struct('qpos', 1, 'refpos', 7)) AS p")
    assert pairs.select(J.first_at_or_after("p", F.lit(6))["qpos"].alias("x")).first().x == 1
    assert pairs.select(J.first_at_or_after("p", F.lit(8)).alias("x")).first().x is None
    sites = spark.createDataFrame([("chr1", 5, 5), ("zz", 1, 1)], "contig string, s long, e long")
    aln = spark.createDataFrame([("chr1", 0, 4, "a"), ("chr1", 0, 5, "b"), ("chr1", 6, 9, "c"), ("chr1", 5, 5, "d")], "contig string, r_start long, r_end long, read_id string")
    ref = spark.createDataFrame([("chr1", 100)], "contig string, length long")
    assert sorted(r.read_id for r in J.overlap_join(sites, aln, ref).collect()) == ["b"]


def test_reference_windows_cross_slices(spark):
    seq = "".join("ACGT"[(i * 7 + i // 5) % 4] for i in range(1000))
    ref = spark.createDataFrame([("c", seq)], "contig string, seq string")
    df = spark.createDataFrame([("c", p) for p in (0, 3, 255, 256, 511, 512, 999)], "contig string, refpos int")
    got = {r.refpos: (r.refseq, r.b) for r in J.ref_window(df, ref, 5, 6, base="b").collect()}
    assert got == {p: (seq[max(p - 5, 0) : p + 6], seq[p]) for p in got} and len(got) == 7


def test_pileup_clips_and_reverse(spark):
    aln = spark.createDataFrame(
        [("f", 0, "c", 2, "5H2M1D3M3H", "ACAAA", "A+a?,1,1;", [10, 20]), ("r", 16, "c", 0, "5M", "TTACT", "A+a?,0,1;", [7, 9]), ("bad", 0, "c", 0, "5M", "AAAAA", "A+a?,1;", [1, 2]), ("more", 0, "c", 0, "2M", "AC", "A+a?,3;", [1])],
        "read_id string, flag int, contig string, pos int, cigar string, seq string, mm string, ml array<int>",
    )
    ref = spark.createDataFrame([("c", "AAACAGATTT", 10)], "contig string, seq string, length long")
    got = {(r.read_id, r.refpos): (r.qpos, r.likelihood, r.qbase, r.refbase, r.direction) for r in L.meth_pileup(aln, ref).collect()}
    assert got == {("f", 2): (5, 0, "A", "A", "+"), ("f", 5): (7, 10, "A", "G", "+"), ("f", 6): (8, 0, "A", "A", "+"), ("f", 7): (9, 20, "A", "T", "+"), ("r", 0): (0, 9, "T", "A", "-"), ("r", 1): (1, 0, "T", "A", "-"), ("r", 4): (4, 7, "T", "A", "-")}
    assert rows(L.pileup_report(aln)) == [("Corrupted_MM", 1), ("Inconsistent_ML", 1), ("Passed", 2)]
    assert {r.likelihood for r in L.meth_pileup(aln, ref, threshold=9).collect()} == {9, 10, 20}


def test_filters(spark):
    df = spark.createDataFrame([("AACCG",), ("MAC",), ("",), ("ACGTN",)], "seq string")
    assert rows(df.where(P.select_kmers("seq", "AC!M"))) == [("AACCG",), ("ACGTN",)]
    assert rows(P.and_filters([lambda d: P.min_length("seq"), lambda d: P.known_bases("seq"), lambda d: P.mono_filter("seq", 0.4)])(df)) == [("AACCG",), ("MAC",)]
    assert rows(P.filter_motif(df, "seq", "RA")) == [("AACCG",)] and rows(P.filter_motif(df, "seq", "C", anchor="center", reach=2)) == [("AACCG",), ("MAC",)]
    with pytest.raises(ValueError):
        P.filter_motif(df, "seq", "Z")
    flags = spark.sql("SELECT 0 AS flag, CAST(NULL AS MAP<STRING,STRING>) AS tags FROM range(300)")
    with pytest.raises(PySparkException):
        P.alignment_report(flags).collect()


def test_statistics(spark):
    none = spark.createDataFrame([("CCC",)], "seq string").withColumn("read_id", F.lit(1))
    assert A.m6a_ratio(none).first().ratio != A.m6a_ratio(none).first().ratio
    curve = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, float("nan")), (2, 4.0)], "step int, error double")
    assert [(r.step, r.mean, r.std, r.smooth) for r in A.training_curve(curve, 0.5).orderBy("step").collect()] == [(1, 2.0, 1.0, 2.0), (2, 4.0, 0.0, 3.0)]
    calls = spark.createDataFrame([(1, 0, 2, -0.5), (1, 0, 1, -0.5), (1, 1, 5, -1.0)], "read_id int, pos int, base int, logp double")
    assert A.consensus(calls).first().seq == "AM"
    with pytest.raises(PySparkException):
        A.check_kinds(spark.createDataFrame([("AM",)], "seq string")).collect()


def test_datasets(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "k int, s int")
    split = D.shuffle_split(df, 7, "k")
    assert split.where("split = 'eval'").count() == 7 and split.count() == 20
    assert rows(D.shuffle_split(df, 7, "k")) == rows(split)
    assert D.merge_equal([df, df.limit(0)], "k").count() == 0
    assert sorted(r.batch for r in G.batch_number(df, "k", 8).collect()) == [0] * 8 + [1] * 8 + [2] * 4


def test_distill_and_segments(spark):
    bases = spark.createDataFrame([(1, i, "ACGT"[i % 4], i * 10, i * 10 + 10, None if i == 4 else 50 + i) for i in range(9)], "read_id int, base_index long, base string, sig_start long, sig_end long, ref_pos long")
    assert [(r.first_base, r.last_base, r.seq) for r in G.distill(bases, 50).collect()] == [(0, 3, "ACGT")]
    path = spark.createDataFrame([(1, i, s) for i, s in enumerate("CCCAAACCCCCAAC")], "read_id int, pos int, state string")
    got = G.invariant_segments(path, lambda s: s == "C", 5).collect()
    assert sorted((r.start, r.end) for r in got) == [(0, 6), (6, 13)]


def test_readers_reject_bad_files(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1\nACGT\n+\nIIII\n@r2\nAC\n-\nII\n")
    with pytest.raises(PySparkException):
        X.read_fastq(spark, str(tmp_path / "a.fastq")).collect()
    (tmp_path / "b.fa").write_text(">c1 words\nAC\nGT\n>\n>c2\n\n")
    assert rows(X.read_fasta(spark, str(tmp_path / "b.fa"))) == [("c1", "ACGT", 4), ("c2", "", 0)]
    (tmp_path / "c.gff3").write_text("#x\nChr1\ts\tmRNA\t1\t9\t.\t+\t.\tID=transcript:t1;Parent=gene:g1\nChr1\ts\texon\t1\t4\t.\t+\t.\tParent=transcript:t1\nChr1\ts\texon\t6\t9\t.\t+\t.\tParent=transcript:t1\n")
    assert rows(X.read_annotation(spark, str(tmp_path / "c.gff3"), "gff3").select("tx_id", "gene_id", "chr", "start", "ord")) == [("t1", "g1", "1", 1, 1), ("t1", "g1", "1", 6, 2)]
    assert X.program_headers(["@HD", "@PG\tID:a", "@PG\tID:me\told"], "me", "VN:2") == ["@HD", "@PG\tID:a", "@PG\tID:me\tVN:2\tPP:a"]


def test_segments_and_records_against_plain_walks(spark):
    rng = random.Random(5)
    paths = {r: "".join(rng.choice("CCA") * rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))) for r in range(30)}
    path = spark.createDataFrame([(r, i, s) for r, p in paths.items() for i, s in enumerate(p)], "read_id int, pos int, state string")
    want = set()
    for r, p in paths.items():
        open_ = None
        for i, s in enumerate(p):
            if s == "C" and (i == 0 or p[i - 1] != "C"):
                if open_ is not None and i - open_ >= 7:
                    want.add((r, open_, i))
                    open_ = None
                open_ = i if open_ is None else open_
    assert {(r.read_id, r.start, r.end) for r in G.invariant_segments(path, lambda s: s == "C", 7).collect()} == want and len(want) > 20

    bases, want = [], []
    for read in range(20):
        at, own = 0, []
        for i in range(rng.randrange(1, 60)):
            n = rng.randrange(1, 9)
            own.append((read, i, rng.choice("ACGT"), at, at + n, None if rng.random() < 0.2 else 100 + i))
            at += n
        bases += own
        i = 0
        while i < len(own):
            ends = [j for j in range(i + 1, len(own)) if own[j][4] - own[i][3] <= 30 and own[j][5] is not None]
            if own[i][5] is not None and ends and len(own[i : ends[-1] + 1]) >= 3:
                want.append((read, i, ends[-1], "".join(b[2] for b in own[i : ends[-1] + 1])))
                i = ends[-1] + 1
            else:
                i += 5
    got = G.distill(spark.createDataFrame(bases, "read_id int, base_index long, base string, sig_start long, sig_end long, ref_pos long"), 30)
    assert sorted((r.read_id, r.first_base, r.last_base, r.seq) for r in got.collect()) == sorted(want)


def test_unmatched_reads_go(spark):
    rng = random.Random(6)
    rows = []
    for i in range(80):
        seq = "".join(rng.choice("ACGT") for _ in range(60))
        call = seq[:20] + "A" + seq[20:40] + seq[41:] if i % 4 else "".join(rng.choice("ACGT") for _ in range(60))
        reverse = i % 2 == 0
        rows.append((i, seq, call.translate(str.maketrans("ACGT", "TGCA"))[::-1] if reverse else call, reverse))
    df = spark.createDataFrame(rows, "read_id int, query string, basecall string, reverse boolean")
    # the two kinds lie far apart, so the Gaussians' means are those of the kinds
    distance = {i: _levenshtein(seq, call.translate(str.maketrans("ACGT", "TGCA"))[::-1] if reverse else call) for i, seq, call, reverse in rows}
    near, far = ([d for i, d in distance.items() if bool(i % 4) == kind] for kind in (True, False))
    mark = sum(near) / len(near) + 0.95 * (sum(far) / len(far) - sum(near) / len(near))
    got = {r.read_id: r.distance for r in P.exclude_unmatched_reads(df, "query", "basecall", "reverse").collect()}
    assert got == {i: d for i, d in distance.items() if d < mark} and set(got) >= {i for i in range(80) if i % 4} and len(got) < 80


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_numbers_over_ranges(spark):
    from seqspark.operators.ranks import numbered

    df = spark.createDataFrame([(i * 7 % 3001, None if i % 3 == 0 else i % 3) for i in range(3001)], "k int, s int")
    got = {(r.s, r.k): r._n for r in numbered(df, "k", "s").collect()}
    for s in (None, 1, 2):
        assert [got[x] for x in sorted((x for x in got if x[0] == s), key=lambda x: x[1])] == list(range(1, sum(x[0] == s for x in got) + 1))
    assert D.limit_per_dataset(df, 1001, "s", "k").groupBy("s").count().where("count <> LEAST(1001, count)").count() == 0


def test_smoothing_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_STEPS", 5)
    rng = random.Random(7)
    means = [float("nan") if i in (0, 12, 15, 19, 20) else rng.random() for i in range(37)]
    want, last = [], None
    for m in means:
        last = None if m != m else m if last is None else 0.8 * last + 0.2 * m
        want.append(last)
    got = A.training_curve(spark.createDataFrame(list(enumerate(means)), "step int, error double"), 0.8).orderBy("step").collect()
    assert [r.smooth for r in got] == [None if w is None else pytest.approx(w) for w in want]


def test_pileup_files_have_one_header(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i % 3}", 9000 - i, None if i == 5 else "x") for i in range(200)], "contig string, refpos long, read_id string")
    X.write_pileup_tsv(df.select("refpos", "contig", "read_id"), str(tmp_path / "p"))
    lines = [x for f in sorted((tmp_path / "p").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == "contig\trefpos\tread_id" and lines.count(lines[0]) == 1
    assert [tuple(x.split("\t")[:2]) for x in lines[1:]] == [(c, str(p)) for c, p in sorted((r.contig, r.refpos) for r in df.collect())]
    assert X.read_pileup_tsv(spark, str(tmp_path / "p")).count() == 200


def test_fastq_is_read_in_splits(spark, tmp_path):
    records = [(f"r{i}", "ACGT" * (i % 40 + 1), "@I+I" * (i % 40 + 1)) for i in range(500)]
    (tmp_path / "a.fastq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records) + "@cut\nAC\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert rows(X.read_fastq(spark, str(tmp_path / "a.fastq"))) == sorted(records)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pileup_of_other_modifications(spark):
    aln = spark.createDataFrame([("f", 0, "c", 0, "4M", "ACGC", "C+m?,1;", [9])], "read_id string, flag int, contig string, pos int, cigar string, seq string, mm string, ml array<int>")
    ref = spark.createDataFrame([("c", "ACGC", 4)], "contig string, seq string, length long")
    assert {(r.refpos, r.likelihood) for r in L.meth_pileup(aln, ref, "5mC").collect()} == {(1, 0), (3, 9)}
    assert len(L.CODES) == 10


def test_views_of_whole_texts_are_read_once(spark):
    from seqspark.plans import reads as _  # noqa: F401
    from seqspark.plans.catalog import QUERIES

    plan = QUERIES["record_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace") == 1


def test_distances_of_matched_reads_are_measured_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(s):
        seen.add(1)
        return s

    df = spark.createDataFrame([(i, "ACGT" * 9, "ACGT" * 9 if i % 4 else "TTTT" * 9, False) for i in range(40)], "read_id int, query string, own string, reverse boolean")
    got = P.exclude_unmatched_reads(df.select("read_id", "query", "reverse", counted("own").alias("basecall")), "query", "basecall", "reverse")
    assert {r.read_id for r in got.collect()} == {i for i in range(40) if i % 4} and seen.value == 40


def test_spans_of_places_on_the_genome(spark):
    ranges = spark.createDataFrame(
        [(1, 0, 99, 1000, 1099, "+"), (1, 100, 599, 2000, 2499, "+"), (2, 0, 4, 10, 14, "-"), (2, 5, 9, 30, 34, "-")], "tx_id long, tx_start long, tx_end long, g_start long, g_end long, strand string"
    )
    spans = spark.createDataFrame([(1, 50, 700, "a"), (1, 98, 101, "b"), (2, 3, 6, "c"), (2, 6, 5, "d"), (3, 0, 9, "e"), (1, 255, 256, "f")], "tx_id long, tx_pos long, last long, name string")
    places = [(t, p, n) for t, lo, hi, n in spans.collect() for p in range(lo, hi + 1)]
    want = rows(J.transcript_to_genome(spark.createDataFrame(places, "tx_id long, tx_pos long, name string"), ranges).select("tx_id", "name", "tx_pos", "g_pos"))
    got = J.transcript_to_genome(spans, ranges, last="last")
    assert rows(got.select("tx_id", "name", "tx_pos", "g_pos")) == want and len(want) == 550 + 4 + 4 + 2
    # places are made behind the join, not shuffled to it
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence(_lo") < plan.index("Join")


def test_annotations_are_sorted_once(spark, tmp_path):
    line = 'chr1\tm\t{}\t{}\t{}\t.\t+\t.\tgene_id "g"; transcript_id "{}";'
    (tmp_path / "a.gtf").write_text("\n".join(line.format(kind, i, i + 1, tx) for i, (kind, tx) in enumerate([("CDS", "a"), ("exon", "a"), ("CDS", "b"), ("exon", "a"), ("CDS", "b")])))
    got = X.read_annotation(spark, str(tmp_path / "a.gtf"))
    assert rows(got.select("tx_id", "start", "ord")) == [("a.1", 1, 1), ("a.1", 3, 2), ("b.1", 2, 1), ("b.1", 4, 2)]
    plan = got._jdf.queryExecution().sparkPlan().toString() and got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_reference_places_of_query_bases(spark):
    rows_ = [(7, "3M2I4M1D2M"), (0, "2H3S5=2X1N1M2S"), (4, "0M3M"), (None, "2M"), (1, None), (2, "5D3P")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "i int, pos int, cigar string")
    pairs = F.transform(F.filter(S.aligned_pairs("pos", "cigar"), lambda p: p["qpos"].isNotNull()), lambda p: p["refpos"])
    got = df.select("i", S.ref_places("pos", "cigar").alias("at"), pairs.alias("plain")).orderBy("i").collect()
    assert [r["at"] for r in got] == [r["plain"] for r in got]
    assert got[0]["at"] == [7, 8, 9, None, None, 10, 11, 12, 13, 15, 16]


def test_pileup_follows_insertions(spark):
    aln = spark.createDataFrame([("a", 0, "c", 1, "2M1I3M", "AACAAT", "A+a?,0,1;", [9, 8])], "read_id string, flag int, contig string, pos int, cigar string, seq string, mm string, ml array<int>")
    ref = spark.createDataFrame([("c", "GAATAAT", 7)], "contig string, seq string, length long")
    pile = L.meth_pileup(aln, ref, reach=1)
    assert {(r.refpos, r.qpos, r.likelihood, r.refbase, r.refseq) for r in pile.collect()} == {(1, 0, 9, "A", "GAA"), (2, 1, 0, "A", "AAT"), (3, 3, 8, "T", "ATA"), (4, 4, 0, "A", "TAA")}
