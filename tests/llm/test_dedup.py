"""Suffix, substring, near-duplicate and line dedup against brute force, with the defined edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqspark.llm import line_dedup, near_copies, simhash, substring_dedup, suffix_dedup

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string"


def _key(i):
    return (1 << 62) if i is None or i != i else int(i)


def _bytes(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def _texts(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé ") for _ in range(300))
    texts = [None, "", "a" * 500, "ab" * 300, base, base, base[:100] + "X" + base[100:], base[50:200], "\0" * 90]
    for _ in range(40):
        i = rng.randrange(250)
        texts.append("".join(rng.choice("abc") for _ in range(rng.randrange(60))) + base[i : i + rng.randrange(10, 120)] + "".join(rng.choice("abc") for _ in range(rng.randrange(60))))
    return texts


def _covered(texts, length):
    """Bytes of each text under a repeated string of ``length`` bytes, and their runs."""
    return [(r[1], r[2]) for r in _bytes(texts, length)]


def _suffix_rows(df):
    rows = sorted((_key(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256), (r.n_passage_bytes, r.n_passages)) for r in df.collect())
    return [r[1] for r in rows], [r[2] for r in rows]


@pytest.mark.parametrize("group", [4096, 3])
def test_suffix_dedup_is_exact(spark, group):
    texts = _texts(5)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], f"{SCHEMA}, key string, at int, ctx int")
    for passage in (25, 40):
        got = _suffix_rows(suffix_dedup.drop_repeats(docs, 40, 8, group, passage))
        assert got == (_bytes(texts, 40), _covered(texts, passage))


def test_suffix_dedup_reads_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 300)
    texts = _texts(6)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(60)
    assert _suffix_rows(suffix_dedup.drop_repeats(docs, 40, 8, passage=30)) == (_bytes(texts, 40), _covered(texts, 30))


def test_suffix_dedup_of_null_and_repeated_ids(spark):
    text = "".join(random.Random(3).choice("abcdef ") for _ in range(500))
    rows = [(None, text), (None, text), (1, text), (1, "x" + text), (2, "short"), (None, None)]
    got = Counter((_key(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter({(1 << 62, 500, 500): 2, (1, 500, 500): 1, (1, 501, 500): 1, (2, 5, 0): 1, (1 << 62, 0, 0): 1})


def _thue_morse(n, a, b):
    """Words that a polynomial hash modulo 2**64 cannot tell from those with a and b exchanged."""
    return ["".join((a, b)[(bin(i).count("1") + f) % 2] for i in range(n)) for f in (0, 1)]


def test_equality_is_not_decided_by_a_polynomial(spark):
    one, two = _thue_morse(4096, "a", "b")
    lead = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{lead} {one}"), (2, f"{lead} {two}")], SCHEMA)
    assert {r.n_removed for r in substring_dedup.drop_repeats(docs).collect()} == {0}
    docs = spark.createDataFrame([(1, "x" + one[:200]), (2, "y" + two[:200])], SCHEMA)
    assert _suffix_rows(suffix_dedup.drop_repeats(docs, 200, 8))[0] == _bytes(["x" + one[:200], "y" + two[:200]], 200)


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 64))) for _ in range(300)]
    strings += strings[:50]
    grid = np.zeros((len(strings), 64), dtype=np.uint8)
    for i, s in enumerate(strings):
        grid[i, : len(s)] = np.frombuffer(s, dtype=np.uint8)
    group = np.array([i % 3 for i in range(len(strings))])
    order, common = suffix_dedup.suffix_order(grid, group)
    held = [(group[i], grid[i].tobytes()) for i in order]
    assert held == sorted(held)
    for a, b, n in zip(held, held[1:], common[1:].tolist()):
        assert n == (-1 if a[0] != b[0] else next((i for i in range(64) if a[1][i] != b[1][i]), 64))


def test_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.drop_repeats(docs).count() == 0
    assert substring_dedup.drop_repeats(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], f"{SCHEMA}, source string")).count() == 0


def _words(rows, n=13):
    split = [(_key(d), re.findall(WORD, t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            first[k] = min(first.get(k, 1 << 63), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < d:
                gone[p : p + n] = [True] * n
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


_GROUPS = [20_000, 5]


@pytest.mark.parametrize("group", _GROUPS)
def test_substring_dedup_is_exact(spark, group):
    rng = random.Random(7)
    base = [rng.choice("ab cd é f g h".split()) for _ in range(200)]
    rows = [(1, None), (2, ""), (3, "a " * 500), (4, " ".join(base)), (5, " ".join(base)), (5, " ".join(base) + " x"), (5, " ".join(base)), (None, " ".join(base)), (None, " ".join(base[:50])), (0, " \n".join(base[30:60]))]
    for _ in range(50):
        a = rng.randrange(150)
        rows.append((rng.randrange(10, 60), " ".join(rng.choice("xyz") for _ in range(rng.randrange(20))) + " " + " ".join(base[a : a + rng.randrange(5, 60)]) + "  y"))
    got = substring_dedup.drop_repeats(spark.createDataFrame(rows, SCHEMA), group=group).collect()
    assert sorted((_key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == _words(rows)
    if group == max(_GROUPS):  # ids of other types, in their own order
        for schema, own in (("doc_id string, text string", lambda i: f"d{i:05}"), ("doc_id double, text string", float)):
            named = spark.createDataFrame([(None if i is None else own(i), t) for i, t in rows], schema)
            other = {own(i): i for i, _ in rows if i is not None} | {None: None}
            got = substring_dedup.drop_repeats(named, group=group).collect()
            assert sorted((_key(other[r.doc_id]), r.n_words, r.n_removed, r.kept_sha256) for r in got) == _words(rows)


def _print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(WORD, low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(rows):
    prints = [_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted((_key(d), f"{prints[i]:016x}", _key(min(least[root(i)], default=None))) for i, (d, _) in enumerate(rows))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    base = [rng.choice("Ab cd É f gh".split()) for _ in range(400)]
    rows = [(None, None), (9, ""), (8, " \n"), (7, "One two"), (None, "one TWO"), (6, "x"), (6, "x")]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice("pq r".split())
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join(rng.choice("k l m n o p".split()) for _ in range(50))) for i in range(30)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((_key(r.doc_id), f"{r.bits % (1 << 64):016x}", _key(r.component_id)) for r in got) == _components(rows)


@pytest.mark.parametrize("bucket", [2048, 4])
def test_near_links_join_all_that_is_linked(spark, bucket):
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(8):
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                q ^= 1 << b
            prints.add(q)
    prints |= {(7 << 32) | x for x in range(60)}  # one hot segment
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "bits long"), 3, bucket).collect()
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 3 for r in links)

    def parts(pairs):
        parent = {p: p for p in signed}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            parent[root(a)] = root(b)
        groups = defaultdict(set)
        for p in signed:
            groups[root(p)].add(p)
        return sorted(map(sorted, groups.values()))

    brute = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 3]
    assert parts([(r.a, r.b) for r in links]) == parts(brute)


def test_keep_one_keeps_the_first_of_each_group(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (2, "quite another text here"), (None, "a b c d")], SCHEMA)
    assert sorted(_key(r.doc_id) for r in simhash.keep_one(docs).collect()) == [1, 2, 1 << 62]


def test_keep_one_keeps_repeated_rows_once(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "A b c d"), (None, "x"), (None, "x"), (None, "y"), (2, "a b c d")]
    for operator in (simhash, near_copies):
        got = Counter((_key(r.doc_id), r.text) for r in operator.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
        assert got == Counter({(1, "a b c d"): 1, (1, "A b c d"): 1, (1 << 62, "x"): 1, (1 << 62, "y"): 1})


def _shingles(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("bucket", [2048, 3])
def test_near_copies_match_brute_force(spark, bucket):
    rng = random.Random(21)
    rows = [(None, None), (9, ""), (8, " \n"), (7, "One two"), (None, "one TWO"), (6, "x"), (6, "x")]
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for i in range(8):  # similarities from 0.6 to 1, most of them over three SimHash bits apart
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(3000)}"
            rows.append((100 + 10 * g + i, " ".join(w)))
    sets = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], _key(d))
    got = near_copies.groups(spark.createDataFrame(rows, SCHEMA), bucket=bucket).collect()
    assert sorted((_key(r.doc_id), _key(r.component_id)) for r in got) == sorted((_key(d), least[root(i)]) for i, (d, _) in enumerate(rows))
    assert near_copies.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline_drops_copies_of_similarity_over_080(spark):
    import corpus_pipeline

    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    other = list(base)
    other[30], other[90] = "changed", "words"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:75] + other[75:][::-1]))], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_line_dedup(spark):
    rows = [(i, f"menu \nbody {i}\n\nfoot", "a") for i in range(20)] + [(50, "menu\nfoot", "a"), (51, None, "a"), (52, "", None), (60, "menu\nx", "b")]
    rows += [(100 + i, "copied page\nwith lines", "c") for i in range(20)]
    rows += [(200, "word " * 200_000 + "\nmenu", "a"), (None, "menu", "a"), (201, "x\nx\ny", None), (202, "x", None)]
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], f"{SCHEMA}, source string, n_lines int, host string")
    got = {_key(r.doc_id): (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got[0] == ("body 0\n", 4, 2)
    assert got[50] == ("", 2, 2) and got[1 << 62] == ("", 1, 1)
    assert got[51] == (None, 0, 0) and got[52] == ("", 1, 0)
    assert got[60] == ("menu\nx", 2, 0)
    assert got[100] == ("", 2, 2)  # pages count each
    assert got[200] == ("word " * 200_000, 2, 1)
    assert got[201] == ("y", 3, 2) and got[202] == ("", 1, 1)  # a null host is one
    got = {_key(r.doc_id): r.text for r in line_dedup.drop_boilerplate(docs, distinct=True).collect()}
    assert got[0] == "body 0\n" and got[100] == "copied page\nwith lines"  # copies are one page


def test_components_follow_long_paths(spark):
    from seqspark.llm.components import connected_components

    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert F is not None


def test_rounds_of_few_links_are_few_tasks(spark, monkeypatch):
    from pathlib import Path

    from seqspark.llm import components

    rng = random.Random(43)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(1000 + i, 1001 + i) for i in range(150)]
    least = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        for bound in (components.BROADCAST_LINKS, 0):  # a shuffle of many links gives the same
            monkeypatch.setattr(components, "BROADCAST_LINKS", bound)
            there = set(folder.glob("links-*"))
            found = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
            assert sorted((r.node, r.root) for r in found) == sorted(least.items())
            files = sorted(len(list(f.glob("part-*"))) for f in set(folder.glob("links-*")) - there)
            # the first table is of the caller's links, in all partitions
            assert len(files) > 2 and (files[-2] <= components.TASKS) == (bound > 0)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_near_copies_are_searched_by_simhash(spark, monkeypatch):
    from seqspark.llm import near_copies, simhash

    rng = random.Random(41)
    texts = []
    for i in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        texts += [words, [*words[:700], "new", *words[701:]], [*words, "end"]]
        # repeats move the fingerprint, not the set
        texts.append(words[:400] + words[:400] + words[400:])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, None), (901, ""), (902, "few words")], "doc_id long, text string")
    bits = {r.doc_id: r.bits & ((1 << 64) - 1) for r in simhash.fingerprints(docs, 5).collect()}
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in texts]
    both = {(i, j) for j in range(len(texts)) for i in range(j) if (bits[i] ^ bits[j]).bit_count() <= 3 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(both) >= 12
    # no MinHash keys: what is joined, SimHash has found, and whole sets have confirmed
    monkeypatch.setattr(near_copies, "BANDS", 0)
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()}
    assert all(got[i] == got[j] for i, j in both)
    parent = list(range(len(texts)))
    for i, j in sorted(both):
        low, high = sorted((parent[i], parent[j]))
        parent = [low if p == high else p for p in parent]
    assert [got[i] for i in range(len(texts))] == parent and got[900] == got[901] == 900 and got[902] == 902
    # at a similarity that the pairs lack, all are refused
    alone = {r.doc_id: r.component_id for r in near_copies.groups(docs, similarity=1.0).collect()}
    same = {}
    assert all(alone[i] == same.setdefault(s, i) for i, s in enumerate(sets))
