"""Token alignment, periodic runs and MinHash near-dedup against brute force, with the defined edge cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.llm import minhash, periodic, registry, token_alignment

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = [None, "", " ", "\n\t ", "a", " a  b ", "<|endoftext|> and <s>x</s>", "a ▁b", "né 漢字 😀 x\x1cy z", "x" * 3000, "ab " * 900, "\r\n\r\n a b", "don't we'll 12 345 a1b2", "tab\there  two", "a\0b c"]


def _tokens(texts):
    """Ids and byte ranges of both sides, from whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.B_PATH)
    name = {i: t for t, i in a.get_vocab().items()}
    letter = token_alignment.byte_letters()
    out = []
    for text in texts:
        sides = []
        if text:
            raw = (" " + text).encode()
            own = [(i, bytes(letter[c] for c in name[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
            other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(x for _, x in own) == raw == b"".join(x for _, x in other):
                for side in (own, other):
                    at, places = 0, []
                    for i, x in side:
                        places.append((i, at, at + len(x)))
                        at += len(x)
                    sides.append(places)
        out.append(sides or [[], []])
    return out


def _aligned(texts):
    docs, count = [], Counter()
    for a, b in _tokens(texts):
        links, j = [], 0
        for x, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, i, k = [], 0, 0
        for end in ends:
            own = [[], []]
            while i < len(a) and a[i][2] <= end:
                own[0].append(str(a[i][0]))
                i += 1
            while k < len(b) and b[k][2] <= end:
                own[1].append(str(b[k][0]))
                k += 1
            groups.append("|".join(",".join(x) for x in own))
        count.update(set(links))
        docs.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(na, nb, len(g), len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, ls in docs]


def _rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df]


def test_alignment_is_exact_on_odd_texts(spark, monkeypatch):
    rng = random.Random(3)
    letters = "abcdeé' ,.\n12漢<>|▁"
    texts = ODD + ["".join(rng.choice(letters[:-1]) for _ in range(rng.randrange(200))) for _ in range(60)] + ["the same text here"] * 3
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in zip(ids, texts)], f"{SCHEMA}, pairs string, n_a int").repartition(3)
    want = sorted(zip([-1 if d is None else d for d in ids], _aligned(texts)))
    for limit, frequent in ((token_alignment.BATCH, token_alignment.FREQUENT), (40, 20)):
        monkeypatch.setattr(token_alignment.aligned, "__defaults__", (token_alignment.A_PATH, token_alignment.B_PATH, limit))
        got = token_alignment.corpus_alignment(docs, frequent=frequent).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, x) for r, x in zip(got, _rows(got))) == want
    assert _aligned(["a ▁b"])[0] == (0, 0, 0, 0, 0, 0, "")
    assert token_alignment.corpus_alignment(docs.limit(0)).count() == 0


def test_both_libraries_give_the_same_ids():
    rng = random.Random(5)
    tokenizers = token_alignment.Tokenizers(token_alignment.A_PATH, token_alignment.B_PATH)
    letters = "abcdefghij ABC'éßäñłж.,;:!?-()[]{}0123456789\n\t\r$#@<>|"
    texts = [b.decode() for b in tokenizers.a_bytes[:50256] if b.decode(errors="ignore").encode() == b] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(30_000)]
    texts = [t for t in texts if token_alignment.COMMON.fullmatch(t)]
    want = tokenizers.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert len(texts) > 70_000 and [tokenizers.quick(" " + t) for t in texts] == [w.ids for w in want]


def test_alignment_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: x for r, x in zip(*(lambda x: (x, _rows(x)))(registry.queries()["op11_token_alignment"](spark, SF).collect()))}
    assert got == dict(zip([d.doc_id for d in docs], _aligned([d.text for d in docs])))


def _runs(words):
    """All runs by scanning every period, and the kept words."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    found.sort(key=lambda r: (r[0], r[2]))
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    return found, best, [w for i, w in enumerate(words) if i not in gone]


def _run_row(words):
    found, best, kept = _runs(words)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def _periodic_words(rng):
    out = []
    for _ in range(rng.randrange(1, 5)):
        q = rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 24, 31, 32, 33, 40, 64, 70])
        block = [rng.choice("aab") if rng.random() < 0.3 else str(rng.randrange(9)) for _ in range(q)]
        if rng.random() < 0.3:
            block = ["a"] * (q - 1) + ["b"]
        n = rng.randrange(3 * q, 7 * q + 2)
        out += [rng.choice("xyz") for _ in range(rng.randrange(5))] + (block * (n // q + 1))[:n]
        if rng.random() < 0.4:
            out[rng.randrange(len(out))] = "!"
    return out


def test_runs_are_all_found():
    rng = random.Random(8)
    for _ in range(150):
        words = _periodic_words(rng)
        number = {w: i for i, w in enumerate(sorted(set(words)))}
        assert [tuple(r) for r in periodic.runs(np.array([number[w] for w in words])).tolist()] == _runs(words)[0], words
    # strings with many runs: Fibonacci and Thue-Morse words, and small alphabets
    fib = ["0", "01"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    for text in (fib[-1] * 4, "".join(str(bin(i).count("1") % 2) for i in range(600)) * 5, "".join(rng.choice("ab") for _ in range(1500)), "ab" * 800 + "a"):
        assert [tuple(r) for r in periodic.runs(np.array([ord(c) for c in text])).tolist()] == _runs(text)[0]


def test_runs_of_documents(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "a", "a " * 6, "a " * 5, "a b\x1ca b\x1ca b\x1ca", "é  é\té\né é\x0bé"] + ["  ".join(_periodic_words(rng)) for _ in range(25)]
    ids = [None if i % 7 == 0 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(d, t, 1) for d, t in zip(ids, texts)], f"{SCHEMA}, start int")
    own = lambda r: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
    want = Counter((d, _run_row(WORD.findall(t or ""))) for d, t in zip(ids, texts))
    assert Counter((r.doc_id, own(r)) for r in periodic.find_runs(docs).collect()) == want
    kept = Counter((d, " ".join(_runs(WORD.findall(t or ""))[2])) for d, t in zip(ids, texts))
    assert Counter((r.doc_id, r.text) for r in periodic.collapse_runs(docs).collect()) == kept
    assert periodic.find_runs(docs.limit(0)).count() == 0

    docs, want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), {}
    for d in docs:
        words = WORD.findall(d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want[d.doc_id] = _run_row(words)
    assert {r.doc_id: own(r) for r in registry.queries()["op12_periodic"](spark, SF).collect()} == want
    assert sum(w[0] > 0 for w in want.values()) > 5


def _sets(texts):
    out = []
    for t in texts:
        words = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
        words = WORD.findall(words)
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    return out


def _components(ids, texts, percent):
    sets, parent = _sets(texts), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least.get(root(i), ids[i])) for i in range(len(texts))]


def _near_texts(rng, bases, copies, n=120):
    texts = []
    for b in range(bases):
        own = [f"w{b}x{i}" for i in range(n)]
        for _ in range(copies):
            words = list(own)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
            # copies of copies: chains
            if rng.random() < 0.3:
                own = words
    return texts


@pytest.mark.parametrize(("bucket", "percent"), [(2048, 85), (4, 80)])
def test_minhash_groups_are_exact(spark, bucket, percent):
    rng = random.Random(11)
    texts = [None, "", " ", "One two", "one  TWO", "one two three", "Éa b c d e", "éa b c d e", "x " * 400, "x " * 5] + _near_texts(rng, 12, 14) + ["the same words in each of these rows"] * 9
    ids = [None if i in (3, 20) else 1000 - i if i % 10 else 7 for i in range(len(texts))]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in zip(ids, texts)], f"{SCHEMA}, name string, component int")
    got = minhash.near_duplicates(docs, similarity=percent / 100, bucket=bucket).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(_components(ids, texts, percent), key=key)


def test_one_of_each_group_stays(spark):
    texts = [None, "", "", *_near_texts(random.Random(12), 3, 8), "x y", "x Y"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    want = {d for d, _, c in _components(range(len(texts)), texts, 85) if d == c}
    assert {r.doc_id for r in minhash.keep_one(docs).collect()} == want and 0 < len(texts) - len(want)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_chains_of_near_copies(spark):
    # each text is near the next alone: words leave at the front and come in at the end
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words[i : i + 104]) for i in range(0, 1800, 4)]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), SCHEMA)
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    want = _components(ids, texts, 85)
    assert got == want and len({w[2] for w in want}) == 1


def test_marks_keep_what_is_near():
    rng = np.random.default_rng(5)
    marks = minhash.pass_marks(0.85)
    equal = (rng.random((200_000, minhash.SIGNATURE)) < 0.85).cumsum(axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert (equal < np.array(marks)).any(axis=1).mean() < 4 * minhash.MISS * 3
    far = (rng.random((20_000, minhash.SIGNATURE)) < 0.5).cumsum(axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert (far >= np.array(marks)).all(axis=1).mean() < 1e-3 and marks == sorted(marks)


def test_minhash_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in registry.queries()["op13_minhash"](spark, SF).collect()}
    want = {d: (n, c, d == c) for d, n, c in _components([d.doc_id for d in docs], [d.text for d in docs], 85)}
    assert got == want and sum(not w[2] for w in want.values()) > 5
