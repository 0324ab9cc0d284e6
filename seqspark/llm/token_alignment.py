"""Alignment of two tokenizers' tokens over the bytes of whole texts.

Both tokenizers encode a space and the text.  A token's bytes are its place; in each batch ``merge_asof``,
keyed by document, finds for each token start of one side the other side's token that covers it,
and the union of both directions is every pair of tokens whose bytes overlap.  Places where tokens
of both sides end cut a text into groups.

A text is cut where one space stands between two characters that are no white space.  The
byte-level tokenizer starts a token at each such space, and no piece of the other vocabulary goes on over
one (this is checked when it is loaded), so each distinct unit is encoded once while it is remembered,
and a text of any length goes through in pieces of bounded size.

Over the corpus, the number of documents that hold an id pair linked is counted.  Pairs that make up
at least one in ``FREQUENT`` of all (document, pair) rows, of which there are at most ``FREQUENT``, are
broadcast; the rest, none of which is frequent, are joined by shuffle.

Defined results: null and empty texts, and texts that one of the tokenizers does not give back byte for byte, have
zeros and the empty string; rows with null or repeated ids are rows of their own, each counted as a document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seqspark.llm.components import stored

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a batch, and of a piece of a longer text.
BATCH = 1 << 18
FREQUENT = 100_000
#: Letters of distinct units whose tokens are kept.
CACHE = 1 << 22
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Units of these letters, digits, signs and white space are cut alike by every engine, whatever its version of Unicode.
COMMON = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ſА-я]*")
# Fixed value: how the byte-level tokenizer parts a text before its merges.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself where printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units(dict):
    """A number for each distinct unit; those asked for the first time wait in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        code = self[unit] = len(self)
        self.new.append(unit)
        return code


class Tokenizers:
    """Both tokenizers, the bytes of each of their tokens, and the tokens of units met lately."""

    def __init__(self, a_path: str, b_path: str):
        # an executor's cores have tasks of their own; threads of the tokenizer would each keep memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letter = byte_letters()
        names = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.a_bytes = [bytes(letter[c] for c in name) if all(c in letter for c in name) else name.encode() for name, _ in names]
        self.quick = self._by_rank()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on over a space: texts cannot be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.widths = [np.fromiter(map(len, table), np.int64, len(table)) for table in (self.a_bytes, self.b_bytes)]
        self.decimal = decimals(max(map(len, (self.a_bytes, self.b_bytes))))
        self.forget()

    def _by_rank(self):
        """The same byte-level tokenizer in a faster library, which takes ids for ranks; none if merges do not stand in the order of their ids."""
        model = json.loads(self.a.to_str())
        parts = model["pre_tokenizer"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
        vocabulary = model["model"]["vocab"]
        made = [vocabulary[m.replace(" ", "")] for m in merges]
        if parts["type"] != "ByteLevel" or not parts["use_regex"] or model["normalizer"] or made != list(range(made[0], made[0] + len(made))):
            return None
        import tiktoken

        letter = byte_letters()
        ranks = {bytes(letter[c] for c in name): i for name, i in vocabulary.items() if all(c in letter for c in name) and (len(name) == 1 or made[0] <= i <= made[-1])}
        return tiktoken.Encoding("ranks", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode_a(self, units: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [x.ids for x in self.a.encode_batch([" " + u for u in units], add_special_tokens=False)]
        quick = self.quick
        out = [quick(" " + u) if COMMON.fullmatch(u) else None for u in units]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.a.encode_batch([" " + units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def forget(self) -> None:
        self.units, self.letters = Units(), 0
        self.good = np.zeros(0, dtype=bool)
        self.ids, self.sizes = ([np.zeros(0, np.int64)] * 2 for _ in range(2))

    def codes(self, units: Iterator[str]) -> np.ndarray:
        """The numbers of a sequence of units; new ones are encoded.  Older numbers hold no longer once ``CACHE`` letters are kept."""
        if self.letters > CACHE:
            self.forget()
        codes = np.fromiter(map(self.units.__getitem__, units), np.int64)
        new, self.units.new = self.units.new, []
        if new:
            a, b = self._encode_a(new), self.b.encode(new, num_threads=1)
            ids = [np.fromiter(chain.from_iterable(own), np.int64) for own in (a, b)]
            sizes = [np.fromiter(map(len, own), np.int64, len(own)) for own in (a, b)]
            self.good = np.concatenate([self.good, self._given_back(new, ids, sizes)])
            self.ids = [np.concatenate(x) for x in zip(self.ids, ids, strict=True)]
            self.sizes = [np.concatenate(x) for x in zip(self.sizes, sizes, strict=True)]
            self.letters += sum(map(len, new))
        return codes

    def _given_back(self, units: list[str], ids: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Whether both sides' bytes are a space and the unit: all units at once, or one by one if something differs."""
        raw = [b" " + u.encode() for u in units]
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        every = b"".join(raw)
        good = np.ones(len(units), dtype=bool)
        for side, table in enumerate((self.a_bytes, self.b_bytes)):
            stop = np.cumsum(sizes[side])
            if np.array_equal(np.concatenate([[0], np.cumsum(self.widths[side][ids[side]])])[stop], stops) and b"".join(map(table.__getitem__, ids[side].tolist())) == every:
                continue
            own = np.split(ids[side], stop[:-1])
            good &= np.fromiter((b"".join(map(table.__getitem__, x.tolist())) == r for x, r in zip(own, raw, strict=True)), bool, len(raw))
        return good

    def tokens(self, side: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of units, and how many each unit has."""
        size = self.sizes[side]
        first, n = np.cumsum(size) - size, size[codes]
        return self.ids[side][np.repeat(first[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 to n - 1, one number a row, with a free byte behind; and their lengths."""
    ids, wide = np.arange(n), len(str(max(n - 1, 0)))
    length = np.maximum((ids[:, None] >= 10 ** np.arange(wide)).sum(axis=1), 1)
    digits = np.zeros((n, wide + 1), dtype=np.uint8)
    for at in range(wide):
        own = at < length
        digits[own, at] = ids[own] // 10 ** (length[own] - 1 - at) % 10 + 48
    return digits, length


def pieces_of(text: str, limit: int) -> Iterator[str]:
    """A text cut at spaces into pieces of some ``limit`` characters."""
    at = 0
    while len(text) - at > limit and (cut := CUT.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def align(pieces: list[str], tokenizers: Tokenizers) -> tuple[np.ndarray, pd.DataFrame, list[bytes], pd.DataFrame]:
    """Of each piece: whether it can be aligned, its counts, its groups as text, and its links (piece, a, b), each as often as it occurs."""
    units = [CUT.split(p) if p else [] for p in pieces]
    codes = tokenizers.codes(chain.from_iterable(units))
    owner = np.repeat(np.arange(len(pieces)), [len(own) for own in units])
    fine = np.ones(len(pieces), dtype=bool)
    fine[owner[~tokenizers.good[codes]]] = False
    codes, owner = codes[fine[owner]], owner[fine[owner]]
    sides = []
    for side in range(2):
        own, n = tokenizers.tokens(side, codes)
        end = np.cumsum(tokenizers.widths[side][own])
        sides.append(pd.DataFrame({"at": np.concatenate([[0], end[:-1]]) if len(end) else end, "end": end, "piece": np.repeat(owner, n), "id": own}))
    a, b = sides
    # the start of each token of a side falls into one token of the other
    over = pd.merge_asof(a[["at", "piece", "id"]], b[["at", "piece", "id"]].rename(columns={"id": "b"}), on="at", by="piece").rename(columns={"id": "a"})
    back = pd.merge_asof(b[["at", "piece", "id"]], a.assign(same=a["at"])[["at", "piece", "id", "same"]].rename(columns={"id": "a"}), on="at", by="piece").rename(columns={"id": "b"})
    links = pd.concat([over[["piece", "a", "b"]], back.loc[back["same"] != back["at"], ["piece", "a", "b"]]], ignore_index=True)
    ends = np.intersect1d(a["end"], b["end"], assume_unique=True)
    group = [np.searchsorted(ends, x["end"].to_numpy()) for x in sides]
    n_of = lambda x: np.bincount(x, minlength=len(pieces))
    last = a["piece"].to_numpy()[np.searchsorted(a["end"].to_numpy(), ends)]
    counts = pd.DataFrame({"n_a": n_of(a["piece"]), "n_b": n_of(b["piece"]), "n_groups": n_of(last), "n_links": n_of(links["piece"])})
    texts = [b""] * len(pieces)
    if len(a):
        # a group's tokens: those of A, then those of B
        place = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        after = np.concatenate([np.where(np.append(np.diff(g), 1) > 0, ord(sign), ord(",")) for g, sign in zip(group, "|;", strict=True)]).astype(np.uint8)
        ids = np.concatenate([a["id"], b["id"]])[place]
        digits, length = tokenizers.decimal[0][ids], tokenizers.decimal[1][ids]
        digits[np.arange(len(ids)), length] = after[place]
        raw = digits[np.arange(digits.shape[1]) <= length[:, None]]
        size = np.bincount(np.concatenate([a["piece"], b["piece"]])[place], weights=length + 1, minlength=len(pieces)).astype(np.int64)
        raw, stop = raw.tobytes(), np.cumsum(size).tolist()
        texts = [raw[s - n : s - 1] if n else b"" for s, n in zip(stop, size.tolist(), strict=True)]
    return fine, counts, texts, links


def _merged(docs: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (document, pair) rows as one, in order, with the sum of their times."""
    order = np.lexsort((pairs, docs))
    docs, pairs, times = docs[order], pairs[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])])) if len(docs) else np.zeros(0, np.int64)
    return docs[new], pairs[new], np.add.reduceat(times, new) if len(new) else times


def _aligned(a_path: str, b_path: str, limit: int):
    def rows(texts: list[str], tokenizers: Tokenizers) -> pa.RecordBatch:
        """One row for each text; no batch of pieces is larger than twice the limit."""
        counts, fine, hashes = np.zeros((len(texts), len(COUNTS)), np.int64), np.array([bool(t) for t in texts]), [hashlib.sha256() for _ in texts]
        begun = np.zeros(len(texts), dtype=bool)
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        batch: list[tuple[int, str]] = []
        waiting = 0

        def flush() -> None:
            nonlocal held, waiting
            if batch:
                owner = np.array([i for i, _ in batch])
                good, n, groups, links = align([p for _, p in batch], tokenizers)
                fine[owner[~good]] = False
                np.add.at(counts, owner, n[list(COUNTS)].to_numpy())
                for i, text in zip(owner.tolist(), groups, strict=True):
                    hashes[i].update(b";" + text if begun[i] else text)
                    begun[i] = True
                pair = links["a"].to_numpy(np.int64) << 32 | links["b"].to_numpy(np.int64)
                held = _merged(*(np.concatenate(x) for x in zip(held, (owner[links["piece"].to_numpy()], pair, np.ones(len(pair), np.int64)), strict=True)))
                batch.clear()
            waiting = 0

        for i, text in enumerate(texts):
            for piece in pieces_of(text, limit) if text else ():
                batch.append((i, piece))
                waiting += len(piece)
                if waiting >= limit:
                    flush()
        flush()
        own = fine[held[0]]
        docs, pairs, times = (x[own] for x in held)
        counts[~fine] = 0
        offsets = pa.array(np.searchsorted(docs, np.arange(len(texts) + 1)), pa.int32())
        return [
            *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array([h.hexdigest() if ok else "" for h, ok in zip(hashes, fine.tolist(), strict=True)]),
            pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times)),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(a_path, b_path)
        for batch in batches:
            # a few texts at a time become Python strings
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(ends):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4 * limit, side="right")))
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *rows(texts, tokenizers)], names=["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])
                lo = hi

    return run


def aligned(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, limit: int = BATCH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of each row, and its distinct linked id pairs (a << 32 | b) with their numbers of links."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<long>, times array<long>"
    return rows.mapInArrow(_aligned(a_path, b_path, limit), schema)


def pair_counts(tokens: DataFrame) -> DataFrame:
    """pair, a, b, n, best: documents that hold each id pair linked, and whether no pair of the same A id is held by more."""
    counts = tokens.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n")
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("_most")), "a").select("pair", "a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def corpus_alignment(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` with n_best (links whose pair is among the best of its A id) and count_sum (over links, the documents that hold the pair)."""
    tokens = stored(aligned(docs, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    counts = stored(pair_counts(tokens).select("pair", "n", "best"), "pairs")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    held = tokens.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    # each of these has 1 / frequent of all rows at least, so there are at most that many
    common = F.broadcast(counts.where(F.col("n") * frequent >= total))
    rare = counts.where(F.col("n") * frequent < total)
    known = held.join(common, "pair").unionByName(held.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair"))
    sums = known.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rows = tokens.select("_row", "doc_id", *COUNTS, "groups_sha256").join(sums, "_row", "left").na.fill(0, ["n_best", "count_sum"])
    return rows.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
