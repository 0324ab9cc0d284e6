"""Near duplicates by MinHash with sequential Bayesian verification.

Two texts are linked if the Jaccard similarity of their sets of ``SHINGLE``-word shingles (ASCII case
aside) is at least ``SIMILARITY``.  Texts with equal sets are one class from the start; all else is done on classes.

1. ``BANDS`` keys of ``ROWS`` minima each put classes into buckets.  A pair of similarity s shares a bucket with probability
   1 - (1 - s**ROWS)**BANDS, 0.99992 at 0.85.
2. In a bucket, signatures (a byte of each minimum) are compared in batches of ``BATCH``.  With a uniform
   prior, the similarity behind m equal of n bytes follows a beta distribution; a pair goes once the posterior
   probability of the wanted similarity is under ``MISS``.  A class is compared with those classes alone that it is not yet joined to,
   and a cell returns the survivors that join something new there, so a group of many near copies gives as many links as classes.
3. Survivors are verified on the whole shingle sets: beside each leading class, its partners' texts pass
   by in cells of bounded size.
4. Verified links make components.  What the forest left open is then settled: in buckets that hold a link which verification
   refused, or that were too large for one cell, components with surviving pairs between them make regions.  In a region,
   the classes outside its largest component are compared with all of it on the whole shingle sets, each class against those that hold its shingles.
   So each pair that shares a bucket and survives is joined or verified, and a text is copied for its region's parts, not for its pairs.

A bucket of over ``BUCKET`` classes is cut into cells by a hash; the cells' components first meet by one class each.  A bucket is
never one task, and nothing but counts reaches the driver.

Defined results: a text of fewer words than a shingle has one shingle, all its words; null and wordless texts have an empty set and link with
nothing, not even each other; rows with a null id are kept, and name a component only if no other row of it has an id; repeated rows share their class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqspark.llm import bytesops as B
from seqspark.llm.components import connected_components, first_rows, stored
from seqspark.llm.shingles import shingle_sets

SHINGLE, SIMILARITY = 5, 0.85
BANDS, ROWS = 20, 6
#: Minima of a signature, those compared at once, and the probability of a miss in each comparison.
SIGNATURE, BATCH, MISS = 128, 32, 1e-4
#: Classes of a cell (in expectation), and partners that are verified beside one copy of a leading class's text.
BUCKET, PARTNERS = 2048, 256
#: Shingles of a region's part (in expectation).
PART_SHINGLES = 1 << 19
#: Classes in buckets, of 16 bytes each, up to this number are broadcast to the texts; more are shuffled with them.
BROADCAST_ROWS = 1_000_000
Search = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def pass_marks(similarity: float, size: int = SIGNATURE, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """For each batch, the least number of equal bytes so far at which a pair of ``similarity`` is still probable enough.

    Two different minima have the same byte once in 256.  Behind m equal of n, with a uniform prior, the share is at least t with
    the probability that n + 1 trials of chance t give at most m.
    """
    t = similarity + (1 - similarity) / 256
    marks = []
    for n in range(batch, size + 1, batch):
        below, m = (1 - t) ** (n + 1), 0
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        marks.append(m)
    return marks


def minima(hashes: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """(texts, size): the least of each text's hashes in each of ``size`` orders; zeros for texts without hashes."""
    out = np.zeros((len(bounds) - 1, size), dtype=np.uint64)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        # mixed behind each factor, as products alone are not independent
        for i, factor in enumerate(B.mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)):
            turned = hashes * factor
            turned ^= turned >> np.uint64(32)
            turned *= np.uint64(0xD6E8FEB86659FD93)
            out[filled, i] = np.minimum.reduceat(turned, bounds[filled])
    return out


def _sketches(shingle: int, bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.blocks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets, shingle)
                least = minima(hashes, bounds, max(size, bands * rows))
                keys = np.empty((len(least), bands), dtype=np.uint64)
                for band in range(bands):
                    key = np.full(len(least), band + 1, dtype=np.uint64)
                    for i in range(band * rows, (band + 1) * rows):
                        key = B.mix(key * np.uint64(3) + least[:, i])
                    keys[:, band] = key
                # a set's class: two sums over its hashes
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (B.mix(hashes), B.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))]
                one, two = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                name = B.mix(one ^ B.mix(two + np.diff(bounds).astype(np.uint64)))
                marks = np.ascontiguousarray(least[:, :size] & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(name.view(np.int64)), pa.array(np.diff(bounds)),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "rk", "name", "n_shingles", "signature", "keys"],
                )

    return run


def _cells(key_columns: int, close):
    """A function over batches of rows sorted by their first ``key_columns`` columns that calls ``close`` with each group's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rest = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(key_columns)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                own = tuple(keys[lo].tolist())
                if own != key:
                    if rest:
                        yield close(key, pa.Table.from_batches(rest))
                    key, rest = own, []
                rest.append(batch.slice(lo, hi - lo))
        if rest:
            yield close(key, pa.Table.from_batches(rest))

    return run


def _pairs_of(key: tuple, found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["key", "a", "b"])


def _survivors(marks: list[int], batch: int):
    """Survivors of each cell's rows (name, component, seeks, signature) that join what is not yet joined there; one of each pair seeks."""

    def near(signature: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
        equal = np.zeros(len(others), dtype=np.int64)
        for i, mark in enumerate(marks):
            part = slice(i * batch, (i + 1) * batch)
            equal += (signature[others, part] == signature[x, part]).sum(axis=1)
            stay = equal >= mark
            others, equal = others[stay], equal[stay]
            if not len(others):
                break
        return others

    def close(key: tuple, table: pa.Table) -> pa.RecordBatch:
        names, once, root, seeks = _members(table)
        raw = table.column("signature").combine_chunks()
        signature = np.frombuffer(b"".join(raw.take(pa.array(once)).to_pylist()), dtype=np.uint8).reshape(len(names), -1)
        return _pairs_of(key, _forest(names, root, seeks, lambda x, others: near(signature, x, others)))

    return _cells(2, close)


def _members(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A cell's classes, a row of each, their components as numbers, and which of them seek."""
    names, once = np.unique(table.column("name").to_numpy(), return_index=True)
    _, root = np.unique(table.column("component").to_numpy()[once], return_inverse=True)
    seeks = np.zeros(len(names), dtype=bool)
    seeks[np.searchsorted(names, table.column("name").to_numpy()[table.column("seeks").to_numpy(zero_copy_only=False).astype(bool)])] = True
    return names, once, root, seeks


def _forest(names: np.ndarray, root: np.ndarray, seeks: np.ndarray, near) -> list[tuple[int, int]]:
    """Links of seeking classes to ``near`` ones, without those that close a ring; of two seeking classes, the first asks."""
    found = []
    for x in np.flatnonzero(seeks).tolist():
        open_ = root != root[x]
        open_[:x] &= ~seeks[:x]
        if not open_.any():
            continue
        for y in near(x, np.flatnonzero(open_)).tolist():
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                found.append((int(names[x]), int(names[y])))
    return found


def _near_sets(similarity: float, shingle: int):
    """Links of each cell's rows (name, component, seeks, text), by whole shingle sets: a class is counted against those that hold its shingles."""
    percent = round(100 * similarity)

    def close(key: tuple, table: pa.Table) -> pa.RecordBatch:
        names, once, root, seeks = _members(table)
        texts, sets, size = table.column("text").combine_chunks().take(pa.array(once)), [], []
        for _, _, data, offsets in B.blocks(texts):
            hashes, cuts = shingle_sets(data, offsets, shingle)
            sets.append(hashes)
            size.append(np.diff(cuts))
        every, size = np.concatenate(sets), np.concatenate(size)
        bounds, owner = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(len(names)), size)
        order = np.argsort(every, kind="stable")
        value, owner = every[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        held = np.diff(np.append(start, len(value)))
        # the number of each shingle among the distinct ones
        number = np.empty(len(value), dtype=np.int64)
        number[order] = np.repeat(np.arange(len(start)), held)

        def near(x: int, others: np.ndarray) -> np.ndarray:
            own = number[bounds[x] : bounds[x + 1]]
            n = held[own]
            holders = owner[np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            shared = np.bincount(holders, minlength=len(names))[others]
            return others[100 * shared >= percent * (size[others] + size[x] - shared)]

        return _pairs_of(key, _forest(names, root, seeks, near))

    return _cells(2, close)


def _verified(similarity: float, shingle: int):
    """(a, b, near) of each cell (a, part): the first row is a's text, the others are its partners'."""
    percent = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, leader = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, part, leads, name = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple[int, int, bool]] = []
            for lo, hi, data, offsets in B.blocks(batch.column(4)):
                hashes, cuts = shingle_sets(data, offsets, shingle)
                for i in range(lo, hi):
                    own = hashes[cuts[i - lo] : cuts[i - lo + 1]]
                    if leads[i]:
                        cell, leader = (a[i], part[i]), own.copy()
                    elif cell == (a[i], part[i]):
                        at = np.searchsorted(leader, own)
                        shared = int((leader[np.minimum(at, len(leader) - 1)] == own).sum()) if len(leader) else 0
                        out.append((a[i], name[i], 100 * shared >= percent * (len(own) + len(leader) - shared)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_())], names=["a", "b", "near"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int, partners: int = PARTNERS) -> DataFrame:
    """(a, b, near) of pairs of classes, by the whole shingle sets of ``texts(name, text)``.

    A class that leads many pairs has a copy of its text for each ``partners`` of them (in expectation).
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / partners).cast("int").alias("parts"))
    cells = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    needs = cells.select("a", "part", F.lit(False).alias("leads"), F.col("b").alias("name"))
    needs = needs.unionByName(cells.select("a", "part").distinct().select("a", "part", F.lit(True).alias("leads"), F.col("a").alias("name")))
    rows = needs.join(texts, "name").select("a", "part", "leads", "name", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.desc("leads"))
    return rows.mapInArrow(_verified(similarity, shingle), "a long, b long, near boolean")


class _Search:
    """Verified links and components of classes, improved by one search after the other."""

    def __init__(self, members: DataFrame, classes: DataFrame, texts: DataFrame, similarity: float, shingle: int, marks: list[int], bucket: int, batch: int):
        """``members(key, name)`` of buckets; ``classes(name, n_shingles, signature)`` and ``texts(name, text)`` of the classes in them."""
        self.members, self.classes, self.texts = members, classes, texts
        self.similarity, self.shingle, self.marks, self.bucket, self.batch = similarity, shingle, marks, bucket, batch
        self.components: DataFrame | None = None
        self.links: list[DataFrame] = []

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with each class's component so far."""
        if self.components is None:
            return rows.withColumn("component", F.col("name"))
        return rows.join(self.components, "name", "left").withColumn("component", F.coalesce("component", "name"))

    def join(self, links: DataFrame) -> None:
        """Components with further verified links (a, b)."""
        self.links.append(links.select("a", "b"))
        found = connected_components(reduce(DataFrame.unionByName, self.links))
        self.components = stored(found.select(F.col("node").alias("name"), F.col("root").alias("component")), "components")

    def survivors(self, cells: DataFrame) -> DataFrame:
        """(key, a, b): survivors among the rows (key, cell, name, component, seeks), stored."""
        rows = cells.join(self.classes.select("name", "signature"), "name").select("key", "cell", "name", "component", "seeks", "signature")
        rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell")
        return stored(rows.mapInArrow(_survivors(self.marks, self.batch), "key long, a long, b long"), "survivors")

    def settle(self, survivors: DataFrame) -> DataFrame:
        """Verify survivors, join what is near, and return the buckets of refused pairs (key)."""
        checked = stored(verify(survivors.select("a", "b").distinct(), self.texts, self.similarity, self.shingle), "verified")
        self.join(checked.where("near"))
        return survivors.join(checked.where("NOT near").select("a", "b"), ["a", "b"], "left_semi").select("key").distinct()

    def parted(self, rows: DataFrame) -> DataFrame:
        """``rows(key, name, component)`` with cells of the bucket's own size each."""
        sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / self.bucket).cast("int").alias("parts"))
        return rows.join(sizes, "key").select("key", F.pmod(F.xxhash64("name"), F.col("parts")).cast("long").alias("cell"), "name", "component", F.lit(True).alias("seeks"))

    def between(self, rows: DataFrame, weight: float) -> DataFrame:
        """Cells of groups ``rows(key, name, component, weight)``: classes outside a group's largest component seek among all of its classes.

        Both are cut into parts of ``bucket`` classes, or a sum of ``weight``; a cell is a part of those that seek and a part of all.
        """
        count = F.greatest(F.count("*") / self.bucket, F.sum("weight") / weight)
        sizes = rows.groupBy("key", "component").agg(count.alias("n"))
        sizes = sizes.groupBy("key").agg(F.count("*").alias("components"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("components > 1")
        rows = rows.join(sizes, "key").withColumn("seeks", F.col("component") != F.col("most.component"))
        parts, seeking = F.ceil("n").cast("long"), F.greatest(F.ceil(F.col("n") - F.col("most.n")).cast("long"), F.lit(1))
        mine = F.pmod(F.xxhash64("name"), parts)
        as_table = F.transform(F.sequence(F.lit(0).cast("long"), seeking - 1), lambda i: F.struct((i * parts + mine).alias("cell"), F.lit(False).alias("seeks")))
        as_seeker = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.struct((F.pmod(F.xxhash64("name", F.lit(1)), seeking) * parts + j).alias("cell"), F.lit(True).alias("seeks")))
        own = F.concat(as_table, F.when(F.col("seeks"), as_seeker).otherwise(F.slice(as_seeker, 1, 0)))
        return rows.select("key", F.explode(own).alias("x"), "name", "component").select("key", "x.cell", "name", "component", "x.seeks")

    def regions(self, keys: DataFrame, members: DataFrame | None = None) -> None:
        """Settle the buckets ``keys`` (of ``members`` if given): components with surviving pairs between them are verified region by region."""
        rows = self.labelled((self.members if members is None else members).join(keys, "key", "left_semi")).withColumn("weight", F.lit(0))
        open_ = self.survivors(self.between(rows, 1.0)).select("a", "b").distinct()
        named = self.labelled(self.classes.select("name")).select("name", "component")
        pairs = open_.join(named.select(F.col("name").alias("a"), F.col("component").alias("x")), "a").join(named.select(F.col("name").alias("b"), F.col("component").alias("y")), "b")
        found = connected_components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
        rows = self.labelled(self.classes.select("name", F.col("n_shingles").alias("weight"))).join(found.select(F.col("node").alias("component"), F.col("root").alias("key")), "component")
        cells = self.between(rows.select("key", "name", "component", "weight"), float(PART_SHINGLES)).join(self.texts, "name").select("key", "cell", "name", "component", "seeks", "text")
        cells = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")
        self.join(stored(cells.mapInArrow(_near_sets(self.similarity, self.shingle), "key long, a long, b long"), "verified"))


def _sized(df: DataFrame) -> DataFrame:
    """For a broadcast if its rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def links(own: DataFrame, rows: DataFrame, similarity: float, shingle: int, size: int, batch: int, miss: float, bucket: int, first: Search | None = None) -> DataFrame:
    """(name, component) of classes with a verified link, from sketches and their texts.

    ``first`` gives the groups (key, name) and pairs (key, a, b) of another search over the texts (rk, text) and their classes (rk, name).  These are verified, and groups
    with a refused pair settled, before the buckets are.
    """
    classes = own.where("n_shingles > 0").groupBy("name").agg(F.min_by(F.struct("rk", "n_shingles", "signature", "keys"), "rk").alias("x")).select("name", "x.*")
    keys = classes.select("name", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keys.join(shared, "key").select("key", "name", "n"), "members")
    large = members.where(F.col("n") > bucket).select("key").distinct()
    members = members.select("key", "name")
    named = members.select("name")
    if first is not None:
        groups, pairs = first(rows, own.where("n_shingles > 0").select("rk", "name").distinct())
        named = named.union(groups.select("name"))
    kept = stored(classes.join(named.distinct(), "name", "left_semi").select("name", "rk", "n_shingles", "signature"), "classes")
    texts = stored(rows.select("rk", "text").join(_sized(kept.select("rk", "name")), "rk").dropDuplicates(["rk"]).select("name", "text"), "texts")
    search = _Search(members, kept.select("name", "n_shingles", "signature"), texts, similarity, shingle, pass_marks(similarity, size, batch, miss), bucket, batch)
    if first is not None:
        refused = stored(search.settle(pairs), "refused")
        if not refused.isEmpty():
            search.regions(refused, groups)
    refused = search.settle(search.survivors(search.parted(search.labelled(members))))
    if not large.isEmpty():
        # cells of one bucket meet by one class of each component
        ones = search.labelled(members.join(large, "key", "left_semi")).groupBy("key", "component").agg(F.min("name").alias("name"))
        refused = refused.unionByName(search.settle(search.survivors(search.parted(ones)))).unionByName(large)
    refused = stored(refused.distinct(), "refused")
    if not refused.isEmpty():
        search.regions(refused)
    return search.components


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, minima: int = ROWS, size: int = SIGNATURE, batch: int = BATCH, miss: float = MISS, bucket: int = BUCKET, wordless: bool = False,
    first: Search | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest doc_id reachable over links, itself included.

    ``wordless``: texts without words are copies of each other.  ``first``: see ``links``.
    """
    if size % batch or bands * minima > size:
        raise ValueError("a signature is a number of batches, and holds the minima of all bands")
    # a row's key: rows that are equal in both columns share it
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    own = stored(rows.select("doc_id", "text", "rk").mapInArrow(_sketches(shingle, bands, minima, size), f"doc_id {kind}, rk long, name long, n_shingles long, signature binary, keys array<long>"), "sketches")
    components = links(own, rows, similarity, shingle, size, batch, miss, bucket, first)
    classes = own.where(F.lit(wordless) | (F.col("n_shingles") > 0)).groupBy("name").agg(F.min("doc_id").alias("first")).join(components, "name", "left").select("name", "first", F.coalesce("component", "name").alias("component"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "component").select("name", "component_id")
    # unless asked for, the empty set's rows are not members of one class
    own_class = F.when(F.lit(wordless) | (F.col("n_shingles") > 0), F.col("name"))
    found = own.select("doc_id", "n_shingles", own_class.alias("name")).join(named, "name", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are first of their component; rows with a null id, or that repeat a kept id, stay once each per distinct row."""
    return first_rows(docs, near_duplicates(docs, **options))
