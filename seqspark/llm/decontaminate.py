"""Benchmark decontamination by template canonicalisation, in built-in expressions alone.

A text's numbers, names (capitalised words inside a sentence) and units after numbers become typed
placeholders; case and punctuation go.  Windows of ``WINDOW`` template words are hashed and joined
with the benchmark's, so that a question with other numbers or names still meets its original.
A template window counts only if most of its words are literal; of an item without such a window, those with ``DENSE_LITERALS``
literal words count.  Windows are joined in three forms:
with names inside sentences as placeholders, with every capitalised word as one (a name may begin a
sentence), and as plain words, which finds literal copies of windows with any number of slots and in
any case.  Then slots are checked: along one alignment of a document and an item, each value of the
item must stand for one value of the document, and different values for different ones.  Windows that
hold a slot which breaks this do not count, but for those that hold the item's own values in all slots: they
are literal copies, whatever clashes elsewhere.  An item is found in a document when its consistent windows join to a
run of ``RUN`` words, or make up half of the item's windows.

Defined results: null and empty texts hold nothing; an item of fewer words than a window is one plain
window of all its words, and one of fewer than ``LEAST_WORDS`` is found only in a document that has no other words; where a template has not one word for each plain word, the plain words stand in
for it; rows with equal id and text count once; repeated items count each by its id; texts of any
length are searched whole; extra columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqspark.llm.components import stored

WINDOW = 8
LITERALS = 5
#: Literal words of a window of an item that has no window with ``LITERALS`` of them.
DENSE_LITERALS = 2
#: Items of fewer words are found where they are all words of a document: inside others, they are no sign of the benchmark.
LEAST_WORDS = 4
RUN = 13
#: Hashes of benchmark windows, or documents with a hit, up to this number are broadcast (some 30 MB); more are shuffled.
BROADCAST_ROWS = 1_000_000
#: The same for benchmark windows with their words (some 50 MB).
BROADCAST_WINDOWS = 100_000

# Units that may follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|mi|miles|hours|hour|minutes|minute|seconds|days|years|dollars|euros|cents|percent|mph|kmh|°c|°f|%|$|€|£"


_NUMBERS = "regexp_replace({text}, '[0-9]++(?:[.,:/][0-9]++)*+', '⟨num⟩')"


# each pattern begins with what is rare in a text, so that most places fail at their first character
def _template(text: str, initial: bool = False) -> str:
    """SQL of the template words of a text column; with ``initial``, any capitalised word is a name."""
    numbered = _NUMBERS.format(text=text)
    if initial:  # units first, for they may be capitals
        return _plain(f"regexp_replace({_united(numbered)}, '\\\\p{{Lu}}(?<![\\\\p{{L}}\\\\p{{N}}].)[\\\\p{{L}}\\'’-]*+', '⟨name⟩')")
    return _plain(_united(f"regexp_replace({numbered}, '\\\\x20(?=\\\\p{{Lu}})(?<=[\\\\p{{Ll}},;:]\\\\x20)\\\\p{{Lu}}[\\\\p{{L}}\\'’-]*+', ' ⟨name⟩')"))


def _united(text: str) -> str:
    units = UNITS.replace("$", "\\\\$")
    return f"regexp_replace({text}, '(⟨num⟩\\\\x20?)(?i:{units})(?![\\\\p{{L}}\\\\p{{N}}])', '$1⟨unit⟩')"


def _plain(text: str) -> str:
    """SQL of the words of a text without case and punctuation."""
    return f"split(trim(regexp_replace(lower({text}), '[.,;:!?\"()*#&|\\\\t\\\\n\\\\r\\\\x20]+', ' ')), ' ')"


#: The forms of a text's words: template, template with sentence-initial names, plain (a number stays one word, as in the template).
FORMS = {"templ": _template("text"), "names": _template("text", True), "vals": _plain("regexp_replace(text, '[.,:/](?=[0-9])(?<=[0-9].)', '')")}
_PLAIN = 2


def _windows(words: str, form: int, length: int = WINDOW) -> str:
    """SQL of the hash of each window of ``length`` words; the words are evaluated and hashed once.

    Hashes of a full window come from those of its halves, and so on; ``zip_with`` fills with nulls behind the end, which is cut off.
    """
    hashed = f"array(transform({words}, w -> xxhash64(w)))"
    if length < WINDOW:
        each = f"transform(sequence(0, size(a) - {length}), i -> xxhash64(slice(a, i + 1, {length}), {form}))"
        none = f"size(a) <> {length}" if length < LEAST_WORDS else f"size(a) < {length}"
        return f"transform({hashed}, a -> IF({none}, CAST(array() AS ARRAY<BIGINT>), {each}))[0]"
    join = lambda a, step, more="": f"zip_with({a}, slice({a}, {step + 1}, greatest(size({a}), 1)), (x, y) -> xxhash64(x, y{more}))"
    last = f"transform(array({join('b', 2)}), c -> {join('c', 4, f', {form}')})[0]"
    each = f"slice(transform(array({join('a', 1)}), b -> {last})[0], 1, greatest(size(a) - {WINDOW - 1}, 0))"
    return f"transform({hashed}, a -> {each})[0]"


def _window(words: str, form: int) -> str:
    """SQL of the hash of one window, the same as ``_windows`` gives."""
    pairs = [f"xxhash64(a[{i}], a[{i + 1}])" for i in range(0, WINDOW, 2)]
    full = f"xxhash64(xxhash64({pairs[0]}, {pairs[1]}), xxhash64({pairs[2]}, {pairs[3]}), {form})"
    return f"transform(array(transform({words}, w -> xxhash64(w))), a -> IF(size(a) = {WINDOW}, {full}, xxhash64(a, {form})))[0]"


def _sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _marks(benchmark: DataFrame) -> DataFrame:
    """One row for each indexed window of each item and form."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    items = items.selectExpr("item_id", "xxhash64(text) AS item_th", *(f"{sql} AS {name}" for name, sql in FORMS.items())).where("vals <> array('')")
    # a form whose words do not stand beside the plain ones has no slots that can be told
    items = items.selectExpr("item_id", "item_th", "vals", *(f"IF(size({t}) = size(vals), {t}, vals) AS {t}" for t in ("templ", "names")), f"least(size(vals), {WINDOW}) AS len")
    rows = items.selectExpr("*", "explode(sequence(0, size(vals) - len)) AS q")
    rows = rows.selectExpr("item_id", "item_th", "q", "len", "size(vals) - len + 1 AS item_windows", *(f"slice({c}, q + 1, len) AS {c}" for c in FORMS))
    forms = ", ".join(f"named_struct('form', {k}, 'item_templ', {t}, 'h', {_window(w, k)})" for k, (t, w) in enumerate((("templ", "templ"), ("names", "names"), ("templ", "vals"))))
    rows = rows.selectExpr("item_id", "item_th", "q", "len", "item_windows", "vals AS item_vals", f"inline(array({forms}))")
    # templates without slots are met in plain words, as are those with too many
    slots = "size(filter(item_templ, w -> w LIKE '%⟨%'))"
    rows = rows.withColumn("slots", F.expr(slots)).withColumn("fewest", F.min(F.when(F.col("form") < _PLAIN, F.col("slots"))).over(Window.partitionBy("item_id", "item_th")))
    most = f"IF(fewest <= {WINDOW - LITERALS}, {WINDOW - LITERALS}, {WINDOW - DENSE_LITERALS})"
    return rows.where(f"form = {_PLAIN} OR len = {WINDOW} AND slots BETWEEN 1 AND {most}").drop("slots", "fewest", "item_th")


def _consistent() -> str:
    """SQL of the places of an alignment's windows ``ws`` (q, slots) that count."""
    pairs = "array_distinct(flatten(transform(ws, w -> w.slots)))"
    one_to_one = " AND ".join(f"size(ps) = size(array_distinct(transform(ps, x -> struct(x.kind, x.{c}))))" for c in ("was", "own"))
    clash = f"IF({one_to_one}, filter(ps, x -> false), filter(ps, x -> exists(ps, y -> y.kind = x.kind AND (y.was = x.was) <> (y.own = x.own))))"
    whole = "NOT exists(w.slots, s -> array_contains(bad, s))"
    literal = "NOT exists(w.slots, s -> s.was <> s.own)"
    return f"array_sort(array_distinct(transform(array({pairs}), ps -> transform(array({clash}), bad -> transform(filter(ws, w -> {whole} OR {literal}), w -> w.q))[0])[0]))"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, share): the items found in each document, with their consistent windows and the share of the item's windows."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    marks = stored(_marks(benchmark), "marks")
    short = [r.len for r in marks.where(f"len < {WINDOW}").select("len").distinct().collect()]
    sought = _sized(marks.select("h").distinct())
    # one pass over the texts: the windows of each form, and those of the lengths of short items
    windows = [_windows(sql, form) for form, sql in enumerate(FORMS.values())] + [_windows(FORMS["vals"], _PLAIN, n) for n in sorted(short)]
    found = docs.selectExpr("doc_id", "xxhash64(text) AS th", f"explode(array({', '.join(windows)})) AS hs").selectExpr("doc_id", "th", "posexplode(hs) AS (p, h)").join(sought, "h")
    hits = stored(found.dropDuplicates(["doc_id", "th", "p", "h"]), "hits")
    # the values at the slots, for documents with a hit alone
    own = _sized(hits.select(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th")).distinct())
    held = docs.withColumn("th", F.xxhash64("text"))
    held = held.join(own, held["doc_id"].eqNullSafe(own["own_id"]) & (held["th"] == own["own_th"]), "left_semi").dropDuplicates(["doc_id", "th"])
    held = held.selectExpr("doc_id AS d", "th AS t", *(f"{sql} AS {name}" for name, sql in FORMS.items()))
    met = hits.join(_sized(marks, BROADCAST_WINDOWS), "h")
    both = met.join(held, met["doc_id"].eqNullSafe(held["d"]) & (met["th"] == held["t"]))
    both = both.withColumn("templ", F.expr("slice(CASE form WHEN 0 THEN templ WHEN 1 THEN names ELSE vals END, p + 1, len)")).withColumn("vals", F.expr("slice(vals, p + 1, len)"))
    both = both.where(f"IF(form = {_PLAIN}, vals = item_vals, templ = item_templ)")
    # the forms' slots are checked apart, for their names differ
    slots = "filter(transform(sequence(0, len - 1), i -> named_struct('kind', IF(form = 1, concat('any', item_templ[i]), item_templ[i]), 'was', item_vals[i], 'own', vals[i])), s -> s.kind LIKE '%⟨%')"
    both = both.selectExpr("doc_id", "th", "item_id", "item_windows", "p - q AS diagonal", "q", f"{slots} AS slots")
    runs = both.groupBy("doc_id", "th", "item_id", "item_windows", "diagonal").agg(F.collect_list(F.struct("q", "slots")).alias("ws"))
    runs = runs.selectExpr("doc_id", "item_id", "item_windows", f"{_consistent()} AS qs").where("size(qs) > 0")
    longest = "aggregate(qs, named_struct('last', -2, 'run', 0, 'best', 0), (s, q) -> named_struct('last', q, 'run', IF(q = s.last + 1, s.run + 1, 1), 'best', greatest(s.best, IF(q = s.last + 1, s.run + 1, 1))), s -> s.best)"
    runs = runs.selectExpr("doc_id", "item_id", "item_windows", "qs", f"{longest} AS best")
    found = runs.groupBy("doc_id", "item_id", "item_windows").agg(F.max("best").alias("best"), F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("n"))
    return found.where(f"best >= {RUN - WINDOW + 1} OR 2 * n >= item_windows").selectExpr("doc_id", "item_id", "CAST(n AS BIGINT) AS n_windows", "round(n / item_windows, 6) AS share")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item of the benchmark is found."""
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_leak"]), "left_anti")
