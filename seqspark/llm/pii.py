"""Personal data by candidate gradient boosting, in built-in expressions and ``pyspark.ml``.

Strict patterns give the base spans.  High-recall generators propose further, overlapping spans:
anything around an at-sign, digit groups with separators, dotted numbers, account-like codes.
Boosted trees score each candidate on its format and its context.  They are not trained to repeat the
strict patterns: each candidate that a base span touches is written anew in forms that the patterns
miss (without its plus sign or country code, with other separators, an address without its domain's end,
bare digits after a cue word), which are positive, and as bare digits in its own place without a cue,
which is negative, as are the candidates that no base span touches and that do not look like the
positive ones to trees grown beforehand.  The sample is bounded and
deterministic (``SAMPLE_ROWS`` candidates); a fifth of its texts is held out and calibrates the margin.
Candidates over ``THRESHOLD`` that touch no base span become spans of kind ``other``; of overlapping ones
the likeliest stays.  Base spans always stay.

Defined results: a null text is the empty text; rows with null or repeated ids are each searched;
without candidates of both labels nothing is added; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from seqspark.llm import spans as S
from seqspark.llm.components import stored

SAMPLE_ROWS = 4000
THRESHOLD = 0.9
CONTEXT = 24
KINDS = ("email", "ip", "card", "phone", "other")

_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = "aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN CAST(substring({d}, -i, 1) AS INT) ELSE 2 * CAST(substring({d}, -i, 1) AS INT) - IF(substring({d}, -i, 1) > '4', 9, 0) END) % 10 = 0"
# a match can only begin where no word of the same letters is under way, or where the last match ended
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text RLIKE '[0-9]\\.[0-9]'", r"forall(split(x.v, '\\.'), p -> CAST(p AS DOUBLE) <= 255)"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "text RLIKE '[0-9][ -]?[0-9][ -]?[0-9]'", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN.format(d=_DIGITS)}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
GENERATORS = {
    "at": (r"(?<![^\s@])[^\s@]++@[^\s@]++", "contains(text, '@')", "true"),
    "digits": (r"[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+", "text RLIKE '[0-9]'", "true"),
    "dotted": (r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+", r"text RLIKE '[0-9]\\.[0-9]'", "true"),
    "code": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+", "text RLIKE '[A-Z]{2}[0-9]{2}'", "true"),
}
_FEATURES = {
    "length": "least(length(v), 200)",
    "digits": "least(length(regexp_replace(v, '[^0-9]', '')), 100)",
    "letters": "least(length(regexp_replace(v, '[^A-Za-z]', '')), 100)",
    "separators": "least(length(regexp_replace(v, '[^ ()./-]', '')), 100)",
    "dots": "least(length(regexp_replace(v, '[^.]', '')), 100)",
    "at": "IF(contains(v, '@'), 1, 0)",
    "dot_after_at": "IF(v RLIKE '@[A-Za-z0-9-]+[.][A-Za-z0-9-]', 1, 0)",
    "plus": "IF(v LIKE '+%', 1, 0)",
    "bracket": "IF(contains(v, '('), 1, 0)",
    "large_part": r"IF(exists(split(v, '[^0-9]+'), p -> coalesce(TRY_CAST(p AS DOUBLE) > 255, false)), 1, 0)",
    "luhn": f"IF(length(regexp_replace(v, '[^0-9]', '')) BETWEEN 12 AND 19 AND {_LUHN.format(d='''regexp_replace(v, '[^0-9]', '')''')}, 1, 0)",
    "joined_left": "IF(before RLIKE '[A-Za-z0-9]$', 1, 0)",
    "joined_right": "IF(after RLIKE '^[A-Za-z0-9]', 1, 0)",
    "cue_phone": "IF(lower(before) RLIKE 'phone|tel|call|fax|mobile', 1, 0)",
    "cue_card": "IF(lower(before) RLIKE 'card|visa|credit|account|iban', 1, 0)",
    "cue_mail": "IF(lower(before) RLIKE 'mail|contact|write', 1, 0)",
    "cue_net": "IF(lower(before) RLIKE 'host|server|addr|ip', 1, 0)",
}


def propose(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), a column of matches for each base kind, and ``candidates``: the generators' spans with their surroundings."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = [f"{S.matches('text', p, gate, keep)} AS {kind}" for kind, (p, gate, keep) in BASE.items()]
    proposed = ", ".join(S.matches("text", p, gate, keep) for p, gate, keep in GENERATORS.values())
    around = f"transform(concat({proposed}), x -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'before', substring(text, greatest(x.s - {CONTEXT - 1}, 1), least(x.s, {CONTEXT})), 'after', substring(text, x.e + 1, 8)))"
    return rows.selectExpr("doc_id", "xxhash64(text) AS th", *found, f"array_distinct({around}) AS candidates")


def _candidate_rows(found: DataFrame) -> DataFrame:
    """One row for each candidate, and ``label``: whether a base span touches it."""
    bases = ", ".join(BASE)
    rows = found.where("size(candidates) > 0").dropDuplicates(["doc_id", "th"]).selectExpr("doc_id", "th", f"transform(concat({bases}), x -> named_struct('s', x.s, 'e', x.e)) AS base", "inline(candidates)")
    touched = "CAST(exists(base, b -> b.s < e AND b.e > s) AS DOUBLE) AS label"
    return rows.selectExpr("doc_id", "th", "s", "e", "v", "before", "after", touched)


def _with_features(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("*", *(f"CAST({f} AS DOUBLE) AS f_{n}" for n, f in _FEATURES.items()))


# forms of a value that a base span touches: value, cue before it, label
_BARE_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_FORMS = (
    ("v", "before", 1),
    ("IF(contains(v, '@'), regexp_replace(v, '(@[^.]*)[.].*$', '$1'), regexp_replace(v, '^[+]', ''))", "before", 1),
    ("IF(contains(v, '@'), translate(v, '.', ','), regexp_replace(v, '^[+][0-9]+[ -]?', ''))", "before", 1),
    ("IF(contains(v, '@'), regexp_replace(v, '[0-9]', ''), trim(BOTH '.' FROM translate(regexp_replace(v, '[ ()-]+', '.'), '+', '')))", "before", 1),
    ("IF(contains(v, '@'), v, trim(BOTH '-' FROM translate(regexp_replace(v, '[ ().-]+', '-'), '+', '')))", "before", 1),
    ("IF(contains(v, '@'), v, trim(BOTH '.' FROM regexp_replace(regexp_replace(v, '^[+][0-9]+[ -]?', ''), '[ ()-]+', '.')))", "before", 1),
    ("IF(contains(v, '@'), v, trim(BOTH '-' FROM regexp_replace(regexp_replace(v, '^[+][0-9]+[ -]?', ''), '[ ().-]+', '-')))", "before", 1),
    (f"IF(contains(v, '@'), v, {_BARE_DIGITS})", "concat(before, array('phone ', 'call ', 'tel: ', 'card ', 'account ')[CAST(pmod(s, 5) AS INT)])", 1),
    ("IF(contains(v, '@'), '', regexp_replace(regexp_replace(v, '^[+][0-9]+[ -]?', ''), '[^0-9]', ''))", "concat(before, array('call ', 'phone: ', 'tel ', 'fax ', 'mobile ')[CAST(pmod(s, 5) AS INT)])", 1),
    (f"IF(contains(v, '@'), '', concat({_BARE_DIGITS}, '7'))", "before", 0),
    ("IF(contains(v, '@'), '', regexp_replace(regexp_replace(v, '^[+][0-9]+[ -]?', ''), '[^0-9]', ''))", "before", 0),
    (f"IF(contains(v, '@'), '', left({_BARE_DIGITS}, 8))", "before", 0),
)


def _written_anew(sample: DataFrame) -> DataFrame:
    """Untouched candidates, and the forms of the touched ones."""
    forms = ", ".join(f"named_struct('w', {w}, 'b', {b}, 'y', {y}.0D)" for w, b, y in _FORMS)
    rows = sample.selectExpr("doc_id", "th", "s", "e", "after", "label = 1 AS touched", f"inline(IF(label = 0, array(named_struct('w', v, 'b', before, 'y', 0.0D)), array({forms})))")
    return rows.where("w <> ''").selectExpr("doc_id", "th", "s", "e", "w AS v", "b AS before", "after", "touched", "y AS label").distinct()


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """A function that adds ``probability`` to candidate rows; null if the sample has one label only.

    The sample holds the ``sample_rows`` candidates with the smallest hash.
    """
    key = F.xxhash64("doc_id", "s", "e", "v")
    sample = rows.withColumn("key", key).orderBy("key", "s", "e").limit(sample_rows)
    sample = stored(_with_features(_written_anew(sample)).coalesce(2), "candidate-sample")
    vector = VectorAssembler(inputCols=[f"f_{n}" for n in _FEATURES], outputCol="features")
    grower = Pipeline(stages=[vector, GBTClassifier(labelCol="label", featuresCol="features", maxDepth=5, maxIter=20, stepSize=0.4, seed=7)])
    side = F.pmod(F.xxhash64("doc_id", "th"), F.lit(5))

    def mixed(df: DataFrame) -> bool:
        return df.select("label").distinct().count() == 2

    if not mixed(sample.where(side > 0)):
        return None
    # an untouched candidate that looks like the touched ones may well be personal data: it does not count as negative
    first = vector_to_array(F.col("probability"))[1]
    sample = stored(grower.fit(sample.where(side > 0)).transform(sample).where(F.col("touched") | (first <= 0.5)).select(sample.columns), "candidate-labels")
    fit, held = sample.where(side > 0), sample.where(side == 0)
    if not (mixed(fit) and mixed(held)):
        return None
    trees = grower.fit(fit)

    def margin(df: DataFrame) -> DataFrame:
        df = df if "f_length" in df.columns else _with_features(df)
        return trees.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")

    line = VectorAssembler(inputCols=["margin"], outputCol="features")
    scale = LogisticRegression(labelCol="label", featuresCol="features", regParam=0.01).fit(line.transform(margin(held)))
    slope, shift = float(scale.coefficients[0]), float(scale.intercept)
    return lambda df: margin(df).withColumn("probability", 1 / (1 + F.exp(-(F.lit(slope) * F.col("margin") + F.lit(shift)))))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base matches (s, e, v) by kind, and ``other``: the further spans the trees select."""
    return _find(docs, threshold).drop("th")


def _find(docs: DataFrame, threshold: float) -> DataFrame:
    """The result of ``find`` with ``th``, the hash of the text."""
    found = stored(propose(docs), "pii")
    score = train(_candidate_rows(found))
    none = S.EMPTY
    if score is None:
        return found.selectExpr("doc_id", "th", *BASE, f"{none} AS other")
    chosen = score(_candidate_rows(found).where("label = 0")).where(F.col("probability") >= threshold)
    # of overlapping candidates the likeliest stays, the first in the text on ties; candidates are parted where none reaches over a place, so lists are short
    by = Window.partitionBy("doc_id", "th").orderBy("s", "e")
    chosen = chosen.withColumn("fresh", F.coalesce(F.col("s") >= F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    chosen = chosen.withColumn("part", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = chosen.groupBy("doc_id", "th", "part").agg(F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("p"), "s", "e", "v"))).alias("all"))
    greedy = f"aggregate(all, {none}, (a, x) -> IF(exists(a, y -> y.s < x.e AND y.e > x.s), a, array_append(a, named_struct('s', x.s, 'e', x.e, 'v', x.v))))"
    chosen = chosen.groupBy("doc_id", "th").agg(F.array_sort(F.flatten(F.collect_list(F.expr(greedy)))).alias("more"))
    chosen = chosen.selectExpr("doc_id AS chosen_id", "th AS chosen_th", "more")
    rows = found.join(chosen, found["doc_id"].eqNullSafe(chosen["chosen_id"]) & (found["th"] == chosen["chosen_th"]), "left")
    return rows.selectExpr("doc_id", "th", *BASE, f"coalesce(more, {none}) AS other")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the text with each span of ``find`` replaced by its kind in angle brackets; overlapping spans become one, of the kind that begins first."""
    every = ", ".join(S.of_kind(kind, n) for n, kind in enumerate(KINDS))
    spans = _find(docs, threshold).dropDuplicates(["doc_id", "th"]).selectExpr("doc_id AS d", "th", f"array_sort(concat({every})) AS spans")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.join(spans, rows["doc_id"].eqNullSafe(spans["d"]) & (F.xxhash64(F.coalesce(rows["text"], F.lit(""))) == spans["th"]), "left")
    names = ", ".join(f"'<{k}>'" for k in KINDS)
    cut = f"aggregate(spans, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', greatest(a.at, x.e), 'out', IF(x.s < a.at, a.out, concat(a.out, substring(text, a.at + 1, x.s - a.at), array({names})[x.k]))), a -> concat(a.out, substring(text, a.at + 1)))"
    return rows.selectExpr("doc_id", f"{cut} AS text")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans and their number, from the result of ``find``."""
    every = [S.of_kind(kind, n) for n, kind in enumerate(KINDS)]
    own = S.joined(f"concat({', '.join(every[:-1])})", KINDS)
    return found.selectExpr("doc_id", *(f"CAST(size({k}) AS BIGINT) AS n_{k}" for k in BASE), f"sha2({own}, 256) AS base_sha256", f"{S.joined(f'concat({", ".join(every)})', KINDS)} AS spans", f"CAST({' + '.join(f'size({k})' for k in KINDS)} AS BIGINT) AS n_spans")
