"""Secret scans over a trigram inverted index, in built-in expressions alone.

From each rule's regular expression a Boolean query over trigrams is derived: one alternative for
each way through the pattern's literals, and all trigrams of an alternative must occur.  The index
holds postings (trigram, document) of the trigrams that the queries name.  Postings are intersected
by counting, for each alternative and document, its distinct trigrams; candidates are verified with
the regular expression itself.  Rules without mandatory trigrams, such as bare hexadecimal runs,
scan every text.  The index is built over lower-cased text, so it serves rules of either case.

Defined results: a null text is the empty text and has no spans; rows with a null or repeated id are
each scanned (their candidates are pooled, the verification is their own); other columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from seqspark.llm import spans as S
from seqspark.llm.components import stored

#: Ways through one pattern that are told apart; beyond it, a part counts as unknown.
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``pattern`` is Java's, ``keep`` is SQL on a match ``x.v``."""

    name: str
    pattern: str
    keep: str = "true"


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", _ASSIGN, f"length(regexp_extract(x.v, {S.literal(_ASSIGN)}, 2)) >= 8"),
    Rule("access", r"AKIA[A-Z0-9]+", "length(x.v) >= 16"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


def _ways(tree) -> list[list[str]]:
    """The ways through a parsed pattern, each a list of literal runs; an empty run marks unknown text."""
    ways: list[list[str]] = [[""]]
    for op, arg in tree:
        if op is sre.LITERAL:
            parts = [[chr(arg)]]
        elif op is sre.SUBPATTERN:
            parts = _ways(arg[-1])
        elif op is sre.BRANCH:
            parts = [w for branch in arg[1] for w in _ways(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, child = arg
            inner = _ways(child)
            if (low, high) == (0, 1) and all(len(w) == 1 for w in inner):
                parts = [[""], *inner]
            elif low:
                parts = [[*w, ""] if len(w) > 1 or high != 1 else w for w in inner]
            else:
                parts = [["", ""]]
        elif op is sre.AT:
            continue
        else:
            parts = [["", ""]]
        if len(ways) * len(parts) > MAX_ALTERNATIVES:
            parts = [["", ""]]
        ways = [[*w[:-1], w[-1] + p[0], *p[1:]] for w in ways for p in parts]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams that a match must contain, in lower case; null when some way through the pattern has none."""
    out = set()
    for way in _ways(parser.parse(pattern)):
        grams = frozenset(run.lower()[i : i + 3] for run in way for i in range(len(run) - 2))
        if not grams:
            return None
        out.add(grams)
    # an alternative that asks for more than another adds nothing
    return sorted((a for a in out if not any(b < a for b in out)), key=sorted)


def trigram_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): the inverted index of ``docs`` over the given trigrams, one posting for each document and trigram."""
    list_ = ", ".join(S.literal(t) for t in trigrams)
    return docs.selectExpr("doc_id", f"explode(transform(array(lower(text)), t -> filter(array({list_}), g -> contains(t, g)))[0]) AS trigram").select("trigram", "doc_id").distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): for each document that meets a rule's trigram query, the numbers of the rules it meets."""
    clauses = [(n, c, grams) for n, r in enumerate(rules) for c, grams in enumerate(trigram_query(r.pattern) or [])]
    wanted = [(g, n, c, len(grams)) for n, c, grams in clauses for g in sorted(grams)]
    # a fixed table: its size follows the rules alone
    queries = docs.sparkSession.createDataFrame(wanted, "trigram string, rule int, clause int, size long")
    postings = trigram_postings(docs, sorted({w[0] for w in wanted}))
    met = postings.join(F.broadcast(queries), "trigram").groupBy("doc_id", "rule", "clause").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n = size")
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, and for each rule a column of its name with its matches (s, e, v) in the whole text."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = stored(candidates(docs, rules), "candidates").withColumnRenamed("doc_id", "held_id")
    rows = docs.join(held, docs["doc_id"].eqNullSafe(held["held_id"]), "left")
    columns = []
    for n, rule in enumerate(rules):
        gate = f"array_contains(rules, {n})" if trigram_query(rule.pattern) is not None else f"text RLIKE {S.literal(rule.pattern)}"
        columns.append(f"{S.matches('text', rule.pattern, f'coalesce({gate}, false)', rule.keep)} AS {rule.name}")
    return rows.selectExpr("doc_id", *columns)


def digest(found: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts of the base rules, the digest of their spans, all spans and their number, from the result of ``scan``."""
    names = tuple(r.name for r in rules)
    every = [S.of_kind(r.name, n) for n, r in enumerate(rules)]
    own = S.joined(f"concat({', '.join(every[: len(base)])})", names)
    return found.selectExpr("doc_id", *(f"CAST(size({r.name}) AS BIGINT) AS n_{r.name}" for r in base), f"sha2({own}, 256) AS base_sha256", f"{S.joined(f'concat({", ".join(every)})', names)} AS spans", f"CAST({' + '.join(f'size({n})' for n in names)} AS BIGINT) AS n_spans")
