"""Places of regular-expression matches in built-in expressions: SQL text over string columns.

Spans count code points, end exclusive.  Patterns are Java's and must not match the empty text.
"""

from __future__ import annotations

EMPTY = "CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, v: STRING>>)"


def literal(pattern: str) -> str:
    """A SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches whose places one fold adds up; a fold copies its list at each step, so lists are short and their sums are added up likewise.
PART = 128


def _placed(found: str, at: str) -> str:
    """SQL of the spans of a list of matches (m, and the length b before it) from the place ``at`` on."""
    return (
        f"aggregate({found}, named_struct('at', {at}, 'out', {EMPTY}),"
        " (a, x) -> IF(x.m IS NULL, a, named_struct('at', a.at + x.b + length(x.m), 'out',"
        " array_append(a.out, named_struct('s', a.at + x.b, 'e', a.at + x.b + length(x.m), 'v', x.m)))), a -> a.out)"
    )


def matches(text: str, pattern: str, gate: str = "true", keep: str = "true") -> str:
    """SQL of array<struct<s, e, v>>: the leftmost non-overlapping matches whose value ``x.v`` passes ``keep``; none where ``gate`` is false.

    The text between matches comes from ``split``, which finds the same matches; lengths add up to places, in parts of ``PART`` matches, so that
    the time follows the number of matches.
    """
    p = literal(pattern)
    found = f"zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (m, b) -> named_struct('m', m, 'b', length(b)))"
    parts = f"transform(sequence(0, CAST((size(f) - 1) DIV {PART} AS INT)), i -> slice(f, i * {PART} + 1, {PART}))"
    total = "aggregate(p, 0, (a, x) -> a + x.b + coalesce(length(x.m), 0))"
    begins = f"aggregate(transform(ps, p -> {total}), array(0), (a, n) -> array_append(a, a[size(a) - 1] + n))"
    many = f"transform(array({parts}), ps -> flatten(zip_with(ps, slice({begins}, 1, size(ps)), (p, at) -> {_placed('p', 'at')})))[0]"
    spans = f"transform(array({found}), f -> IF(size(f) <= {PART}, {_placed('f', '0')}, {many}))[0]"
    return f"IF({gate}, filter({spans}, x -> {keep}), {EMPTY})"


def of_kind(spans: str, kind: int) -> str:
    """SQL of array<struct<s, k, e>>: spans as a sortable list; ``kind`` is the place in the list of kinds."""
    return f"transform({spans}, x -> named_struct('s', x.s, 'k', {kind}, 'e', x.e))"


def joined(spans: str, kinds: tuple[str, ...]) -> str:
    """SQL of ``kind:start:end`` of each span by start, then kind, joined by commas."""
    names = ", ".join(literal(k) for k in kinds)
    return f"array_join(transform(array_sort({spans}), x -> concat_ws(':', array({names})[x.k], x.s, x.e)), ',')"
