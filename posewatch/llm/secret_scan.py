"""Secrets in whole texts, with linking of the parts of one credential (free style).

Three kinds are reported wherever they stand: assignments, access identifiers and long
hexadecimal runs. A credential has complementary parts: an access identifier, a secret
and an endpoint. Parts that alone mean little (weak ones) are reported only if a part of
another role, strong or weak, lies in the same scope, which is found by an interval join:
every part opens an interval of `REACH` code points to both sides, and weak parts of
other roles that touch it are linked to it.

Every text is read in one row; nothing is shuffled. All parts are found over the whole
text, and the reach of each is looked up in sorted places.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewatch.llm import tables

REACH = 400
# The base kinds in their order, then the kinds of linked weak parts.
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A,
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
WEAK_ACCESS = re.compile(
    r"\b(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}|\b(?:user(?:name)?|login|client_id)\x20*[:=]\x20*[\w.@+-]{3,}",
    re.I | re.A,
)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(
    r"\b(?:https?|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+"
    r"|\b(?:host|endpoint|server)\x20*[:=]\x20*[\w.:-]+",
    re.I | re.A,
)
DOMAIN = re.compile(r"\.(?:amazonaws\.com|internal|local)\b", re.I | re.A)
LABELS = re.compile(r"[a-z0-9-]++(?:\.[a-z0-9-]++)*+", re.I | re.A)
EDGE = re.compile(r"\b(?=[a-z0-9-])", re.I | re.A)
# Which roles complete which: a weak part needs a part of another role nearby.
ROLE = {"assign": "secret", "access": "id", "hex": "secret"}


def base_spans(text: str) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) of the kinds that count alone. The keyword test is implied by
    the pattern, so it only saves time."""
    small = text.lower()
    if any(k in small for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield m.start(), "assign", m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield m.start(), "access", m.end()
    for m in HEX.finditer(text):
        yield m.start(), "hex", m.end()


def host_names(text: str) -> Iterator[tuple[int, int]]:
    """Host names with a domain in `DOMAIN`. The labels are read once, as a pattern that
    tries every start would take the square of a long run's length."""
    found = [(m.start(), m.end()) for m in DOMAIN.finditer(text)]
    i = 0
    for run in LABELS.finditer(text) if found else ():
        if i == len(found):
            return
        first, last = EDGE.search(text, run.start(), run.end()), None
        while i < len(found) and found[i][0] < run.end():
            if first and found[i][0] > first.start():
                last = found[i][1]
            i += 1
        if last is not None:
            yield first.start(), last


def endpoints(text: str) -> Iterator[tuple[int, int]]:
    """Endpoints from left to right, without those that begin inside another one."""
    high = 0
    for s, e in sorted([*(m.span() for m in ENDPOINT.finditer(text)), *host_names(text)], key=lambda x: (x[0], -x[1])):
        if s >= high:
            yield s, e
            high = e


def matches(pattern: re.Pattern):
    return lambda text: (m.span() for m in pattern.finditer(text))


WEAK = {
    "weak_access": ("id", matches(WEAK_ACCESS)),
    "weak_secret": ("secret", matches(WEAK_SECRET)),
    "endpoint": ("place", endpoints),
}


def linked_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Weak parts that lie within reach of a part of another role, strong or weak.

    A part is within reach if it has a code point among the `REACH` ones before or after
    the other. Parts that overlap do not complete each other: what overlaps a base span
    belongs to it, and a weak part inside another one (a path of a URL) is no second part.
    """
    taken = sorted((s, e) for s, _, e in base)
    weak = []
    for kind, (role, find) in WEAK.items():
        i = 0
        for s, e in find(text):
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if i == len(taken) or taken[i][0] >= e:  # not part of a base span
                weak.append((s, kind, e, role))
    if not weak:
        return []
    starts, ends = {}, {}
    for s, e, role in [*((s, e, r) for s, _, e, r in weak), *((s, e, ROLE[k]) for s, k, e in base)]:
        starts.setdefault(role, []).append(s)
        ends.setdefault(role, []).append(e)
    for places in (*starts.values(), *ends.values()):
        places.sort()

    def completed(s: int, e: int, role: str) -> bool:
        return any(
            bisect_right(ends[r], s - REACH) < bisect_right(ends[r], s)
            or bisect_left(starts[r], e) < bisect_left(starts[r], e + REACH)
            for r in starts
            if r != role
        )

    return [(s, k, e) for s, k, e, role in weak if completed(s, e, role)]


def in_order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[1])))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every whole text.

    Returns `id_col` and `spans`, an array of (kind, start, end, base) by start and then
    by kind, in code points with the end exclusive; `base` tells base spans from linked
    ones. One row for each input row, repeated ids included; a null or empty text has an
    empty array, a null id stays null, other columns are not looked at, and an empty
    table gives no rows.
    """

    def work(columns: list[list]) -> list[list]:
        out = []
        for text in columns[1]:
            base = in_order(list(base_spans(text or "")))
            strong = {*base}
            found = in_order([*base, *linked_spans(text or "", base)])
            out.append(
                [{"kind": k, "start": s, "end": e, "base": (s, k, e) in strong} for s, k, e in found]
            )
        return [columns[0], out]

    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    return tables.map_rows(df, [id_col, text_col], schema, work)


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with every span replaced by its kind in brackets; nulls stay null.

    Columns, their order and rows stay as they are.
    """
    names = df.columns
    at = names.index(text_col)

    def work(columns: list[list]) -> list[list]:
        out = []
        for text in columns[at]:
            base = in_order(list(base_spans(text or "")))
            spans = merged_labels([*base, *linked_spans(text or "", base)])
            if spans:
                cuts = [0, *(x for s, _, e in spans for x in (s, e)), len(text)]
                pieces = [text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
                text = pieces[0] + "".join(f"[{k}]{p}" for (_, k, _), p in zip(spans, pieces[1:], strict=True))
            out.append(text)
        return [*columns[:at], out, *columns[at + 1 :]]

    schema = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in df.dtypes)
    return tables.map_rows(df, [f"`{n.replace('`', '``')}`" for n in names], schema, work)


def merged_labels(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Overlapping spans become one, with the kind of the first."""
    out: list[tuple[int, str, int]] = []
    for s, k, e in in_order(spans):
        if out and s < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(e, out[-1][2]))
        else:
            out.append((s, k, e))
    return out
