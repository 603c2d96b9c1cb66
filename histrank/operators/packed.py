"""Several values packed in one field: a parsing expression grammar with ordered choice.

    list      <- blank* ( open values close / values ) blank* end        (open and close are partners)
    values    <- ( delimiter / blank / value )*
    value     <- quoted / bracketed / bare
    quoted    <- q ( escaped / doubled q / char / q !closing )* q &closing    (q: " or ' ; also typographic pairs)
    bracketed <- open ( quoted / bracketed / char )* close &closing           (kept as it stands, delimiters and all)
    closing   <- blank* ( delimiter / end )
    bare      <- ( !delimiter any )+                            (error if it starts with a quote or an open bracket)

Choice is ordered: where a quote or bracket is never closed before a delimiter or the end, the parser goes back and
reads the value as bare, with an error flag where the partner is missing.  Partners of brackets are found once for a
text (the memo), and repetitions are possessive, so parsing is linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing list.
MISSING = ("nan", "None", "null", "not_available")
# Brackets around a whole list or a value.
BRACKETS = {"[": "]", "(": ")", "{": "}"}
# Typographic quotes, opening and closing.
QUOTES = {"“": "”", "‘": "’", "«": "»", "„": "“"}

VALUES = T.ArrayType(
    T.StructType([T.StructField("value_pos", T.LongType()), T.StructField("item_value", T.StringType()), T.StructField("error", T.BooleanType())])
)


@dataclass(frozen=True)
class Notation:
    """What delimits the values of a field: delimiters, longest first, and brackets that may enclose the list."""

    delimiters: tuple[str, ...]
    brackets: str = "[({"

    def _ends(self) -> tuple[str, str, str]:
        """Patterns: any delimiter; the characters of delimiters of one; what may follow a closed value."""
        d = "|".join(re.escape(x) for x in self.delimiters)
        single = "".join(re.escape(x) for x in self.delimiters if len(x) == 1)
        return d, single, rf"[^\S{single}]*+(?:{d}|\Z)"

    def quoted(self, ends: str) -> list[str]:
        """Patterns of the quoted values, each with one group."""
        close = rf"(?={ends})"
        out = [rf'"((?:[^"\\]|\\.|""|\\|"(?!{ends}))*+)"{close}', rf"'((?:[^'\\]|\\.|''|\\|'(?!{ends}))*+)'{close}"]
        return out + [rf"{a}((?:[^{b}]|{b}(?!{ends}))*+){b}{close}" for a, b in QUOTES.items()]

    def compiled(self) -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
        """(delimiters, quoted and bare values; an open bracket that starts a value; brackets and quoted values; an end)."""
        d, single, ends = self._ends()
        several = [x for x in self.delimiters if len(x) > 1]
        bare = rf"((?:{''.join(f'(?!{re.escape(x)})' for x in several)}[^{single}])++)"
        values = re.compile(rf"(?:{d}|\s)++|" + "|".join([*self.quoted(ends), bare]), re.DOTALL)
        before = rf"(?:\A|[{single}{''.join(re.escape(x[-1]) for x in several)}])"
        inside = "|".join(self.quoted(rf"[^\S{single}]*+(?:{d}|[\])}}]|\Z)"))
        marks = re.compile(rf"(?:(?<=[{single}{''.join(re.escape(x[-1]) for x in several)}\[({{])|\A)\s*+(?:{inside})|[\[\](){{}}]", re.DOTALL)
        return values, re.compile(rf"{before}\s*+[\[({{]"), marks, re.compile(ends)


IDS = Notation(("::", ",", ";", "|", "\t", "\n", "\r", " "))
TITLES = Notation(("::", ",", ";", "|", "\t", "\n", "\r"), brackets="[")


def _partners(text: str, marks: re.Pattern) -> dict[int, int]:
    """Where each bracket outside quotes has its partner; brackets without one are left out."""
    out: dict[int, int] = {}
    waiting: list[int] = []
    for m in marks.finditer(text):
        at = m.end() - 1
        if m.lastindex is not None:
            continue  # a quoted value
        if text[at] in BRACKETS:
            waiting.append(at)
        elif waiting and BRACKETS[text[waiting[-1]]] == text[at]:
            out[waiting[-1]], out[at] = at, waiting[-1]
            waiting.pop()
    return out


def parse_values(text: str | None, notation: Notation) -> list[tuple[int, str, bool]]:
    """(position, value, error) of each value in text, from left to right.

    None, blank texts, an empty list and the words of MISSING give none; nothing between two delimiters is no value.
    A bracket around the whole list that has no partner is dropped and flags all values; a value that starts
    with a quote or bracket without partner is flagged.  A bracketed value keeps its brackets and what they hold.
    """
    if text is None:
        return []
    text = text.strip()
    if not text or text in MISSING:
        return []
    values, opens, marks, ends = _compiled(notation)
    broken, partners = False, None
    if text[0] in notation.brackets:
        whole = len(text) > 1 and text[-1] == BRACKETS[text[0]]
        if not whole or any(c in text[1:-1] for c in "[](){}"):
            partners = _partners(text, marks)
            mate = partners.get(0)
            # brackets that close before the end and another pair at the end: a list of bracketed values
            whole = whole and (mate is None or mate == len(text) - 1 or partners.get(len(text) - 1) is None)
            broken = not whole and mate is None
        if whole or broken:
            text, partners = text[1:-1] if whole else text[1:], None
    out: list[tuple[int, str, bool]] = []
    bare = values.groups
    if not opens.search(text):
        found: Iterator[re.Match] = values.finditer(text)
    else:
        partners = _partners(text, marks) if partners is None else partners
        found = _with_brackets(text, values, partners, ends)
    for m in found:
        kind = m.lastindex
        if kind is None:
            continue
        value, error = m.group(kind), broken
        if kind == 1:
            value = re.sub(r'\\(["\'\\])|""', lambda e: e[1] or '"', value) if '"' in value or "\\" in value else value
        elif kind == 2:
            value = re.sub(r"\\([\"'\\])|''", lambda e: e[1] or "'", value) if "'" in value or "\\" in value else value
        elif kind == bare and value.lstrip()[:1] in ('"', "'", "“"):
            value, error = value.lstrip()[1:], True
        elif kind == bare and m.re is values and value[:1] in BRACKETS and m.start() not in partners:
            error = True
        if value := value.strip():
            out.append((len(out), value, error))
    return out


def _with_brackets(text: str, values: re.Pattern, partners: dict[int, int], ends: re.Pattern) -> Iterator[re.Match]:
    """The matches of values, with bracketed values in place of bare ones where they close at the end of a value."""
    at = 0
    while at < len(text):
        if text[at] in BRACKETS and at in partners and ends.match(text, partners[at] + 1):
            m = _ANY.match(text, at, partners[at] + 1)
        else:
            m = values.match(text, at)
        yield m
        at = m.end()


_ANY = re.compile("(.+)", re.DOTALL)
_CACHE: dict[Notation, tuple[re.Pattern, ...]] = {}


def _compiled(notation: Notation) -> tuple[re.Pattern, ...]:
    if notation not in _CACHE:
        _CACHE[notation] = notation.compiled()
    return _CACHE[notation]


def packed_values(text: Column, notation: Notation) -> Column:
    """Array of (value_pos, item_value, error) for a packed text, as one Arrow-batched pass."""

    @F.pandas_udf(VALUES)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:  # texts that repeat in a batch are parsed once
            codes, distinct = pd.factorize(texts)
            parsed = [[{"value_pos": p, "item_value": v, "error": e} for p, v, e in parse_values(t, notation)] for t in distinct] + [[]]
            yield pd.Series([parsed[k] for k in codes], dtype=object)

    return parse(text)


def split_packed(df: DataFrame, key: str, text: str, notation: Notation) -> DataFrame:
    """(row_key, value_pos, item_value, error): one row for each value of each text.

    Rows of df that repeat give repeated rows.  Other columns of df, whatever their names, are not read.
    """
    picked = df.select(F.col(f"`{key}`").alias("row_key"), packed_values(F.col(f"`{text}`"), notation).alias("v"))
    return picked.select("row_key", F.explode("v").alias("v")).select("row_key", "v.value_pos", "v.item_value", "v.error")
