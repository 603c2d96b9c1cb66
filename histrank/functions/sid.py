"""Semantic ids: <a_1><b_7><c_3>, one token for each level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_sid(sid: Column) -> Column:
    """sid without white space."""
    return F.regexp_replace(sid, r"\s+", "")


def sid_tokens(sid: Column) -> Column:
    """Tokens of a semantic id; empty if anything else is in it, null and empty texts included."""
    text = normalize_sid(sid)
    return F.when(text.rlike(r"^(<[A-Za-z]_\d+>)+$"), F.regexp_extract_all(text, F.lit(r"(<[A-Za-z]_\d+>)"))).otherwise(F.array().cast("array<string>"))


def sid_prefix(tokens: Column, level: int | Column) -> Column:
    """The first `level` tokens as one text; null where there are fewer."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.when(F.size(tokens) >= level, F.array_join(F.slice(tokens, 1, level), ""))


def sid_prefixes(tokens: Column) -> Column:
    """All prefixes (level, prefix), shortest first."""
    levels = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))
    return F.transform(levels, lambda n: F.struct(n.alias("level"), F.array_join(F.slice(tokens, F.lit(1), n), "").alias("prefix")))


def codes_to_sid(codes: Column, offset: int = 0) -> Column:
    """Codes of each level as a semantic id; the level letters are a, b, c and so on."""
    token = F.transform(codes, lambda c, i: F.concat(F.lit("<"), F.char(F.lit(97) + i), F.lit("_"), (c + F.lit(offset)).cast("string"), F.lit(">")))
    return F.array_join(token, "")


def unpack_codes(packed: Column, levels: int, bits: int) -> Column:
    """Codes of `bits` bits each from a packed number, the lowest bits first."""
    return F.array(*[F.shiftright(packed, i * bits).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(levels)])


def normalise_id(x: Column) -> Column:
    """An item id as text without outer blanks; whole numbers lose a decimal part of zeros."""
    x = F.trim(x)
    return F.when(F.rlike(x, F.lit(r"^-?[0-9]+[.]0+$")), F.regexp_replace(x, "[.]0+$", "")).otherwise(x)
