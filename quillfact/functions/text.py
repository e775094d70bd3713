"""Text primitives as columns: counting, trimming, number formatting, grounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfact.functions import lexicon as L


def strip(c: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def like(c: Column, pattern: str | Column) -> Column:
    return c.rlike(pattern) if isinstance(pattern, str) else F.rlike(c, pattern)


def let(body, **values: Column) -> Column:
    """body(x) with the values bound to the fields of x once, however often body names them; a ladder of rules that repeats
    its inputs would otherwise copy their expressions into every rule."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(name) for name, c in values.items()])), lambda x: body(x)), 1)


def fence(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed here, once a row: a generator of one row keeps later filters and projections from
    being rewritten in terms of the long expressions behind them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def literal(c: Column) -> Column:
    """c as a pattern that matches just its text."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def first_of(c: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first key of the table that c contains."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(k)), F.lit(v)) for k, v in table])


def either(a: Column, b: Column) -> Column:
    """a, or b where a is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def token_estimate(c: Column) -> Column:
    return F.floor(F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))) * F.lit(L.TOKENS_PER_WORD)).cast("int")


def short(x: Column) -> Column:
    """A double with six significant digits and no trailing zeros; a tie goes to the even digit."""
    size = F.abs(x) * F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(x))))  # its six digits stand before the point
    down = (size - F.floor(size) == 0.5) & (F.floor(size) % 2 == 0)
    sci = F.format_string("%.5e", F.when(down, x * (1 - 1e-10)).otherwise(x))
    exponent = F.regexp_extract(sci, r"e([-+]\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(sci.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    scientific = F.regexp_replace(sci, r"\.?0+e", "e")
    return F.when(x.isNull(), F.lit(None)).when(x == 0, "0").when(exponent.between(-4, 5), plain).otherwise(scientific)


def grounding(quote: Column, text: Column) -> Column:
    """1.0 verbatim, 0.85 without regard to case, 0.70 without regard to white space, else 0."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    return (
        F.when((F.coalesce(quote, F.lit("")) == "") | (F.coalesce(text, F.lit("")) == ""), 0.0)
        .when(F.contains(text, quote), 1.0)
        .when(F.contains(F.lower(text), F.lower(strip(quote))), 0.85)
        .when(F.contains(flat(text), flat(strip(quote))), 0.70)
        .otherwise(0.0)
    )


def final_confidence(extraction: Column, ground: Column, binding: Column) -> Column:
    return F.round(extraction * ground * binding, 3)
