"""What a number in a line stands for: an ordered ladder of rules, as one column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfact.functions import lexicon as L
from quillfact.functions.text import has_any, let, like, literal, strip


def index_base(line: Column) -> tuple[Column, Column]:
    """Year and value of an index base such as [2001=100]; null without one."""
    pattern = r"(?i)(?:[\[\(]|\b)(?:FY\s*)?(\d{4})(?:-\d{2,4})?\s*=\s*(\d+)(?:[\]\)]|\b)"
    return tuple(F.try_to_number(F.nullif(F.regexp_extract(line, pattern, g), F.lit("")), F.lit("999999999")).cast("int") for g in (1, 2))


def navigation(line: Column) -> Column:
    """Dot leaders that end in a number, or a page reference."""
    return F.coalesce(like(strip(line), r"(?:\.\s*|…\s*){2,}\d+\s*$|\.{2,}\s*\d+|(?i:\b(?:page|p\.?)\s*\d+\b)"), F.lit(False))


def section_prefix(line: Column, value: Column, number: Column | None = None) -> Column:
    """Whether value (or number) is the outline number that the line begins with."""
    c = F.lower(strip(F.coalesce(line, F.lit(""))))
    number = F.lit(None).cast("string") if number is None else strip(number)
    # nothing begins an empty line; where the line is a literal one, the planner drops the rest
    return (c != "") & let(_begins, line=c, value=strip(value), number=number)


OUTLINE = r"(?:[a-z0-9]+\.)+[a-z0-9]+|[0-9]+[a-z]\.[0-9]+|[ivxlcdm]+(?:\.[0-9]+)+"


def _begins(x: Column) -> Column:
    title = F.regexp_extract(x["line"], r"^\s*(?:appendix\s+table|table|chart|figure|box)\s+([a-z0-9\.\-]+)", 1)
    found = F.regexp_extract(x["line"], rf"^\s*\(?({OUTLINE})\)?\s+([a-z%])", 1)
    return let(_is_prefix, title=title, found=found, line=x["line"], value=x["value"], number=x["number"])


def _is_prefix(x: Column) -> Column:
    same = lambda c: F.coalesce(x["value"] == c, F.lit(False)) | F.coalesce(x["number"] == c, F.lit(False))
    in_title = (x["title"] != "") & (same(x["title"]) | F.coalesce(F.array_contains(F.split(x["title"], r"\."), x["value"]), F.lit(False)))
    rest = strip(F.regexp_replace(x["line"], rf"^\s*\(?(?:{OUTLINE})", ""))
    is_unit = like(rest, r"^(?:per cent|percent|%|bps|basis\s+points|crore|million|billion|lakh|shares)")
    lead = lambda y: F.regexp_extract(y["bare"], r"^\d+", 0)
    # most lines begin with no outline number: what is cut from it is not worked out for them
    return in_title | ((x["found"] != "") & ~is_unit & let(lambda y: ((lead(y) != "") & same(lead(y))) | same(y["bare"]), bare=strip(F.regexp_replace(x["found"], r"^[a-z.]+", ""))))


def number_role(num: Column, raw: Column, unit: Column, line: Column) -> Column:
    """struct<role, confidence> of a number; document structure is ruled out before any business meaning."""
    empty = F.lit("")
    raw, unit, full = F.coalesce(raw, empty), F.coalesce(unit, empty), F.coalesce(line, empty)
    year, value = index_base(full)
    return let(
        _role_ladder, num=strip(num), raw=strip(raw), full=full, bare=strip(full), both=F.lower(F.concat(empty, F.lit(" "), raw, F.lit(" "), unit, F.lit("  "), full)), own=F.lower(F.concat_ws(" ", raw, unit)), n=literal(strip(num)), year=year, value=value
    )


def _role_ladder(x: Column) -> Column:
    empty = F.lit("")
    num, raw, full, bare, both, own, n, year, value = (x[c] for c in ("num", "raw", "full", "bare", "both", "own", "n", "year", "value"))
    # a pattern with the number in it is compiled anew for each row: one that needs some word is tried where the word is
    near = lambda before, after, c=both, words=(): reduce(lambda a, b: a & b, [*([has_any(c, words)] if words else []), F.contains(c, num), like(c, F.concat(F.lit(before), n, F.lit(after)))])
    whole = F.try_to_number(F.nullif(F.regexp_extract(num, r"^[-+]?(\d+)(?:\.\d+)?$", 1), empty), F.lit("999999999999999")).cast("long")
    bps = like(both, r"\b(?:bps?|basis\s+points?)\b")
    small = like(num, r"^\d{1,2}$")
    # fixed patterns, in their fixed order
    ladder = [
        (section_prefix(bare, num), "PARAGRAPH_IDENTIFIER", 0.99),
        (like(num, r"^[-+]?\d{1,3}$") & like(bare, r"^[-+]?\d{1,3}$"), "CHART_AXIS_TICK", 0.99),
        (bps & like(both, r"\b(?:above|below)\b"), "SPREAD", 0.99),
        (bps & (like(both, r"\b(?:reduced|decreased|cut|lowered|increased|raised|hiked|change(?:d)?|movement)\s+(?:by\s+)?\b") | near(r"\bby\s+", r"\s*(?:bps?|basis\s+points?)\b")), "BASIS_POINT_CHANGE", 0.99),
        (like(both, r"\b(?:percentage\s+points?|pp)\b"), "PERCENTAGE_POINT_CHANGE", 0.99),
        (near(r"(?:[A-Za-z]|\))", r"(?:\s|$|[,\.;\)])", full) & ~like(raw, r"^(?:\$|₹|INR|USD|Rs)"), "FOOTNOTE_REFERENCE", 0.98),
        (like(num, r"^\d{1,3}$") & near("^", r"\s+[A-Za-z]", bare) & ~has_any(own, ["₹", "$", "inr", "usd", "%", "percent", "crore", "million", "shares", "parcels"]), "FOOTNOTE_REFERENCE", 0.98),
        (small & like(bare, r"^\(?\d{1,2}[\.\)]\s+[A-Za-z]") & near(r"^\(?", "", bare), "ROW_IDENTIFIER", 0.98),
        (whole == year, "INDEX_BASE_YEAR", 0.99),
        (whole == value, "INDEX_BASE_VALUE", 0.99),
        (small & like(bare, r"^(?:\d{1,2}\s+){3,}\d{1,2}$"), "COLUMN_IDENTIFIER", 0.98),
        (navigation(full) | near(r"\b(?:page|p\.?)\s*", r"\b", words=["p"]), "PAGE_REFERENCE", 0.95),
        (near(r"\b(?:note|footnote)\s*", r"\b", words=["note"]), "NOTE_REFERENCE", 0.95),
        (like(num, r"^(?:19|20)\d{2}$") & like(both, r"\b(?:fy|fiscal|quarter|q[1-4]|year|ended|as at|march|december|june|september)\b"), "YEAR", 0.95),
        (like(num, r"^(?:19|20)\d{2}$") & ~like(own, r"(?:₹|\$|inr|usd|rs|percent|\%|shares|parcels|employees)"), "YEAR", 0.90),
        (like(num, r"^\d{2}$") & near(r"\b(?:fy|fiscal|q[1-4]\s*fy|20)\s*", r"\b"), "YEAR", 0.95),
        (near(rf"\b(?:{L.MONTHS})\s+", r"\b", words=L.MONTHS.split("|")) | near(r"\b", r"\s+(?:months?|days?)\s+ended\b", words=["ended"]), "DATE_COMPONENT", 0.95),
        (like(own, r"\b(?:shares?|equity shares?|preference shares?|securities)\b"), "SHARE_COUNT", 0.95),
        (near(r"\b", r"\s+(?:equity|preference)?\s*shares?\b", words=["share"]), "SHARE_COUNT", 0.90),
        (has_any(own, [*L.MONEY_SIGNS, "rupees", "dollars"]), "MONEY", 0.95),
        (near(r"(?:₹|\$|inr|usd|rs\.?)\s*(?:\w+\s+){0,2}", "", words=["₹", "$", "inr", "usd", "rs"]), "MONEY", 0.90),
        (has_any(own, ["%", "percent"]), "PERCENT", 0.95),
        (near(r"\b", r"\s*(?:\%|percent|percentage)\b", words=["%", "percent"]), "PERCENT", 0.90),
        (like(both, r"\b(?:parcels?|orders?|shipments?|employees?|headcount|workers?|facilities|hubs|vehicles|centres|tonnes|metric tonnes)\b"), "COUNT", 0.90),
    ]
    out = None
    for test, role, confidence in ladder:
        said = F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))
        out = F.when(test, said) if out is None else out.when(test, said)
    return out.otherwise(F.struct(F.lit("METRIC_VALUE").alias("role"), F.lit(0.70).alias("confidence")))


def canonical_metric(metric: Column) -> Column:
    """A metric's canonical name: a known alias, else its content words in the singular, joined."""
    raw = F.lower(strip(F.coalesce(metric, F.lit(""))))
    known = F.create_map(*[F.lit(x) for row in L.METRIC_ALIASES.items() for x in row])
    spelt = F.regexp_replace(F.regexp_replace(raw, r"\bpat\b", "profit_after_tax"), r"\bebita\b", "ebitda")
    words = F.filter(F.split(F.regexp_replace(spelt, r"[^a-z0-9\s_]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(L.STOPWORDS))
    singular = F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3) & ~like(w, L.KEPT_PLURALS), F.regexp_replace(w, "s$", "")).otherwise(w))
    name = let(lambda x: F.nullif(x["name"], F.lit("")), name=F.array_join(singular, "_"))
    return F.coalesce(F.try_element_at(known, raw), name, F.lit("unspecified_metric"))
