"""Many lines from the parts table, and the extractor's ladder on them in SQL: fixed patterns are those of the extractor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfact.functions import lexicon as L
from quillfact.functions.text import fence
from quillfact.plans.facts import read, spread

PHRASES = ["Revenue from Operations", "express parcel volume", "Express parcel revenue", "EBITDA margin", "EBITDA", "Net profit", "profit after tax", "women employees", "headcount", "attrition rate", "real GDP growth", "retail headline inflation", "headline inflation", "core CPI inflation", "food inflation rate", "policy repo rate", "share capital", "offer of", "total income", "operating income", "cash flow", "net debt", "litigation", "output of mills"]
FORMS = ["₹# million", "#%", "# per cent", "(#%)", "# crore", "# equity shares", "# bps", "#", "-#", "#,500 orders", "INR #", "20#", "#.5%", "$ # billion", "(₹#)", "# months ended", "#.25 percent"]
CONTEXTS = [
    "The @ was ~ in FY2023", "@ of ~ during 2024-25 against the previous year", "@ rose by ~ in April to December 2024", "@ (see chart ~) held", "Tolerance band ~ for @", "@ of 4 (+/-) ~", "@~ stood", "Shares aggregating ~ and @", "@ is ~, annual, year-on-year",
    "In Fiscal 23 @ came to ~ above plan", "#.4 @ grew ~", "2022-~ @ reached", "@ was cut by ~ on page 7", "@ for the full year was ~ and ~", "@ [2011=100] at ~", "Note # says @ of ~", "~ @ this quarter", "@ ~ below the year",
    "Harbour Light Holdings #,000 equity shares aggregating ₹# million of @", "@ was ~ in 2021 and ~ in 2022",
]
FILES = ["delhivery-fy24.pdf", "rbi-2024-25.pdf", "mill.pdf"]


def made_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, ordinal, filename, line: a phrase, a form of number and a context for each part."""
    k = F.col("p_partkey")
    one = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words)).cast("int") + 1)
    size = F.col("p_size").cast("string")
    line = F.replace(F.replace(one(CONTEXTS, k * 7 + F.floor(k / 17)), F.lit("@"), one(PHRASES, k)), F.lit("~"), one(FORMS, k * 5 + F.floor(k / 23)))
    lines = fence(spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")), filename=one(FILES, k), line=F.replace(line, F.lit("#"), size))
    return lines.select(k.alias("k"), F.lit(0).alias("ordinal"), "filename", "line")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_of = lambda words, i: f"{_list(words)}[CAST(({i}) % {len(words)} AS INT) + 1]"
_first = lambda table, c: "CASE " + " ".join(f"WHEN contains({c}, '{k}') THEN '{v}'" for k, v in table) + " END"
# Fixed patterns, in their fixed order: those of functions/roles.py and operators/extract.py, in the other dialect.
NAVIGATION = r"(regexp_matches({0}, '(?:\.\s*|…\s*){{2,}}[0-9]+\s*$|\.{{2,}}\s*[0-9]+') OR regexp_matches({0}, '(?i)\b(?:page|p\.?)\s*[0-9]+\b'))"
OUTLINE = r"(?:(?:[a-z0-9]+\.)+[a-z0-9]+|[0-9]+[a-z]\.[0-9]+|[ivxlcdm]+(?:\.[0-9]+)+)"
BPS = r"regexp_matches(both_, '\b(?:bps?|basis\s+points?)\b')"
_any = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_prefixed = lambda *values: "(title <> '' AND (" + " OR ".join(f"title = {v}" for v in values) + f" OR list_contains(string_split(title, '.'), {values[0]}))) OR (found <> '' AND NOT is_unit AND (" + " OR ".join(f"(lead_ <> '' AND lead_ = {v}) OR stem = {v}" for v in values) + "))"
ROLES = [
    (_prefixed("num"), "PARAGRAPH_IDENTIFIER"), (r"regexp_matches(num, '^[-+]?\d{1,3}$') AND regexp_matches(line, '^[-+]?\d{1,3}$')", "CHART_AXIS_TICK"), (BPS + r" AND regexp_matches(both_, '\b(?:above|below)\b')", "SPREAD"),
    (BPS + r" AND (regexp_matches(both_, '\b(?:reduced|decreased|cut|lowered|increased|raised|hiked|change(?:d)?|movement)\s+(?:by\s+)?\b') OR regexp_matches(both_, '\bby\s+' || n || '\s*(?:bps?|basis\s+points?)\b'))", "BASIS_POINT_CHANGE"),
    (r"regexp_matches(both_, '\b(?:percentage\s+points?|pp)\b')", "PERCENTAGE_POINT_CHANGE"), (r"regexp_matches(line, '(?:[A-Za-z]|\))' || n || '(?:\s|$|[,\.;\)])') AND NOT regexp_matches(tok, '^(?:\$|₹|INR|USD|Rs)')", "FOOTNOTE_REFERENCE"),
    (r"regexp_matches(num, '^\d{1,3}$') AND regexp_matches(line, '^' || n || '\s+[A-Za-z]') AND NOT " + _any("own", ["₹", "$", "inr", "usd", "%", "percent", "crore", "million", "shares", "parcels"]), "FOOTNOTE_REFERENCE"),
    (r"regexp_matches(num, '^\d{1,2}$') AND regexp_matches(line, '^\(?\d{1,2}[\.\)]\s+[A-Za-z]') AND regexp_matches(line, '^\(?' || n)", "ROW_IDENTIFIER"), ("whole = base_year", "INDEX_BASE_YEAR"), ("whole = base_value", "INDEX_BASE_VALUE"),
    (r"regexp_matches(num, '^\d{1,2}$') AND regexp_matches(line, '^(?:\d{1,2}\s+){3,}\d{1,2}$')", "COLUMN_IDENTIFIER"), (NAVIGATION.format("line") + r" OR regexp_matches(both_, '\b(?:page|p\.?)\s*' || n || '\b')", "PAGE_REFERENCE"),
    (r"regexp_matches(both_, '\b(?:note|footnote)\s*' || n || '\b')", "NOTE_REFERENCE"), (r"regexp_matches(num, '^(?:19|20)\d{2}$') AND regexp_matches(both_, '\b(?:fy|fiscal|quarter|q[1-4]|year|ended|as at|march|december|june|september)\b')", "YEAR"),
    (r"regexp_matches(num, '^(?:19|20)\d{2}$') AND NOT regexp_matches(own, '(?:₹|\$|inr|usd|rs|percent|\%|shares|parcels|employees)')", "YEAR"), (r"regexp_matches(num, '^\d{2}$') AND regexp_matches(both_, '\b(?:fy|fiscal|q[1-4]\s*fy|20)\s*' || n || '\b')", "YEAR"),
    (rf"regexp_matches(both_, '\b(?:{L.MONTHS})\s+' || n || '\b') OR regexp_matches(both_, '\b' || n || '\s+(?:months?|days?)\s+ended\b')", "DATE_COMPONENT"), (r"regexp_matches(own, '\b(?:shares?|equity shares?|preference shares?|securities)\b')", "SHARE_COUNT"),
    (r"regexp_matches(both_, '\b' || n || '\s+(?:equity|preference)?\s*shares?\b')", "SHARE_COUNT"), (_any("own", [*L.MONEY_SIGNS, "rupees", "dollars"]), "MONEY"), (r"regexp_matches(both_, '(?:₹|\$|inr|usd|rs\.?)\s*(?:\w+\s+){0,2}' || n)", "MONEY"), (_any("own", ["%", "percent"]), "PERCENT"),
    (r"regexp_matches(both_, '\b' || n || '\s*(?:\%|percent|percentage)\b')", "PERCENT"), (r"regexp_matches(both_, '\b(?:parcels?|orders?|shipments?|employees?|headcount|workers?|facilities|hubs|vehicles|centres|tonnes|metric tonnes)\b')", "COUNT"),
]
_period = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper({c}), '\\bFISCAL\\s*(\\d{{4}})\\b', 'FY \\1', 'g'), '\\bFISCAL\\s*(\\d{{2}})\\b', 'FY 20\\1', 'g'), '\\bFY\\s*(\\d{{2}})\\b', 'FY 20\\1', 'g'), '\\bFY\\s*(\\d{{4}})\\b', 'FY \\1', 'g')"
_found = lambda c, pattern: _period(f"nullif(regexp_extract({c}, '{pattern}', 1), '')")
NAMED = r"(FY\s?\d{2,4}|Fiscal\s?\d{2,4}|20\d{2}-\d{2}|20\d{2})"
METRIC_TABLE = "(VALUES " + ", ".join(f"({i}, '{p}', '{m}', '{r}')" for i, (p, m, r) in enumerate(L.METRICS)) + ") m(rank, pattern, metric, expected)"

LINES_SQL = rf"""WITH l AS (SELECT p_partkey AS k, {_of(FILES, 'p_partkey')} AS filename, replace(replace(replace({_of(CONTEXTS, 'p_partkey * 7 + p_partkey // 17')}, '@', {_of(PHRASES, 'p_partkey')}), '~', {_of(FORMS, 'p_partkey * 5 + p_partkey // 23')}), '#', CAST(p_size AS VARCHAR)) AS line, p_size FROM part),
e AS (SELECT *, lower(line) AS low, {_first(L.FILE_ENTITIES, 'filename')} AS known_entity, {_first(L.FILE_PERIODS, 'filename')} AS document_period FROM l),
sellers AS (SELECT k, 0 AS number, rank, 'Harbour Light Holdings' AS entity, metric, value, unit, NULL AS period, NULL AS scope, predicate FROM (SELECT * FROM e WHERE starts_with(line, 'Harbour')), LATERAL (VALUES (0, 'Offer for Sale Amount', '₹' || p_size || ' million', 'INR million', 'offered for sale'), (1, 'Shares Offered for Sale', p_size || ',000', 'shares', 'offered equity shares of')) s(rank, metric, value, unit, predicate)),
t AS (SELECT *, generate_subscripts(w, 1) - 1 AS number, unnest(w) AS token FROM (SELECT *, regexp_extract_all(line, '{L.NUMBER}', 1) AS w FROM e JOIN {METRIC_TABLE} ON regexp_matches(low, pattern) WHERE NOT starts_with(line, 'Harbour') AND NOT {NAVIGATION.format('line')})),
u AS (SELECT *, trim(token) AS tok, nullif(regexp_extract(token, '(?i)\(\s*(?:₹|\$|inr|usd|rs\.?)?\s*(\d+(?:,\d+)*(?:\.\d+)?)\s*\%?\s*\)', 1), '') AS inside FROM t WHERE regexp_matches(token, '\d')),
v AS (SELECT *, coalesce(-abs(CAST(replace(inside, ',', '') AS DOUBLE)), CAST(replace(regexp_extract(token, '[-+]?\d+(?:,\d+)*(?:\.\d+)?'), ',', '') AS DOUBLE)) AS x FROM u),
w AS (SELECT *, format('{{:g}}', x) AS num, CAST(x AS VARCHAR) AS shown_number, lower(' ' || token || '   ' || line) AS both_, lower(tok || ' ') AS own, instr(line, tok) AS pos_,
  regexp_extract(low, '^\s*(?:appendix\s+table|table|chart|figure|box)\s+([a-z0-9\.\-]+)', 1) AS title, regexp_extract(low, '^\s*\(?({OUTLINE})\)?\s+([a-z%])', 1) AS found, trim(regexp_replace(low, '^\s*\(?{OUTLINE}', '')) AS rest,
  TRY_CAST(nullif(regexp_extract(line, '(?i)(?:[\[\(]|\b)(?:FY\s*)?(\d{{4}})(?:-\d{{2,4}})?\s*=\s*(\d+)(?:[\]\)]|\b)', 1), '') AS BIGINT) AS base_year, TRY_CAST(nullif(regexp_extract(line, '(?i)(?:[\[\(]|\b)(?:FY\s*)?(\d{{4}})(?:-\d{{2,4}})?\s*=\s*(\d+)(?:[\]\)]|\b)', 2), '') AS BIGINT) AS base_value FROM v),
a AS (SELECT *, replace(replace(num, '.', '\.'), '+', '\+') AS n, TRY_CAST(nullif(regexp_extract(num, '^[-+]?(\d+)(?:\.\d+)?$', 1), '') AS BIGINT) AS whole, trim(regexp_replace(found, '^[a-z.]+', '')) AS stem, regexp_extract(trim(regexp_replace(found, '^[a-z.]+', '')), '^\d+') AS lead_, regexp_matches(rest, '^(?:per cent|percent|%|bps|basis\s+points|crore|million|billion|lakh|shares)') AS is_unit FROM w),
b AS (SELECT *, CASE {' '.join(f"WHEN {rule} THEN '{role}'" for rule, role in ROLES)} ELSE 'METRIC_VALUE' END AS role FROM a),
c AS (SELECT *, CASE WHEN x < 0 AND NOT regexp_matches(tok, '^[-(]') THEN '-' || tok WHEN contains(tok, '(') AND contains(tok, ')') THEN '-' || trim(regexp_replace(tok, '[()]', '', 'g')) ELSE tok END AS shown FROM b
  WHERE role IN ({', '.join(f"'{r}'" for r in L.METRIC_ROLES)}) AND NOT ({_prefixed('tok', 'shown_number')}) AND NOT (pos_ > 1 AND regexp_matches(substr(line, pos_ - 1, 1), '[A-Za-z)]') AND NOT regexp_matches(tok, '^(?:\$|₹|INR|USD|Rs)'))
  AND NOT regexp_matches(substr(line, greatest(pos_ - 5, 1), least(pos_ - 1, 5)), '(?:19|20)\d{{2}}-?$')),
d AS (SELECT *, substr(line, greatest(pos_ - 1 - 40, 0) + 1, least(pos_ - 1, 40)) AS before, substr(line, pos_ + length(tok), 50) AS after FROM (SELECT *, row_number() OVER (PARTITION BY k, rank, num, shown ORDER BY number) AS again FROM c) WHERE again = 1),
f AS (SELECT *, nullif(regexp_extract(token, '(?i)(million|billion|crore|lakh|crores|lakhs|%|percent|per cent|shares|equity\s+shares|parcels|orders|employees|INR|USD|₹|\$)', 1), '') AS said, trim(after) AS follows FROM d
  WHERE NOT regexp_matches(before, '(?:\(\s*\+/-\s*\)|\+/-|±)\s*$') AND NOT contains(lower(before), 'tolerance band') AND NOT regexp_matches(before, '(?i)\b(?:chart|figure|table|box)\s+[A-Za-z0-9\.]*$')),
g AS (SELECT *, CASE WHEN role IN ('BASIS_POINT_CHANGE', 'SPREAD') THEN 'bps' WHEN said IS NULL AND expected = 'PERCENT' AND regexp_matches(lower(follows), '^(?:%|per cent|percent)') THEN '%' WHEN said IS NULL AND expected = 'PERCENT' AND regexp_matches(lower(follows), '^bps') THEN 'bps' WHEN lower(said) IN ('%', 'percent', 'per cent') THEN '%' ELSE said END AS unit0 FROM f),
h AS (SELECT *, lower(before || ' ' || tok || ' ' || after) AS win, lower(right(before, 20) || ' ' || tok || ' ' || left(after, 28)) AS near_ FROM g
  WHERE CASE expected WHEN 'PERCENT' THEN coalesce(unit0 IN ('%', 'bps'), false) WHEN 'MONEY' THEN coalesce({_any('lower(unit0)', ["inr", "usd", "₹", "$", "rs", "crore", "million", "billion", "lakh"])}, false) ELSE true END),
i AS (SELECT *, CASE WHEN regexp_matches(near_, 'april\s*.*?december|apr(?:il)?\s*.*?dec') THEN 'APR_DEC' WHEN contains(near_, 'full year') OR contains(near_, 'annual') THEN 'FULL_YEAR' END AS scope,
  {_found('line', '(?i)' + chr(92) + 'b(FY' + chr(92) + 's?' + chr(92) + 'd{2,4}|Fiscal' + chr(92) + 's?' + chr(92) + 'd{2,4}|Q[1-4]' + chr(92) + 's?FY?' + chr(92) + 'd{2,4}|20' + chr(92) + 'd{2})' + chr(92) + 'b')} AS of_line, nullif(regexp_extract(line, '\b(20\d{{2}}-\d{{2}})\b', 1), '') AS other FROM h),
j AS (SELECT *, CASE WHEN contains(win, 'previous year') OR contains(win, 'prior year') THEN coalesce('FY ' || (CAST(left(other, 4) AS INT) - 1) || '-' || substr(other, 3, 2), of_line)
  ELSE coalesce({_found('after', r'(?i)^\s*(?:in|during|for)?\s*' + NAMED + r'\b')}, {_found('before', r'(?i)\b' + NAMED + r'\s*(?:in|during|from|to)?\s*$')}, {_found('win', r'(?i)\b' + NAMED + r'\b')}, of_line) END AS stated FROM i),
o AS (SELECT *, CASE WHEN stated IS NULL AND {_any('low', ['year-on-year', 'yoy', 'annual'])} THEN document_period ELSE stated END AS bound FROM j)
SELECT k, CAST(rank AS INT) AS rank, CAST(number AS INT) AS number, entity, metric, value, unit, period, scope, predicate FROM sellers
UNION ALL SELECT k, CAST(rank AS INT), CAST(number AS INT), coalesce(known_entity, 'Document Entity'), metric1, CASE WHEN role = 'BASIS_POINT_CHANGE' AND NOT starts_with(shown, '-') THEN '-' || shown ELSE shown END, coalesce(unit0, CASE WHEN role = 'SHARE_COUNT' THEN 'shares' END),
  CASE WHEN scope = 'APR_DEC' AND (contains(win, '2024') OR contains(win, 'fy25')) THEN 'FY 2024-25' WHEN scope IS NULL AND bound = 'FY 2024' THEN 'FY 2023-24' WHEN bound = 'FY 2025' THEN 'FY 2024-25' WHEN regexp_matches(bound, '^\d{{4}}-\d{{2}}$') THEN 'FY ' || bound ELSE bound END, scope, CASE WHEN contains(lower(metric1), 'revenue') THEN 'was reported as' ELSE 'reached' END
FROM (SELECT *, CASE WHEN role = 'BASIS_POINT_CHANGE' THEN 'Policy Repo Rate Change' WHEN role = 'SPREAD' THEN 'Spread to Policy Repo Rate' WHEN contains(low, 'shares') AND contains(low, 'aggregating') AND role = 'MONEY' AND expected = 'SHARE_COUNT' THEN 'Offer Size' WHEN contains(lower(tok), 'shares') OR role = 'SHARE_COUNT' THEN 'Offer Equity Shares'
  WHEN contains(low, 'retail headline inflation') THEN 'Retail Headline Inflation' WHEN contains(low, 'headline inflation') THEN 'Headline Inflation' WHEN contains(low, 'core') AND contains(low, 'inflation') THEN 'Core Inflation' WHEN contains(low, 'food') AND contains(low, 'inflation') THEN 'Food Inflation' WHEN contains(low, 'real gross domestic product') OR contains(low, 'real gdp') THEN 'Real GDP Growth' ELSE metric END AS metric1 FROM o)"""
