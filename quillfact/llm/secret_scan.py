"""Secret scan with DataFrame functions only.

Base kinds are regular expressions; their places come from the pieces between matches. The method adds strings of
kind entropy: candidate strings of a character class in which a sliding window reaches the class's Shannon entropy. The
window's character counts are kept up incrementally: each step takes one character out and one in, and updates the
counts and the sum of c*log2(c). Allow-listed strings (fixed examples, UUIDs, alphabets) and strings that overlap a base
span are not added; base spans are never suppressed.

Running sums and extremes over an array are made in pieces of PIECE elements with the pieces' own totals added afterwards,
so that a very long text with very many matches costs in proportion to them.

Defined results: a null text is empty and has no spans; spans count code points, end exclusive; equal rows give equal
results; an empty table gives no rows; extra columns are not read; a very long text is scanned whole.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: name: (candidates, alphabet, window, least bits); a candidate holds a digit (base64: and letters of both cases) anywhere and fills at least a window.
CLASSES = {
    "hex": (r"(?<![0-9A-Za-z+/_=-])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{16,}(?![0-9A-Za-z+/_=-])", "0123456789abcdefABCDEF", 16, 3.0),
    "base64": (r"(?<![0-9A-Za-z+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9A-Z+/_=-]*+[a-z])(?=[0-9a-z+/_=-]*+[A-Z])[0-9A-Za-z+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.8),
}
# Fixed strings of which a candidate is no secret.
ALLOW = r"(?i)example|sample|dummy|placeholder|changeme|0123456789abcdef|abcdefghijklmnop|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


PIECE, FAR = 256, 2**31 - 1


def running(values: Column, op, start: int) -> Column:
    """For each element of an array of integers, op over all before it; op is associative, and start changes nothing."""
    none, first = F.array().cast("array<int>"), F.lit(start)

    def fold(array: Column, of=lambda x: x) -> Column:
        return F.aggregate(array, F.struct(first.alias("at"), none.alias("out")), lambda acc, x: F.struct(op(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    last = F.greatest(F.ceil(F.size(values) / PIECE).cast("int") - 1, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: fold(F.slice(values, k * PIECE + 1, PIECE)))
    return F.flatten(F.zip_with(pieces, fold(pieces, lambda p: p["at"])["out"], lambda p, o: F.transform(p["out"], lambda x: op(o, x))))


SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches (none of them empty)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    each = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1))).alias("gap"), found.alias("hit"), values.alias("value"))

    def placed(each: Column) -> Column:
        before = running(F.transform(each, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda a, b: a + b, 0)
        start = lambda x, at: at + F.length(x["gap"])
        return F.zip_with(each, before, lambda x, at: F.struct(start(x, at).alias("start"), (start(x, at) + F.length(x["hit"])).alias("end"), x["value"].alias("value")))

    return F.when(F.rlike(text, F.lit(pattern)), F.element_at(F.transform(F.array(each), placed), 1).cast(SPAN)).otherwise(F.array().cast(SPAN))


def clear_of(found: Column, base: Column) -> Column:
    """The spans of found that overlap none of base: both are sorted together, and the furthest end of base spans before a span
    and the nearest start of those after it decide."""
    one = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), (x["value"] if kind else F.lit("")).alias("value")))

    def left(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(0)), F.greatest, 0)
        starts = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["kind"] == 0, x["start"]).otherwise(FAR))), F.least, FAR))
        marked = F.arrays_zip(both.alias("x"), ends.alias("before"), starts.alias("after"))
        free = F.filter(marked, lambda m: (m["x"]["kind"] == 1) & (m["before"] <= m["x"]["start"]) & (m["after"] >= m["x"]["end"]))
        return F.transform(free, lambda m: F.struct(m["x"]["start"].alias("start"), m["x"]["end"].alias("end"), m["x"]["value"].alias("value")))

    both = F.array_sort(F.concat(one(base, 0), one(found, 1)))
    return F.when((F.size(found) > 0) & (F.size(base) > 0), F.element_at(F.transform(F.array(both), left), 1).cast(SPAN)).otherwise(found)


def peak_entropy(value: Column, alphabet: str, window: int) -> Column:
    """The largest Shannon entropy (bits) of a window of characters of value; null if it is shorter than the window."""
    chars = F.split(value, "")
    chars = F.filter(chars, lambda c: c != "")
    steps = F.arrays_zip(chars.alias("one"), F.slice(F.concat(F.array_repeat(F.lit(""), window), chars), 1, F.greatest(F.length(value), F.lit(1))).alias("off"))
    cost = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    letters = F.lit(alphabet)

    def step(acc, x):
        one, off = F.instr(letters, x["one"]), F.when(x["off"] == "", 0).otherwise(F.instr(letters, x["off"]))
        less, more = F.element_at(acc["counts"], off + 1), F.element_at(acc["counts"], one + 1)
        more = more - F.when(one == off, 1).otherwise(0)
        total = acc["total"] + F.when(off > 0, F.element_at(cost, less) - F.element_at(cost, less + 1)).otherwise(0.0) + F.element_at(cost, more + 2) - F.element_at(cost, more + 1)
        n = acc["n"] + 1
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == one, 1).otherwise(0) - F.when((j == off) & (off > 0), 1).otherwise(0))
        best = F.when(n >= window, F.greatest(acc["best"], F.lit(math.log2(window)) - total / window)).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"), n.alias("n"))

    start = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("n"))
    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def _is_high(alphabet: str, window: int, least: float, found: Column) -> Column:
    return F.coalesce(peak_entropy(found["value"], alphabet, window) >= least, F.lit(False))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    text = F.col("__text")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("__text"))
    out = out.select("doc_id", F.filter(matches(text, ASSIGN, 1), lambda x: F.length(x["value"]) >= 6).alias("a"), matches(text, ACCESS).alias("k"), matches(text, HEX).alias("h"), *[matches(text, c[0]).alias(f"c_{name}") for name, c in CLASSES.items()])
    out = out.withColumn("base", F.concat(_spans(F.col("a"), 0), _spans(F.col("k"), 1), _spans(F.col("h"), 2)))
    added = []
    for name, (_, alphabet, window, least) in CLASSES.items():
        high = partial(_is_high, alphabet, window, least)
        fresh = F.filter(clear_of(F.col(f"c_{name}"), F.col("base")), lambda x: ~F.rlike(x["value"], F.lit(ALLOW)))
        added.append(_spans(F.filter(fresh, lambda x: high(x)), 3))  # noqa: B023  filter calls it at once
    out = out.withColumn("more", F.array_distinct(F.concat(*added)))
    return out.select(
        "doc_id", F.size("a").cast("long").alias("n_assign"), F.size("k").cast("long").alias("n_access"), F.size("h").cast("long").alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_entropy"),
    )
