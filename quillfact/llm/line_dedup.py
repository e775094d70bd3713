"""Cross-site boilerplate lines, found by the spread of a line over sites.

Each line is two 64-bit hashes. A HyperLogLog sketch of the sites is aggregated for each line hash (partial sketches
merge after the shuffle); estimates far below or above the threshold decide; lines near it get an exact distinct
count. A line on at least min_sites sites is boilerplate: its first occurrence (by doc_id, then position) stays and
all others are removed, so that no content leaves the corpus altogether.

Defined results: a null text has no lines and stays null; an empty line is never boilerplate; a null source is one
site of its own; lines are compared byte by byte; each row loses lines of its own text alone, also where a doc_id repeats,
and of equal first places (same doc_id, same line number) each stays; a row without doc_id loses nothing; extra columns pass through, but for __n_lines and __n_removed, which are replaced; a very long
text costs no more than in proportion to its lines; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfact.llm.common import free_name, settle, sized

MIN_SITES = 10
#: Sketches of 2**12 registers: estimates are off by 1.6 % (one sigma); the band of exact counts is far wider.
LOG_REGISTERS = 12
BAND = (0.7, 1.4)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, version, site, pos, h1, h2 of every line that is not empty; hashing comes before the explode, so no text is copied.
    version: the hash of the text, which tells apart rows that repeat a doc_id."""
    hashed = F.transform(F.split("text", "\n", -1), lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(11), "text").alias("version"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("site"), F.posexplode(hashed).alias("pos", "h")).where("h is not null").select("doc_id", "version", "site", "pos", "h.h1", "h.h2")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first (doc_id, pos) of the lines on at least min_sites sites."""
    spread = settle(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites"), F.min(F.struct("doc_id", "pos")).alias("first"))
        .where(F.col("sites") >= BAND[0] * min_sites)
    )
    near = spread.where(F.col("sites") < BAND[1] * min_sites).select("h1", "h2")
    exact = lines.join(sized(near), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites).select("h1", "h2")
    far = spread.where(F.col("sites") >= BAND[1] * min_sites)
    return settle(far.unionByName(spread.where(F.col("sites") < BAND[1] * min_sites).join(exact, ["h1", "h2"], "left_semi")).select("h1", "h2", "first"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with text rid of boilerplate lines, and the columns __n_lines, __n_removed."""
    lines = settle(lines_of(docs))
    cut = lines.join(sized(boilerplate(lines, min_sites)), ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    docs = docs.drop("__n_lines", "__n_removed")
    doc, version, places = (free_name(c, docs.columns) for c in ("__doc", "__version", "__cut"))
    cut = cut.where("doc_id is not null").groupBy(F.col("doc_id").alias(doc), F.col("version").alias(version)).agg(F.collect_set("pos").alias(places))
    parts = F.split("text", "\n", -1)
    # array_except hashes, so that many lines of which many go are no square; the lines are bound once, not split for each of them
    left = lambda p: F.array_except(F.sequence(F.lit(1), F.size(p)), F.transform(F.col(places), lambda i: i + 1))
    rest = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(left(p), lambda i: F.element_at(p, i)), "\n")), 1)
    kept = F.when(F.col(places).isNull(), F.col("text")).otherwise(rest)
    out = docs.join(cut, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(F.lit(11), docs["text"]) == F.col(version)), "left")
    return out.select(*[kept.alias(c) if c == "text" else F.col(c) for c in docs.columns], F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("__n_lines"), F.coalesce(F.size(F.col(places)), F.lit(0)).cast("long").alias("__n_removed"))
