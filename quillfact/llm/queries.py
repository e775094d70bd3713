"""Registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.secret_scan import secret_scan

    return secret_scan(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.line_dedup import line_dedup

    out = line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.quality import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.chat_format import chat_format

    return chat_format(_read(spark, sf_dir, "conversations"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.ngram_join import ngram_components

    return ngram_components(_read(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.html_extract import html_extract

    return html_extract(_read(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.decontaminate import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of op9_decontaminate, under the name that they had of their own."""
    return op9_decontaminate(spark, sf_dir)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quillfact.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.filter_audit import audit

    return audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.embedding_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillfact.llm.resampling import resample

    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Letters, digits and all non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Runs of anything but ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"

LINE_DEDUP_SQL = """
, d AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM {docs}),
l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
b AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 10),
m AS (SELECT l.r, l.doc_id, l.line, l.pos, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS cut FROM l LEFT JOIN b ON l.line = b.line),
k AS (SELECT r, doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text FROM m GROUP BY r, doc_id)
"""

CONTAMINATION_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({ASCII_LOWER}, '{WORD}') AS w, row_number() OVER () AS r FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i+9], ' '))) AS g FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM q),
p AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i+n-1], ' ')}}), recursive := true) FROM d, s WHERE len(w) >= n),
m AS (SELECT p.doc_id, p.i, p.n, q.item_id FROM p JOIN q ON p.n = q.n AND p.g = q.g),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id),
u AS (SELECT DISTINCT r, item_id, unnest(w) AS x FROM b),
o AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) WHERE x IN (SELECT x FROM u)),
f AS (SELECT x, count(*) AS df FROM o GROUP BY x),
y AS (SELECT r, item_id, list(x ORDER BY coalesce(df, 0), x)[1:3] AS ws FROM u LEFT JOIN f USING (x) GROUP BY r, item_id),
z AS (SELECT DISTINCT a.doc_id, y.item_id FROM y JOIN o a ON a.x = y.ws[1] WHERE (len(ws) < 2 OR EXISTS (SELECT 1 FROM o c WHERE c.doc_id = a.doc_id AND c.x = y.ws[2] AND abs(c.i - a.i) <= 20)) AND (len(ws) < 3 OR EXISTS (SELECT 1 FROM o c WHERE c.doc_id = a.doc_id AND c.x = y.ws[3] AND abs(c.i - a.i) <= 20))),
v AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near_items FROM z GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN v USING (doc_id)"""

ORACLE_SQL = {
    "op2_line_dedup": "WITH base AS (SELECT 1)" + LINE_DEDUP_SQL.format(docs="documents") + "SELECT doc_id, n_lines, n_removed, sha256(text) AS kept_sha256 FROM k",
    "op4_exact_dedup": f"""WITH d AS (SELECT doc_id, {ASCII_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op5_chat_format": """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, string_agg(role || chr(31) || text || chr(30), '') OVER (PARTITION BY conv_id ORDER BY i) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT min(conv_id) AS conv_id, n, prefix FROM p WHERE i = n GROUP BY n, prefix),
k AS (SELECT conv_id, n FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i = w.n AND p.i < p.n AND p.prefix = w.prefix))
SELECT t.conv_id, t.i AS turn_index, k.n AS n_turns, t.role, '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) AS rendered FROM t JOIN k USING (conv_id)""",
    "op7_ngram_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM d),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a) k USING (doc_id)""",
    "op9_decontaminate": CONTAMINATION_SQL,
    "op9_proximity": CONTAMINATION_SQL,
    "op11_filter_audit": rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, unnest([
    {{'x': 'A', 'fails': len(w) < 200}}, {{'x': 'B', 'fails': 100 * len(list_distinct(w)) < 50 * len(w)}}, {{'x': 'C', 'fails': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)}},
    {{'x': 'D', 'fails': regexp_matches(text, '[#$%&*|]')}}, {{'x': 'E', 'fails': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)}}], recursive := true), doc_id, row_number() OVER () AS r FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, coalesce(string_agg(x, '' ORDER BY x) FILTER (fails), '') AS fails FROM f GROUP BY r, part, good, toxic),
n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE length(o) < 5 AND NOT contains(o, x)),
s AS (SELECT o AS filter_order, step::INTEGER AS step, o[step] AS x, left(o, step - 1) AS before FROM o, range(1, 6) r(step) WHERE length(o) = 5),
g AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS fails, fails = x AS alone, before <> '' AND regexp_matches(fails, '[' || before || 'x]') AS gone FROM n, s),
c AS (SELECT part, filter_order, step, x, count(*) AS masks, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM g GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c""",
    "op13_resampling": rf"""WITH RECURSIVE k AS (SELECT i AS i, 0 AS step, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM k WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS crc FROM k WHERE step = 8),
d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '{WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all({ASCII_LOWER}, '{WORD}') AS w FROM benchmark),
x AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d),
y AS (SELECT g, count(*) AS s, 0 AS t FROM x GROUP BY g UNION ALL SELECT g, 0, count(*) FROM (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM b) GROUP BY g),
z AS (SELECT g, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t, hex(encode(g)) AS h FROM y GROUP BY g),
v AS (SELECT g, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT)), lambda a, e: xor(a >> 8, crc[(xor(a, e) & 255) + 1])), 4294967295) % 10000 AS bucket FROM z, crc),
u AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM v GROUP BY bucket),
n AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM u) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM u) + 10000)::DOUBLE)))::BIGINT AS gain FROM u),
e AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM x JOIN v USING (g) JOIN n USING (bucket) GROUP BY doc_id),
q AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('7:' || doc_id), 8))::BIGINT AS h FROM d LEFT JOIN e USING (doc_id)),
r AS (SELECT *, weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM q),
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_words >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM a) // 100 THEN rank END AS rank FROM r LEFT JOIN a USING (doc_id)""",
}

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_quality, op4_exact_dedup, op5_chat_format, op6_packing, op7_ngram_join, op8_html_extract, op9_decontaminate, op9_proximity, op10_suffix_dedup, op11_filter_audit, op12_embedding_dedup, op13_resampling)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE_SQL.items() if v}
