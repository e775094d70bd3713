"""Tables of the fact store as Parquet folders: ingest, append, replace, upsert, cascade delete, swap, evolution, purge.

Rows of a document lie in one of a fixed number of buckets, so there are at most that many folders, however many documents
there are; a document is replaced by writing its bucket anew. Folders are never changed. What belongs to the store is said
by one small state file, which a commit replaces at its end: a reader sees all of a commit or nothing of it, and a commit
that fails leaves the store as it was. The state also holds the number of the last batch of each stream, with which the
batch's rows came, and the next free number of each table. Folders that a commit replaces are removed by the commit
after it. There is one writer at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillfact.functions.lexicon import PIPELINE_VERSION
from quillfact.sources.scratch import settle, shared_dir
from quillfact.sources.tables import DEFAULTS, schema_of, typed

TABLES = ("documents", "chunks", "facts", "rejected_extractions", "fact_relationships")
BY_DOCUMENT = ("documents", "chunks", "facts", "rejected_extractions")
#: Columns that later versions added to facts, with their defaults.
FACT_DEFAULTS = {c: v for c, v in DEFAULTS["facts"].items() if c != "entity"}
BUCKETS = 256
WHOLE = "all"


def binary_documents(spark: SparkSession, path: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """Files as documents: the id is the content's hash, so that a repeated upload is the same document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where("length > 0")
    digest = F.sha2("content", 256)
    return files.select(digest.alias("document_id"), digest.alias("file_hash"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("modificationTime").alias("upload_timestamp"))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, for tables that are put together and read again."""
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def content_id(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


# State


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _state(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The version of the store and what belongs to it: tables (folders by bucket), schemas, batches, next (numbers), garbage."""
    fs, path = _folder(spark, f"{root}/_state")
    versions = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")] if fs.exists(path) else []
    if not versions:
        return 0, {"tables": {}, "schemas": {}, "batches": {}, "next": {}, "garbage": []}
    stream = fs.open(_folder(spark, f"{root}/_state/{max(versions):012d}.json")[1])
    try:
        return max(versions), json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put(spark: SparkSession, root: str, version: int, state: dict) -> None:
    """Make state the store's next version: a file that is written aside gets its name in one step."""
    fs, aside = _folder(spark, f"{root}/_state/new-{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    if not fs.rename(aside, _folder(spark, f"{root}/_state/{version + 1:012d}.json")[1]):
        raise OSError(f"another writer has committed version {version + 1} of {root}")
    fs.delete(_folder(spark, f"{root}/_state/{version - 1:012d}.json")[1], False)


def _bucket(name: str = "document_id") -> F.Column:
    return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(BUCKETS)).cast("int")


def _write(spark: SparkSession, root: str, table: str, df: DataFrame) -> dict[str, list[str]]:
    """Folders of the rows of df in a new place, by bucket if they belong to documents; buckets without rows have none."""
    place = f"{table}/{uuid.uuid4().hex}"
    if table in BY_DOCUMENT and "document_id" in df.columns:
        df.withColumn("__bucket", _bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{root}/{place}")
        fs, path = _folder(spark, f"{root}/{place}")
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return {n.split("=")[1]: [f"{place}/{n}"] for n in names if n.startswith("__bucket=")}
    df.write.parquet(f"{root}/{place}")
    return {WHOLE: [place]}


def _merged(old: str | None, new: StructType) -> str:
    """The schema of a table that gets rows of another: columns of both, the wider type of equal ones."""
    if old is None:
        return new.json()
    fields = {f.name: f for f in StructType.fromJson(json.loads(old)).fields}
    width = {t: i for i, t in enumerate(("tinyint", "smallint", "int", "bigint"))} | {"float": 8, "double": 9}
    for f in new.fields:
        was = fields.get(f.name)
        if was is None or width.get(f.dataType.simpleString(), -1) > width.get(was.dataType.simpleString(), -1):
            fields[f.name] = StructField(f.name, f.dataType, True)
    return StructType(list(fields.values())).json()


def change(spark: SparkSession, root: str, replaced: dict[str, tuple[DataFrame | None, DataFrame]] | None = None, whole: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None, numbers: dict[str, int] | None = None) -> None:
    """One commit. replaced: for a table, rows that take the place of all rows of the documents in ids(document_id); whole: tables
    that are replaced; added: rows that come to a table. batch: the stream and number of the batch that this is; numbers: how
    many numbers of a table were given away. A table may be read from the folders that it replaces."""
    version, state = _state(spark, root)
    tables, garbage, made = {t: dict(b) for t, b in state["tables"].items()}, [], []
    fs, _ = _folder(spark, root)
    try:
        for name, (rows, ids) in (replaced or {}).items():
            held, key = tables.setdefault(name, {}), ids.select(F.col("document_id").cast("string").alias("document_id")).distinct()
            touched = {str(r[0]) for r in key.select(_bucket()).distinct().collect()}  # BUCKETS numbers at most
            if rows is not None:
                touched |= {str(r[0]) for r in rows.select(_bucket()).distinct().collect()}
            old = [f for b in touched for f in held.get(b, [])]
            if old:
                kept = _stored(spark, root, old, state["schemas"][name])
                kept = kept.join(key, kept["document_id"].cast("string") == key["document_id"], "left_anti")
                rows = kept if rows is None else kept.unionByName(rows, allowMissingColumns=True)
            for b in touched:
                garbage += held.pop(b, [])
            if rows is not None:
                new = _write(spark, root, name, rows)
                made += [f for some in new.values() for f in some]
                held.update(new)
                state["schemas"][name] = _merged(state["schemas"].get(name), rows.schema)
        for name, df in (whole or {}).items():
            new = _write(spark, root, name, df)
            made += [f for some in new.values() for f in some]
            garbage += [f for some in tables.get(name, {}).values() for f in some]
            tables[name], state["schemas"][name] = new, df.schema.json()
        for name, df in (added or {}).items():
            new, held = _write(spark, root, name, df), tables.setdefault(name, {})
            made += [f for some in new.values() for f in some]
            for b, some in new.items():
                held[b] = [*held.get(b, []), *some]
            state["schemas"][name] = _merged(state["schemas"].get(name), df.schema)
        after = {"tables": tables, "schemas": state["schemas"], "batches": state["batches"] | (dict([batch]) if batch else {}), "next": state["next"] | {t: state["next"].get(t, 1) + n for t, n in (numbers or {}).items()}, "garbage": garbage}
        _put(spark, root, version, after)
    except BaseException:
        for folder in made:
            fs.delete(_folder(spark, f"{root}/{folder}")[1], True)
        raise
    for folder in state["garbage"]:
        fs.delete(_folder(spark, f"{root}/{folder}")[1], True)


def last_batch(spark: SparkSession, root: str, stream: str) -> int:
    """The number of the stream's last batch in the store, -1 before the first."""
    return _state(spark, root)[1]["batches"].get(stream, -1)


def next_number(spark: SparkSession, root: str, table: str) -> int:
    return _state(spark, root)[1]["next"].get(table, 1)


# Tables


def _stored(spark: SparkSession, root: str, folders: list[str], schema: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[f"{root}/{f}" for f in folders])


def exists(spark: SparkSession, root: str, table: str) -> bool:
    """Whether a table is there and has rows (or was put in place whole)."""
    return any(_state(spark, root)[1]["tables"].get(table, {}).values())


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table with the columns that were ever stored in it; a column that older rows lack is null there."""
    state = _state(spark, root)[1]
    folders = [f for some in state["tables"].get(table, {}).values() for f in some]
    if folders:
        return _stored(spark, root, folders, state["schemas"][table])
    schema = state["schemas"].get(table)
    return spark.createDataFrame([], StructType.fromJson(json.loads(schema)) if schema else schema_of(table))


def rows_of(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table in its own columns and types, defaults filled in, also of rows that older versions stored."""
    return typed(read(spark, root, table), table)


def append(df: DataFrame, root: str, table: str, by: str | None = "document_id") -> None:
    change(df.sparkSession, root, added={table: df})


def drop_documents(spark: SparkSession, root: str, table: str, ids: DataFrame) -> None:
    """Remove the rows of the documents in ids(document_id)."""
    change(spark, root, replaced={table: (None, ids)})


def replace_documents(df: DataFrame, root: str, table: str, ids: DataFrame | None = None) -> None:
    """The rows of df take the place of all earlier rows of the documents in ids(document_id), also of those that have no
    row in df; without ids, of the documents in df. Buckets of other documents are not rewritten."""
    df = settle(df)
    own = df.select("document_id")
    change(df.sparkSession, root, replaced={table: (df, own if ids is None else own.unionByName(ids.select("document_id")))})


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> None:
    """Put whole tables in place together, or not at all."""
    change(spark, root, whole=tables)


def upsert(df: DataFrame, root: str, table: str, key: str = "document_id") -> None:
    """The rows of df, and the rows of the table whose key df does not have."""
    spark = df.sparkSession
    if key == "document_id" and table in BY_DOCUMENT:
        replace_documents(df, root, table)
        return
    if exists(spark, root, table):
        df = read(spark, root, table).join(df.select(key).distinct(), key, "left_anti").unionByName(df, allowMissingColumns=True)
    commit(spark, root, {table: df})


def evolved(df: DataFrame, defaults: dict = FACT_DEFAULTS) -> DataFrame:
    """df with missing columns added and null ones filled from the defaults."""
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns], *[F.lit(v).alias(c) for c, v in defaults.items() if c not in df.columns])


def purged(df: DataFrame, version: int = PIPELINE_VERSION) -> DataFrame:
    return df.where(F.col("pipeline_version") >= version)


def purge(spark: SparkSession, root: str, version: int = PIPELINE_VERSION) -> None:
    """Remove stored facts of older versions, relationships of older versions, and those that touch a fact which goes."""
    held = rows_of(spark, root, "facts")
    gone = settle(held.where(F.col("pipeline_version") < version).select("document_id", "fact_id"))
    edges = purged(rows_of(spark, root, "fact_relationships"), version)
    replaced = {"facts": (held.join(gone.select("document_id").distinct(), "document_id", "left_semi").where(F.col("pipeline_version") >= version), gone.select("document_id"))}
    change(spark, root, replaced=replaced, whole={"fact_relationships": without_relationships(edges, gone)} if exists(spark, root, "fact_relationships") else None)


def without_relationships(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """edges that touch none of the facts (fact_id)."""
    for side in ("fact_id_a", "fact_id_b"):
        edges = edges.join(facts.select(F.col("fact_id").alias(side)), side, "left_anti")
    return edges


def without_document(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents in ids(document_id): relationships that touch one of their facts go too."""
    out = {name: df.join(ids, "document_id", "left_anti") for name, df in tables.items() if "document_id" in df.columns}
    if "fact_relationships" in tables:
        edges = tables["fact_relationships"]
        out["fact_relationships"] = without_relationships(edges, tables["facts"].join(ids, "document_id", "left_semi")).select(edges.columns)
    return out


def relationships_without(spark: SparkSession, root: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The table of relationships without those that touch stored facts of the documents in ids(document_id), if there are any."""
    if not (exists(spark, root, "fact_relationships") and exists(spark, root, "facts")):
        return {}
    edges = read(spark, root, "fact_relationships")
    gone = read(spark, root, "facts").join(ids, "document_id", "left_semi").select("fact_id")
    return {"fact_relationships": without_relationships(edges, gone).select(edges.columns)}


def drop_relationships(spark: SparkSession, root: str, ids: DataFrame) -> None:
    """Remove the stored relationships that touch facts of the documents in ids(document_id)."""
    if whole := relationships_without(spark, root, ids):
        commit(spark, root, whole)


def delete_documents(spark: SparkSession, root: str, ids: DataFrame) -> None:
    """Remove documents with all that belongs to them, in one commit."""
    change(spark, root, replaced={t: (None, ids) for t in BY_DOCUMENT if exists(spark, root, t)}, whole=relationships_without(spark, root, ids))


def clear(spark: SparkSession, root: str) -> None:
    """Remove all tables. Numbers go on from where they were, and streams do not begin anew."""
    version, state = _state(spark, root)
    fs, _ = _folder(spark, root)
    _put(spark, root, version, state | {"tables": {}, "schemas": {}, "garbage": []})
    for table in TABLES:
        fs.delete(_folder(spark, f"{root}/{table}")[1], True)


def document(spark: SparkSession, root: str, table: str, document_id: str) -> DataFrame:
    """The rows of one document, from its bucket alone; a document that is not there is an error (KeyError)."""
    state = _state(spark, root)[1]
    bucket = str(spark.range(1).select(F.lit(document_id).alias("document_id")).select(_bucket()).first()[0])
    part = lambda t: _stored(spark, root, f, state["schemas"][t]).where(F.col("document_id") == document_id) if (f := state["tables"].get(t, {}).get(bucket)) else None
    there = part("documents")
    if there is None or there.isEmpty():
        raise KeyError(f"no document {document_id}")
    rows = part(table)
    return read(spark, root, table).limit(0) if rows is None else rows


def with_chunks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts whose chunk is still there."""
    return facts.join(chunks, ["document_id", "chunk_index"], "left_semi")


def documents_of(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, filename, page_count, chunk_count of pages(document_id, filename, page_number) and their chunks."""
    counts = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"))
    out = pages.groupBy("document_id").agg(F.min("filename").alias("filename"), F.count_distinct("page_number").cast("int").alias("page_count")).join(counts, "document_id", "left")
    return out.select("document_id", "filename", "page_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
