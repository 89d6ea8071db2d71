"""Chunk files, the index table, the registry of documents, gold labels and caches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, digest_id, document_input

CHUNK_SCHEMA = (
    "chunk_id string, chunk_type string, text string, metadata struct<page_number:int,title:string,char_count:int,element_category:string,"
    "table_caption:string,table_part:int,table_parts_total:int,table_source:string,text_as_html:string,caption:string,figure_caption:string,"
    "generated_caption_used:boolean,ocr_keywords:array<string>,ocr_raw_char_count:int,image_base64:string,image_mime_type:string,"
    "core_text:string,overlap_prefix_chars:int>"
)
_FIELDS = CHUNK_SCHEMA.replace(" string", ":string", 3).replace("metadata struct", "metadata:struct")
ELEMENTS = "doc_id string, idx int, page int, category string, text string, text_as_html string, image_base64 string, image_mime_type string"
REGISTRY = "doc_id string, name string, pdf_path string, chunks_path string, collection string, pages int, chunks int, status string, message string, progress string, is_sample boolean, created double"


class StoreError(Exception):
    """A request that can't be met."""


class UnknownDocument(StoreError):
    """No such document."""


class NotReady(StoreError):
    """The document isn't indexed yet."""


class BadRequest(StoreError):
    """An empty query or a file of the wrong kind."""


def partition_key(files: DataFrame) -> DataFrame:
    """Files (path, length, modificationTime) with the key of their cached layout."""
    return files.withColumn("cache_key", digest_id(F.col("path"), F.col("length").cast("string"), F.unix_timestamp("modificationTime").cast("string")))


def not_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    return partition_key(files).join(cache.select("cache_key"), "cache_key", "left_anti")


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder, by a reader that any store has."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def parse_files(files: DataFrame, parser: Callable[[bytes], list[dict]]) -> DataFrame:
    """Layout elements of files, by an injected parser: bytes to a list of {page, category, text, ...}.

    Beside the ELEMENTS columns: cache_key, of the file's path, size and time; parse_error, the
    reason if the parser failed, in one row without an element.
    """
    fields = [x.strip().split()[0] for x in ELEMENTS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, content in zip(batch["cache_key"], batch["content"], strict=True):
                rows, error = [], None
                try:
                    rows = parser(bytes(content))
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out = [[key, i, *[r.get(c) for c in fields[2:]], key, None] for i, r in enumerate(rows)] or [[key, *[None] * (len(fields) - 1), key, error]]
                yield pd.DataFrame(out, columns=[*fields, "cache_key", "parse_error"], dtype=object)

    return partition_key(files).select("cache_key", "content").mapInPandas(run, f"{ELEMENTS}, cache_key string, parse_error string")


def parsed(spark: SparkSession, folder: str, cache: str, parser: Callable[[bytes], list[dict]], glob: str = "*.pdf") -> DataFrame:
    """Elements of a folder's files: from the cache, a Parquet table, where their keys are in it; others are parsed and added to it."""
    files = binary_files(spark, folder, glob)
    schema = f"{ELEMENTS}, cache_key string, parse_error string"
    known = spark.read.schema(schema).parquet(cache) if _there(spark, cache) else spark.createDataFrame([], schema)
    fresh = not_cached(files.drop("cache_key"), known.where("parse_error is null").select("cache_key").distinct())
    append(parse_files(fresh.drop("cache_key"), parser), cache)
    mine = partition_key(files.drop("content")).select("cache_key")
    return spark.read.schema(schema).parquet(cache).join(mine, "cache_key", "left_semi").where("parse_error is null and idx is not null")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir); where they are one process, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="leafsight-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root.rstrip('/')}/leafsight-{tag}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str) -> None:
    """Add df to the table at `path`, in a folder of this write's own: writers at the same time share no temporary files, so none removes another's."""
    df.write.parquet(f"{path}/write={uuid.uuid4().hex}")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: what reads it twice computes it once."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def write_chunks(chunks: DataFrame, path: str, keep_images: bool = True, array: bool = False) -> None:
    """Chunks as JSON lines, or as one JSON array (of a document, in one row), without image payloads if so asked."""
    kept = chunks if keep_images else chunks.withColumn("metadata", F.col("metadata").dropFields("image_base64"))
    if array:
        row = F.to_json(F.struct(*kept.columns), {"ignoreNullFields": "false"})
        kept.agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ",\n"), F.lit("]")).alias("value")).write.mode("overwrite").text(path)
    else:
        kept.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON arrays or lines, in one fixed schema: a file that begins with a bracket is an array.

    Files of either kind are split among tasks, however large they are. What comes after an
    array's last whole record is left out; a line that isn't JSON is a row of nulls. Arrays are
    written as records to the shared folder.
    """
    heads = spark.read.text(path, lineSep="}").select(F.left(F.ltrim(F.regexp_replace("value", r"^[\s\x{feff}]+", "")), F.lit(1)).alias("c"), "_metadata.file_path", "_metadata.file_block_start")
    firsts = heads.where("file_block_start = 0").withColumn("i", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("c", "i").alias("c"))
    # as many names as Spark's own listing of the files holds
    kinds = [(r["c"] == "[", unquote(r["file_path"])) for r in firsts.collect()]
    arrays, lines = [p for a, p in kinds if a], [p for a, p in kinds if not a]
    out = spark.read.schema(CHUNK_SCHEMA).json(lines) if lines else spark.createDataFrame([], CHUNK_SCHEMA)
    return out.unionByName(array_records(spark, arrays).select(F.from_json("value", CHUNK_SCHEMA).alias("c")).select("c.*")) if arrays else out


def array_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The objects of JSON arrays, as texts (file_path, value), of files that many tasks read.

    Files are read in pieces that end at a closing brace, which any reader of lines can find from
    any place in a file. Whether a piece begins within a string follows from the number of quotes
    before it, and how deep in brackets it ends from those outside of strings before it: sums
    within each block of a file, then over the blocks. An object ends where the depth is one again.
    """
    text = spark.read.text(paths, lineSep="}").select("_metadata.file_path", F.col("_metadata.file_block_start").alias("b"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    outside = lambda x: F.regexp_replace(x, r'"[^"]*("|$)', "")
    depth = lambda x: F.regexp_count(x, F.lit(r"[\[{]")) - F.regexp_count(x, F.lit(r"[\]}]"))
    x = text.withColumn("i", F.monotonically_increasing_id()).withColumn("plain", plain).withColumn("q", F.regexp_count("plain", F.lit('"')) % 2)
    # the brace that ends the piece counts where it isn't within a string
    from_out, from_in = depth(outside(F.col("plain"))) - (1 - F.col("q")), depth(outside(F.regexp_replace("plain", r'^[^"]*("|$)', ""))) - F.col("q")
    x = written(x.select("file_path", "b", "i", "value", "q", from_out.alias("d0"), from_in.alias("d1")), "pieces")
    here = Window.partitionBy("file_path", "b").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = Window.partitionBy("file_path").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("q").over(here), F.lit(0)) - F.col("q")
    light = x.select("file_path", "b", "i", "q", "d0", "d1", (within % 2).alias("p"))
    as_begun = lambda s: F.when((F.col("p") + s) % 2 == 0, F.col("d0")).otherwise(F.col("d1"))
    light = light.select("file_path", "b", "i", ((F.col("p") + F.col("q")) % 2).alias("p"), F.sum(as_begun(0)).over(here).alias("s0"), F.sum(as_begun(1)).over(here).alias("s1"))
    blocks = light.groupBy("file_path", "b").agg(F.max_by("p", "i").alias("p"), F.max_by("s0", "i").alias("s0"), F.max_by("s1", "i").alias("s1"))
    blocks = blocks.withColumn("begun", F.coalesce(F.sum("p").over(past), F.lit(0)) % 2)
    blocks = blocks.select("file_path", "b", "begun", F.coalesce(F.sum(F.when(F.col("begun") == 0, F.col("s0")).otherwise(F.col("s1"))).over(past), F.lit(0)).alias("deep"))
    at = light.join(blocks, ["file_path", "b"])
    ends = ((F.col("p") + F.col("begun")) % 2 == 0) & (F.col("deep") + F.when(F.col("begun") == 0, F.col("s0")).otherwise(F.col("s1")) == 1)
    at = at.select("file_path", "b", "i", F.when(ends, 1).otherwise(0).alias("end"))
    at = at.withColumn("n", F.sum("end").over(here) - F.col("end"))
    earlier = at.groupBy("file_path", "b").agg(F.sum("end").alias("ends")).select("file_path", "b", F.coalesce(F.sum("ends").over(past), F.lit(0)).alias("n0"))
    owner = at.join(earlier, ["file_path", "b"]).select("file_path", "b", "i", (F.col("n0") + F.col("n")).alias("n"), "end")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("b", "i", "value"))), lambda v: v["value"])
    whole = x.join(owner, ["file_path", "b", "i"]).groupBy("file_path", "n").agg(F.concat(F.array_join(pieces, "}"), F.lit("}")).alias("value"), F.max("end").alias("end"))
    return whole.where("end = 1").select("file_path", F.regexp_replace("value", r"^[^{]+", "").alias("value"))


def index_rows(chunks: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """Chunks (chunk_id, chunk_type, text, metadata; doc_id and chunk_seq if they have them) as rows of the index, with vectors by `encode`, an expression or pandas UDF."""
    m = F.col("metadata")
    page = F.coalesce(F.nullif(m["page_number"], F.lit(0)), F.lit(-1))
    return chunks.select(
        *[c for c in ("doc_id", "chunk_seq") if c in chunks.columns], "chunk_id", "chunk_type", "text", page.alias("page"), F.coalesce(m["title"], F.lit("")).alias("title"), F.length("text").alias("char_count"),
        m["table_caption"].alias("table_caption"), m["table_part"].alias("table_part"), m["table_parts_total"].alias("table_parts_total"), m["caption"].alias("caption"),
        m["image_mime_type"].alias("image_mime_type"), m["overlap_prefix_chars"].alias("overlap_prefix_chars"),
        blank_to_null(F.array_join(m["ocr_keywords"], ", ")).alias("ocr_keywords"), blank_to_null(m["core_text"]).alias("core_text"),
        encode(document_input(m["title"], F.col("text"))).alias("embedding"),
    )


def duplicates(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_index(rows: DataFrame, path: str, doc_id: str | None = None) -> None:
    """Replace the documents' partitions of the index, all in one write; chunk ids repeated within a document are refused.

    The documents are those of the column doc_id, or the one that is named.
    """
    rows = rows if doc_id is None else rows.withColumn("doc_id", F.lit(doc_id))
    if (bad := rows.groupBy("doc_id", "chunk_id").count().where("count > 1").first()) is not None:
        raise StoreError(f"repeated chunk id {bad['chunk_id']}")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def scan_index(spark: SparkSession, path: str, doc_id: str | None = None, types: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)
    return rows if types is None else rows.where(F.col("chunk_type").isin(types))


def register(chunks: DataFrame) -> DataFrame:
    """Per doc_id its pages (the largest number, null as 0) and chunks."""
    return chunks.groupBy("doc_id").agg(F.max(F.coalesce("page", F.lit(0))).alias("pages"), F.count(F.lit(1)).alias("chunks"))


#: An event of the registry: the fields of an entry that change (null: as they were), when, and by which call.
EVENTS = f"{REGISTRY}, at double, event string"


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """All documents' entries, each field as the latest event of its document that names it left it; none if there is no registry yet."""
    events = spark.read.schema(EVENTS).parquet(path) if _there(spark, path) else spark.createDataFrame([], EVENTS)
    names = [x.split()[0] for x in REGISTRY.split(", ")][1:]
    latest = [F.max(F.when(F.col(c).isNotNull(), F.struct("at", "event", F.col(c).alias("value"))))["value"].alias(c) for c in names]
    return events.groupBy("doc_id").agg(*latest)


def put_entries(entries: DataFrame, path: str) -> None:
    """Append events: what `entries` (doc_id and any other columns of the registry) changes. Writers don't wait for each other, and nothing is ever replaced."""
    row = [F.col(n).cast(k).alias(n) if n in entries.columns else F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in REGISTRY.split(", "))]
    append(entries.select(*row, F.lit(time.time()).alias("at"), F.lit(uuid.uuid4().hex).alias("event")), path)


def put_entry(spark: SparkSession, path: str, **fields: object) -> None:
    """Add a document's entry, or change the fields given of the one it has. A new entry has what isn't given as none, 0 or ready."""
    names = [x.split() for x in REGISTRY.split(", ")]
    new = load_registry(spark, path).where(F.col("doc_id") == fields["doc_id"]).isEmpty()
    row = ({"pages": 0, "chunks": 0, "status": "ready", "message": "", "progress": "", "is_sample": False} if new else {}) | fields
    put_entries(spark.createDataFrame([tuple(row.get(n) for n, _ in names)], REGISTRY).coalesce(1), path)


def compact_registry(spark: SparkSession, path: str, to: str) -> None:
    """Write the events that still count, one a document, as a registry at `to`. The one at `path` stays as it is."""
    put_entries(load_registry(spark, path), to)


def register_sample(spark: SparkSession, path: str, pdf_path: str, chunks_path: str, collection: str, name: str, created: float = 0.0) -> dict | None:
    """The sample document's entry, made if there is none; None if its files aren't there."""
    there = load_registry(spark, path).where("is_sample").first()
    if there is not None:
        return there.asDict()
    if not (_there(spark, pdf_path) and _there(spark, chunks_path)):
        return None
    chunks = read_chunks(spark, chunks_path).select(F.lit("sample").alias("doc_id"), F.col("metadata.page_number").alias("page"))
    counts = register(chunks).first()
    put_entry(
        spark, path, doc_id="sample", name=name, pdf_path=pdf_path, chunks_path=chunks_path, collection=collection,
        pages=counts["pages"] if counts else 0, chunks=counts["chunks"] if counts else 0, is_sample=True, created=created,
    )
    return load_registry(spark, path).where("is_sample").first().asDict()


def index_document(spark: SparkSession, registry: str, doc_id: str, index: str, chunk: Callable[[], DataFrame], encode: Callable[[Column], Column]) -> str:
    """Chunk and index one document, its entry going from indexing to ready, or to error with the reason; the status.

    `chunk` gives (chunk_id, chunk_type, text, metadata). The entry says at each step what is done.
    """
    try:
        put_entry(spark, registry, doc_id=doc_id, status="indexing", message="", progress="chunking")
        rows = chunk()
        put_entry(spark, registry, doc_id=doc_id, chunks=rows.count(), progress="encoding chunks")
        write_index(index_rows(rows, encode), index, doc_id)
        put_entry(spark, registry, doc_id=doc_id, status="ready", message="", progress="")
        return "ready"
    except Exception as e:
        put_entry(spark, registry, doc_id=doc_id, status="error", message=f"{type(e).__name__}: {e}", progress="")
        return "error"


def listed(registry: DataFrame) -> DataFrame:
    """Samples first, then by age."""
    return registry.orderBy(~F.col("is_sample"), "created")


def ready(registry: DataFrame, doc_id: str, query: str | None = None) -> dict:
    """The document's entry; raises what an API answers with 404, 409 and 400."""
    row = registry.where(F.col("doc_id") == doc_id).first()
    if row is None:
        raise UnknownDocument(doc_id)
    if row["status"] != "ready":
        raise NotReady(f"{doc_id}: {row['status']}")
    if query is not None and not query.strip():
        raise BadRequest("the query is empty")
    return row.asDict()


def accept_upload(name: str, size: int) -> None:
    if not name.lower().endswith(".pdf"):
        raise BadRequest("only PDF files are taken")
    if not size:
        raise BadRequest("the file is empty")


def add_uploads(spark: SparkSession, registry: str, files: DataFrame, count_pages: Callable[[Column], Column], collection: str = "documents") -> DataFrame:
    """Entries (doc_id, name, pages, status) in state indexing for files (path, length, modificationTime, content), all in one append.

    The id is a digest of the file's bytes, so that a file sent twice has one entry; `count_pages`,
    an expression or pandas UDF of the bytes, is asked once a file. Files that accept_upload would
    refuse get an entry in state error that says why.
    """
    name = F.element_at(F.split("path", "/"), -1)
    why = F.when(~F.lower(name).endswith(".pdf"), "only PDF files are taken").when(F.col("length") == 0, "the file is empty").otherwise("")
    each = files.select(F.left(F.sha2("content", 256), F.lit(12)).alias("doc_id"), name.alias("name"), F.col("path").alias("pdf_path"), why.alias("message"), "content")
    fine = each.where("message = ''").withColumn("pages", count_pages(F.col("content")).cast("int"))
    both = fine.unionByName(each.where("message <> ''").withColumn("pages", F.lit(0))).drop("content").dropDuplicates(["doc_id"])
    rows = both.withColumns({"status": F.when(F.col("message") == "", "indexing").otherwise("error"), "chunks": F.lit(0), "collection": F.lit(collection), "progress": F.lit(""), "is_sample": F.lit(False), "created": F.lit(time.time())})
    kept = written(rows, "uploads")
    put_entries(kept, registry)
    return kept.select("doc_id", "name", "pages", "status")


def gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, text, kind, holdout) and grades (query_id, page, grade) of a YAML list."""
    import yaml

    with open(path) as f:
        rows = yaml.safe_load(f)
    queries = [(i, r["query"], r.get("kind"), bool(r.get("holdout", False))) for i, r in enumerate(rows)]
    grades = [(i, int(p), int(g)) for i, r in enumerate(rows) for p, g in r["relevant"].items()]
    return spark.createDataFrame(queries, "query_id long, text string, kind string, holdout boolean"), spark.createDataFrame(grades, "query_id long, page int, grade int")


def generation_key(model: str, version: str, query: Column) -> Column:
    return digest_id(F.lit(model), F.lit(version), query, size=20)


def with_cache(queries: DataFrame, cache: DataFrame, model: str, version: str, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Queries with their generated passage: from the cache (cache_key, passage), else by `generate`."""
    keyed = queries.withColumn("cache_key", generation_key(model, version, F.col("text")))
    known = keyed.join(cache, "cache_key")
    return known.unionByName(generate(keyed.join(cache.select("cache_key"), "cache_key", "left_anti")).select(known.columns))


ANSWERS = "cache_key string, answer string"


def load_answers(spark: SparkSession, cache: str) -> DataFrame:
    """(cache_key, answer) of a cache of models' answers, one row a key; none if there is no cache yet."""
    rows = spark.read.schema(ANSWERS).parquet(cache) if _there(spark, cache) else spark.createDataFrame([], ANSWERS)
    # two runs at once may both have asked; null answers are failures
    return rows.where("answer is not null").groupBy("cache_key").agg(F.min("answer").alias("answer"))


def asked_once(rows: DataFrame, payload: Column, cache: str, model: str, version: str, ask: Callable[[Column], Column], answer: str = "answer") -> DataFrame:
    """rows with the column `answer`: what a model says of their payloads, asked once for each distinct payload, in this run and in later ones.

    `cache` is a Parquet table by the digest of model, version and payload. Payloads that it lacks
    are brought together (with map-side combination: copies are no burden), given to `ask`, an
    expression or pandas UDF of the column it is given, and the answers are appended before
    anything reads them, so that a plan that uses them twice asks nothing. A model that fails on a
    payload answers null, which is not kept: the next run asks again. A null payload is not asked
    about and has no answer.
    """
    spark = rows.sparkSession
    key = F.when(payload.isNotNull(), F.sha2(F.concat_ws("|", F.lit(model), F.lit(version), payload.cast("string")), 256))
    each = rows.select(key.alias("cache_key"), payload.alias("payload")).where("cache_key is not null").groupBy("cache_key").agg(F.first("payload").alias("payload"))
    fresh = each.join(load_answers(spark, cache).select("cache_key"), "cache_key", "left_anti")
    append(fresh.select("cache_key", ask(F.col("payload")).cast("string").alias("answer")), cache)
    told = load_answers(spark, cache).select(F.col("cache_key").alias("told_key"), F.col("answer").alias("told"))
    every = [c for c in rows.columns if c != answer]
    return rows.join(told, key == F.col("told_key"), "left").select(*every, F.col("told").alias(answer))


def image_payload(base64: Column) -> Column:
    """The bytes of an image, null if they can't be read."""
    return F.try_to_binary(base64, F.lit("base64"))
