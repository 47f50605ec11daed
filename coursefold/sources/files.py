"""Files and documents: explicit schemas, guards instead of silent empty results."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import starts_with

CHAPTER = "struct<chapterId:string,bookId:string,number:int,title:string,summary:string>"
MANIFEST = f"schema string, board string, profileVersion string, class int, subjects array<struct<subjectId:string,name:string,icon:string,chapterCount:int,chapters:array<{CHAPTER}>>>"


def point_lookup(table: DataFrame, **key) -> DataFrame:
    """The row with this key. A missing table is an error when it is read, a missing row an empty result."""
    for name, value in key.items():
        table = table.where(F.col(name) == value)
    return table.limit(1)


def prefix_scan(table: DataFrame, column: str, prefix: str) -> DataFrame:
    return table.where(starts_with(F.col(column), prefix))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of every table, each counted on its own."""
    counts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def file_listing(spark: SparkSession, root: str, prefix: str = "", content: bool = False) -> DataFrame:
    """Names below ``root`` that start with ``prefix``, which ends in / so that no longer name starts like it, and an ETag of write time and length.

    Only that folder is listed, and no content is read unless it is asked for.
    """
    if prefix and not prefix.endswith("/"):
        raise ValueError("a prefix ends in /")
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/{prefix}")
    name = F.regexp_replace("path", "^.*?" + re.escape(re.sub("^[a-z]+:/*", "/", root)) + "/", "")
    return files.select(name.alias("name"), "length", F.concat_ws("-", F.unix_micros("modificationTime"), "length").alias("etag"), *(["content"] if content else []))


def path_counts(paths: DataFrame, url: str = "url") -> DataFrame:
    """(host, folder, files) of addresses: how many files there are below each first folder of a host."""
    part = lambda i: F.regexp_extract(url, "^[a-z]+://([^/]+)/([^/?#]*)", i)
    return paths.groupBy(part(1).alias("host"), part(2).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def required(wanted: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """``wanted`` names with their ETags; one that is not there is an error that names it, when rows are read."""
    found = wanted.join(files.select(name, "etag"), name, "left")
    missing = F.raise_error(F.concat(F.lit("there is no "), F.col(name))).cast("boolean")
    return found.where(F.when(F.col("etag").isNull(), missing).otherwise(True))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """(pos, raw): the objects of a file that holds one JSON array, each as its text with all of its fields."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.expr("inline(transform(cast(parse_json(value) as array<variant>), (v, i) -> named_struct('pos', i, 'raw', to_json(v))))"))


def manifests(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """Class manifests; an unknown schema or a wrong chapter count raises, whatever is then read of them."""
    return guarded(spark.read.schema(MANIFEST).json(path, multiLine=True), expected)


def guarded(rows: DataFrame, expected: str) -> DataFrame:
    """The check is a filter, which no later choice of columns takes away."""
    wrong = F.exists("subjects", lambda s: ~F.size(s["chapters"]).eqNullSafe(s["chapterCount"]))
    fail = lambda why: F.raise_error(F.lit(why)).cast("boolean")
    known = F.when(~F.col("schema").eqNullSafe(F.lit(expected)), fail("manifest schema is not known"))
    return rows.where(known.when(F.coalesce(wrong, F.lit(False)), fail("chapter count does not match")).otherwise(True))


def flattened(rows: DataFrame) -> DataFrame:
    """One row per chapter, numbered 1..N through all books of its subject in document order."""
    subjects = rows.select("board", "class", F.posexplode("subjects").alias("subject_pos", "s"))
    return subjects.select("board", "class", "subject_pos", F.col("s.subjectId").alias("subject_id"), F.col("s.name").alias("subject"), F.posexplode("s.chapters").alias("pos", "c")).select("board", "class", "subject_pos", "subject_id", "subject", (F.col("pos") + 1).alias("number"), F.col("c.chapterId").alias("chapter_id"), F.col("c.title").alias("title"), F.col("c.summary").alias("summary"))


def catalog_entries(catalog: DataFrame, grade: int) -> DataFrame:
    """Entries (raw JSON each) whose own ``grade`` is that integer as a number; other fields stay in the raw text.

    A text, a fraction or a grade of something nested is none, nor is JSON that cannot be read.
    """
    value = F.try_variant_get(F.try_parse_json("raw"), "$.grade", "variant")
    return catalog.where((F.schema_of_variant(value) == "BIGINT") & (F.try_variant_get(value, "$", "bigint") == int(grade)))


def stored_value(text: Column, schema: str, default: Column, required: tuple[str, ...] = ()) -> Column:
    """A stored JSON value, or the default if it is absent, unreadable or lacks a ``required`` field."""
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = F.from_json(text, f"{schema}, _corrupt string", mode)
    whole = text.isNotNull() & (F.trim(text) != "") & read["_corrupt"].isNull()
    for name in required:
        whole = whole & read[name].isNotNull()
    return F.when(F.coalesce(whole, F.lit(False)), read.dropFields("_corrupt")).otherwise(default)
