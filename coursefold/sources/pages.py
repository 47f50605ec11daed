"""A paged listing as a source: each chain of pages is read by one task, which follows its cursors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

from .transfer import _folder

SOURCE = "coursefold_pages"
FIRST = "first"
_KINDS = {StringType: str, IntegerType: int, LongType: int, DoubleType: (int, float), BooleanType: bool}


class BadPage(ValueError):
    """A page that is not as its schema says, by its name."""


@dataclass
class Chain(InputPartition):
    name: str


def page_items(text: str, page: str, fields: list[tuple[str, type | tuple, bool]]) -> tuple[list[tuple], str | None]:
    """(items as tuples, next cursor) of a page's JSON: ``items``, each with all ``fields`` (name, kind, may be null), and ``nextCursor``."""
    try:
        body = json.loads(text)
    except ValueError as e:
        raise BadPage(f"{page}: no JSON") from e
    if not isinstance(body, dict) or not isinstance(body.get("items"), list) or not isinstance(body.get("nextCursor"), (str, type(None))):
        raise BadPage(f"{page}: it has no items or a cursor that is no text")
    rows = []
    for n, item in enumerate(body["items"]):
        if not isinstance(item, dict):
            raise BadPage(f"{page}: item {n} is no object")
        for name, kind, null in fields:
            v = item.get(name)
            if not (null if v is None else isinstance(v, kind) and (kind is bool or not isinstance(v, bool))):
                raise BadPage(f"{page}: {name} of item {n} is not as it should be")
        rows.append(tuple(item.get(name) for name, _, _ in fields))
    return rows, body["nextCursor"]


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.fields = [(f.name, _KINDS[type(f.dataType)], f.nullable) for f in schema.fields if f.name != "chain"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _folder(self.root)
        return [Chain(f.base_name) for f in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda f: f.base_name) if f.type == fs.FileType.Directory and f.base_name[0] not in "_."]

    def read(self, partition: Chain) -> Iterator[tuple]:
        system, root = _folder(self.root)
        cursor, seen = FIRST, set()
        while cursor is not None:
            page = f"{partition.name}/{cursor}.json"
            if cursor in seen:
                raise BadPage(f"{page}: its chain comes back to it")
            seen.add(cursor)
            try:
                with system.open_input_stream(f"{root}/{page}") as f:
                    text = f.read().decode()
            except (FileNotFoundError, UnicodeDecodeError) as e:
                raise BadPage(f"{page}: it cannot be read") from e
            rows, cursor = page_items(text, page, self.fields)
            for r in rows:
                yield (partition.name, *r)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> StructType:
        raise ValueError("give the schema of the items")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(schema, dict(self.options))


def paged(spark: SparkSession, root: str, items: str) -> DataFrame:
    """(chain, the fields of ``items``) of all items of all chains of pages below ``root``.

    A chain is a folder; its first page is ``first.json``, and a page's ``nextCursor`` names the next, null the end. A page that is not as ``items`` says
    (a field missing, of another kind, or null where it may not be) is an error that names it.
    """
    spark.dataSource.register(PageSource)
    schema = StructType().add("chain", "string", False)
    for f in StructType.fromDDL(items).fields:
        schema = schema.add(f)
    return spark.read.format(SOURCE).schema(schema).load(root)


def as_pages(rows: DataFrame, chain: str, number: str, encoded, size: int = 50) -> DataFrame:
    """Files (name, content) of ``rows`` as pages of ``size``: ``number`` counts a chain's rows from 1; ``encoded`` makes a cursor of an offset."""
    rest = [c for c in rows.columns if c not in (chain, number)]
    page = F.floor((F.col(number) - 1) / size)
    items = F.transform(F.sort_array(F.collect_list(F.struct(number, *rest))), lambda x: F.struct(*(x[c].alias(c) for c in rest)))
    pages = rows.groupBy(chain, page.alias("_page")).agg(items.alias("items"))
    last = rows.groupBy(chain).agg(F.max(page).alias("_last"))
    pages = pages.join(last, chain)
    cursor = lambda n: encoded((n * size).cast("string"))
    follows: Column = F.when(F.col("_page") < F.col("_last"), cursor(F.col("_page") + 1))
    name = F.concat_ws("/", F.col(chain).cast("string"), F.concat(F.when(F.col("_page") == 0, FIRST).otherwise(cursor(F.col("_page"))), F.lit(".json")))
    content = F.to_json(F.struct("items", follows.alias("nextCursor")), {"ignoreNullFields": "false"})
    return pages.select(name.alias("name"), content.cast("binary").alias("content"))
