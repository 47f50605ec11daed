"""Content slices: which listed books are whole under a board's rules, their files, and the manifest of what is ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import book_of, folder_of

#: A board that skips books without content, and files besides chapters that each book of a board must have.
SKIPS_UNBUILT = ["cbse"]
#: Files of a slice besides those copied: the catalog and the class manifest.
OWN_FILES = 2


def judge_books(books: DataFrame, files: DataFrame, skips_unbuilt: list[str] = SKIPS_UNBUILT, required: tuple[str, ...] = ()) -> DataFrame:
    """``books`` (board, book_id) with ``state`` ready, skipped or broken, ``fault`` and ``first``, the first name at fault.

    ``files``: name, as ``refined/<book>/<chapter>.json``. In this order: a book without refined files is skipped or, by its
    board's rule, broken; then each refined chapter needs its summary, then its plan; then each ``required`` folder
    needs the book's own file. Names compare byte by byte.
    """
    folder = folder_of(F.col("name"))
    named = files.select("name", folder.alias("folder"), F.substring(F.col("name"), F.length(folder) + 2, F.length("name")).alias("rest"))
    # one grouping by chapter in place of a join for each kind of file
    chapter = F.when(F.col("folder") == "plans", F.regexp_replace("rest", r"\.plan\.json\z", ".json")).otherwise(F.col("rest"))
    has = lambda kind: F.max(F.col("folder") == kind)
    whole = named.where(F.col("folder").isin("refined", "summaries", "plans")).groupBy(chapter.alias("chapter"))
    whole = whole.agg(F.min(F.when(F.col("folder") == "refined", F.col("name"))).alias("name"), has("summaries").alias("s"), has("plans").alias("p")).where("name is not null")
    lacking = lambda kind: F.min(F.when(~F.col(kind), F.col("name")))
    built = whole.groupBy(book_of(F.col("name")).alias("book_id")).agg(F.count(F.lit(1)).alias("chapters"), lacking("s").alias("_s"), lacking("p").alias("_p"))
    out = books.join(built, "book_id", "left")
    checks = [("unbuilt", F.when(F.col("chapters").isNull(), F.concat(F.lit("refined/"), F.col("book_id")))), ("no-summary", F.col("_s")), ("no-plan", F.col("_p"))]
    if required:
        own = named.where(F.col("folder").isin(*required)).groupBy(F.regexp_replace("rest", r"\.json\z", "").alias("book_id")).agg(*(has(f).alias(f"_has_{f}") for f in required))
        out = out.join(own, "book_id", "left")
        checks += [(f"no-{f}", F.when(~F.coalesce(f"_has_{f}", F.lit(False)), F.concat(F.lit(f"{f}/"), F.col("book_id"), F.lit(".json")))) for f in required]
    fault = F.coalesce(*(F.when(name.isNotNull(), F.struct(F.lit(what).alias("fault"), name.alias("first"))) for what, name in checks))
    out = out.withColumn("_f", fault)
    skipped = F.col("chapters").isNull() & F.col("board").isin(skips_unbuilt)
    state = F.when(skipped, "skipped").when(F.col("_f").isNull(), "ready").otherwise("broken")
    return out.select(*books.columns, state.alias("state"), F.when(~skipped, F.col("_f.fault")).alias("fault"), F.when(~skipped, F.col("_f.first")).alias("first"))


def slice_files(judged: DataFrame, files: DataFrame) -> DataFrame:
    """Names of all files of ready books, with board and book_id; reading one when a book is broken is an error that names its first fault."""
    broken = F.raise_error(F.concat(F.lit("book "), F.col("book_id"), F.lit(": "), F.col("fault"), F.lit(" "), F.col("first")))
    sound = judged.where(F.when(F.col("state") == "broken", broken.cast("boolean")).otherwise(F.col("state") == "ready"))
    return files.withColumn("book_id", book_of(F.col("name"))).join(sound.select("board", "book_id"), "book_id")


def slice_counts(files: DataFrame, key: str) -> DataFrame:
    """Files (name, book_id) of each slice, with the two that every slice has, and its number of books."""
    return files.groupBy(key).agg((F.count(F.lit(1)) + OWN_FILES).alias("files"), F.countDistinct("book_id").alias("books"))


def disjoint_union(*files: DataFrame, name: str = "name") -> DataFrame:
    """All rows of listings that share no name; a name in two of them is an error."""
    every = files[0]
    for f in files[1:]:
        every = every.unionByName(f)
    rest = [c for c in every.columns if c != name]
    rows = every.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    twice = F.raise_error(F.concat(F.lit("listed twice: "), F.col(name))).cast("boolean")
    return rows.where(F.when(F.col("_n") > 1, twice).otherwise(True)).select(name, "_r.*")


def upsert(manifest: DataFrame, entries: DataFrame, key: list[str]) -> DataFrame:
    """The manifest with ``entries`` added or put in place, and ``changed``: false where the entry was there just so."""
    rest = [c for c in manifest.columns if c not in key]
    old, new = manifest.select(*key, F.struct(*rest).alias("_old")), entries.select(*key, F.struct(*rest).alias("_new"))
    both = old.join(new, key, "full_outer")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    return both.withColumn("_r", F.coalesce("_new", "_old")).select(*key, "_r.*", changed.alias("changed"))


def ready_only(files: DataFrame, prefix: Column, marker: str = "version.json", name: str = "name") -> DataFrame:
    """Files below prefixes whose marker, written last, is there."""
    rows = files.withColumn("_p", prefix)
    marked = rows.where(F.col(name) == F.concat(F.col("_p"), F.lit(marker))).select("_p").distinct()
    return rows.join(marked, "_p", "left_semi").drop("_p")


def copied(files: DataFrame, source: str, target: Column, name: str = "name") -> DataFrame:
    """Files below ``source`` under the same names below ``target``; their content is moved by the write of the rows."""
    return files.where(F.col(name).startswith(source)).withColumn(name, F.concat(target, F.substring(F.col(name), len(source) + 1, 1 << 30)))


def without_prefix(files: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """What a prefix delete leaves; nothing below it is fine."""
    if not prefix.endswith("/"):
        raise ValueError("a prefix ends in /, or it also removes longer names")
    return files.where(~F.col(name).startswith(prefix))
