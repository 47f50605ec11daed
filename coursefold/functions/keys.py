"""Keys and paths as column expressions: compact ids, zero-padded row keys, class keys, file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(guid: Column) -> Column:
    return F.replace(guid, F.lit("-"), F.lit(""))


def scope_key(child: Column, class_level: Column) -> Column:
    return F.concat(compact(child), F.lit("_"), F.format_string("%02d", class_level.cast("int")))


def summary_key(child: Column, class_level: Column, chapter: Column) -> Column:
    return F.concat(F.lit("s_"), scope_key(child, class_level), F.lit("_"), chapter)


def attempt_key(child: Column, class_level: Column, chapter: Column, attempt: Column) -> Column:
    """Text order breaks past 999 attempts, so rows are sorted by the number and never by this."""
    return F.concat(F.lit("a_"), scope_key(child, class_level), F.lit("_"), chapter, F.lit("_"), F.format_string("%03d", attempt.cast("int")))


def check_key(child: Column, class_level: Column, chapter: Column, attempt: Column, number: Column) -> Column:
    return F.concat(F.lit("c_"), scope_key(child, class_level), F.lit("_"), chapter, F.format_string("_%03d_%03d", attempt.cast("int"), number.cast("int")))


def class_key(board: Column, class_level: Column) -> Column:
    return F.concat(F.lower(board), F.lit("-"), class_level.cast("string"))


def document_id(board: Column, class_level: Column) -> Column:
    return F.concat(F.lit("class:"), class_key(board, class_level))


def prefix_successor(prefix: str) -> str:
    """The least text after all that start with ``prefix``."""
    if not prefix:
        raise ValueError("a prefix is needed")
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


def starts_with(column: Column, prefix: str) -> Column:
    """A range that reaches the scan, and the prefix itself."""
    return (column >= prefix) & (column < prefix_successor(prefix)) & column.startswith(prefix)


def kebab(name: Column) -> Column:
    """``ParkLateMailFunction`` to ``park-late-mail``."""
    bare = F.regexp_replace(name, "Function$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "([A-Z])", "-$1"), "^-", ""))


def is_book_id(column: Column) -> Column:
    return column.rlike(r"\A[A-Za-z0-9._-]+\z")


def derived_file(refined: Column, kind: str) -> Column:
    """The file that belongs to a refined chapter file, whose name starts at its top folder.

    ``refined/b/x.json`` has the summary ``summaries/b/x.json`` and the plan ``plans/b/x.plan.json``.
    """
    rest = F.regexp_extract(refined, r"\Arefined/(.*)\.json\z", 1)
    return F.when(rest != "", F.concat(F.lit(f"{kind}/"), rest, F.lit(".plan.json" if kind == "plans" else ".json")))


def folder_of(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), 1)


def book_of(name: Column) -> Column:
    """The second part of a file's name; null for a file of a top folder itself."""
    return F.when(F.size(F.split(name, "/")) > 2, F.get(F.split(name, "/"), 1))


def path(*parts: Column | str, folder: bool = False) -> Column:
    """Parts joined by slashes, such as family, child, class and file; a folder ends in one, so no longer name starts like it."""
    joined = F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.concat(joined, F.lit("/")) if folder else joined


def action_id(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)
