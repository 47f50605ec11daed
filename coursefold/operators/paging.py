"""Cursor paging: the cursor is the base64url text of an offset into the filtered rows."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import url64


class InvalidPage(ValueError):
    pass


def encode(offset: int) -> str:
    return base64.urlsafe_b64encode(str(offset).encode()).rstrip(b"=").decode()


def decode(cursor: str | None, count: int) -> int:
    """The offset; no cursor is the first page. It must be a number from 1 to under ``count``."""
    if not cursor:
        return 0
    try:
        if len(cursor) > 16 or not re.fullmatch(r"[A-Za-z0-9_-]+", cursor):
            raise InvalidPage(cursor)
        text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode("ascii")
    except ValueError as e:
        raise InvalidPage(cursor) from e
    if not re.fullmatch(r"[0-9]+", text) or not 1 <= int(text) < count:
        raise InvalidPage(cursor)
    return int(text)


def encoded(offset: Column) -> Column:
    """``encode`` of a column."""
    return url64(offset.cast("string").cast("binary"))


def decoded(cursor: Column, count: Column) -> Column:
    """``decode`` of a column: the offset, 0 for no cursor, and null for one that is refused."""
    shaped = (F.length(cursor) <= 16) & cursor.rlike(r"\A[A-Za-z0-9_-]+\z")
    padded = F.rpad(F.translate(cursor, "-_", "+/"), (F.ceil(F.length(cursor) / 4) * 4).cast("int"), F.lit("="))
    text = F.when(shaped, F.try_to_binary(padded, F.lit("base64"))).cast("string")
    offset = F.when(text.rlike(r"\A[0-9]+\z"), text).try_cast("long")
    return F.when(F.coalesce(cursor, F.lit("")) == "", F.lit(0).cast("long")).when((offset >= 1) & (offset < count), offset)


def page(rows: DataFrame, order: list[str], limit: int = 50, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """A page in a total order, and the next cursor if more rows follow."""
    if not 1 <= limit <= 100:
        raise InvalidPage(str(limit))
    count = rows.count()
    start = decode(cursor, count)
    return rows.orderBy(*order).offset(start).limit(limit), encode(start + limit) if start + limit < count else None
