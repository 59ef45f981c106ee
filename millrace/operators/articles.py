"""Published articles by their facets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lower(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(x))


def _about(kind: str, wanted: int, relationship: str) -> Callable[[Column], Column]:
    return lambda e: (e["kind"] == kind) & (e["id"] == wanted) & (F.lit(not relationship) | (e["relationship"] == relationship))


def filtered(
    articles: DataFrame, *, q: str = "", topics: list[str] | None = None, competition: str = "", season: str = "", author: str = "", first_day: dt.date | None = None, last_day: dt.date | None = None, player: int | None = None, team: int | None = None, relationship: str = ""
) -> DataFrame:
    """Articles that all given facets fit; what is not given fits all.

    articles: title, subtitle, author_id, author_name, notes, body, topics, competitions and seasons (arrays), published_at,
    entities (array of kind, id, relationship).  Words and names go without regard to case; the search goes over title, subtitle,
    author, notes, body and topics joined by blanks; of several topics one is enough.
    """
    out = articles
    if q.strip():
        everything = F.concat_ws(" ", "title", "subtitle", "author_name", "notes", "body", "topics")
        out = out.where(F.contains(F.lower(everything), F.lit(q.strip().lower())))
    asked = [t.strip().lower() for t in topics or [] if t.strip()]
    if asked:
        out = out.where(F.arrays_overlap(_lower(F.col("topics")), F.array(*map(F.lit, asked))))
    for column, wanted in (("competitions", competition), ("seasons", season)):
        if wanted.strip():
            out = out.where(F.array_contains(_lower(F.col(column)), wanted.strip().lower()))
    if author.strip():
        out = out.where(F.col("author_id").cast("string") == author.strip())
    if first_day is not None:
        out = out.where(F.to_date("published_at") >= F.lit(first_day))
    if last_day is not None:
        out = out.where(F.to_date("published_at") <= F.lit(last_day))
    for kind, wanted in (("player", player), ("team", team)):
        if wanted is not None:
            out = out.where(F.exists("entities", _about(kind, wanted, relationship)))
    return out
