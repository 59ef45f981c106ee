"""Season labels: a calendar year (2025) or a split year (2025-26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def start_year(label: Column) -> Column:
    return F.regexp_extract(label, "^([0-9]{4})(-[0-9]{2})?$", 1).try_cast("int")


def split_label(year: Column) -> Column:
    """2025 -> 2025-26, 1999 -> 1999-00."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def aggregate_label(label: Column) -> Column:
    """The split-year label that a season of either shape belongs to."""
    return split_label(start_year(label))


def constituents(label: Column) -> Column:
    """Both shapes of label that fall under an aggregate season."""
    return F.array(start_year(label).cast("string"), split_label(start_year(label)))


def sort_order(label: Column) -> Column:
    """The year a season ends in."""
    return start_year(label) + F.when(label.contains("-"), 1).otherwise(0)


def first_timestamp(*texts: Column) -> Column:
    """The first of several ISO texts that is a time."""
    return F.coalesce(*(F.try_to_timestamp(t) for t in texts))


def settled(fetched: Column, now: Column, hours: int = 12) -> Column:
    """Whether a payload has had its time to settle."""
    return now >= fetched + F.make_interval(hours=F.lit(hours))


def rotation(key: Column, day: Column, n: int) -> Column:
    """Order that moves on by one place each day."""
    return F.pmod(key + F.dayofyear(day), F.lit(n))


def canonical_label(code: Column, label: Column, aliases: Column) -> Column:
    """The label that a competition's season goes by; aliases: a map from "CODE|alias" to it."""
    named = F.trim(label)
    return F.coalesce(F.try_element_at(aliases, F.concat(F.upper(F.trim(code)), F.lit("|"), named)), named)


def candidate_labels(code: Column, label: Column, aliases: Column) -> Column:
    """Labels a season may be stored under: the canonical one, the asked one, then its other aliases by name."""
    main = canonical_label(code, label, aliases)
    own = F.filter(F.map_entries(aliases), lambda e: (F.split_part(e["key"], F.lit("|"), F.lit(1)) == F.upper(F.trim(code))) & (e["value"] == main))
    others = F.array_sort(F.transform(own, lambda e: F.split_part(e["key"], F.lit("|"), F.lit(2))))
    return F.array_distinct(F.concat(F.array(main, F.trim(label)), others))
