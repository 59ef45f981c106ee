"""Full-outer merges with precedence, versioned rows, and ladders of look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import content_key
from .cohort import best_row


def full_merge(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[Column], order_b: list[Column], prefer: dict[str, str]) -> DataFrame:
    """Full outer join on keys after keeping one row a key on either side.

    prefer: column -> "a" or "b", the side whose value wins where both have one;
    columns of one side only come along.  authority says which side leads a row.
    """
    left, right = best_row(a, keys, order_a).alias("a"), best_row(b, keys, order_b).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    has_a = F.col(f"a.{keys[0]}").isNotNull()
    cols = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    for c in dict.fromkeys([*a.columns, *b.columns]):
        if c in keys:
            continue
        if c in a.columns and c in b.columns:
            first, second = ("a", "b") if prefer.get(c, "a") == "a" else ("b", "a")
            cols.append(F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c))
        else:
            cols.append(F.col(f"{'a' if c in a.columns else 'b'}.{c}").alias(c))
    return left.join(right, on, "full_outer").select(*cols, F.when(has_a, "a").otherwise("b").alias("authority"))


def supersede(current: DataFrame, new: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Versioned rows: open rows whose key has a new version are closed, new ones are added open.

    current: keys, values, is_current, superseded_at.  Keys without a new version stay as they are.
    """
    fresh = new.select(*keys).distinct().withColumn("__new", F.lit(True))
    closes = F.col("is_current") & F.col("__new").isNotNull()
    old = current.join(fresh, keys, "left").withColumn("superseded_at", F.when(closes, now).otherwise(F.col("superseded_at"))).withColumn("is_current", F.col("is_current") & F.col("__new").isNull()).drop("__new")
    return old.unionByName(new.withColumn("is_current", F.lit(True)).withColumn("superseded_at", F.lit(None).cast("timestamp")), allowMissingColumns=True)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed and new rows replace those of their key."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def replace_slices(base: DataFrame, new: DataFrame, slice_key: str) -> DataFrame:
    """All rows of the slices that `new` covers are replaced."""
    return base.join(new.select(slice_key).distinct(), slice_key, "left_anti").unionByName(new)


def changed(old: DataFrame, new: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """keys and change (added, removed, changed, same) by a digest of the content columns, whatever the order of their fields."""
    a = old.select(*keys, content_key(old, *content).alias("__a"))
    b = new.select(*keys, content_key(new, *content).alias("__b"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") == F.col("__b"), "same").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def ladder(rows: DataFrame, key: str, steps: list[tuple[str, DataFrame, str]], out: str) -> DataFrame:
    """Resolve `out` by the first step that knows it.

    steps: (method, look-up table with the join columns and `out`, join column).  Adds <out> and method;
    rows that no step resolves keep nulls.  A look-up must have one row for each join value.
    """
    df, found, method = rows, [], F.lit(None).cast("string")
    for i, (name, lookup, on) in enumerate(steps):
        df = df.join(lookup.select(F.col(on), F.col(out).alias(f"__s{i}")), on, "left")
        found.append(f"__s{i}")
    for i, (name, _, _) in reversed(list(enumerate(steps))):
        method = F.when(F.col(f"__s{i}").isNotNull(), name).otherwise(method)
    return df.withColumn(out, F.coalesce(*found)).withColumn("method", method).drop(*found)


def unique_match(rows: DataFrame, candidates: DataFrame, on: str | list[str], key: str, candidate: str, agree: Column | None = None) -> DataFrame:
    """key, candidate: accepted only where exactly one candidate shares `on`, a column or several (and agrees).

    Without `agree`, candidates meet no row one by one: of each key the smallest and the largest are kept, which are the
    same where there is one.  What can be an equality belongs into `on`, as `agree` is asked of every pair.
    """
    on = [on] if isinstance(on, str) else on
    low, high = F.min(f"c.{candidate}").alias("__low"), F.max(f"c.{candidate}").alias("__high")
    if agree is None:
        ends = candidates.alias("c").groupBy(*(F.col(f"c.{o}").alias(o) for o in on)).agg(low, high).where("__low is not null")
        met = rows.select(*on, key).join(ends, on).groupBy(key).agg(F.min("__low").alias(candidate), F.max("__high").alias("__high"))
    else:
        pairs = rows.alias("r").join(candidates.alias("c"), [F.col(f"r.{o}") == F.col(f"c.{o}") for o in on]).where(agree)
        met = pairs.groupBy(F.col(f"r.{key}").alias(key)).agg(low, high).withColumnRenamed("__low", candidate)
    return met.where(F.col(candidate) == F.col("__high")).drop("__high")


def sole_owner(rows: DataFrame, shared_id: str, newest_first: list[Column]) -> DataFrame:
    """One row may hold a shared id: the first by order keeps it, the others get null; rows without one stay as they are."""
    nth = F.row_number().over(Window.partitionBy(shared_id).orderBy(*newest_first))
    held = rows.where(F.col(shared_id).isNotNull()).withColumn(shared_id, F.when(nth == 1, F.col(shared_id)))
    return held.unionByName(rows.where(F.col(shared_id).isNull()))


def switched(base: DataFrame, staged: DataFrame, slice_key: str) -> DataFrame:
    """Staged rows take the place of the current ones of their slices; those stay as rows that are not current."""
    fresh = staged.select(F.col(slice_key).alias("__slice")).distinct().withColumn("__new", F.lit(True))
    old = base.join(fresh, F.col(slice_key).eqNullSafe(F.col("__slice")), "left")
    old = old.withColumn("is_current", F.col("is_current") & F.col("__new").isNull()).drop("__slice", "__new")
    return old.unionByName(staged.withColumn("is_current", F.lit(True)))


def repaired(canonical: DataFrame, provider: DataFrame, register: DataFrame) -> DataFrame:
    """entity, canonical_id, how of provider rows (entity, register_id, native_id): by register id, else an adopted row of the same native id, else new.

    canonical: canonical_id, register_id, native_id.  New ids hang on the entity alone, so that a rerun gives the same ones.
    """
    by_register = canonical.where("register_id is not null").groupBy("register_id").agg(F.min("canonical_id").alias("__r"))
    by_native = canonical.where("register_id is null and native_id is not null").groupBy("native_id").agg(F.min("canonical_id").alias("__n"))
    known = register.select("register_id").distinct()
    rows = provider.join(known.withColumn("__known", F.lit(True)), "register_id", "left").join(by_register, "register_id", "left").join(by_native, "native_id", "left")
    how = F.when(F.col("__known") & F.col("__r").isNotNull(), "register").when(F.col("__n").isNotNull(), "adopted").otherwise("created")
    made = F.concat(F.lit("new-"), F.substring(F.sha2(F.col("entity").cast("string"), 256), 1, 16))
    given = F.when(how == "register", F.col("__r").cast("string")).when(how == "adopted", F.col("__n").cast("string")).otherwise(made)
    return rows.select("entity", given.alias("canonical_id"), how.alias("how"))


def by_confidence(rows: DataFrame, key: str, steps: list[tuple[str, DataFrame, float]], value: str, manual: DataFrame | None = None) -> DataFrame:
    """key, value, source, confidence: the value of the source with the highest confidence that has one; a manual one is never moved.

    steps: (source, table of key and value with one row a key, confidence).
    """
    listed = ([("manual", manual, 1.0)] if manual is not None else []) + sorted(steps, key=lambda s: -s[2])
    out = rows.select(key)
    picks = []
    for i, (name, table, sure) in enumerate(listed):
        out = out.join(table.select(F.col(key), F.col(value).alias(f"__v{i}")), key, "left")
        picks.append(F.when(F.col(f"__v{i}").isNotNull(), F.struct(F.col(f"__v{i}").alias(value), F.lit(name).alias("source"), F.lit(float(sure)).alias("confidence"))))
    best = F.coalesce(*picks)
    return out.select(key, best[value].alias(value), best["source"].alias("source"), best["confidence"].alias("confidence"))


def counterparts(rows: DataFrame, others: DataFrame, splits: DataFrame) -> DataFrame:
    """entity, counterpart: the one row of the other provider with the same alias, where it may move.

    rows: entity, alias; others: counterpart, alias; splits: counterparts that other mappings or events hold in place.
    """
    alone = others.groupBy("alias").agg(F.countDistinct("counterpart").alias("n"), F.min("counterpart").alias("counterpart")).where("n = 1")
    asked = rows.groupBy("alias").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("entity")).where("n = 1")
    return asked.select("alias", "entity").join(alone.select("alias", "counterpart"), "alias").join(splits.select("counterpart").distinct(), "counterpart", "left_anti").select("entity", "counterpart")
