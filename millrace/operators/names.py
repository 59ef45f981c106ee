"""Names of one list found in another, without comparing all pairs.

Every rule of the likeness of names gives a key that two names meet in if they pass it:

- equal forms: the form;
- all words of one within the other's: the rarest word of the smaller, looked up among all words of the other;
- one form within the other: its rarest six letters in a row, looked up among all such letters of the other;
- the same first and last word: the two;
- the same first word alone: that word, where one candidate has it (else the rule decides nothing);
- letters in sequence, 2 * M >= 0.82 * S for M matched and S letters in all: U = S - 2 * M letters are unmatched,
  so so many pairs of neighbouring letters match that the two share one even when each leaves its most frequent
  pairs out, and its place is moved by U at most. The key is a rare pair, its place, and the length of the name.

Only distinct forms meet, and the rarest key is taken, so that common words and letters do not meet each other.
(Pairs of letters are weak keys: of names of random letters about a tenth of a scope's pairs are compared.)
Names that share a form share the outcome; candidates that share one are kept as their smallest and largest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import form_score, name_form, name_words
from .steps import stored

LETTERS = 6
TIE = 0.03
FIRST_NAME = 0.72


def _forms(df: DataFrame) -> DataFrame:
    return stored(df.select("scope", "form").distinct().withColumn("words", name_words(F.col("form"))))


def _rarest(keys: DataFrame, among: DataFrame) -> DataFrame:
    """scope, form, key: of each form the key that fewest forms of `among` have; keys that none has cannot be met."""
    counts = among.groupBy("scope", "key").agg(F.count("*").alias("n"))
    return keys.join(counts, ["scope", "key"], "left").groupBy("scope", "form").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))


def _met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.withColumnRenamed("form", "a").join(b.withColumnRenamed("form", "b"), ["scope", *on]).select("scope", "a", "b")


def _contained(rows: DataFrame, cands: DataFrame, keys: Column) -> DataFrame:
    """Pairs in which the rarest key of one form is a key of the other, either way round."""
    a, b = (df.select("scope", "form", F.explode(keys).alias("key")) for df in (rows, cands))
    return _met(_rarest(a, b), b, ["key"]).unionByName(_met(a, _rarest(b, a), ["key"]))


def _errors(total: Column) -> Column:
    """The most unmatched letters of two names that have so many together."""
    return F.floor(total * 18 / 100).cast("int")


def _shortest(n: Column) -> Column:
    """Lengths of names that may match one of n letters go from this one to _longest()."""
    return F.ceil(n * 41 / 59).cast("int")


def _longest(n: Column) -> Column:
    return F.floor(n * 59 / 41).cast("int")


def _grams(forms: DataFrame) -> DataFrame:
    """scope, form, n, at, gram: every two letters in a row."""
    n = F.length("form")
    return forms.where(n > 1).select("scope", "form", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 2)).alias("at")).withColumn("gram", F.substring("form", F.col("at") + 1, F.lit(2)))


def _rare(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Those of `grams` of which a match must share one: all but as many of the most frequent as it must share, less one.

    Of M matched letters in U + 1 stretches at most, 3 * M - S - 1 >= 0.23 * S - 1 pairs of neighbours match.
    """
    shared = F.greatest(F.lit(1), F.ceil((F.col("n") + _shortest(F.col("n"))) * 23 / 100 - 1))
    place = F.rank().over(Window.partitionBy("scope", "form").orderBy("met", "gram"))
    return grams.join(counts, ["scope", "gram"]).withColumn("place", place).where(F.col("place") <= F.col("n") - shared).select("scope", "form", "n", "at", "gram")


def _sequences(rows: DataFrame, cands: DataFrame) -> DataFrame:
    """Pairs with a rare pair of letters in common, at places and in names of lengths that a match allows."""
    a, b = _grams(rows), _grams(cands)
    counts = stored(a.unionByName(b).groupBy("scope", "gram").agg(F.count("*").alias("met")))
    n, size = F.col("n"), F.col("size")
    asked = _rare(a, counts).select("*", F.explode(F.sequence(_shortest(n), _longest(n))).alias("size")).withColumn("errors", _errors(n + size))
    first = F.greatest(F.lit(0), F.col("at") - F.floor((n - size + F.col("errors")) / 2).cast("int"))
    last = F.least(size - 2, F.col("at") - F.ceil((n - size - F.col("errors")) / 2).cast("int"))
    asked = asked.withColumns({"first": first, "last": last}).where("first <= last").select("scope", "form", "gram", "size", F.explode(F.sequence("first", "last")).alias("at"))
    return _met(asked, _rare(b, counts).withColumnRenamed("n", "size"), ["gram", "size", "at"])


def candidate_pairs(rows: DataFrame, cands: DataFrame, sole_first: DataFrame | None = None) -> DataFrame:
    """scope, a, b: pairs of forms (scope, form, words) of which no pair with a likeness above 0 is missing, but for those of the first word alone.

    sole_first: scope and word of the first words that only one candidate has, if that rule counts.
    """
    grams = F.when(F.length("form") >= LETTERS, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("form") - LETTERS + 1), lambda i: F.substring(F.col("form"), i, F.lit(LETTERS)))))
    ends = F.when(F.size("words") > 1, F.struct(F.get("words", F.lit(0)).alias("f"), F.element_at("words", -1).alias("l")))
    with_ends = [df.select("scope", "form", ends.alias("ends")).where("ends is not null") for df in (rows, cands)]
    pairs = [
        _met(rows.select("scope", "form", F.col("form").alias("key")), cands.select("scope", "form", F.col("form").alias("key")), ["key"]),
        _contained(rows, cands, F.array_distinct("words")),
        _contained(rows, cands, grams),
        _met(*with_ends, ["ends"]),
        _sequences(rows, cands),
    ]
    if sole_first is not None:
        firsts = [df.where(F.size("words") > 1).select("scope", "form", F.get("words", F.lit(0)).alias("word")) for df in (rows, cands)]
        pairs.append(_met(firsts[0], firsts[1].join(sole_first, ["scope", "word"], "left_semi"), ["word"]))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out.distinct()


def best_matches(rows: DataFrame, candidates: DataFrame, *, least: float, allow_first_name: bool = False) -> DataFrame:
    """id, candidate, score: the most alike candidate of a row's scope, if it scores `least` and no other comes within TIE of it.

    rows: id, scope, name; candidates: id, scope, name (an id may have several names).  A first name alone
    decides only where one candidate has it.  Rows without a name or without such a candidate are left out.
    """
    asked = stored(rows.select("id", "scope", name_form("name").alias("form")).where("form <> ''"))
    given = stored(candidates.select(F.col("id").alias("candidate"), "scope", name_form("name").alias("form")).where("form <> ''"))
    first = F.get(name_words(F.col("form")), F.lit(0))
    firsts = given.select("scope", "candidate", first.alias("word")).where("word is not null").groupBy("scope", "word").agg(F.countDistinct("candidate").alias("n")).where("n = 1").select("scope", "word")
    firsts = stored(firsts)
    pairs = candidate_pairs(_forms(asked), _forms(given), firsts if allow_first_name else None)
    scored = stored(pairs.withColumn("score", form_score(F.col("a"), F.col("b"), allow_first_name)).where(F.col("score") >= least))
    known = given.groupBy("scope", F.col("form").alias("b")).agg(F.min("candidate").alias("low"), F.max("candidate").alias("high"))
    top = scored.groupBy("scope", "a").agg(F.max("score").alias("best"))
    near = scored.join(top, ["scope", "a"]).where(F.col("score") >= F.col("best") - TIE).join(known, ["scope", "b"])
    sole = near.groupBy("scope", "a").agg(F.max("best").alias("score"), F.min("low").alias("candidate"), F.max("high").alias("high")).where("candidate = high")
    if allow_first_name:
        by_first = sole.withColumn("word", F.get(name_words(F.col("a")), F.lit(0))).join(firsts.withColumn("alone", F.lit(True)), ["scope", "word"], "left")
        sole = by_first.where((F.col("score") != FIRST_NAME) | F.col("alone"))
    return asked.join(sole.select("scope", F.col("a").alias("form"), "candidate", "score"), ["scope", "form"]).select("id", "candidate", "score")


def with_changes(fresh: DataFrame, existing: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`fresh` with `changed`: true for keys without a row so far and for rows that differ in a field, where two nulls are the same."""
    old = existing.select(F.col(key), F.lit(True).alias("__there"), *(F.col(f).alias(f"__{f}") for f in fields))
    same = F.col("__there").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return fresh.join(old, key, "left").select(*fresh.columns, (~same).alias("changed"))
