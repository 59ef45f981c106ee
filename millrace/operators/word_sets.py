"""The most alike sets of words: exact, by classes of equal sets.

Rows with the same words meet as one class, so copies cost nothing: a row whose class holds two others is tied, and one
other is its best.  Only classes of what is left open are held against the other classes, a block of the one against a
block of the other, as one product of two tables of words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import block_numbers, in_blocks
from .steps import stored

QUERY_SETS, POOL_SETS = 4000, 20_000


def _marks(sets: pd.Series, known: dict[str, int]) -> np.ndarray:
    """A row for each set and a column for each known word: 1 where the set has it."""
    out = np.zeros((len(sets), len(known)), dtype=np.float32)
    for i, words in enumerate(sets):
        out[i, [known[w] for w in words if w in known]] = 1.0
    return out


def two_best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
    """w, likeness, c, n: of each set of `q` the two most alike other sets of `p` that share a word with it; p: w, c, n."""
    found: list[pd.DataFrame] = []
    sizes = p["w"].map(len).to_numpy()
    for lo in range(0, len(q), 256):
        sets = q["w"].iloc[lo : lo + 256].reset_index(drop=True)
        own = sets.map(len).to_numpy()
        known = {w: i for i, w in enumerate(dict.fromkeys(w for words in sets for w in words))}
        asked = _marks(sets, known)
        for at in range(0, len(p), 2048):
            size = sizes[at : at + 2048]
            shared = (asked @ _marks(p["w"].iloc[at : at + 2048], known).T).astype(float)
            likeness = shared / (own[:, None] + size[None] - shared)
            likeness[(shared == 0) | (likeness == 1.0)] = -1.0
            for _ in range(2):
                to = likeness.argmax(axis=1)
                best = likeness[np.arange(len(own)), to]
                hit = np.flatnonzero(best >= 0)
                found.append(pd.DataFrame({"at": lo + hit, "likeness": best[hit], "c": p["c"].to_numpy()[at + to[hit]], "n": p["n"].to_numpy()[at + to[hit]]}))
                likeness[np.arange(len(own)), to] = -1.0
    if not found:
        return pd.DataFrame({"w": q["w"][:0], "likeness": np.zeros(0), "c": p["c"][:0], "n": p["n"][:0]})
    top = pd.concat(found).sort_values(["at", "likeness", "c"], ascending=[True, False, True]).groupby("at", sort=False).head(2)
    return pd.DataFrame({"w": q["w"].to_numpy()[top["at"]], "likeness": top["likeness"].to_numpy(), "c": top["c"].to_numpy(), "n": top["n"].to_numpy()})


def best(queries: DataFrame, candidates: DataFrame, key: str, words: str, *, least: float, tie: float) -> DataFrame:
    """k, c, likeness: the candidate other than the query itself with the largest share of common words (ties to the smaller key), if it has `least` and no other comes within `tie`.

    words: sorted distinct words of a row.  Rows without words meet nothing.
    """
    asked = stored(queries.select(F.col(key).alias("k"), F.col(words).alias("w")).where(F.size("w") > 0))
    given = candidates.select(F.col(key).alias("c"), F.col(words).alias("w")).where(F.size("w") > 0)
    classes = stored(given.groupBy("w").agg(F.min("c").alias("c"), F.max("c").alias("high"), F.countDistinct("c").alias("n")))
    inside = asked.join(given.select(F.col("c").alias("k")).distinct().withColumn("own", F.lit(1)), "k", "left").join(classes, "w", "left")
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("n").isNotNull(), F.coalesce("own", F.lit(0))).otherwise(0)
    # the one other row of the same words, and none of it where there are more, which tie
    left = stored(inside.withColumn("others", others).where("others < 2").select("k", "w", F.when(F.col("others") == 1, F.when(F.col("c") == F.col("k"), F.col("high")).otherwise(F.col("c"))).alias("same")))
    sets = stored(left.select("w").distinct())
    kind = dict(candidates.dtypes)[key]
    met = in_blocks(sets, classes.select("w", "c", "n"), lambda q, p: two_best(q, p), f"w array<string>, likeness double, c {kind}, n long", block_numbers(sets, classes, QUERY_SETS, POOL_SETS), ("w", "w"))
    # at most two sets a block; a set that several rows have counts as two rows of its likeness
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("likeness")).alias("d"), "c", "n")))
    near = met.groupBy("w").agg(ranked.alias("near"))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    following = F.when(first["n"] > 1, first["d"]).otherwise(second["d"])
    told = left.join(near, "w", "left").select(
        "k", F.coalesce("same", first["c"]).alias("c"), F.when(F.col("same").isNotNull(), 1.0).otherwise(-first["d"]).alias("likeness"), F.when(F.col("same").isNotNull(), -first["d"]).otherwise(-following).alias("next")
    )
    return told.where((F.col("likeness") >= least) & (F.col("next").isNull() | (F.col("likeness") - F.col("next") > tie))).select("k", "c", "likeness")
