"""Names, search folding, reading time and position words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

def _marked() -> tuple[str, str]:
    """Small letters below U+2000 that are one other letter with marks, by their canonical decompositions, and those letters, place by place."""
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")) for c in map(chr, range(0xC0, 0x2000)) if c == c.lower()}
    pairs = [(c, b) for c, b in bare.items() if len(b) == 1 and b != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _marked()
# Letters that no mark makes of others, and what they are looked for by; the last two are an addition.
LETTERS_ALONE = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "ł": "l", "đ": "d"}


def fold(text: Column) -> Column:
    """Lower case without marks, of any script, for search; stays in the JVM."""
    out = F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), MARKED, PLAIN)
    for a, b in LETTERS_ALONE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@pandas_udf(StringType())
def canonical_name(names: pd.Series) -> pd.Series:
    """HTML entities resolved, case folded, all combining marks gone, other signs as single blanks."""
    import html
    import re

    def one(name: str | None) -> str | None:
        if name is None:
            return None
        spread = unicodedata.normalize("NFKD", html.unescape(name).casefold())
        bare = "".join(c for c in spread if not unicodedata.combining(c))
        return " ".join(re.sub(r"[^0-9a-z]+", " ", bare).split())

    known = {x: one(x) for x in names.dropna().unique()}
    return names.map(known).astype(object).where(names.notna(), None)


def alnum_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^0-9a-z]+", "")


def name_tokens(name: Column, stop: list[str] | None = None) -> Column:
    tokens = F.filter(F.split(F.trim(F.regexp_replace(F.lower(name), "[^0-9a-z]+", " ")), " "), lambda x: F.length(x) > 0)
    return F.array_except(tokens, F.array(*(F.lit(s) for s in stop))) if stop else F.array_distinct(tokens)


def name_likeness(a: Column, b: Column) -> Column:
    """1 for equal names, then by shared words, then by edit distance; null if either is null."""
    ta, tb = name_tokens(a), name_tokens(b)
    shared, either = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
    fewer = F.least(F.size(ta), F.size(tb))
    ends = (F.element_at(F.concat(ta, F.array(F.lit(""))), 1) == F.element_at(F.concat(tb, F.array(F.lit(""))), 1)) & (F.element_at(F.concat(F.array(F.lit("")), ta), -1) == F.element_at(F.concat(F.array(F.lit("")), tb), -1))
    edit = 1.0 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when(F.lower(a) == F.lower(b), 1.0)
        .when(shared == either, 0.98)
        .when(ends, 0.95)
        .when((shared == fewer) & (fewer > 0), 0.9)
        .otherwise(F.greatest(shared / F.greatest(either, F.lit(1)) * 0.9, F.when(edit >= 0.82, edit).otherwise(0.0)))
    )


def reading_minutes(text: Column, words_a_minute: int = 220) -> Column:
    """At least 1."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.greatest(F.lit(1), F.ceil(words / F.lit(words_a_minute))).cast("int")


def first_known(*cells: Column) -> Column:
    """The first cell that is not blank, a dash or nan."""
    return F.coalesce(*(F.when(~F.lower(F.trim(c)).isin("", "—", "nan"), F.trim(c)) for c in cells))


def trailing_number(text: Column, otherwise: int = 999) -> Column:
    return F.coalesce(F.regexp_extract(text, "([0-9]+)$", 1).try_cast("int"), F.lit(otherwise))


def position_group(label: Column, rules: list[tuple[str, list[str]]], otherwise: str = "UNK") -> Column:
    """The first group, in the order of rules, one of whose words stands in the label."""
    words = F.split(F.upper(F.trim(label)), r"[^A-Z0-9]+")
    out = F.lit(otherwise)
    for group, names in reversed(rules):
        out = F.when(F.arrays_overlap(words, F.array(*(F.lit(n) for n in names))), group).otherwise(out)
    return out


# Words of native positions and the group they stand for, in the order in which groups are tried.
POSITION_WORDS = {
    "MID": ["AMC", "CAM", "CDM", "CM", "DM", "DMC", "LM", "MC", "MID", "MIDFIELD", "MIDFIELDER", "ML", "MR", "RM"],
    "DEF": ["BACK", "CB", "CENTERBACK", "CENTREBACK", "D", "DC", "DEF", "DEFENCE", "DEFENDER", "DL", "DR", "FULLBACK", "LB", "LWB", "RB", "RWB", "WB", "WINGBACK"],
    "FWD": ["AM", "AML", "AMR", "CF", "F", "FC", "FL", "FORWARD", "FR", "FW", "FWL", "FWR", "LW", "RW", "SS", "ST", "STRIKER", "WINGER"],
}


def position_of(raw: Column) -> Column:
    """GK, DEF, MID, FWD or UNK of a native position: by its words, else by how it begins or what stands in it."""
    p = F.upper(F.trim(raw))
    words = F.split(p, "[^A-Z]+")
    group = F.when((p == "G") | F.contains(p, F.lit("GOALKEEPER")) | F.array_contains(words, "GK"), "GK")
    for name, known in POSITION_WORDS.items():
        group = group.when(F.arrays_overlap(words, F.array(*map(F.lit, known))), name)
    group = group.when(F.startswith(p, F.lit("D")) | F.contains(p, F.lit("DEF")), "DEF").when(F.startswith(p, F.lit("F")), "FWD")
    return group.when(F.startswith(p, F.lit("M")) | F.contains(p, F.lit("MID")), "MID").otherwise("UNK")


# Native position words and the labels shown for them.
POSITION_LABELS = {
    "AM": "Attacking Midfield", "CENTRAL MIDFIELDER": "Central Midfield", "CENTRE-BACK": "Centre-Back", "CENTRE-FORWARD": "Centre-Forward", "CENTREBACK": "Centre-Back", "CENTREFORWARD": "Centre-Forward",
    "DC": "Centre-Back", "DEFENDER": "Defender", "DEFENSIVE MIDFIELDER": "Defensive Midfield", "DL": "Left-Back", "DM": "Defensive Midfield", "DR": "Right-Back", "F": "F", "FORWARD": "Forward",
    "FULL-BACK": "Full Back", "FULLBACK": "Full Back", "G": "Goalkeeper", "GK": "Goalkeeper", "GOALKEEPER": "Goalkeeper", "INSIDE FORWARD": "Inside Forward", "LW": "Left Winger", "MC": "Central Midfield",
    "MIDFIELDER": "Midfielder", "ML": "Left Midfield", "MR": "Right Midfield", "RIGHT WINGER": "Right Winger", "RW": "Right Winger", "ST": "Centre-Forward", "WINGER": "Winger",
}


def position_label(raw: Column) -> Column:
    """The label of a native position; one without a label stays, with its blanks and underscores squeezed."""
    squeezed = F.trim(F.regexp_replace(F.replace(raw, F.lit("_"), F.lit(" ")), r"\s+", " "))
    known = F.create_map(*(F.lit(x) for pair in POSITION_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.upper(squeezed)), squeezed)


def without_rate_mark(label: Column) -> Column:
    """A label without a closing /90."""
    return F.regexp_replace(label, r"\s*/\s*90$", "")


@pandas_udf(StringType())
def name_form(names: pd.Series) -> pd.Series:
    """The form in which names are compared: compatibility forms taken apart, marks gone, case folded, & as "and", letters and digits of any script, single blanks; null for null."""

    def one(name: str) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() else " " for c in bare.casefold().replace("&", " and ")).split())

    known = {x: one(x) for x in names.dropna().unique()}
    return names.map(known).astype(object).where(names.notna(), None)


# Words of club names that tell no two of them apart.
NAME_STOPS = ["ac", "afc", "as", "c", "calcio", "cd", "cf", "club", "de", "f", "fc", "football", "la", "le", "rcd", "sc", "ss", "sv", "the"]


def name_words(form: Column) -> Column:
    """The words of a name in its form that count."""
    return F.filter(F.split(form, " "), lambda w: (w != "") & ~w.isin(NAME_STOPS))


def form_steps(a: Column, b: Column, allow_first_name: bool = False) -> Column:
    """The likeness of two names in their forms by rules on their words; null where only their letters in sequence can tell, 0 for a name without any."""
    x, y = name_words(a), name_words(b)
    within = lambda p, q: F.size(F.array_except(p, q)) == 0
    many = (F.size(x) > 1) & (F.size(y) > 1) & (F.get(x, F.lit(0)) == F.get(y, F.lit(0)))
    inside = (F.length(a) >= 6) & (F.length(b) >= 6) & (F.contains(a, b) | F.contains(b, a))
    steps = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(inside, 0.9).when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
    steps = steps.when(within(x, y) & within(y, x), 0.98).when((F.size(x) >= 2) & within(x, y), 0.92).when((F.size(y) >= 2) & within(y, x), 0.9)
    if not allow_first_name:
        steps = steps.when(within(x, y) | within(y, x), 0.82)
    steps = steps.when(many & (F.element_at(x, -1) == F.element_at(y, -1)), 0.95)
    return steps.when(many, 0.72) if allow_first_name else steps


def name_steps(a: Column, b: Column, allow_first_name: bool = False) -> Column:
    """form_steps() of two names as they are written."""
    formed = [F.coalesce(name_form(c), F.lit("")) for c in (a, b)]
    return form_steps(*formed, allow_first_name)


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of letters in matching blocks, by difflib; below 0.82 it counts as 0."""
    from difflib import SequenceMatcher

    def one(x: str, y: str) -> float:
        matcher = SequenceMatcher(None, x, y)
        if matcher.real_quick_ratio() < 0.82 or matcher.quick_ratio() < 0.82:
            return 0.0
        ratio = matcher.ratio()
        return ratio if ratio >= 0.82 else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def form_score(a: Column, b: Column, allow_first_name: bool = False) -> Column:
    """Likeness of two names in their forms from 0 to 1, by words first; only what these leave open is compared letter by letter."""
    steps = form_steps(a, b, allow_first_name)
    # an empty pair costs the Python step nothing
    return F.coalesce(steps, sequence_ratio(F.when(steps.isNull(), a).otherwise(""), F.when(steps.isNull(), b).otherwise("-")))


def name_score(a: Column, b: Column, allow_first_name: bool = False) -> Column:
    """form_score() of two names as they are written."""
    return form_score(*(F.coalesce(name_form(c), F.lit("")) for c in (a, b)), allow_first_name)
