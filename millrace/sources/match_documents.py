"""Full match documents: typed events, and a ledger of what is wrong with them, which gates a match.

Cells are read as text, so that a bad one is an entry of the ledger and not a lost document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import event_classes as ec
from ..operators import spatial
from ..operators.steps import stored
from .files import whole_number

NAMED = "struct<value:string,displayName:string>"
PLACES = {"x": "x", "y": "y", "endX": "end_x", "endY": "end_y", "goalMouthY": "goal_mouth_y", "goalMouthZ": "goal_mouth_z", "blockedX": "blocked_x", "blockedY": "blocked_y"}
STATED = ["isTouch", *ec.STATED.values()]
_CELLS = ["id", "eventId", "minute", "second", "expandedMinute", "teamId", "playerId", *PLACES, *STATED]
EVENT = f"struct<{','.join(f'{c}:string' for c in _CELLS)},period:{NAMED},type:{NAMED},outcomeType:{NAMED},qualifiers:array<struct<type:{NAMED}>>>"
MATCH = f"matchId string, home struct<teamId:string,name:string>, away struct<teamId:string,name:string>, playerIdNameDictionary map<string,string>, events array<{EVENT}>"
# Qualifiers that documents use and that no column is made of.
OTHER_QUALIFIERS = [
    "Angle", "Assisted", "BlockedX", "BlockedY", "BoxCentre", "BoxLeft", "BoxRight", "Diving", "GoalMouthY", "GoalMouthZ", "High", "LeadingToAttempt", "LeadingToGoal", "Length", "Low", "NoTouch", "Normal",
    "OppositeRelatedEvent", "OutOfBox", "PassEndX", "PassEndY", "PenaltyArea", "PlayerPosition", "PullBack", "RelatedEventId", "SixYardBox", "Standing", "Zone",
]
QUALIFIERS = sorted({n for names in [*ec.BODY.values(), *ec.SITUATIONS.values(), *ec.FLAGS.values()] for n in names} | {"Blocked", *OTHER_QUALIFIERS})
TYPES = sorted(n for names in ec.KINDS.values() for n in names)
LEAST_EVENTS, MOST_TYPES, MOST_QUALIFIERS, LEAST_SHOTS, LEAST_MEDIAN = 100, 5, 10, 3, 50.0
LEDGER = "match_id string, level string, code string, event_index int, detail string, n long"


def _blank(cell: Column) -> Column:
    return F.coalesce(cell, F.lit("")) == ""


def _bad_place(cell: Column) -> Column:
    number = cell.try_cast("decimal(38,10)")
    return cell.isNotNull() & F.coalesce(~number.between(0, 100), F.lit(True))


def _digits(cell: Column) -> Column:
    """A whole number without a sign; null for anything else."""
    return F.when(cell.rlike("^[0-9]+(\\.0+)?$"), cell.try_cast("decimal(38,4)").try_cast("long"))


def parsed(documents: DataFrame) -> DataFrame:
    """Rows of a column `document` (JSON text) with `m`, and what is wrong with their structure as `faults`."""
    rows = documents.withColumn("m", F.from_json("document", MATCH))
    field = lambda name: F.get_json_object("document", f"$.{name}")
    missing = F.transform(F.filter(F.array(*(F.when(field(f).isNull(), F.lit(f)) for f in ("matchId", "home", "away", "events"))), lambda x: x.isNotNull()), lambda x: F.struct(F.lit("missing_match_field").alias("code"), x.alias("detail")))
    one = lambda holds, code, detail: F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail")))
    more = F.array(
        *(one(_blank(F.col(f"m.{side}.teamId")), "missing_team_id", f"{side}.teamId") for side in ("home", "away")),
        one(field("events").isNotNull() & ~F.startswith(field("events"), F.lit("[")), "invalid_events", "events"),
    )
    return rows.withColumn("faults", F.concat(missing, F.filter(more, lambda x: x.isNotNull())))


def _placed(rows: DataFrame) -> DataFrame:
    """Every event with its number in the document (source_index) and by period, minute, second and event id (event_index)."""
    events = rows.select(F.coalesce("m.matchId", F.lit("?")).alias("match_id"), F.posexplode("m.events").alias("source_index", "e")).where("e is not null")
    number = lambda c: F.coalesce(whole_number(F.col(c)), F.lit(0))
    order = Window.partitionBy("match_id").orderBy(number("e.period.value"), F.coalesce(whole_number(F.col("e.expandedMinute")), number("e.minute")), number("e.second"), F.coalesce(whole_number(F.col("e.eventId")), "source_index"), "source_index")  # a match's events
    return events.withColumn("event_index", F.row_number().over(order) - 1)


def _fault(e: Column) -> Column:
    """code and detail of the first thing that is wrong with an event; null for a good one."""
    needed = {"teamId": _blank(e["teamId"]), "type": e["type"].isNull(), "period": e["period"].isNull(), "minute": _blank(e["minute"]), "second": _blank(e["second"])}
    missing = F.array_join(F.filter(F.array(*(F.when(gone, F.lit(f)) for f, gone in needed.items())), lambda x: x.isNotNull()), ",")
    minute, second, expanded, type_id = _digits(e["minute"]), _digits(e["second"]), whole_number(e["expandedMinute"]), whole_number(e["type"]["value"])
    clock = minute.isNull() | (minute > 65535) | second.isNull() | (second > 59) | F.coalesce(~expanded.between(0, 65535), F.lit(False))
    long = F.array_join(F.filter(F.array(*(F.when(F.length(e[f]) > 64, F.lit(f)) for f in ("id", "teamId", "playerId"))), lambda x: x.isNotNull()), ",")
    place = F.coalesce(*(F.when(_bad_place(e[f]), F.lit(f)) for f in PLACES))
    said = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    return (
        F.when(missing != "", said("missing_event_fields", missing))
        .when(clock, said("invalid_event_clock", F.concat_ws(":", e["minute"], e["second"])))
        .when(long != "", said("identifier_too_long", long))
        .when(F.coalesce(~type_id.between(0, 65535), F.lit(False)), said("invalid_source_event_type_id", e["type"]["value"]))
        .when(place.isNotNull(), said("invalid_coordinate", place))
    )


def _typed(rows: DataFrame) -> DataFrame:
    """Events in their columns: ids, clock, kind, outcome, eight coordinates, flags, and what a pass does."""
    e = F.col("e")
    names = F.transform(F.coalesce(e["qualifiers"], F.array().cast(f"array<struct<type:{NAMED}>>")), lambda q: q["type"]["displayName"])
    said = lambda c: F.coalesce(F.lower(e[c]) == "true", F.lit(False))
    typed = rows.withColumns(
        {
            "event_id": e["id"], "team_id": e["teamId"], "player_id": e["playerId"], "minute": _digits(e["minute"]), "second": _digits(e["second"]), "expanded_minute": whole_number(e["expandedMinute"]),
            "source_type": whole_number(e["type"]["value"]), "kind": ec.kind(e["type"]["displayName"]), "period": ec.period(whole_number(e["period"]["value"]), e["period"]["displayName"]),
            "success": ec.success(whole_number(e["outcomeType"]["value"]), e["outcomeType"]["displayName"]), "is_touch": said("isTouch"), "body_part": ec.body_part(names), "situation": ec.situation(names),
            "shot_outcome": ec.shot_outcome(e["type"]["displayName"], names), **{c: spatial.encode(e[f]) for f, c in PLACES.items()},
            **{f: flag | said(ec.STATED[f]) if f in ec.STATED else flag for f, flag in ec.flags(names).items()},
        }
    )
    x, y, ex, ey = (F.col(c) for c in ("x", "y", "end_x", "end_y"))
    passed = F.col("kind") == "pass"
    yes = lambda c: F.coalesce(passed & c, F.lit(False))
    typed = typed.withColumns({"match_seconds": F.col("minute") * 60 + F.col("second"), "progressive": yes(spatial.progressive(x, y, ex, ey)), "final_third": yes(spatial.enters_final_third(x, ex, F.col("success"))), "box_entry": yes(spatial.enters_box(x, y, ex, ey, F.col("success")))})
    return typed.drop("e", "fault", "source_index")


def normalized(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of the matches without errors, ledger: match_id, level, code, event_index, detail, n).

    An event with an error is no event; a match with one gives none.  Names of types and qualifiers outside the known
    ones are counted by name as notes; more than MOST_TYPES or MOST_QUALIFIERS of them in a match are an error, fewer a
    warning.  A match of fewer than LEAST_EVENTS, or a team whose LEAST_SHOTS or more shots have a median x below
    LEAST_MEDIAN, is an error too.  event_index of the ledger is the place in the document.
    """
    rows = stored(parsed(documents))
    match_id = F.coalesce("m.matchId", F.lit("?")).alias("match_id")
    number, text = F.lit(None).cast("int").alias("event_index"), F.lit(None).cast("string").alias("detail")
    one = F.lit(1).cast("long").alias("n")
    level = lambda x: F.lit(x).alias("level")
    placed = stored(_placed(rows).withColumn("fault", _fault(F.col("e"))))
    good = placed.where("fault is null")
    type_name = F.concat_ws(":", F.coalesce(whole_number(F.col("e.type.value")).cast("string"), F.lit("?")), F.coalesce(F.nullif(F.col("e.type.displayName"), F.lit("")), F.lit("?")))
    types = placed.where(~F.coalesce(F.col("e.type.displayName"), F.lit("")).isin(TYPES)).groupBy("match_id", type_name.alias("detail")).agg(F.count("*").alias("n"))
    named = good.select("match_id", F.explode("e.qualifiers").alias("q"))
    qualifier_name = F.concat_ws(":", F.coalesce(whole_number(F.col("q.type.value")).cast("string"), F.lit("?")), F.coalesce(F.nullif(F.col("q.type.displayName"), F.lit("")), F.lit("?")))
    qualifiers = named.where(~F.coalesce(F.col("q.type.displayName"), F.lit("")).isin(QUALIFIERS)).groupBy("match_id", qualifier_name.alias("detail")).agg(F.count("*").alias("n"))

    def tolerated(counts: DataFrame, most: int, code: str, over: str) -> DataFrame:
        total = counts.groupBy("match_id").agg(F.sum("n").alias("n"))
        return total.select("match_id", F.when(F.col("n") > most, "error").otherwise("warning").alias("level"), F.when(F.col("n") > most, over).otherwise(code).alias("code"), number, text, "n")

    typed = _typed(good)
    shots = typed.where("kind = 'shot' and x is not null").groupBy("match_id", "team_id").agg(F.count("*").alias("n"), (F.percentile("x", F.lit(0.5)) / 100).alias("middle"))
    parts = [
        rows.select(match_id, level("error"), F.explode("faults").alias("f")).select("match_id", "level", "f.code", number, "f.detail", one),
        rows.where("m.events is not null").select(match_id, F.size("m.events").cast("long").alias("n")).where(F.col("n") < LEAST_EVENTS).select("match_id", level("error"), F.lit("implausibly_low_event_count").alias("code"), number, text, "n"),
        placed.where("fault is not null").select("match_id", level("error"), "fault.code", F.col("source_index").alias("event_index"), "fault.detail", one),
        types.select("match_id", level("note"), F.lit("unknown_event_type").alias("code"), number, "detail", "n"),
        qualifiers.select("match_id", level("note"), F.lit("unknown_qualifier").alias("code"), number, "detail", "n"),
        tolerated(types, MOST_TYPES, "unknown_event_types", "unknown_event_tolerance_exceeded"),
        tolerated(qualifiers, MOST_QUALIFIERS, "unknown_qualifiers", "unknown_qualifier_tolerance_exceeded"),
        shots.where((F.col("n") >= LEAST_SHOTS) & (F.col("middle") < LEAST_MEDIAN)).select("match_id", level("error"), F.lit("shot_orientation_failed").alias("code"), number, F.col("team_id").alias("detail"), "n"),
    ]
    ledger = parts[0]
    for p in parts[1:]:
        ledger = ledger.unionByName(p)
    ledger = stored(ledger)
    bad = ledger.where("level = 'error'").select("match_id").distinct()
    return typed.join(bad, "match_id", "left_anti"), ledger


def references(matches: DataFrame) -> DataFrame:
    """match_ref (from 0, by kick-off with unknown ones last, then id) and the columns of the matches that a request shows."""
    order = Window.orderBy(F.col("kickoff").asc_nulls_last(), "match_id")  # the matches of one request
    return matches.withColumn("match_ref", (F.row_number().over(order) - 1).cast("int"))


def compact(events: DataFrame, matches: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """Shots or passes of normalized() as a request shows them: the match as its reference, labels for codes, and the player's name.

    matches: references(); names: player_id, player_name.
    """
    words = {"shot": ["shot_outcome", "body_part", "situation"], "pass": []}[kind]
    own = {"shot": ["x", "y", "big_chance", "shot_assist", "goal_mouth_y", "goal_mouth_z", "blocked_x", "blocked_y"], "pass": ["x", "y", "end_x", "end_y", "success", "progressive", "final_third", "box_entry", "key_pass", "cross", "long_ball"]}[kind]
    label = lambda c: F.initcap(F.replace(F.col(c), F.lit("_"), F.lit(" "))).alias(c)
    rows = events.where(F.col("kind") == kind).join(matches.select("match_id", "match_ref"), "match_id").join(names, "player_id", "left")
    return rows.select("match_ref", "event_index", "match_seconds", *own, *map(label, words), "player_id", "player_name")
