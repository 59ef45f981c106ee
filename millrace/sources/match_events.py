"""Match documents to typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spatial import encode

NAMED = "struct<value:int,displayName:string>"
EVENT = f"struct<id:long,eventId:int,minute:int,second:int,expandedMinute:int,teamId:long,playerId:long,x:double,y:double,endX:double,endY:double,period:{NAMED},type:{NAMED},outcomeType:{NAMED},isTouch:boolean,qualifiers:array<struct<type:{NAMED},value:string>>>"
MATCH = f"matchId long, startDate string, home struct<teamId:long,name:string>, away struct<teamId:long,name:string>, playerIdNameDictionary map<string,string>, events array<{EVENT}>"


def has(qualifiers: Column, name: str) -> Column:
    return F.exists(F.coalesce(qualifiers, F.array().cast(f"array<struct<type:{NAMED},value:string>>")), lambda q: F.coalesce(q["type"]["displayName"] == name, F.lit(False)))


def typed_events(matches: DataFrame, flags: dict[str, str]) -> DataFrame:
    """One row for each event, numbered from 0 within its match by period, minute, second, event id and place.

    flags: column -> qualifier name.  Coordinates are scaled to 0..10000 and null where they are out of range.
    """
    rows = matches.select("matchId", F.posexplode("events").alias("place", "e"))
    order = Window.partitionBy("matchId").orderBy("e.period.value", F.coalesce("e.expandedMinute", "e.minute"), "e.second", F.coalesce("e.eventId", "place"), "place")
    return rows.select(
        F.col("matchId").alias("match_id"),
        (F.row_number().over(order) - 1).alias("event_index"),
        F.col("e.teamId").alias("team_id"),
        F.col("e.playerId").alias("player_id"),
        F.col("e.period.value").alias("period"),
        F.col("e.minute").alias("minute"),
        F.col("e.second").alias("second"),
        F.col("e.expandedMinute").alias("expanded_minute"),
        F.col("e.type.displayName").alias("event_type"),
        F.when(F.col("e.outcomeType.displayName") == "Successful", True).when(F.col("e.outcomeType").isNotNull(), False).alias("success"),
        *(encode(F.col(f"e.{a}")).alias(b) for a, b in (("x", "x"), ("y", "y"), ("endX", "end_x"), ("endY", "end_y"))),
        F.coalesce("e.isTouch", F.lit(False)).alias("is_touch"),
        *(has(F.col("e.qualifiers"), q).alias(c) for c, q in flags.items()),
    )
