"""Match documents with faults of every kind, canonical JSON against the standard library, and names of pass filters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import event_profiles
from millrace.sources import files, match_documents


def event(i, **changes):
    made = {"id": i, "eventId": i, "minute": i % 90, "second": i % 60, "teamId": "h" if i % 2 else "a", "playerId": 7, "x": 50.0, "y": 50, "type": {"value": 1, "displayName": "Pass"}, "period": {"value": 1}, "outcomeType": {"value": 1}, "qualifiers": []}
    made.update(changes)
    return {k: v for k, v in made.items() if v != "gone"}


def match(i, events, **changes):
    made = {"matchId": i, "home": {"teamId": "h"}, "away": {"teamId": "a"}, "events": events}
    made.update(changes)
    return json.dumps({k: v for k, v in made.items() if v != "gone"})


def test_every_fault_has_its_entry(spark):
    plain = [event(i) for i in range(100)]
    faults = {
        "missing_event_fields": event(5, teamId=None, minute=""),
        "invalid_event_clock": event(5, second=60),
        "identifier_too_long": event(5, playerId="p" * 65),
        "invalid_source_event_type_id": event(5, type={"value": 70000, "displayName": "Pass"}),
        "invalid_coordinate": event(5, blockedY=100.5),
    }
    docs = [match(f"m-{code}", [*plain[:5], bad, *plain[6:]]) for code, bad in faults.items()]
    docs += [match("few", plain[:99]), match("empty", "gone"), match("odd", {"a": 1}), match("teams", plain, home={}, away="gone"), match("fine", plain), match("bool", [event(1, x=True), *plain[1:]])]
    shots = [event(i, type={"value": 16, "displayName": "Goal"}, x=10 + i) for i in range(3)]
    docs += [match("turned", [*shots, *plain]), match("two", [*shots[:2], *plain])]
    unknown = [event(i, type={"value": 99, "displayName": "New"}) for i in range(6)]
    docs += [match("new5", [*unknown[:5], *plain]), match("new6", [*unknown, *plain]), match("q11", [event(i, qualifiers=[{"type": {"value": 1, "displayName": "Zap"}}] * 11) if i == 0 else e for i, e in enumerate(plain)])]
    events, ledger = match_documents.normalized(spark.createDataFrame([(d,) for d in docs], "document string"))
    got = {}
    for r in ledger.collect():
        got.setdefault(r["match_id"], []).append((r["level"], r["code"], r["event_index"], r["detail"], r["n"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        "m-missing_event_fields": [("error", "missing_event_fields", 5, "teamId,minute", 1)],
        "m-invalid_event_clock": [("error", "invalid_event_clock", 5, "5:60", 1)],
        "m-identifier_too_long": [("error", "identifier_too_long", 5, "playerId", 1)],
        "m-invalid_source_event_type_id": [("error", "invalid_source_event_type_id", 5, "70000", 1)],
        "m-invalid_coordinate": [("error", "invalid_coordinate", 5, "blockedY", 1)],
        "bool": [("error", "invalid_coordinate", 0, "x", 1)],
        "few": [("error", "implausibly_low_event_count", None, None, 99)],
        "empty": [("error", "missing_match_field", None, "events", 1)],
        "odd": [("error", "invalid_events", None, "events", 1)],
        "teams": sorted([("error", "missing_match_field", None, "away", 1), ("error", "missing_team_id", None, "away.teamId", 1), ("error", "missing_team_id", None, "home.teamId", 1)], key=str),
        "new5": sorted([("note", "unknown_event_type", None, "99:New", 5), ("warning", "unknown_event_types", None, None, 5)], key=str),
        "new6": sorted([("note", "unknown_event_type", None, "99:New", 6), ("error", "unknown_event_tolerance_exceeded", None, None, 6)], key=str),
        "q11": sorted([("note", "unknown_qualifier", None, "1:Zap", 11), ("error", "unknown_qualifier_tolerance_exceeded", None, None, 11)], key=str),
    }
    # two teams share three shots, so neither has three
    assert {r["match_id"] for r in events.select("match_id").distinct().collect()} == {"fine", "two", "turned", "new5"}


def test_a_team_that_shoots_the_wrong_way(spark):
    plain = [event(i) for i in range(100)]
    shots = [event(i, teamId="h", type={"value": 16, "displayName": "Goal"}, x=x) for i, x in enumerate([10, 49.99, 90])]
    ledger = match_documents.normalized(spark.createDataFrame([(match("m", [*shots, *plain]),)], "document string"))[1]
    assert [(r["code"], r["detail"], r["n"]) for r in ledger.collect()] == [("shot_orientation_failed", "h", 3)]


def test_order_flags_and_coordinates(spark):
    events = [event(i) for i in range(100)]
    events[3] = event(3, minute=0, second=0, expandedMinute=0, eventId="gone", x=12.345, goalMouthZ="99.995", isKeyPass=True, qualifiers=[{"type": {"displayName": "Cross"}}, {"type": {"displayName": "Head"}}, {"type": None}])
    got = match_documents.normalized(spark.createDataFrame([(match("m", events),)], "document string"))[0]
    r = got.where("event_id = '3'").first()
    assert (r["event_index"], r["x"], r["goal_mouth_z"], r["key_pass"], r["cross"], r["long_ball"], r["body_part"]) == (1, 1235, 10000, True, True, False, "head")
    assert sorted(x["event_index"] for x in got.collect()) == list(range(100))


def test_canonical_json_is_that_of_the_standard_library(spark):
    rng = random.Random(1)

    def made(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return {rng.choice("abcäß") * rng.randint(1, 3): made(depth - 1) for _ in range(rng.randrange(5))}
        return [rng.randint(-9, 9), rng.random() * 1e12, rng.choice([None, True, False]), rng.choice(["", "é\n\"x", "日本"])][kind]

    docs = [made(4) for _ in range(200)]
    df = spark.createDataFrame([(i, json.dumps(x, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for i, x in enumerate(docs)] + [(900, "{no"), (901, None), (902, '{"a": NaN}')], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", files.canonical_json("t").alias("c")).collect()}
    assert got == {i: json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for i, x in enumerate(docs)} | {900: None, 901: None, 902: None}


def test_the_order_of_fields_and_entries_does_not_change_a_key(spark):
    a = spark.sql("select 1 as id, named_struct('p', 1, 'q', map('x', array(), 'y', array(named_struct('b', 1, 'a', 2)))) as v, 2 as w")
    b = spark.sql("select 2 as w, named_struct('q', map('y', array(named_struct('a', 2, 'b', 1)), 'x', array()), 'p', 1) as v, 1 as id")
    c = spark.sql("select 2 as w, named_struct('q', map('y', array(named_struct('a', 1, 'b', 2)), 'x', array()), 'p', 1) as v, 1 as id")
    keys = [df.select(files.content_key(df, "v", "w").alias("k")).first()["k"] for df in (a, b, c)]
    assert keys[0] == keys[1] != keys[2]


def test_pass_filters_by_any_name():
    for name in ("completed", " ALL ", None, "crosses", "final-third-entry"):
        event_profiles.pass_filter(name)
    with pytest.raises(ValueError):
        event_profiles.pass_filter("sideways")


def test_documents_lie_in_files_of_bounded_size(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    files.write_documents(spark.range(1000).coalesce(1).select("id", F.lit("x").alias("t")), path, rows_a_file=300)
    assert len([p for p in (tmp_path / "docs").iterdir() if p.suffix == ".json"]) == 4
    assert files.read_documents(spark, path, "id long, t string").count() == 1000
