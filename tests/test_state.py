"""Published slices, incremental profiles and plans: crashes between steps, batches that come twice, and a plain simulation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import eligibility, sink
from millrace.streaming import incremental, planner

SCHEMA = "slice string, id long, v long"


def held(spark, root):
    return sorted(map(tuple, sink.current(spark, root, "slice", SCHEMA).collect()))


def test_a_failed_gate_and_a_crash_keep_the_old_rows(spark, tmp_path):
    root = f"file://{tmp_path}/published"
    assert held(spark, root) == []
    first = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 30)], SCHEMA)
    rules = {"measures": {"n": F.count("*")}, "checks": {"few": F.col("n") >= 2}}
    report = {r["slice"]: (r["passed"], r["failed"]) for r in sink.publish(first, root, "one", "slice", measures=rules["measures"], checks={"any": F.col("n") > 0}).collect()}
    assert report == {"a": (True, []), "b": (True, [])}
    second = spark.createDataFrame([("a", 1, 11), ("a", 4, 41), ("b", 3, 33)], SCHEMA)
    report = {r["slice"]: r["failed"] for r in sink.publish(second, root, "two", "slice", **rules).collect()}
    assert report == {"a": [], "b": ["few"]}
    after_two = [("a", 1, 11), ("a", 4, 41), ("b", 3, 30)]
    assert held(spark, root) == after_two
    # a run that dies behind its rows and before its marker is not seen
    third = spark.createDataFrame([("a", 9, 9), ("a", 8, 8), ("b", 9, 9), ("b", 8, 8)], SCHEMA)
    sink.stage(third, root, "three", "slice")
    assert held(spark, root) == after_two
    # one that dies while it makes rows leaves none either
    broken = third.withColumn("v", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        sink.publish(broken, root, "three", "slice", **rules)
    assert held(spark, root) == after_two
    for _ in range(2):  # done again, and once more, it is there once
        sink.publish(third, root, "three", "slice", **rules)
        assert held(spark, root) == [("a", 8, 8), ("a", 9, 9), ("b", 8, 8), ("b", 9, 9)]
    # an earlier run done again does not go ahead of a later one
    sink.publish(second, root, "two", "slice", **rules)
    assert held(spark, root) == [("a", 8, 8), ("a", 9, 9), ("b", 8, 8), ("b", 9, 9)]
    assert sorted(map(tuple, sink.current(spark, root, "slice", SCHEMA, without="three").collect())) == after_two


def test_restricted_slices_hold_allowed_ids_only(spark, tmp_path):
    rows = spark.createDataFrame([("cup", 1, 1), ("cup", 2, 2), ("league", 3, 3), (None, 4, 4)], SCHEMA)
    allowed = spark.createDataFrame([("cup", 2)], "slice string, id long")
    sink.publish(rows, f"file://{tmp_path}", "r", "slice", measures={"n": F.count("*")}, checks={"any": F.col("n") > 0}, allowed=allowed, restricted=F.col("slice") == "cup")
    assert held(spark, f"file://{tmp_path}") == [("cup", 2, 2), ("league", 3, 3)]


PROFILE = "who long, n long, total long"


def profile(events):
    return events.groupBy("who").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def test_profiles_equal_a_full_rebuild_after_every_batch_and_after_replays(spark, tmp_path):
    rng = random.Random(2)
    folder = f"file://{tmp_path}/inc"
    seen = spark.createDataFrame([], "who long, v long")
    for batch_id in range(4):
        rows = [(rng.choice([None, *range(9)]), rng.randint(0, 5)) for _ in range(12 if batch_id != 2 else 0)]
        batch = spark.createDataFrame(rows, "who long, v long")
        for _ in range(2):  # a batch that comes again changes nothing
            incremental.apply(batch, batch_id, folder, "who", profile, PROFILE, buckets=4)
        seen = seen.unionByName(batch.where("who is not null"))
        assert incremental.differences(incremental.profiles(spark, folder, PROFILE), profile(seen)).count() == 0


def test_only_touched_buckets_are_published(spark, tmp_path):
    folder = f"file://{tmp_path}/inc"
    for batch_id, who in enumerate(([1, 2, 3, 4, 5, 6, 7, 8], [3])):
        incremental.apply(spark.createDataFrame([(w, 1) for w in who], "who long, v long"), batch_id, folder, "who", profile, PROFILE, buckets=8)
    runs = {r["run"]: r["n"] for r in sink.manifest(spark, f"{folder}/profiles").groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert runs[f"{1:012d}"] == 1 < runs[f"{0:012d}"]


def simulate(items, ticks, slots, cap, lease, most):
    """The plan item by item: items are (item, order, eta), ticks are (now, [(item, attempt, ok, cost)])."""
    state = {i: {"order": o, "eta": e, "status": "pending", "attempts": 0, "until": None, "cost": 0} for i, o, e in items}
    for now, told in ticks:
        for i, attempt, ok, cost in told:
            s = state[i]
            s["cost"] += cost
            s.setdefault("said", {})[attempt] = ok
        for s in state.values():
            if s["status"] == "claimed":
                ok = s.get("said", {}).get(s["attempts"])
                if ok:
                    s["status"] = "success"
                elif ok is False or s["until"] < now:
                    s["status"] = "failed" if s["attempts"] >= most else "pending"
            s["said"] = {}
        if cap and sum(s["cost"] for s in state.values()) >= cap:
            for s in state.values():
                s["status"] = "skipped" if s["status"] == "pending" else s["status"]
        free = slots - sum(s["status"] == "claimed" for s in state.values())
        for i in sorted((i for i, s in state.items() if s["status"] == "pending" and s["eta"] <= now), key=lambda i: state[i]["order"])[: max(free, 0)]:
            state[i].update(status="claimed", attempts=state[i]["attempts"] + 1, until=now + dt.timedelta(seconds=lease))
    return {i: (s["status"], s["attempts"], s["cost"]) for i, s in state.items()}


@pytest.mark.parametrize("cap", [0, 9])
def test_ticks_equal_a_simulation(spark, cap):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    given = spark.createDataFrame([(f"i{k}", k) for k in range(1, 9)], "item string, planned_order int")
    first = planner.planned(given, "p", "2024-01-01 00:00:00", 60, 600)
    items = [(r["item"], r["planned_order"], r["eta"]) for r in first.collect()]
    assert all(60 <= (b[2] - a[2]).total_seconds() <= 600 for a, b in zip(sorted(items, key=lambda x: x[1]), sorted(items, key=lambda x: x[1])[1:], strict=False))
    ticks, state = [], first
    limits = {"slots": 3, "cap": cap, "lease_seconds": 900, "most_attempts": 2}
    for t in range(1, 9):
        now = start + dt.timedelta(minutes=15 * t)
        told = [(f"i{rng.randint(1, 8)}", rng.randint(1, 2), rng.random() < 0.6, 1) for _ in range(4)]
        told = list({(i, a): (i, a, ok, c) for i, a, ok, c in told}.values())
        ticks.append((now, told))
        reports = spark.createDataFrame([(now, *r) for r in told], planner.REPORTS)
        state = spark.createDataFrame(planner.tick(state, reports, **limits).collect(), planner.STATE)
    got = {r["item"]: (r["status"], r["attempts"], r["cost"]) for r in state.collect()}
    assert got == simulate(items, ticks, 3, cap, 900, 2)
    v = planner.verdict(state).first()
    assert v["items"] == 8 and v["success"] == sum(s == "success" for s, _, _ in got.values())


def test_verdicts(spark):
    rows = [("a", "success"), ("a", "success"), ("b", "success"), ("b", "failed"), ("c", "failed"), ("c", "skipped"), ("d", "skipped"), ("e", "success"), ("e", "claimed")]
    got = {r["plan"]: r["verdict"] for r in planner.verdict(spark.createDataFrame(rows, "plan string, status string")).collect()}
    assert got == {"a": "success", "b": "partial_success", "c": "failed", "d": "skipped", "e": "open"}


def test_a_plan_begun_twice_and_an_empty_tick_change_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/plan"
    first = planner.planned(spark.createDataFrame([("x", 1)], "item string, planned_order int"), "p", "2024-01-01 00:00:00")
    planner.begin(first, folder)
    planner.begin(first.withColumn("status", F.lit("failed")), folder)
    state = planner.state_of(spark, folder)
    assert [r["status"] for r in state.collect()] == ["pending"]
    nothing = planner.tick(state, spark.createDataFrame([], planner.REPORTS), slots=1, cap=1, lease_seconds=1, most_attempts=1)
    assert sorted(map(tuple, nothing.collect())) == sorted(map(tuple, state.collect()))


def test_both_rounds_of_eligibility(spark):
    rows = [("big", f"b{i}", ["DEF", "MID", "FWD"][i % 3 if i < 12 else 2], 1000, True, 1.0, 1.0) for i in range(13)]
    rows += [("thin", f"t{i}", "DEF", 1000, i < 9, 1.0, 1.0) for i in range(10)] + [("small", "s1", "DEF", 1000, True, 1.0, 1.0), ("small", "s2", "DEF", 10, True, 1.0, 1.0), ("big", "g", "GK", 1000, True, 1.0, 1.0), ("big", "n", None, None, None, None, None)]
    rows += [("gaps", f"g{i}", "MID" if i < 8 else "FWD" if i < 10 else "DEF", 1000, True, 1.0 if i % 2 else None, 1.0) for i in range(13)]
    df = spark.createDataFrame(rows, "slice string, entity string, family string, minutes int, has_source boolean, f double, g double")
    least = spark.createDataFrame([(s, 900) for s in ("big", "thin", "small", "gaps")], "slice string, least int")
    kept, ledger = eligibility.eligible(df, least, ["f", "g"], ["f"], ["g"])
    assert sorted(r["slice"] for r in kept.collect()) == ["big"] * 13
    got = sorted(((r["round"], r["slice"], r["family"], r["entity"], r["reason"], r["n"]) for r in ledger.collect()), key=str)
    assert got == sorted(
        [
            (1, "small", None, None, "insufficient_eligible_players", 1), (2, "thin", "DEF", "t9", "missing_source", None), (2, "thin", None, None, "insufficient_eligible_players_after_source_gate", 9),
            (2, "gaps", "FWD", None, "insufficient_position_family_players", 2), (2, "gaps", "MID", None, "low_broad_profile_coverage", None), (2, "gaps", "DEF", None, "low_broad_profile_coverage", None),
        ],
        key=str,
    )
