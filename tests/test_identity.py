"""Names against all pairs by a plain reading of the rules, and the ladder of identities rung by rung."""

import random
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import identity, names

STOPS = set(text.NAME_STOPS)


def form(name):
    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in bare.casefold().replace("&", " and ")).split())


def likeness(left, right, first_name):
    a, b = form(left), form(right)
    x, y = ([w for w in f.split() if w not in STOPS] for f in (a, b))
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 6 and (a in b or b in a):
        return 0.9
    if not x or not y:
        return 0.0
    rules = [(set(x) == set(y), 0.98), (len(x) > 1 and set(x) <= set(y), 0.92), (len(y) > 1 and set(y) <= set(x), 0.9), (not first_name and (set(x) <= set(y) or set(y) <= set(x)), 0.82)]
    many = x[0] == y[0] and len(x) > 1 and len(y) > 1
    rules += [(many and x[-1] == y[-1], 0.95), (many and first_name, 0.72)]
    ratio = SequenceMatcher(None, a, b).ratio()
    return next((score for holds, score in rules if holds), ratio if ratio >= 0.82 else 0.0)


def best_by_all_pairs(rows, cands, least, first_name):
    out = {}
    for i, scope, name in rows:
        scored = [(likeness(name, n, first_name), c, n) for c, s, n in cands if s == scope]
        scored = [x for x in scored if x[0]]
        best = max((x[0] for x in scored), default=0.0)
        tied = {c for s, c, _ in scored if s >= best - 0.03}
        if best < least or len(tied) != 1:
            continue
        words = [w for w in form(name).split() if w not in STOPS]
        same_first = {c for c, s, n in cands if s == scope and words and [w for w in form(n).split() if w not in STOPS][:1] == words[:1]}
        if best == 0.72 and len(same_first) != 1:
            continue
        out[i] = (tied.pop(), round(best, 9))
    return out


def test_forms_and_likeness_of_any_script(spark):
    pairs = [("José", "Jose", 1.0), ("Ćosić", "Cosic", 1.0), ("Мир", "Мир", 1.0), ("Straße", "STRASSE", 1.0), ("ﬁne", "fine", 1.0), ("R&D", "r and d", 1.0), ("FC Ajax", "Ajax AFC", 0.98), ("the club", "la", 0.0), ("Łódź", "Lodz", 0.75)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [r["s"] for r in df.orderBy("i").select(text.name_score(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.98, 0.0, 0.0]
    assert got == [likeness(a, b, False) for a, b, _ in pairs]


def test_best_matches_equal_all_pairs(spark):
    rng = random.Random(11)
    parts = ["ana", "bruno", "carlos", "dmitri", "élodie", "fc", "gomez", "hansen", "ivanović", "johansson", "de", "la", "marta", "united", "city", "santos", "o'neill", "мир", "van dijk"]

    def name():
        words = [rng.choice(parts) for _ in range(rng.randint(1, 3))]
        out = " ".join(words)
        for _ in range(rng.randint(0, 3)):  # misspelt
            at = rng.randrange(len(out) + 1)
            out = out[:at] + rng.choice(["", "x", "a", "e"]) + out[at + rng.randint(0, 1) :]
        return rng.choice([out, out.upper(), out.title()])

    rows = [(i, rng.choice("pq"), name()) for i in range(180)] + [(900, "p", None), (901, "p", ""), (902, "z", "ana")]
    cands = [(1000 + i // 2, rng.choice("pq"), name()) for i in range(160)] + [(5000, "p", None)]
    schema = "id long, scope string, name string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(cands, schema)
    for first_name, least in ((False, 0.68), (True, 0.72)):
        got = {r["id"]: (r["candidate"], round(r["score"], 9)) for r in names.best_matches(a, b, least=least, allow_first_name=first_name).collect()}
        want = best_by_all_pairs([r for r in rows if r[2]], [c for c in cands if c[2]], least, first_name)
        assert got == want and len(want) > 20


def test_common_words_do_not_meet_each_other(spark):
    """Many names with one common word on each side: what is common in them brings no pair together."""
    rng = random.Random(4)

    def made(n):
        return spark.createDataFrame([("s", "united " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(18))) for _ in range(n)], "scope string, form string").withColumn("words", text.name_words(F.col("form")))

    assert names.candidate_pairs(made(400), made(400)).count() < 400 * 400 / 6


def test_changes_count_nulls_as_equal(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "a"), (3, None, None)], "k int, f string, g string")
    new = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, None, "b"), (4, None, None)], "k int, f string, g string")
    assert {r["k"]: r["changed"] for r in names.with_changes(new, old, "k", ["f", "g"]).collect()} == {1: False, 2: True, 3: True, 4: True}


ROWS = "provider string, provider_id string, slice string, name string, teams array<string>, needs_team boolean"
MAPPED = "provider string, provider_id string, entity string, method string"


def tables(spark):
    others = [("A", "a1", "s", "Ana Sá", ["t1"], True), ("A", "a2", "s", "Bo Li", ["t1"], True), ("A", "a3", "s", "Bo Li", ["t2"], True), ("A", "a4", "s", "Cy", [], False), ("A", "a5", "s", "Di", [], False), ("A", "", "s", "No Id", [], False)]
    mapped = [("A", "a1", "e1", "auto"), ("A", "a2", "e2", "auto"), ("A", "a3", "e3", "manual"), ("A", "a4", "e4", "auto"), ("B", "b9", "x9", "auto")]
    canonical = [("e1", None), ("e2", None), ("e3", None), ("e4", "R4"), ("x9", None)]
    register = [("A", "a3", "R3", "Bo"), ("A", "a4", "R4", "Cyrus"), ("A", "a5", "R5", "Di")]
    return (
        spark.createDataFrame(others, ROWS),
        spark.createDataFrame(mapped, MAPPED),
        spark.createDataFrame(canonical, "entity string, register_id string"),
        spark.createDataFrame(register, "provider string, provider_id string, register_id string, name string"),
        spark.createDataFrame([], "slice string, entity string, team string"),
    )


def test_each_rung(spark):
    others, mapped, canonical, register, spells = tables(spark)
    names_of = register.join(canonical.where("register_id is not null"), "register_id").select("entity", "name")
    known = identity.evidence(others, mapped, names_of, spells)
    assert {(r["entity"], tuple(sorted(r["aliases"])), tuple(sorted(r["teams"]))) for r in known.collect()} == {("e1", ("ana sa",), ("t1",)), ("e2", ("bo li",), ("t1",)), ("e3", ("bo li",), ("t2",)), ("e4", ("cy", "cyrus"), ())}
    more = [("B", "b1", "s", "ANA SA", [], False), ("B", "b2", "s", "Bo Li", ["t2"], True), ("B", "b3", "s", "bo li", [], False), ("B", "b4", "s", "Bo Li", [], True), ("B", "b9", "s", "cyrus", [], False), ("W", "w1", "s", "Ana Sa", ["t1"], True), ("W", "w2", "s", "Bo Li", [], False), ("W", "w3", "s", None, [], False), ("B", None, "s", "Ana Sa", [], False)]
    got = {(r["provider"], r["provider_id"]): (r["entity"], r["rung"], r["ambiguous"]) for r in identity.resolve(others.unionByName(spark.createDataFrame(more, ROWS)), mapped, canonical, register, known, ["W"]).collect()}
    assert got == {
        ("A", "a1"): ("e1", "mapping", False),
        ("A", "a2"): ("e2", "mapping", False),
        ("A", "a3"): ("e3", "mapping", False),  # manual: the register does not move it
        ("A", "a4"): ("e4", "register", False),
        ("A", "a5"): ("r-R5", "register", False),
        ("A", ""): (None, "none", False),
        ("B", "b1"): ("e1", "candidate", False),
        ("B", "b2"): ("e3", "candidate", False),
        ("B", "b3"): ("n-B-b3", "native", True),
        ("B", "b4"): ("n-B-b4", "native", False),  # needs a team and has none
        ("B", "b9"): ("e4", "moved", False),  # by the register's name of e4
        ("W", "w1"): ("e1", "candidate", False),
        ("W", "w2"): (None, "quarantine", True),
        ("W", "w3"): (None, "quarantine", False),
        ("B", None): (None, "none", False),
    }


def test_retry_with_teams_of_events_until_nothing_moves(spark):
    others, mapped, canonical, register, spells = tables(spark)
    waiting = spark.createDataFrame([("W", "w2", "s", "Bo Li", [], False), ("W", "w4", "s", "Bo Li", [], False), ("W", "w5", "s", "Di", [], False), ("W", "w6", "s", "Nobody", [], False)], ROWS)
    events = spark.createDataFrame([("W", "w2", "s", "wt2", None), ("W", "w2", "s", "wt2", None), ("W", "w4", "s", "wt7", None)], "provider string, provider_id string, slice string, provider_team_id string, team string")
    teams = spark.createDataFrame([("W", "wt2", "t2")], "provider string, provider_team_id string, team string")
    state, maps, canon, runs = identity.settle(waiting, others, events, mapped, canonical, register, teams, spells, ["W"])
    # w5 waits a run for the entity that the register makes of a5; w4 has a team that nobody knows
    assert {r["provider_id"]: (r["entity"], r["rung"], r["run"]) for r in state.collect()} == {"w2": ("e3", "candidate", 1), "w4": (None, "quarantine", 0), "w5": ("r-R5", "candidate", 2), "w6": (None, "quarantine", 0)}
    assert runs == 3
    again, maps2, _, more = identity.settle(waiting, others, events, maps, canon, register, teams, spells, ["W"])
    assert more == 1 and sorted(map(tuple, maps2.collect())) == sorted(map(tuple, maps.collect()))
    assert {r["rung"] for r in again.collect()} == {"mapping", "quarantine"}
