"""Kinds, periods, outcomes and flags of match events from their provider names and qualifiers, in order of precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that documents use, and the kinds they stand for.
SHOTS = ["Goal", "MissedShots", "SavedShot", "ShotOnPost"]
SAVES = ["KeeperPickup", "Save", "Claim", "Smother", "Punch", "KeeperSweeper", "CrossNotClaimed", "PenaltyFaced"]
OFFSIDES = ["OffsideGiven", "OffsideProvoked", "CaughtOffside", "OffsidePass"]
SUBSTITUTIONS = ["SubstitutionOff", "SubstitutionOn"]
ADMINISTRATIVE = [
    "Start", "End", "Out", "CornerAwarded", "Turnover", "PlayerRetired", "PlayerReturns", "KeeperBecomesPlayer", "PlayerBecomesGoalkeeper", "ConditionChange", "OfficialChange",
    "StartDelay", "EndDelay", "TeamSetUp", "FormationSet", "FormationChange", "PlayerOff", "PlayerOn", "PlayerChangedPosition", "PlayerChangedJerseyNumber", "DeletedEvent",
    "FormationPosition", "Error", "ChanceMissed", "Resume", "ContentiousRefereeDecision", "RefereeDropBall", "InjuryTimeAnnouncement", "CoachSetup", "DelayedStart", "EarlyEnd", "CoverageInterruption",
]
NAMED = {
    "pass": ["Pass"],
    "ball_touch": ["BallTouch", "OtherBallContact"],
    "take_on": ["TakeOn", "GoodSkill"],
    "ball_recovery": ["BallRecovery"],
    "tackle": ["Tackle", "AttemptedTackle"],
    "interception": ["Interception"],
    "clearance": ["Clearance"],
    "blocked_pass": ["BlockedPass"],
    "aerial": ["Aerial"],
    "challenge": ["Challenge", "FiftyFifty", "FailedToBlock", "MissedChallenge"],
    "dispossessed": ["Dispossessed", "ShieldBallOpp", "ShieldBallOutOfPlay"],
    "foul": ["Foul", "FoulThrowIn"],
    "card": ["Card", "RescindedCard"],
}
KINDS = {"shot": SHOTS, "save": SAVES, "offside": OFFSIDES, "substitution": SUBSTITUTIONS, "administrative": ADMINISTRATIVE} | NAMED
DEFENSIVE = ["ball_recovery", "tackle", "interception", "clearance", "blocked_pass"]
ACTIONS = ["pass", "ball_touch", "take_on", "shot", *DEFENSIVE, "dispossessed"]
CONTESTS = ["aerial", "challenge"]
PERIODS = {"FirstHalf": 1, "SecondHalf": 2, "FirstPeriodOfExtraTime": 3, "SecondPeriodOfExtraTime": 4, "PenaltyShootout": 5, "PostGame": 14}
#: what a part of the body, a situation and a flag are told by: the first that a qualifier names
BODY = {"right_foot": ["RightFoot"], "left_foot": ["LeftFoot"], "head": ["Head"], "other": ["OtherBodyPart"]}
SITUATIONS = {"penalty": ["Penalty"], "direct_free_kick": ["DirectFreekick"], "corner": ["FromCorner", "CornerTaken"], "fast_break": ["FastBreak"], "set_piece": ["SetPiece", "FreekickTaken"], "open_play": ["RegularPlay", "OpenPlay"]}
FLAGS = {
    "key_pass": ["KeyPass"], "shot_assist": ["ShotAssist"], "intentional_assist": ["IntentionalGoalAssist", "IntentionalAssist"], "cross": ["Cross"], "long_ball": ["Longball"], "chipped": ["Chipped"],
    "head_pass": ["HeadPass"], "through_ball": ["Throughball"], "throw_in": ["ThrowIn"], "corner": ["CornerTaken"], "free_kick": ["FreekickTaken"],
    "set_piece": ["SetPiece", "Penalty", "FromCorner", "CornerTaken", "DirectFreekick", "FreekickTaken"], "regular_play": ["RegularPlay", "OpenPlay"], "big_chance": ["BigChance"], "defensive": ["Defensive"],
}
#: flags that a document may also state itself
STATED = {"key_pass": "isKeyPass", "shot_assist": "isShotAssist", "intentional_assist": "isGoalAssist"}


def _any(names: Column, wanted: list[str]) -> Column:
    """Whether a list of names holds one of `wanted`; a null list holds none."""
    return F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, wanted))), F.lit(False))


def _first(choices: dict[str, list[str]], holds) -> Column:
    out = F.lit("unknown")
    for label, names in reversed(choices.items()):
        out = F.when(holds(names), label).otherwise(out)
    return out


def kind(name: Column) -> Column:
    return _first(KINDS, lambda names: name.isin(*names))


def period(value: Column, name: Column) -> Column:
    """The number if it is a known one, else that of the name, else 0."""
    by_name = F.lit(0)
    for n, i in PERIODS.items():
        by_name = F.when(name == n, i).otherwise(by_name)
    return F.when(value.isin(*PERIODS.values()), value).otherwise(by_name)


def success(value: Column, name: Column) -> Column:
    """True, false, or null where neither number nor name tells."""
    word = F.coalesce(F.lower(name), F.lit(""))
    number = F.coalesce(value, F.lit(-1))
    return F.when((number == 1) | (word == "successful"), True).when((number == 0) | (word == "unsuccessful"), False)


def body_part(qualifiers: Column) -> Column:
    return _first(BODY, lambda names: _any(qualifiers, names))


def situation(qualifiers: Column) -> Column:
    return _first(SITUATIONS, lambda names: _any(qualifiers, names))


def shot_outcome(name: Column, qualifiers: Column) -> Column:
    blocked = (name == "SavedShot") & _any(qualifiers, ["Blocked"])
    return F.when(blocked, "blocked").when(name == "Goal", "goal").when(name == "SavedShot", "saved").when(name == "MissedShots", "off_target").when(name == "ShotOnPost", "woodwork").otherwise("unknown")


def flags(qualifiers: Column) -> dict[str, Column]:
    """A boolean for each of FLAGS."""
    return {flag: _any(qualifiers, names) for flag, names in FLAGS.items()}


def is_action(kind_: Column, defensive: Column) -> Column:
    """Contests count only with the defensive flag."""
    return F.when(kind_.isin(*CONTESTS), defensive).otherwise(kind_.isin(*ACTIONS))


def is_defensive(kind_: Column, defensive: Column) -> Column:
    return kind_.isin(*DEFENSIVE) | (kind_.isin(*CONTESTS) & defensive)
