"""Who a provider's row is about: a ladder of rules over what is known, with evidence from other providers.

Tables:
  rows      provider, provider_id, slice, name, teams (array of canonical teams), needs_team
  mappings  provider, provider_id, entity, method ('auto' or 'manual'), one row for each provider and id
  canonical entity, register_id (null if the register does not know it)
  register  provider, provider_id, register_id, name: ids of providers that the register lists
  evidence  slice, provider, entity, alias, teams: what the rows of one provider say of an entity in a slice

A run takes the state as it stands when it begins; what it resolves is evidence for the next run (settle()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_name
from .steps import stored

KEY = ["provider", "provider_id"]
NATIVE, REGISTERED = "n-", "r-"


def _grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the rows: it is sorted and merged, never sent through the driver, whatever its size."""
    return df.hint("merge")


def _strings() -> Column:
    return F.array().cast("array<string>")


def evidence(rows: DataFrame, mappings: DataFrame, register_names: DataFrame, spells: DataFrame) -> DataFrame:
    """slice, provider, entity, aliases, teams: rows whose entity is mapped, with the register's names and known spells of that entity.

    register_names: entity, name; spells: slice, entity, team.  Sets are gathered for one entity of one slice and provider at a time.
    """
    known = rows.join(_grown(mappings.select(*KEY, "entity")), KEY)
    said = known.select("slice", "provider", "entity", canonical_name("name").alias("alias"), F.explode_outer("teams").alias("team"))
    seen = said.select("slice", "provider", "entity").distinct()
    listed = seen.join(_grown(register_names.select("entity", canonical_name("name").alias("alias"))), "entity").select("slice", "provider", "entity", "alias", F.lit(None).cast("string").alias("team"))
    played = seen.join(_grown(spells), ["slice", "entity"]).select("slice", "provider", "entity", F.lit(None).cast("string").alias("alias"), "team")
    every = said.unionByName(listed).unionByName(played)
    return every.groupBy("slice", "provider", "entity").agg(F.collect_set(F.when(F.col("alias") != "", F.col("alias"))).alias("aliases"), F.collect_set("team").alias("teams"))


def index(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by name, by name and team): the smallest and largest entity for each key; a key is unique where they are the same.

    by name: slice, alias, provider; by team: slice, alias, team, provider (of the alias), team_provider.
    """
    names = known.select("slice", "provider", "entity", F.explode("aliases").alias("alias"))
    teams = known.select("slice", F.col("provider").alias("team_provider"), "entity", F.explode("teams").alias("team"))
    ends = [F.min("entity").alias("low"), F.max("entity").alias("high")]
    by_name = names.groupBy("slice", "alias", "provider").agg(*ends)
    by_team = names.join(_grown(teams), ["slice", "entity"]).groupBy("slice", "alias", "team", "provider", "team_provider").agg(*ends)
    return by_name, by_team


def unique_candidates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """provider, provider_id, slice, candidate, ambiguous: the one entity of other providers' evidence with the row's name, and team where it has any.

    Rows that no entity fits are left out; of an ambiguous one the candidate is null.  A row that needs a team and has none fits nothing.
    """
    by_name, by_team = index(known)
    asked = rows.select(*KEY, "slice", canonical_name("name").alias("alias"), "teams", "needs_team").where("alias <> ''")
    bare = asked.where(F.coalesce(F.size("teams"), F.lit(0)) <= 0).where("not needs_team")
    other = by_name.withColumnRenamed("provider", "by")
    met = bare.join(_grown(other), ["slice", "alias"]).where("by <> provider").select(*KEY, "slice", "low", "high")
    sided = asked.select(*KEY, "slice", "alias", F.explode("teams").alias("team"))
    others = by_team.withColumnsRenamed({"provider": "by", "team_provider": "team_by"})
    met = met.unionByName(sided.join(_grown(others), ["slice", "alias", "team"]).where("by <> provider and team_by <> provider").select(*KEY, "slice", "low", "high"))
    ends = met.groupBy(*KEY, "slice").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return ends.select(*KEY, "slice", F.when(F.col("low") == F.col("high"), F.col("low")).alias("candidate"), (F.col("low") != F.col("high")).alias("ambiguous"))


def resolve(rows: DataFrame, mappings: DataFrame, canonical: DataFrame, register: DataFrame, known: DataFrame, event_providers: list[str]) -> DataFrame:
    """The rows with entity, rung and ambiguous, by the first rung that holds; each rung sees what the ones before it left.

    mapping    an entity is mapped (for automatic mappings of providers that the register lists, see below)
    register   the register lists the id: its entity, which takes an automatic mapping over; a manual one is never moved
    moved      an automatic mapping to an entity without a register id, which nothing else is mapped to, moves to the one candidate
    candidate  the one entity that other providers' evidence points to
    native     a provider with totals of its own gets a new entity, named after the id
    quarantine other providers' rows wait; entity is null
    none       rows without an id
    """
    listed = canonical.where("register_id is not null").groupBy("register_id").agg(F.min("entity").alias("listed_entity"))
    ids = register.groupBy(*KEY).agg(F.min("register_id").alias("row_register")).join(_grown(listed.withColumnRenamed("register_id", "row_register")), "row_register", "left")
    ids = ids.select(*KEY, F.coalesce("listed_entity", F.concat(F.lit(REGISTERED), F.col("row_register"))).alias("register_entity"))
    alone = mappings.groupBy("entity").agg((F.count("*") == 1).alias("alone"))
    unlisted = canonical.select("entity", F.col("register_id").isNull().alias("unlisted"))
    held = mappings.join(_grown(alone), "entity").join(_grown(unlisted), "entity", "left").select(*KEY, F.col("entity").alias("mapped"), "method", (F.col("alone") & F.coalesce("unlisted", F.lit(True))).alias("movable"))
    asked = stored(rows.where(F.coalesce("provider_id", F.lit("")) != "").join(_grown(held), KEY, "left").join(_grown(ids), KEY, "left"))
    event, auto = F.col("provider").isin(event_providers), F.col("method") == "auto"
    by_mapping = F.col("mapped").isNotNull() & (event | ~auto | (F.col("register_entity").isNull() & ~F.col("movable")))
    first = F.when(by_mapping, F.struct(F.col("mapped").alias("entity"), F.lit("mapping").alias("rung"))).when(
        F.col("register_entity").isNotNull() & (F.col("mapped").isNotNull() | ~event), F.struct(F.col("register_entity").alias("entity"), F.lit("register").alias("rung"))
    )
    stepped = asked.withColumn("first", first)
    # an event provider's id that the register lists is not looked for among names, and not created either
    open_rows = stepped.where("first is null and register_entity is null")
    found = unique_candidates(open_rows.select(*rows.columns), known)
    left = stepped.join(_grown(found), [*KEY, "slice"], "left")
    new = F.concat(F.lit(NATIVE), F.col("provider"), F.lit("-"), F.col("provider_id"))
    pick = lambda entity, rung: F.struct(entity.cast("string").alias("entity"), F.lit(rung).alias("rung"))
    moved = F.col("mapped").isNotNull()
    then = (
        F.when(F.col("first").isNotNull(), F.col("first"))
        .when(moved & (F.col("candidate").isNull() | (F.col("candidate") == F.col("mapped"))), pick(F.col("mapped"), "mapping"))
        .when(moved, pick(F.col("candidate"), "moved"))
        .when(F.col("candidate").isNotNull(), pick(F.col("candidate"), "candidate"))
        .when(event, pick(F.lit(None), "quarantine"))
        .otherwise(pick(new, "native"))
    )
    done = left.withColumn("then", then).select(*rows.columns, F.col("then.entity").alias("entity"), F.col("then.rung").alias("rung"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
    blank = rows.where(F.coalesce("provider_id", F.lit("")) == "").select("*", F.lit(None).cast("string").alias("entity"), F.lit("none").alias("rung"), F.lit(False).alias("ambiguous"))
    return done.unionByName(blank)


def mappings_after(resolved: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings with those of a run: new and moved ones are automatic, all others stay."""
    made = resolved.where("entity is not null and rung <> 'mapping'").groupBy(*KEY).agg(F.min("entity").alias("entity")).withColumn("method", F.lit("auto"))
    return mappings.select(*KEY, "entity", "method").join(_grown(made.select(*KEY)), KEY, "left_anti").unionByName(made)


def canonical_after(resolved: DataFrame, canonical: DataFrame) -> DataFrame:
    """Entities with those that a run has made."""
    register_id = F.when(F.col("entity").startswith(REGISTERED), F.substring("entity", len(REGISTERED) + 1, 1 << 20))
    made = resolved.where("rung in ('register', 'native')").select("entity").distinct().join(_grown(canonical.select("entity")), "entity", "left_anti")
    return canonical.select("entity", "register_id").unionByName(made.select("entity", register_id.alias("register_id")))


def with_event_teams(waiting: DataFrame, events: DataFrame, team_mappings: DataFrame) -> DataFrame:
    """Rows in quarantine with the teams that their events name: canonical ones, and mapped ones of the provider; needs_team if any event names one.

    events: provider, provider_id, slice, provider_team_id, team; team_mappings: provider, provider_team_id, team.
    """
    named = events.join(team_mappings.select("provider", "provider_team_id", F.col("team").alias("mapped_team")), ["provider", "provider_team_id"], "left")
    context = named.groupBy(*KEY, "slice").agg(F.array_union(F.collect_set("team"), F.collect_set("mapped_team")).alias("__teams"), F.coalesce(F.bool_or(F.coalesce("provider_team_id", F.lit("")) != ""), F.lit(False)).alias("__needs"))
    met = waiting.join(_grown(context), [*KEY, "slice"], "left")
    changed = {"teams": F.coalesce("__teams", _strings()), "needs_team": F.coalesce("__needs", F.lit(False))}
    return met.withColumns(changed).select(*waiting.columns)


def settle(
    waiting: DataFrame, others: DataFrame, events: DataFrame, mappings: DataFrame, canonical: DataFrame, register: DataFrame, team_mappings: DataFrame, spells: DataFrame, event_providers: list[str], most_runs: int = 10
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(state of the waiting rows, mappings, canonical, runs): rows are tried again with the teams of their events until a run moves none.

    waiting: rows in quarantine; others: rows of other providers, which are resolved in each run first and are the evidence.
    Every run is written down, so one that is broken off is done again from the tables of the one before; a run over a settled state moves nothing.
    """
    state = stored(waiting.select("*", F.lit(None).cast("string").alias("entity"), F.lit("quarantine").alias("rung"), F.lit(0).alias("run")))
    fields = waiting.columns
    for run in range(1, most_runs + 1):
        names = register.select(*KEY, "register_id", "name").join(_grown(canonical.where("register_id is not null")), "register_id").select("entity", "name").distinct()
        known = stored(evidence(others, mappings, names, spells))
        told = stored(resolve(others, mappings, canonical, register, known, event_providers))
        canonical, between = stored(canonical_after(told, canonical)), stored(mappings_after(told, mappings))
        still = with_event_teams(state.where("entity is null").select(*fields), events, team_mappings)
        tried = stored(resolve(still, between, canonical, register, known, event_providers))
        after = stored(mappings_after(tried, between))
        moved = tried.where("entity is not null").select(*fields, "entity", "rung", F.lit(run).alias("run"))
        state = stored(state.join(_grown(moved.select(*KEY, "slice")), [*KEY, "slice"], "left_anti").unionByName(moved))
        changes = after.join(_grown(mappings), [*KEY, "entity"], "left_anti")
        mappings = after
        if changes.isEmpty():
            return state, mappings, canonical, run
    return state, mappings, canonical, most_runs
