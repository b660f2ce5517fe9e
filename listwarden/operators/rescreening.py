"""Screening kept up to date when the list changes.

A run keeps, for each distinct profile, its best ``match_limit + reserve`` matches. What lies behind them is unknown, and the place of the last
one kept, its horizon, says from where on; a profile with fewer matches has no horizon, all of its matches are known. When the list changes,

* matches with entities that were removed or updated go,
* profiles are screened against the added and updated entities only, and what ranks behind a profile's horizon is left out, since unknown
  matches may rank before it,
* a profile that still holds ``match_limit`` matches, or has no horizon, is exact: every unknown match ranks behind the horizon,
* the others have used up their reserve and are screened against the whole new list.

The work of a change is the profiles against what changed, plus the few profiles used up; stored matches are read once. Every match depends on
its profile and its entity alone, so the result equals a full run on the new list. Changes and stored matches meet in plain joins on the entity's key; an
entity that a third of all profiles match is one key of the small side, and Spark splits the large side where it is skewed.

Cases: a change of a column that screening does not read is no change. Keys of ``changes`` that the state never matched do nothing. An empty change gives the state
as it was. Repeated rows of ``changes`` count once. Entities are known by (source, entity_id), which must be unique in a list.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwarden.config import DEFAULT, ScreeningConfig
from listwarden.operators import screening
from listwarden.operators.screening import ENTITY
from listwarden.operators.staging import materialized
from listwarden.operators.tables import by_ids, list_diff

#: What screening reads of an entity, besides its key.
SCREENED = [
    "entity_type", "primary_name", "all_names", "identity_documents", "vessel_imo", "date_of_birth", "countries", "nationality", "citizenship",
]
RESERVE = 10


@dataclass(frozen=True)
class ScreeningState:
    """Result of a run that can be carried over to the next list version.

    profiles: distinct inputs with what matching needs; matches: the known best matches of each profile, with ``place``, their order;
    horizons: (profile_id, horizon), the last known place, of profiles that have matches behind it; recomputed: how many
    profiles the last change sent through the whole list.
    """

    profiles: DataFrame
    matches: DataFrame
    horizons: DataFrame
    config: ScreeningConfig
    reserve: int
    recomputed: int = 0


def _place() -> Column:
    """Order of a profile's matches, smallest first."""
    return F.struct((-F.col("overall")).alias("overall"), "match_layer", *ENTITY)


def _wide(config: ScreeningConfig, reserve: int) -> ScreeningConfig:
    return config.with_(match_limit=config.match_limit + reserve)


def _kept(found: DataFrame, horizons: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The first ``depth`` matches of each profile, and the horizons: the place of the last one where more are known, else the old one."""
    order = Window.partitionBy("profile_id").orderBy("place")
    ranked = found.withColumn("match_rank", F.row_number().over(order)).filter(F.col("match_rank") <= depth + 1)
    ranked = materialized(ranked, "ranked")
    full = ranked.filter(F.col("match_rank") == depth + 1).select("profile_id")
    last = ranked.filter(F.col("match_rank") == depth).join(full, "profile_id", "left_semi").select("profile_id", F.col("place").alias("last"))
    merged = horizons.join(last, "profile_id", "full_outer").select("profile_id", F.coalesce("last", "horizon").alias("horizon"))
    return ranked.filter(F.col("match_rank") <= depth), materialized(merged, "horizons")


def start(requests: DataFrame, listed: DataFrame, config: ScreeningConfig = DEFAULT, reserve: int = RESERVE) -> ScreeningState:
    """A full run. requests and listed as for ``screening.screen``, but that ``listed`` are entities."""
    prof = materialized(screening.profiles(requests, config), "profiles")
    return _whole(prof, listed, config, reserve)


def _whole(prof: DataFrame, listed: DataFrame, config: ScreeningConfig, reserve: int) -> ScreeningState:
    # one match more than is kept tells whether others are behind
    deeper = _wide(config, reserve + 1)
    found = screening.screen_profiles(prof, screening.prepare_list(listed, deeper), deeper).drop("match_rank").withColumn("place", _place())
    none = found.select("profile_id", F.col("place").alias("horizon")).limit(0)
    matches, horizons = _kept(found, none, config.match_limit + reserve)
    return ScreeningState(prof, matches, horizons, config, reserve)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, entity_id, change): entities added, removed, or updated in what screening reads."""
    return list_diff(old.select(*ENTITY, *SCREENED), new.select(*ENTITY, *SCREENED), ENTITY, SCREENED)


def carry_over(state: ScreeningState, changed: DataFrame, new: DataFrame) -> ScreeningState:
    """The state for the list ``new``; ``changed`` has a row (source, entity_id, change) for each entity that differs."""
    config, depth = state.config, state.config.match_limit + state.reserve
    changed = materialized(changed.select(*ENTITY, "change").distinct(), "changes")
    gone = changed.filter(F.col("change") != "added").select(*ENTITY)
    fresh = by_ids(new, changed.filter(F.col("change") != "removed"), ENTITY)

    wide = _wide(config, state.reserve + 1)
    met = screening.screen_profiles(state.profiles, screening.prepare_list(fresh, wide), wide).drop("match_rank").withColumn("place", _place())
    known = met.join(state.horizons, "profile_id", "left").filter(F.col("horizon").isNull() | (F.col("place") <= F.col("horizon"))).drop("horizon")
    stays = state.matches.drop("match_rank").join(gone, ENTITY, "left_anti")
    merged = materialized(stays.unionByName(known), "merged")
    matches, horizons = _kept(merged, state.horizons, depth)

    counted = merged.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    short = horizons.join(counted, "profile_id", "left").filter(F.coalesce("n", F.lit(0)) < config.match_limit).select("profile_id")
    short = materialized(short, "used_up")
    recomputed = short.count()
    if not recomputed:
        return replace(state, matches=matches, horizons=horizons, recomputed=0)
    again = _whole(by_ids(state.profiles, short, ["profile_id"]), new, config, state.reserve)
    matches = matches.join(short, "profile_id", "left_anti").unionByName(again.matches)
    horizons = horizons.join(short, "profile_id", "left_anti").unionByName(again.horizons)
    return replace(state, matches=materialized(matches, "matches"), horizons=materialized(horizons, "horizons"), recomputed=recomputed)


def best_matches(requests: DataFrame, state: ScreeningState) -> DataFrame:
    """Best matches of every request, as ``screening.screen`` gives them. ``requests`` are those of the state, or some of them."""
    keyed = requests.select("request_id", screening.profile_id().alias("profile_id")).distinct()
    best = state.matches.filter(F.col("match_rank") <= state.config.match_limit).drop("place")
    return keyed.join(best, "profile_id").drop("profile_id")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Matches that a list version brought or took: (request_id, source, entity_id, outcome) with outcome new, gone or changed."""
    key = ["request_id", *ENTITY]
    told = lambda df, name: df.select(*key, F.struct("overall", "match_layer", "recommendation", "matched_name").alias(name))
    both = told(before, "was").join(told(after, "now"), key, "full_outer")
    outcome = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return both.select(*key, outcome.alias("outcome")).filter("outcome IS NOT NULL")
