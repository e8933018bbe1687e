"""Matching runs over all leagues at once.

The frames stay lazy; leagues are a column, not a loop. What one run feeds back into itself (first-round matches, team
votes) is a frame as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import virtual_reason
from ..functions.timing import round3
from ..operators import events, leagues, reports, state, teams
from ..operators.lineage import cut


@dataclass(frozen=True)
class Inputs:
    """Canonical frames of a source and a target; ``known`` has (sport, id, competition_id)."""

    tournaments: DataFrame
    events: DataFrame
    target_tournaments: DataFrame
    target_events: DataFrame
    aliases: DataFrame
    known: DataFrame | None = None
    players: DataFrame | None = None
    target_players: DataFrame | None = None


@dataclass(frozen=True)
class Result:
    leagues: DataFrame
    events: DataFrame
    teams: DataFrame
    stats: DataFrame
    players: DataFrame | None = None
    rates: DataFrame | None = None


def _candidates(target: DataFrame) -> DataFrame:
    return target.select(F.col("id").alias("competition_id"), F.col("name").alias("competition_name"), "sport", F.col("category_name").alias("country"), F.col("id").alias("candidate_seq"))


def run(inputs: Inputs, source: str = "sr", by_score_only: bool = False, override: DataFrame | None = None) -> Result:
    """League match, two rounds of event matching, team map, optional players and bottom-up, statistics.

    ``source`` chooses weights and vote formula ('sr' or 'ls'), and for 'ls' players confirm or doubt leagues of medium confidence; ``override`` has (id, competition_id) that win over
    everything; ``by_score_only`` leaves the known map out and takes low scores.
    """
    weights = leagues.LS if source == "ls" else leagues.SR
    candidates = _candidates(inputs.target_tournaments)
    index = leagues.alias_index(inputs.aliases)
    if by_score_only:
        found = leagues.best_even_if_low(inputs.tournaments, candidates, index)
    else:
        found = leagues.match_leagues(inputs.tournaments, candidates, index, inputs.known, weights)
    if override is not None:
        forced = override.select("id", "competition_id", F.lit(1.0).alias("confidence"), F.lit("LEAGUE_KNOWN").alias("rule"))
        found = found.join(override.select("id"), "id", "left_anti").unionByName(forced)
    found = cut(found)  # small, and used by everything that follows
    linked = found.filter("competition_id <> ''").select(F.col("id").alias("league_id"), "competition_id")
    s = inputs.events.join(linked, F.col("tournament_id") == F.col("league_id")).withColumnRenamed("id", "event_id")
    t = inputs.target_events.join(linked, F.col("tournament_id") == F.col("competition_id")).withColumnRenamed("id", "event_id")
    names = None
    if source != "ls":
        side = lambda d, x: d.select(F.col(f"{x}_id").alias("id"), F.col(f"{x}_name").alias("name"))
        every = [side(d, x) for d in (inputs.events, inputs.target_events) for x in ("home", "away")]
        names = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).groupBy("id").agg(F.min("name").alias("name"))
    vote = lambda matches: teams.map_teams(matches, names)
    matched = events.two_rounds(s, t, vote)
    mapped = cut(vote(matched))
    players = None
    if inputs.players is not None and inputs.target_players is not None:
        rules = teams.LS_PLAYERS if source == "ls" else teams.SR_PLAYERS
        players = teams.match_players(inputs.players, inputs.target_players, mapped, rules)
        if source == "ls":
            found = cut(teams.feed_back(found, teams.league_player_rates(inputs.players, players, mapped)))
        mapped, matched = teams.propagate(mapped, matched, teams.player_overlap(inputs.players, players))
    totals = t.groupBy("league_id").agg(F.count("*").alias("n_target"))
    rates = state.reverse_confirm(matched, ["league_id"], totals)
    return Result(found, matched, mapped, reports.match_stats(matched, ["league_id"]), players, rates)


def learned_aliases(result: Result, sport: str, as_of: int) -> DataFrame:
    """Team mappings with two votes or more, as rows for the alias store."""
    return result.teams.filter("votes >= 2").select(
        F.lit("team").alias("side"), F.col("s").alias("src_id"), F.col("t").alias("ts_id"), F.lit(sport).alias("sport"),
        F.col("votes").cast("long").alias("votes"), "confidence", F.lit(as_of).cast("long").alias("last_seen"), F.lit("learned").alias("origin"),
    )


def bulk(inputs: Inputs) -> Result:
    """The yearly bulk run (W5): leagues played on a screen are left out, scores are the offline ones, matching goes level by level."""
    real = inputs.tournaments.filter(virtual_reason(F.col("name")).isNull())
    sure = None
    if inputs.known is not None:
        sure = real.join(inputs.known, ["sport", "id"]).select("id", "competition_id", F.lit(1.0).alias("confidence"), F.lit("LEAGUE_KNOWN").alias("rule"))
        real = real.join(inputs.known, ["sport", "id"], "left_anti")
    named = real.select("id", F.col("name").alias("league_name"), "sport", "category_name")
    pairs = named.join(_candidates(inputs.target_tournaments), "sport")
    scored = pairs.withColumn("score", leagues.offline_score("league_name", "competition_name", "category_name", "country"))
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "candidate_seq")  # the first candidate wins ties
    best = scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("id", F.struct("competition_id", "score").alias("x"))
    rule = leagues.rule_of(F.col("x.score"))
    found = best.select("id", F.when(rule != "LEAGUE_NO_MATCH", F.col("x.competition_id")).otherwise("").alias("competition_id"), round3(F.col("x.score")).alias("confidence"), rule.alias("rule"))
    found = cut(found if sure is None else found.unionByName(sure))  # small, and used by everything that follows
    linked = found.filter("competition_id <> ''").select(F.col("id").alias("league_id"), "competition_id")
    s = inputs.events.join(linked, F.col("tournament_id") == F.col("league_id")).withColumnRenamed("id", "event_id")
    t = inputs.target_events.join(linked, F.col("tournament_id") == F.col("competition_id")).withColumnRenamed("id", "event_id")
    matched = cut(events.level_major(s, t))
    return Result(found, matched, matched.limit(0), reports.match_stats(matched, ["league_id"]))


def league_export(tournaments: DataFrame, target: DataFrame) -> DataFrame:
    """The league-only run (W7): every league with its best target, score and rule."""
    named = tournaments.select("id", F.col("name").alias("league_name"), "sport", "category_name")
    pairs = named.join(_candidates(target), "sport")
    scored = pairs.withColumn("score", leagues.offline_score("league_name", "competition_name", "category_name", "country", discount=True))
    w = Window.partitionBy("id", "league_name").orderBy(F.col("score").desc(), "candidate_seq")  # the first candidate wins ties
    best = scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return best.select("id", "league_name", "competition_id", "competition_name", "score").withColumn("rule", leagues.rule_of(F.col("score")))
