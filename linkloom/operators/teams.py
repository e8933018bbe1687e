"""Team votes, player matching and bottom-up propagation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_similarity, player_similarity
from ..functions.timing import round3
from .events import name_pair_scores

SR_PLAYERS = {"least": 0.60, "accept": 0.70, "high": 0.85, "birthday": True}
LS_PLAYERS = {"least": 0.65, "accept": 0.75, "high": 0.90, "birthday": False}


def votes(matches: DataFrame) -> DataFrame:
    """(league_id, s, t, conf): a vote for each side of each matched event."""
    side = lambda s: matches.filter("matched").select("league_id", F.col(f"{s}_id").alias("s"), F.col(f"target_{s}_id").alias("t"), F.col("confidence").alias("conf"))
    return side("home").unionByName(side("away"))


def elect(ballots: DataFrame, group: list[str], source: str, target: str, confidence: str | None = None) -> DataFrame:
    """The target with the most votes for each source: votes, total and, with ``confidence``, its sum and mean.

    Ties go to the larger confidence sum (where there is one), then to the smaller target.
    """
    sums = [F.count("*").alias("votes")] + ([F.sum(confidence).alias("conf_sum"), F.avg(confidence).alias("conf_mean")] if confidence else [])
    counted = ballots.groupBy(*group, source, target).agg(*sums)
    own = Window.partitionBy(*group, source)
    order = [F.col("votes").desc(), *([F.col("conf_sum").desc()] if confidence else []), F.col(target)]
    ranked = counted.withColumn("total", F.sum("votes").over(own)).withColumn("_n", F.row_number().over(own.orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def map_teams(matches: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Team mapping from matched events: with ``names`` (id, name) by votes and name similarity (G1), else by votes and mean confidence."""
    won = elect(votes(matches), ["league_id"], "s", "t", "conf")
    if names is None:
        return won.select("league_id", "s", "t", "votes", round3(F.col("conf_mean")).alias("confidence"))
    named = won.join(names.toDF("s", "_sn"), "s", "left").join(names.toDF("t", "_tn"), "t", "left")
    named = named.withColumn("_sn", F.coalesce("_sn", F.lit(""))).withColumn("_tn", F.coalesce("_tn", F.lit("")))
    scores = name_pair_scores(named.select(F.col("_sn").alias("x"), F.col("_tn").alias("y"))).toDF("_sn", "_tn", "_sim")
    named = named.join(scores, ["_sn", "_tn"])
    conf = 0.6 * F.col("votes") / F.col("total") + 0.4 * F.col("_sim")
    return named.select("league_id", "s", "t", "votes", round3(conf).alias("confidence"))


def match_players(source: DataFrame, target: DataFrame, teams: DataFrame, rules: dict = SR_PLAYERS) -> DataFrame:
    """Players of mapped teams, one to one in the source's order.

    Candidates are scored as pairs; the greedy choice, which depends on the order, runs per team.
    """
    a = source.select(F.col("team_id").alias("s"), F.col("id").alias("player_id"), F.col("name").alias("_an"), F.col("birthday").alias("_ab"))
    b = target.select(F.col("team_id").alias("t"), F.col("id").alias("target_player_id"), F.col("name").alias("_bn"), F.col("birthday").alias("_bb"))
    pairs = teams.select("s", "t").join(a, "s").join(b, "t")
    if rules["birthday"]:
        sim = player_similarity(F.col("_an"), F.col("_bn"))
        same = (F.coalesce("_ab", F.lit("")) != "") & (F.substring("_ab", 1, 10) == F.substring("_bb", 1, 10))
        score = F.least(F.lit(1.0), 0.85 * F.col("_sim") + F.when(F.col("_dob"), 0.15).otherwise(0.0))
    else:
        names = pairs.select("_an", "_bn").distinct().repartition("_an", "_bn")
        names = names.select("_an", "_bn", name_similarity(F.col("_an"), F.col("_bn")).alias("_score"))
        pairs = pairs.join(names, ["_an", "_bn"])
        sim, same, score = F.col("_score"), F.lit(False), F.col("_sim")
    scored = pairs.withColumn("_sim", sim).withColumn("_dob", same).filter(F.col("_sim") >= rules["least"]).withColumn("score", score)
    good = scored.filter(F.col("score") >= rules["accept"])
    rule = F.when(F.col("score") >= rules["high"], "PLAYER_NAME_HI").when(F.col("_dob"), "PLAYER_DOB").otherwise("PLAYER_NAME_MED")
    rows = good.select("s", "t", "player_id", "target_player_id", "score", rule.alias("rule"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        kept = []
        for _, own in pdf.sort_values(["player_id", "score", "target_player_id"], ascending=[True, False, True]).groupby("player_id", sort=True):
            for i, r in own.iterrows():
                if r["target_player_id"] not in used:
                    used.add(r["target_player_id"])
                    kept.append(i)
                    break
        return pdf.loc[kept]

    return rows.groupBy("s", "t").applyInPandas(choose, rows.schema)


def overlap_bonus(rate: Column) -> Column:
    return F.when(rate >= 0.60, 0.15).when(rate >= 0.40, 0.08).when(rate >= 0.20, 0.03).otherwise(0.0)


def player_overlap(players: DataFrame, matched: DataFrame) -> DataFrame:
    """(s, overlap, bonus): the share of each mapped team's players that were matched (B1)."""
    all_of = players.groupBy(F.col("team_id").alias("s")).agg(F.countDistinct("id").alias("players"))
    got = matched.groupBy("s").agg(F.countDistinct("player_id").alias("hits"))
    rate = F.coalesce("hits", F.lit(0)) / F.col("players")
    return all_of.join(got, "s", "left").select("s", rate.alias("overlap"), overlap_bonus(rate).alias("bonus"))


def propagate(teams: DataFrame, matches: DataFrame, overlap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Team and event confidences raised by their players' overlap, at most 1 (B1)."""
    bonus = overlap.select("s", "bonus")
    up = lambda c, b: F.least(F.lit(1.0), F.col(c) + F.coalesce(b, F.lit(0.0)))
    better = teams.join(bonus, "s", "left").withColumn("confidence", round3(up("confidence", F.col("bonus")))).drop("bonus")
    h, a = bonus.toDF("home_id", "_h"), bonus.toDF("away_id", "_a")
    mean = (F.coalesce("_h", F.lit(0.0)) + F.coalesce("_a", F.lit(0.0))) / 2
    events = matches.join(h, "home_id", "left").join(a, "away_id", "left")
    raised = F.when(F.col("matched"), round3(up("confidence", mean))).otherwise(F.col("confidence"))
    return better, events.withColumn("confidence", raised).select(*matches.columns)


def league_feedback(confidence: Column, overlap: Column) -> Column:
    """A league's confidence after its players were compared (B2)."""
    change = F.when(overlap >= 0.60, 0.05).when(overlap >= 0.40, 0.0).when(overlap >= 0.30, -0.03).otherwise(-0.08)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence + change))


def league_player_rates(players: DataFrame, matched: DataFrame, mapped: DataFrame) -> DataFrame:
    """(league_id, rate): the share of the players of a league's mapped teams that were matched (B2)."""
    teams = mapped.select("league_id", "s").distinct()
    every = teams.join(players.select(F.col("team_id").alias("s"), F.col("id").alias("player_id")).distinct(), "s")
    hits = matched.select("s", "player_id").distinct().withColumn("_hit", F.lit(1))
    return every.join(hits, ["s", "player_id"], "left").groupBy("league_id").agg((F.count("_hit") / F.count("*")).alias("rate"))


def feed_back(leagues: DataFrame, rates: DataFrame, rule: str = "LEAGUE_NAME_MED") -> DataFrame:
    """Leagues (id, competition_id, confidence, rule) of medium confidence, confirmed or doubted by their players (B2)."""
    joined = leagues.join(rates.select(F.col("league_id").alias("id"), "rate"), "id", "left")
    told = (F.col("rule") == rule) & F.col("rate").isNotNull()
    better = F.when(told, round3(league_feedback(F.col("confidence"), F.col("rate")))).otherwise(F.col("confidence"))
    return joined.withColumn("confidence", better).select(*leagues.columns)
