"""The registered queries of the library's own operators, each with its SQL where SQL can express it.

The tables that they run on hold no matches or teams; each query applies an operator to columns of the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sources
from .functions import geo, text, timing
from .operators import alignment, blocking, events, evidence, features, graph_index, leagues, offline, reports, scoring, state, teams
from .sources import selections

QUERIES: dict = {}
ORACLES: dict = {}

SECONDS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
EPOCH = "(epoch_us(ts) // 1000000)"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed(spark: SparkSession, sf_dir: str, kind: str, prefix: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(f"{prefix}_id"), F.expr(SECONDS).alias(f"{prefix}_time"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _timed(spark, sf_dir, "click", "s"), _timed(spark, sf_dir, "view", "t")


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    colour = F.substring_index("p_name", " ", 1)
    a = names.select(F.col("p_name").alias("a"), colour.alias("k"))
    b = names.select(F.col("p_name").alias("b"), colour.alias("k"))
    noun = lambda d, c: d.select(c, F.substring_index(c, " ", -1).alias("k"))
    same = noun(a, "a").join(noun(b, "b"), "k")
    return a.join(b, "k").unionByName(same).filter("a < b").select("a", "b").distinct()


_SQL_PAIRS = """
names AS (SELECT DISTINCT p_name FROM part),
pairs AS (SELECT x.p_name AS a, y.p_name AS b FROM names x JOIN names y ON x.p_name < y.p_name
          AND (split_part(x.p_name, ' ', 1) = split_part(y.p_name, ' ', 1) OR split_part(x.p_name, ' ', -1) = split_part(y.p_name, ' ', -1)))
"""
_SQL_SIDES = f"""
s AS (SELECT user_id, event_id AS s_id, {EPOCH} AS s_time FROM events WHERE event_type = 'click'),
t AS (SELECT user_id, event_id AS t_id, {EPOCH} AS t_time FROM events WHERE event_type = 'view')
"""


# --- names -------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_SQL_PAIRS}
SELECT a, b, round(len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' '))))
  / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 6) AS jaccard FROM pairs"""
)
def token_jaccard_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = text.jaccard(text.token_set(F.col("a")), text.token_set(F.col("b")))
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(sim, 6).alias("jaccard"))


@query(
    f"""WITH {_SQL_PAIRS}, j AS (SELECT a, b, jaro_similarity(a, b) AS jaro,
  CASE WHEN a[1:4] = b[1:4] THEN 4 WHEN a[1:3] = b[1:3] THEN 3 WHEN a[1:2] = b[1:2] THEN 2 WHEN a[1] = b[1] THEN 1 ELSE 0 END AS p FROM pairs)
SELECT a, b, round(jaro, 6) AS jaro, round(jaro + p * 0.1 * (1 - jaro), 6) AS jaro_winkler FROM j"""
)
def jaro_winkler_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(text.jaro(a, b, whole=True), 6).alias("jaro"), F.round(text.jaro_winkler(a, b, whole=True), 6).alias("jaro_winkler"))


@query(
    r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents WHERE text IS NOT NULL),
k AS (SELECT word FROM w WHERE regexp_matches(word, '^[A-Za-z0-9À-ÖØ-öø-ÿ.,_-]+$') AND NOT regexp_matches(word, '[ÆÐØÞßæðøþ]'))
SELECT word, trim(regexp_replace(regexp_replace(lower(strip_accents(word)), '[._,-]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM k"""
)
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of all documents, those whose letters every folding treats alike."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word")).distinct()
    plain = words.filter(F.col("word").rlike(r"^[A-Za-z0-9À-ÖØ-öø-ÿ.,_-]+$") & ~F.col("word").rlike("[ÆÐØÞßæðøþ]"))
    return plain.select("word", text.normalize_name(F.col("word")).alias("norm"))


@query()
def normalize_all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of all documents, whatever their letters; SQL folds some of them otherwise, the tests compare by hand."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", text.normalize_name(F.col("word")).alias("norm"))


@query()
def name_similarity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger of Jaccard and Jaro-Winkler; half transpositions have no counterpart in SQL, the tests compare by hand."""
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(text.name_similarity(F.col("a"), F.col("b")), 6).alias("name_similarity"))


@query(
    """WITH t AS (SELECT page_id, lower(trim(url)) AS n FROM pages)
SELECT page_id, CASE WHEN regexp_matches(n, '^e-') THEN 'e-prefix' WHEN regexp_matches(n, '^e\\s*\\|') THEN 'e|prefix'
  WHEN regexp_matches(n, '^e(basketball|football|soccer|sport)') THEN 'e-joined' WHEN contains(n, '(e)') THEN '(e)'
  WHEN contains(n, 'esports') OR contains(n, 'e-sports') THEN 'esports' WHEN contains(n, 'cyber') THEN 'cyber'
  WHEN regexp_matches(n, 'nba\\s*2k') THEN 'nba 2k' WHEN contains(n, 'blitz') THEN 'blitz' WHEN contains(n, 'h2h') AND contains(n, 'gg') THEN 'h2h gg' END AS reason
FROM t"""
)
def virtual_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.virtual_reason(F.col("url")).alias("reason"))


@query(
    """SELECT DISTINCT p_name, CASE WHEN contains(p_name, 'small') THEN 'small' WHEN contains(p_name, 'large') THEN 'large' ELSE '' END AS size_word,
 (lower(p_type) IN ('economy', 'promo')) AS cheap, p_type FROM part"""
)
def feature_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = features._ladder(F.col("p_name"), {"small": ["small"], "large": ["large"]})
    return table(spark, sf_dir, "part").select("p_name", size.alias("size_word"), F.lower("p_type").isin("economy", "promo").alias("cheap"), "p_type").distinct()


# --- event matching ----------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_SQL_SIDES}
SELECT s_id, t_id, abs(s_time - t_time) AS time_diff, round(exp(-(abs(s_time - t_time) ** 2) / (2.0 * 3600 * 3600)), 6) AS time_score
FROM s JOIN t USING (user_id) WHERE abs(s_time - t_time) <= 21600"""
)
def gaussian_time_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    pairs = blocking.time_window_join(s, t, ["user_id"], "s_time", "t_time", 21600)
    gap = F.abs(F.col("s_time") - F.col("t_time"))
    return pairs.select("s_id", "t_id", gap.alias("time_diff"), F.round(timing.gaussian_time(gap, 3600), 6).alias("time_score"))


@query(f"WITH {_SQL_SIDES} SELECT s_id, t_id, s_time // 86400 AS day FROM s JOIN t ON s.user_id = t.user_id AND s_time // 86400 = t_time // 86400")
def utc_day_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    day = lambda d, c: d.withColumn("day", timing.utc_day(F.col(c)))
    return day(s, "s_time").join(day(t, "t_time"), ["user_id", "day"]).select("s_id", "t_id", "day")


@query(
    f"""WITH {_SQL_SIDES}, p AS (SELECT s_id, t_id, count(*) OVER (PARTITION BY s_id) AS n FROM s JOIN t USING (user_id) WHERE abs(s_time - t_time) <= 7200)
SELECT s_id, t_id FROM p WHERE n = 1"""
)
def unique_candidate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    return events.unique_candidates(blocking.time_window_join(s, t, ["user_id"], "s_time", "t_time", 7200), "s_id").select("s_id", "t_id")


_SQL_TIERED = f"""WITH {_SQL_SIDES}, p AS (
  SELECT s_id, t_id, abs(s_time - t_time) AS d, s_time // 86400 = t_time // 86400 AS same_day FROM s JOIN t USING (user_id) WHERE abs(s_time - t_time) <= 86400
), r AS (
  SELECT s_id, t_id, d, CASE WHEN d <= 21600 AND 0.3 * exp(-(d * d) / (2.0 * 3600 * 3600)) + 0.7 >= 0.5 THEN 'EVENT_L1'
      WHEN d <= 32400 AND 0.15 * exp(-(d * d) / (2.0 * 10800 * 10800)) + 0.85 >= 0.6 THEN 'EVENT_L2' WHEN same_day THEN 'EVENT_L3' END AS rule FROM p
), q AS (
  SELECT *, CASE rule WHEN 'EVENT_L1' THEN 0.3 * exp(-(d * d) / (2.0 * 3600 * 3600)) + 0.7
      WHEN 'EVENT_L2' THEN 0.15 * exp(-(d * d) / (2.0 * 10800 * 10800)) + 0.85 ELSE 1.0 END AS score FROM r WHERE rule IS NOT NULL
), b AS (
  SELECT s_id, t_id, rule, d AS time_diff, round(score, 6) AS score FROM q QUALIFY row_number() OVER (PARTITION BY s_id ORDER BY rule, q.score DESC, t_id) = 1
)"""


@query(_SQL_TIERED + " SELECT s_id, t_id, rule, time_diff, score FROM b")
def tiered_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    best = events.best_by_tier(events.tiered_candidates(s, t, ["user_id"], "s_time", "t_time"), "s_id", "t_id")
    return best.select("s_id", "t_id", "rule", "time_diff", F.round("score", 6).alias("score"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _sides(spark, sf_dir)
    best = tiered_best_match(spark, sf_dir).select("s_id", F.col("t_id").cast("string").alias("target_id"), "rule", F.col("score").alias("confidence"))
    return s.select("s_id", (F.col("user_id") % 10).alias("grp")).join(best, "s_id", "left").withColumn("matched", F.col("rule").isNotNull())


_SQL_STATS = """, m AS (SELECT s.s_id, s.user_id % 10 AS grp, b.rule, b.score, b.t_id FROM s LEFT JOIN b USING (s_id))"""


@query(
    _SQL_TIERED
    + _SQL_STATS
    + """ SELECT grp, count(*) AS total, count(rule) AS n_matched, floor(coalesce(avg(score), 0) * 1000 + 0.5) / 1000 AS avg_confidence,
 count(*) FILTER (rule = 'EVENT_L1') AS n_event_l1, count(*) FILTER (rule = 'EVENT_L2') AS n_event_l2, count(*) FILTER (rule = 'EVENT_L3') AS n_event_l3,
 floor(count(rule) / count(*) * 1000 + 0.5) / 1000 AS rate FROM m GROUP BY grp"""
)
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.match_stats(_matches(spark, sf_dir), ["grp"], ["EVENT_L1", "EVENT_L2", "EVENT_L3"])


QUERIES["entry_match_stats"] = match_stats
ORACLES["entry_match_stats"] = ORACLES["match_stats"]


@query(
    _SQL_TIERED
    + _SQL_STATS
    + """, rr AS (SELECT grp, count(*) AS n_source, count(rule) AS n_matched, count(DISTINCT t_id) AS n_target_matched FROM m GROUP BY grp),
 n AS (SELECT user_id % 10 AS grp, count(*) AS n_target FROM t GROUP BY 1)
 SELECT grp, n_source, n_matched, n_target_matched, n_target, round(CASE WHEN least(n_source, n_target_matched) > 0 THEN n_matched / least(n_source, n_target_matched) ELSE 0 END, 6) AS rcr_observed,
  round(CASE WHEN least(n_source, n_target) > 0 THEN n_matched / least(n_source, n_target) ELSE 0 END, 6) AS rcr_documented FROM rr JOIN n USING (grp)"""
)
def reverse_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t = _sides(spark, sf_dir)
    totals = t.groupBy((F.col("user_id") % 10).alias("grp")).agg(F.count("*").alias("n_target"))
    rows = state.reverse_confirm(_matches(spark, sf_dir), ["grp"], totals)
    return rows.withColumn("rcr_observed", F.round("rcr_observed", 6)).withColumn("rcr_documented", F.round("rcr_documented", 6))


# --- votes and overlap -------------------------------------------------------------------------------------------------


@query(
    """WITH v AS (SELECT l_partkey, l_suppkey, count(*) AS votes FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_suppkey, votes, (sum(votes) OVER (PARTITION BY l_partkey))::BIGINT AS total FROM v
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, l_suppkey) = 1"""
)
def vote_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams.elect(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), [], "l_partkey", "l_suppkey")


@query(
    """WITH v AS (SELECT l_partkey, l_suppkey, count(*) AS votes, sum(l_quantity) AS conf_sum, avg(l_quantity) AS conf_mean FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_suppkey, votes, conf_sum, round(conf_mean, 6) AS conf_mean, (sum(votes) OVER (PARTITION BY l_partkey))::BIGINT AS total FROM v
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, conf_sum DESC, l_suppkey) = 1"""
)
def vote_mapping_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = teams.elect(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), [], "l_partkey", "l_suppkey", "l_quantity")
    return rows.withColumn("conf_mean", F.round("conf_mean", 6))


@query(
    """WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') / count(*) AS r FROM orders GROUP BY 1)
SELECT o_custkey, round(r, 6) AS overlap, CASE WHEN r >= 0.6 THEN 0.15 WHEN r >= 0.4 THEN 0.08 WHEN r >= 0.2 THEN 0.03 ELSE 0.0 END::DOUBLE AS bonus FROM c"""
)
def overlap_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("r"))
    return rate.select("o_custkey", F.round("r", 6).alias("overlap"), teams.overlap_bonus(F.col("r")).alias("bonus"))


@query(
    """SELECT o_orderkey, CASE WHEN s >= 0.85 THEN 'LEAGUE_NAME_HI' WHEN s >= 0.7 THEN 'LEAGUE_NAME_MED' WHEN s >= 0.55 THEN 'LEAGUE_NAME_LOW' ELSE 'LEAGUE_NO_MATCH' END AS rule,
 CASE WHEN s >= 0.6 THEN 'HIGH' WHEN s >= 0.4 THEN 'MEDIUM' WHEN s >= 0.3 THEN 'LOW' ELSE 'FAIL' END AS rcr_level FROM (SELECT o_orderkey, (o_orderkey % 101) / 100 AS s FROM orders)"""
)
def league_tier_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("o_orderkey") % 101) / 100
    return table(spark, sf_dir, "orders").select("o_orderkey", leagues.rule_of(s).alias("rule"), state.rcr_level(s).alias("rcr_level"))


@query(
    """WITH k AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 3 = 0)
SELECT c_custkey, coalesce(k.n_regionkey::BIGINT, c_custkey % 5) AS target, CASE WHEN k.n_regionkey IS NULL THEN 'LEAGUE_NAME_HI' ELSE 'LEAGUE_KNOWN' END AS rule
FROM customer LEFT JOIN k ON c_nationkey = n_nationkey"""
)
def known_map_then_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are leagues of five names, which are also the candidates; nations divisible by three are the known map."""
    names = ["Alpha", "Bravo", "Charlie", "Delta", "Echo"]
    customers = table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey").cast("string")).withColumn("sport", F.lit("football"))
    nations = table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("competition_id"))
    known = customers.join(nations, "c_nationkey").select("sport", "id", "competition_id")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = customers.select("id", "sport", name.alias("name"), F.lit("").alias("category_name"))
    candidates = spark.createDataFrame([(str(i), n, "football", "", i) for i, n in enumerate(names)], "competition_id string, competition_name string, sport string, country string, candidate_seq int")
    index = spark.createDataFrame([], "alias_norm string, canonical string")
    found = leagues.match_leagues(rows, candidates, index, known)
    return found.select(F.col("id").cast("long").alias("c_custkey"), F.col("competition_id").cast("long").alias("target"), "rule")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


# --- scoring -----------------------------------------------------------------------------------------------------------


def _order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive orders of a customer as pairs of events, with similarities in [0, 1] derived from their columns."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("before", F.lag(F.struct("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")).over(w))
    o = o.filter("before is not null")
    ratio = F.least("o_totalprice", "before.o_totalprice") / F.greatest("o_totalprice", "before.o_totalprice")
    days = F.datediff("o_orderdate", "before.o_orderdate")
    return o.select(
        F.col("before.o_orderkey").alias("a"),
        F.col("o_orderkey").alias("b"),
        "o_custkey",
        *scoring.compare(ratio, 1.0 - ratio, days * 600, F.col("o_orderstatus") == F.col("before.o_orderstatus"), F.col("o_orderpriority") == F.col("before.o_orderpriority")),
    )


_SQL_FS = """WITH o AS (SELECT *, lag(o_orderkey) OVER w AS a, lag(o_totalprice) OVER w AS pa, lag(o_orderdate) OVER w AS da, lag(o_orderstatus) OVER w AS sa, lag(o_orderpriority) OVER w AS ra
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
p AS (SELECT a, o_orderkey AS b, o_custkey, least(o_totalprice, pa) / greatest(o_totalprice, pa) AS r, date_diff('day', da, o_orderdate) * 600 AS g, o_orderstatus = sa AS st, o_orderpriority = ra AS sp FROM o WHERE a IS NOT NULL),
f AS (SELECT a, b, o_custkey, CASE WHEN r >= 0.8 THEN 2 WHEN r >= 0.5 THEN 1 ELSE 0 END AS home_name, CASE WHEN 1 - r >= 0.8 THEN 2 WHEN 1 - r >= 0.5 THEN 1 ELSE 0 END AS away_name,
  CASE WHEN abs(g) <= 1800 THEN 2 WHEN abs(g) <= 21600 THEN 1 ELSE 0 END AS time_diff, CASE WHEN st THEN 2 ELSE 0 END AS league_tier, CASE WHEN sp THEN 2 ELSE 0 END AS sport FROM p)"""


@query(
    _SQL_FS
    + """ , s AS (SELECT a, b, [log2(0.03/0.75), log2(0.12/0.20), log2(0.85/0.05)][home_name + 1] + [log2(0.03/0.75), log2(0.12/0.20), log2(0.85/0.05)][away_name + 1]
 + [log2(0.05/0.60), log2(0.25/0.30), log2(0.70/0.10)][time_diff + 1] + [log2(0.05/0.70), 0, log2(0.95/0.30)][league_tier + 1] + [log2(0.01/0.80), 0, log2(0.99/0.20)][sport + 1] AS score FROM f)
 SELECT a, b, round(score, 6) AS score, round(1 / (1 + exp(-score / 3)), 6) AS normalized, CASE WHEN score >= 6 THEN 2 WHEN score >= -2 THEN 1 ELSE 0 END AS class FROM s"""
)
def fs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_pairs(spark, sf_dir).withColumn("s", scoring.score(scoring.Model.default()))
    s = F.col("s")
    return rows.select("a", "b", F.round(s, 6).alias("score"), F.round(scoring.normalized(s), 6).alias("normalized"), scoring.classify(s).alias("class"))


@query(_SQL_FS + " SELECT home_name::TINYINT AS home_name, away_name::TINYINT AS away_name, time_diff::TINYINT AS time_diff, league_tier::TINYINT AS league_tier, sport::TINYINT AS sport, count(*) AS n FROM f GROUP BY ALL")
def fs_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = ("home_name", "away_name", "time_diff", "league_tier", "sport")
    counts = scoring.pattern_counts(_order_pairs(spark, sf_dir).withColumn("league_id", F.lit("all")))
    return counts.select(*[F.col(c).cast("tinyint").alias(c) for c in levels], "n")


@query()
def fs_em_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that expectation-maximisation fits on all order pairs."""
    model = scoring.fit(_order_pairs(spark, sf_dir))
    rows = [(f, k, float(model.match[i][k]), float(model.other[i][k])) for i, f in enumerate(scoring.fixed.FS_FIELDS) for k in range(3)]
    return spark.createDataFrame(rows, "field string, level int, m double, u double")


@query(
    f"""WITH {_SQL_SIDES}, p AS (SELECT user_id, s_time - t_time AS gap FROM s JOIN t USING (user_id) WHERE abs(s_time - t_time) <= 21600),
m AS (SELECT user_id, trunc(quantile_cont(gap, 0.5))::BIGINT AS "offset", count(*) AS n FROM p GROUP BY 1)
SELECT user_id, "offset", n, trunc(quantile_cont(abs(gap - "offset"), 0.5))::BIGINT AS mad, n >= 3 AS valid FROM p JOIN m USING (user_id) GROUP BY ALL"""
)
def offset_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    pairs = blocking.time_window_join(s, t, ["user_id"], "s_time", "t_time", 21600)
    return scoring.offsets(pairs.select("user_id", (F.col("s_time") - F.col("t_time")).alias("gap")), ["user_id"]).select("user_id", "offset", "n", "mad", "valid")


# --- blocking ----------------------------------------------------------------------------------------------------------


@query(
    """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding, e.embedding)::DOUBLE AS score FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id)
SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, id) AS rank FROM p) WHERE rank <= 5"""
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors with the same label of every vector whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("x"))
    found = blocking.dense_top_k(e.filter("id % 20 = 0"), e, 5, block=("label",))
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query()
def dense_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors, whatever their label, of every vector whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    found = blocking.dense_top_k(e.filter("id % 20 = 0"), e, 5)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query()
def graph_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the five nearest of all vectors by the graph index; recall against the exact scan is measured in the tests."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    found = graph_index.search(vectors.filter("id % 20 = 0"), graph_index.build(vectors), 5)
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, unnest([p_name[i:i+2] FOR i IN range(1, len(p_name) - 1)]) AS gram FROM n),
h AS (SELECT p_name, ((xor((((xor(((xor(197, ord(gram[1])) * 147) & 255), ord(gram[2]))) * 147) & 255), ord(gram[3])) * 147) & 255)::INT AS bucket FROM g),
c AS (SELECT p_name, bucket, count(*)::DOUBLE AS tf FROM h GROUP BY ALL)
SELECT p_name, bucket, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY p_name)), 6) AS weight FROM c"""
)
def trigram_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return blocking.encode(names, "p_name", "p_name").withColumn("weight", F.round("weight", 6))


@query(
    """WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, unnest([p_name[i:i+2] FOR i IN range(1, len(p_name) - 1)]) AS gram FROM n),
h AS (SELECT p_name, ((xor((((xor(((xor(197, ord(gram[1])) * 147) & 255), ord(gram[2]))) * 147) & 255), ord(gram[3])) * 147) & 255)::INT AS bucket FROM g),
c AS (SELECT p_name, bucket, count(*)::DOUBLE AS tf FROM h GROUP BY ALL),
e AS (SELECT p_name, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY p_name)) AS weight FROM c),
s AS (SELECT a.p_name AS query_id, b.p_name AS id, round(sum(a.weight * b.weight), 6) AS score FROM e a JOIN e b USING (bucket) GROUP BY ALL)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""
)
def trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    e = blocking.encode(names, "p_name", "p_name")
    found = blocking.top_k(e.toDF("query_id", "bucket", "weight"), e.toDF("id", "bucket", "weight"), [], 10, digits=6)
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


# --- scans and state ---------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.first_rows(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations are home teams and suppliers' nations away teams of one league."""
    side = lambda name, column, x: table(spark, sf_dir, name).select(
        F.lit("all").alias("tournament_id"), F.lit("sr").alias("source"), *[F.when(F.lit(x == y), F.col(column).cast("string")).otherwise("").alias(f"{y}_{part}") for y in ("home", "away") for part in ("id", "name")]
    )
    teams_ = sources.team_names(side("customer", "c_nationkey", "home").unionByName(side("supplier", "s_nationkey", "away")))
    return teams_.select(F.col("id").cast("int").alias("nation"))


@query(
    """SELECT c_custkey AS k, 'orders' AS origin FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def anti_join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"))
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("origin")).distinct()
    ordered = ordered.join(customers, "k", "left_semi")
    return reports.merge_truth(ordered, customers, ["k"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_extract_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return parsed.select("event_id", F.explode("m").alias("name", "k")).filter("name = 'k'").select("event_id", "k")


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def count_distinct_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT doc_id FROM documents WHERE n_chars >= 500), t AS (SELECT doc_id FROM labels WHERE quality = 1),
c AS (SELECT (SELECT count(*) FROM p SEMI JOIN t USING (doc_id)) AS tp, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM t) AS n_true)
SELECT tp, n_predicted, n_true, round(tp / n_predicted, 6) AS "precision", round(tp / n_true, 6) AS recall, round(2 * tp / (n_predicted + n_true), 6) AS f1 FROM c"""
)
def prf_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = table(spark, sf_dir, "documents").filter("n_chars >= 500").select("doc_id")
    truth = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    rows = reports.precision_recall(predicted, truth, ["doc_id"])
    return rows.select("tp", "n_predicted", "n_true", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.newest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 3).select("user_id", "event_id")


@query(
    f"""WITH v AS (SELECT user_id AS src, event_type AS dst, count(*) AS votes, max({EPOCH}) AS last_seen FROM events GROUP BY ALL)
SELECT src::VARCHAR AS src_id, dst AS ts_id, votes, last_seen FROM v WHERE votes >= 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY votes DESC, last_seen DESC, dst) = 1"""
)
def alias_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' two halves merged as alias votes, and the best alias of each source."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("src_id"), F.col("event_type").alias("ts_id"), F.expr(SECONDS).alias("last_seen"))

    def half(keep: Column) -> DataFrame:
        rows = e.filter(keep).groupBy("src_id", "ts_id").agg(F.count("*").alias("votes"), F.max("last_seen").alias("last_seen"))
        return rows.select(F.lit("team").alias("side"), "src_id", "ts_id", F.lit("football").alias("sport"), "votes", F.lit(1.0).alias("confidence"), "last_seen", F.lit("learned").alias("origin"))

    odd = F.col("event_id") % 2 == 1
    return state.best_aliases(state.upsert(half(odd), half(~odd))).select("src_id", "ts_id", "votes", "last_seen")


@query(
    """WITH p AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS geo, a <> b AS veto FROM p"""
)
def place_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    # nation names are one word but for the underscore, which normalising makes a space: compare the number alone
    bare = lambda c: F.regexp_replace(c, "_", "")
    pairs = n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey")
    return pairs.select("a", "b", geo.geo_similarity(bare("a"), bare("b")).alias("geo"), geo.location_veto(bare("a"), bare("b")).alias("veto"))


@query()
def greedy_with_alias_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full matcher: users are leagues, event types and parts of the hour stand for teams."""
    return events.match_events(*_as_games(spark, sf_dir))


def _as_games(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("sec", F.expr(SECONDS))
    row = lambda kinds, shift: e.filter(F.col("event_type").isin(*kinds)).select(
        F.col("user_id").cast("string").alias("league_id"),
        F.col("event_id").cast("string").alias("event_id"),
        (F.col("sec") + shift).alias("start_unix"),
        F.concat(F.lit("h"), F.col("sec") % 7).alias("home_id"),
        F.concat(F.lit("Team "), F.col("sec") % 7).alias("home_name"),
        F.concat(F.lit("a"), F.col("sec") % 5).alias("away_id"),
        F.concat(F.lit("Club "), F.col("sec") % 5).alias("away_name"),
    )
    return row(["click", "signup"], 0), row(["view", "purchase"], 600)


# --- which leagues and events a run is about -------------------------------------------------------------------------------


@query(
    """SELECT DISTINCT c_custkey AS tournament_id, c_name AS name, coalesce(n_name, '') AS location
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2 WHERE c_nationkey % 5 = 2 OR c_nationkey = 3 AND c_acctbal > 5000"""
)
def sport_leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    sport = F.when((F.col("c_nationkey") % 5 == 2) | ((F.col("c_nationkey") == 3) & (F.col("c_acctbal") > 5000)), 2).otherwise(0)
    leagues_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tournament_id"), F.col("c_name").alias("name"), sport.alias("sport_id"), F.col("c_nationkey").alias("category_id"))
    categories = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("sport_id"))
    return selections.leagues_of_sport(leagues_, categories, "2")


@query(
    """WITH n AS (SELECT o_custkey AS id, count(DISTINCT o_orderkey) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1),
r AS (SELECT id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, CAST(id AS VARCHAR)) AS place, c_mktsegment AS s FROM n JOIN customer ON id = c_custkey),
t AS (SELECT id FROM r WHERE s = 'BUILDING' AND place <= 20 OR s = 'MACHINERY' AND place <= 10),
h AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 AND c_mktsegment <> 'HOUSEHOLD'),
m AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 480000)
SELECT CAST(c_custkey AS VARCHAR) AS tournament_id, c_name AS name, c_mktsegment AS sport_id, c_nationkey AS category_id, coalesce(n_name, '') AS category_name,
c_custkey IN (SELECT id FROM h) AS is_hot, c_custkey IN (SELECT id FROM m) AS has_mapping, coalesce(n, 0) AS event_count
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN n ON n.id = c_custkey
WHERE c_custkey IN (SELECT id FROM h UNION SELECT id FROM m UNION SELECT id FROM t)"""
)
def target_league_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    leagues_ = customer.select(F.col("c_custkey").alias("tournament_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sport_id"), F.col("c_nationkey").alias("category_id"))
    categories = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("name"))
    events_ = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("tournament_id"), F.col("o_orderdate").cast("string").alias("scheduled"))
    hot = customer.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("tournament_id"), (F.col("c_mktsegment") == "HOUSEHOLD").alias("is_deleted"))
    mapped = orders.filter("o_totalprice > 480000").select(F.col("o_custkey").alias("tournament_id"))
    return selections.target_leagues(hot, mapped, leagues_, categories, events_, "1997", {"BUILDING": 20, "MACHINERY": 10})


@query(
    """WITH e AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_suppkey AS tournament_id, epoch_us(l_shipdate) // 1000000 AS start_unix, l_returnflag AS home_id, l_linestatus AS away_id FROM lineitem),
r AS (SELECT e.*, row_number() OVER (PARTITION BY tournament_id, home_id, away_id ORDER BY start_unix, id) AS n FROM e
WHERE (tournament_id, home_id, away_id) IN (SELECT (s_suppkey, 'R', 'F') FROM supplier UNION SELECT (s_suppkey, 'A', 'O') FROM supplier WHERE s_acctbal > 0))
SELECT id, tournament_id, start_unix, home_id, away_id FROM r WHERE n <= 5"""
)
def team_pair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))")
    events_ = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_suppkey").alias("tournament_id"),
        start.alias("start_unix"), F.col("l_returnflag").alias("home_id"), F.col("l_linestatus").alias("away_id"),
    )
    pair = lambda df, home, away: df.select(F.col("s_suppkey").alias("tournament_id"), F.lit(home).alias("home_id"), F.lit(away).alias("away_id"))
    supplier = table(spark, sf_dir, "supplier")
    return selections.events_of_pairs(events_, pair(supplier, "R", "F").unionByName(pair(supplier.filter("s_acctbal > 0"), "A", "O")))


# --- offsets, validation and stores on columns of like shape ---------------------------------------------------------------

_SQL_NAMED = f"""s AS (SELECT user_id, event_id AS s_id, {EPOCH} AS s_time FROM events WHERE event_type = 'click'),
t AS (SELECT user_id, event_id AS t_id, {EPOCH} AS t_time FROM events WHERE event_type = 'signup'),
p AS (SELECT user_id, s_id, t_id, t_time - s_time AS gap, ((s_id * 7 + t_id * 13) % 20) / 20 AS name FROM s JOIN t USING (user_id)),
a AS (SELECT user_id, s_id, any_value(t_id) AS t_id, any_value(gap) AS gap FROM p WHERE name >= 0.85 GROUP BY ALL HAVING count(*) = 1 AND abs(any_value(gap)) <= 604800)"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and signups of a user as source and target events whose names are alike to a degree that follows from their ids."""
    s, t = _timed(spark, sf_dir, "click", "s"), _timed(spark, sf_dir, "signup", "t")
    pairs = s.join(t, "user_id").withColumn("name", ((F.col("s_id") * 7 + F.col("t_id") * 13) % 20) / 20)
    return scoring.anchors(pairs.select(F.col("user_id").alias("league_id"), F.col("s_id").alias("s"), F.col("t_id").alias("t"), (F.col("t_time") - F.col("s_time")).alias("gap"), "name"))


@query()
def aligned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest monotone alignment of each user's clicks and signups."""
    s, t = _timed(spark, sf_dir, "click", "s"), _timed(spark, sf_dir, "signup", "t")
    name = ((F.col("s_id") * 7 + F.col("t_id") * 13) % 20) / 20
    pairs = s.join(t, "user_id").select(F.col("user_id").cast("string").alias("league_id"), F.col("s_id").cast("string").alias("s"), "s_time", F.col("t_id").cast("string").alias("t"), "t_time", name.alias("name"))
    return alignment.align_leagues(pairs)


@query()
def evidence_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one resolution of all scored edges between clicks and views of a user."""
    s, t = _sides(spark, sf_dir)
    pairs = blocking.time_window_join(s, t, ["user_id"], "s_time", "t_time", 21600)
    near = timing.gaussian_time(F.abs(F.col("s_time") - F.col("t_time")), 3600)
    edges = pairs.select(F.col("s_id").cast("string").alias("event_id"), F.col("t_id").cast("string").alias("target_id"), F.lit("").alias("competition_id"), timing.round3(0.7 + 0.3 * near).alias("score"))
    return evidence.resolve(edges, 0.70)[0]


@query(f"WITH {_SQL_NAMED} SELECT user_id, s_id, t_id, gap FROM a")
def offset_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchors(spark, sf_dir).select(F.col("league_id").alias("user_id"), F.col("s").alias("s_id"), F.col("t").alias("t_id"), "gap")


@query(
    f"""WITH {_SQL_NAMED}, m AS (SELECT user_id, trunc(quantile_cont(gap, 0.5))::BIGINT AS o, count(*) AS n FROM a GROUP BY 1),
d AS (SELECT user_id, o, n, trunc(quantile_cont(abs(gap - o), 0.5))::BIGINT AS mad FROM a JOIN m USING (user_id) GROUP BY ALL),
u AS (SELECT user_id, o FROM d WHERE n >= 3 AND mad <= 200000 AND abs(o) >= 300)
SELECT s_id, s_time + coalesce(o, 0) AS corrected, coalesce(o, 0) AS "offset" FROM s LEFT JOIN u USING (user_id)"""
)
def offset_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = scoring.offsets(_anchors(spark, sf_dir), ["league_id"])
    s = _timed(spark, sf_dir, "click", "s").select(F.col("user_id").alias("league_id"), "s_id", F.col("s_time").alias("start_unix"))
    return scoring.corrected(s, offsets, most_mad=200_000).select("s_id", F.col("start_unix").alias("corrected"), F.col("offset_applied").alias("offset"))


@query(
    """WITH r AS (SELECT o_custkey AS key, count(*) AS n_events, count(*) FILTER (o_orderstatus = 'F') / count(*) AS rcr FROM orders GROUP BY 1),
v AS (SELECT key, n_events, rcr, CASE WHEN key % 10 = 0 THEN 'OVERRIDE' WHEN n_events < 5 THEN 'INSUFFICIENT' WHEN rcr < 0.3 THEN 'SUSPECT' ELSE 'OK' END AS status FROM r)
SELECT key, n_events, status, CASE WHEN status = 'SUSPECT' THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence,
 CASE WHEN rcr >= 0.6 THEN 0.10 WHEN rcr >= 0.4 THEN 0.05 WHEN rcr >= 0.3 THEN 0.02 ELSE 0.0 END::DOUBLE AS bonus FROM v"""
)
def known_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are entries of a known map, the share of their finished orders is the reverse-confirm rate."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n_events"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("rcr"))
    overrides = rows.filter("key % 10 = 0").select("key")
    return state.validate_known(rows, overrides).select("key", "n_events", "status", "confidence", state.rcr_bonus(F.col("rcr")).alias("bonus"))


_SQL_VOTES = f"SELECT user_id AS src, event_type AS dst, count(*) AS votes, max({EPOCH}) AS last_seen, CASE WHEN user_id % 5 = 0 AND event_type = 'view' THEN 'manual' ELSE 'learned' END AS origin FROM events GROUP BY ALL"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("sec", F.expr(SECONDS))
    rows = e.groupBy("user_id", "event_type").agg(F.count("*").alias("votes"), F.max("sec").alias("last_seen"))
    origin = F.when((F.col("user_id") % 5 == 0) & (F.col("event_type") == "view"), "manual").otherwise("learned")
    return rows.select(F.lit("league").alias("side"), F.col("user_id").cast("string").alias("src_id"), F.col("event_type").alias("ts_id"), F.lit("football").alias("sport"), "votes", F.lit(1.0).alias("confidence"), "last_seen", origin.alias("origin"))


@query(f"WITH v AS ({_SQL_VOTES}), x AS (SELECT max(last_seen) AS last FROM v) SELECT src::VARCHAR AS src_id, dst AS ts_id, votes, last_seen FROM v, x WHERE NOT (votes = 1 AND last_seen < last - 864000)")
def alias_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _votes(spark, sf_dir)
    last = rows.agg(F.max("last_seen")).first()[0]
    return state.prune(rows, last, days=10).select("src_id", "ts_id", "votes", "last_seen")


@query(
    f"""WITH v AS ({_SQL_VOTES}) SELECT src::VARCHAR AS src_id, dst AS ts_id, origin, votes FROM v WHERE origin = 'manual' OR votes >= 2
QUALIFY row_number() OVER (PARTITION BY src ORDER BY origin = 'manual' DESC, votes DESC, last_seen DESC, dst) = 1"""
)
def league_alias_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.best_league_aliases(_votes(spark, sf_dir)).select("src_id", "ts_id", "origin", "votes")


@query(
    """WITH l AS (SELECT o_custkey AS key, o_orderkey AS seq, o_orderdate AS day, (o_orderkey % 101) / 100 AS rcr,
 CASE WHEN o_orderkey % 7 = 0 THEN 'OVERRIDE' WHEN o_orderkey % 7 = 1 THEN 'INSUFFICIENT' WHEN o_orderkey % 101 < 30 THEN 'SUSPECT' ELSE 'OK' END AS status FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC, seq DESC) AS r FROM l WHERE status IN ('SUSPECT', 'OK'))
SELECT key, round(avg(rcr), 6) AS mean_rcr, bool_or(r = 1 AND status = 'SUSPECT') AS suspect FROM n WHERE r <= 10 GROUP BY key"""
)
def recent_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "OVERRIDE").when(k % 7 == 1, "INSUFFICIENT").when(k % 101 < 30, "SUSPECT").otherwise("OK")
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), k.alias("seq"), F.col("o_orderdate").alias("at"), (k % 101 / 100).alias("rcr"), status.alias("status"))
    return state.recent_mean(log).select("key", F.round("mean_rcr", 6).alias("mean_rcr"), "suspect")


@query(
    """WITH p AS (SELECT lang, doc_id FROM documents WHERE n_chars >= 500), t AS (SELECT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
c AS (SELECT lang, count(*) FILTER (p.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(p.doc_id) AS np, count(t.doc_id) AS nt FROM p FULL JOIN t USING (lang, doc_id) GROUP BY lang),
s AS (SELECT nt, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS pr, CASE WHEN nt > 0 THEN tp / nt ELSE 0 END AS rc FROM c)
SELECT round(sum(pr * nt) / sum(nt), 6) AS "precision", round(sum(rc * nt) / sum(nt), 6) AS recall,
 round(sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * nt) / sum(nt), 6) AS f1 FROM s"""
)
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages are leagues; long documents are predicted to be good ones."""
    d = table(spark, sf_dir, "documents")
    truth = d.join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select("lang", "doc_id")
    scores = reports.precision_recall(d.filter("n_chars >= 500").select("lang", "doc_id"), truth, ["doc_id"], ["lang"])
    mean = reports.weighted_means(scores, "n_true")
    return mean.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def offline_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline evaluator's matcher on the events of :func:`greedy_with_alias_learning`."""
    source, target = _as_games(spark, sf_dir)
    return offline.match_offline(source, target)


# --- levels, vetoes, shares and report tables on columns of like shape -------------------------------------------------------


def _pick(values: list, at: Column) -> Column:
    """One of ``values``, by a number from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


@query(
    f"""WITH {_SQL_SIDES}, p AS (SELECT s_id, t_id, abs(s_time - t_time) AS gap, ((s_id * 7 + t_id * 13) % 21) / 20 AS name, (s_id + t_id) % 3 = 0 AS rev, (s_id + t_id) % 2 = 0 AS strong
FROM s JOIN t USING (user_id)),
l AS (SELECT *, exp(-(gap * gap) / (2.0 * 3600 * 3600)) AS n1, exp(-(gap * gap) / (2.0 * 10800 * 10800)) AS n2, exp(-(gap * gap) / (2.0 * 43200 * 43200)) AS n4 FROM p),
o AS (SELECT *, CASE WHEN gap <= 21600 AND name >= 0.4 AND 0.3 * n1 + 0.7 * name >= 0.5 THEN 0.3 * n1 + 0.7 * name END AS s1,
CASE WHEN gap <= 32400 AND name >= 0.65 AND 0.15 * n2 + 0.85 * name >= 0.6 THEN 0.15 * n2 + 0.85 * name END AS s2, CASE WHEN gap <= 86400 AND name >= 0.75 THEN name END AS s3 FROM l),
b AS (SELECT *, greatest(s1, s2, s3) AS best FROM o),
r AS (SELECT s_id, t_id, CASE WHEN best IS NOT NULL THEN CASE WHEN s1 = best THEN 'EVENT_L1' WHEN s2 = best THEN 'EVENT_L2' ELSE 'EVENT_L3' END
WHEN strong AND name >= 0.85 AND gap <= 259200 THEN 'EVENT_L4' WHEN NOT rev AND name >= 0.9 AND gap <= 2592000 THEN 'EVENT_L5' END AS rule,
coalesce(best, CASE WHEN strong AND name >= 0.85 AND gap <= 259200 THEN 0.8 + 0.1 * n4 ELSE name END) AS score FROM b)
SELECT s_id, t_id, rule, round(score, 6) AS score FROM r WHERE rule IS NOT NULL"""
)
def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    pairs = s.join(t, "user_id").withColumn("name", ((F.col("s_id") * 7 + F.col("t_id") * 13) % 21) / 20)
    both = F.col("s_id") + F.col("t_id")
    level = evidence.best_level(F.col("name"), F.abs(F.col("s_time") - F.col("t_time")), both % 3 == 0, both % 2 == 0)
    return pairs.withColumn("_l", level).filter("_l IS NOT NULL").select("s_id", "t_id", "_l.rule", F.round("_l.score", 6).alias("score"))


_COMPETITIONS = ["", "league", "league", "cup", "reserve", "regional_league", "short_format", "draft", "all_star", "super_cup", "playoff", "", "league"]


def _features(k: Column) -> Column:
    return F.struct(
        _pick(["", "", "women", "men"], k % 4).alias("gender"), _pick(["", "", "", "", "u19", "u21"], F.floor(k / 2) % 6).alias("age_group"),
        _pick(["", "", "", "", "", "north"], F.floor(k / 3) % 6).alias("region"), _pick(_COMPETITIONS, k % 13).alias("comp_type"), _pick([0, 0, 1, 2], F.floor(k / 5) % 4).alias("tier_number"),
    )


@query(
    f"""WITH k AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem),
f AS (SELECT a, b, ['', '', 'women', 'men'][1 + a % 4] AS ag, ['', '', 'women', 'men'][1 + b % 4] AS bg, ['', '', '', '', 'u19', 'u21'][1 + a // 2 % 6] AS aa, ['', '', '', '', 'u19', 'u21'][1 + b // 2 % 6] AS ba,
['', '', '', '', '', 'north'][1 + a // 3 % 6] AS ar, ['', '', '', '', '', 'north'][1 + b // 3 % 6] AS br, {_COMPETITIONS}[1 + a % 13] AS ac, {_COMPETITIONS}[1 + b % 13] AS bc,
[0, 0, 1, 2][1 + a // 5 % 4] AS a_tier, [0, 0, 1, 2][1 + b // 5 % 4] AS b_tier FROM k)
SELECT a, b, CASE WHEN (ag = 'women') <> (bg = 'women') THEN 'gender_conflict' WHEN aa <> ba THEN 'age_conflict' WHEN ar <> br THEN 'region_conflict'
WHEN (ac = 'short_format') <> (bc = 'short_format') THEN 'short_format_conflict'
WHEN ac IN ('cup', 'super_cup') AND bc = 'league' OR bc IN ('cup', 'super_cup') AND ac = 'league' THEN 'competition_type_conflict'
WHEN ac = 'reserve' AND bc IN ('league', 'cup', 'super_cup', 'regional_league') OR bc = 'reserve' AND ac IN ('league', 'cup', 'super_cup', 'regional_league') THEN 'competition_type_conflict'
WHEN ac = 'regional_league' AND bc = 'league' OR bc = 'regional_league' AND ac = 'league' THEN 'competition_type_conflict'
WHEN (ac = 'draft') <> (bc = 'draft') OR (ac = 'all_star') <> (bc = 'all_star') THEN 'competition_type_conflict'
WHEN a_tier > 0 AND b_tier > 0 AND a_tier <> b_tier THEN 'tier_number_conflict' END AS veto,
round(CASE WHEN ag <> '' AND bg <> '' AND ag <> bg THEN 0.0 ELSE 1.0 END * CASE WHEN aa <> '' AND ba <> '' AND aa <> ba THEN 0.3 ELSE 1.0 END
* CASE WHEN ac = 'reserve' AND bc = '' OR bc = 'reserve' AND ac = '' THEN 0.5 ELSE 1.0 END * CASE WHEN ac = 'regional_league' AND bc = '' OR bc = 'regional_league' AND ac = '' THEN 0.7 ELSE 1.0 END, 6)::DOUBLE AS penalty FROM f"""
)
def league_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    read = pairs.withColumn("x", _features(F.col("a"))).withColumn("y", _features(F.col("b")))
    return read.select("a", "b", features.league_veto(F.col("x"), F.col("y")).alias("veto"), F.round(features.feature_penalty(F.col("x"), F.col("y")), 6).alias("penalty"))


@query(
    """SELECT c_custkey AS id, ['', 'women', 'women', 'men'][1 + c_custkey % 4] AS gender, ['', 'u21', 'u19', 'youth'][1 + c_custkey // 4 % 4] AS age_group,
['', 'northeast', 'south', 'central'][1 + c_custkey // 16 % 4] AS region, ['league', 'cup', 'super_cup', 'playoff', 'friendly', 'short_format', ''][1 + c_custkey % 7] AS comp_type FROM customer"""
)
def league_feature_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    words = [
        _pick(["Premier", "Women", "Ladies'", "Boys"], k % 4), _pick(["", "U21", "Under-19", "Youth"], F.floor(k / 4) % 4), _pick(["", "North East", "Southern", "Ceńtral"], F.floor(k / 16) % 4),
        _pick(["League", "CUP", "Super Cup", "Playoff", "Friendly", "Futsal", "Group"], k % 7),
    ]
    read = table(spark, sf_dir, "customer").select(k.alias("id"), features.league_features(F.concat_ws(" ", *words)).alias("f"))
    return read.select("id", "f.gender", "f.age_group", "f.region", "f.comp_type")


_SQL_SHARES = """p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS id, l_returnflag = 'R' AS hit FROM lineitem),
o AS (SELECT s, count(DISTINCT id) FILTER (hit) / count(DISTINCT id) AS overlap FROM p GROUP BY 1),
ob AS (SELECT s, overlap, (CASE WHEN overlap >= 0.6 THEN 0.15 WHEN overlap >= 0.4 THEN 0.08 WHEN overlap >= 0.2 THEN 0.03 ELSE 0 END)::DOUBLE AS bonus FROM o)"""


def _team_players(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as the players of suppliers, and those returned as the matched ones."""
    rows = table(spark, sf_dir, "lineitem")
    found = rows.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("player_id"))
    return rows.select(F.col("l_suppkey").alias("team_id"), F.col("l_partkey").alias("id")), found


@query(f"WITH {_SQL_SHARES} SELECT s, round(overlap, 6) AS overlap, bonus FROM ob")
def player_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams.player_overlap(*_team_players(spark, sf_dir)).withColumn("overlap", F.round("overlap", 6))


@query(
    f"""WITH {_SQL_SHARES}, e AS (SELECT o_orderkey AS id, o_custkey % 97 AS home_id, o_custkey * 7 % 97 AS away_id, o_orderstatus <> 'P' AS matched, (o_orderkey % 80) / 100 + 0.2 AS confidence FROM orders)
SELECT id, matched, CASE WHEN matched THEN floor(least(1.0, confidence + (coalesce(h.bonus, 0) + coalesce(a.bonus, 0)) / 2) * 1000 + 0.5) / 1000 ELSE confidence END AS confidence
FROM e LEFT JOIN ob h ON h.s = home_id LEFT JOIN ob a ON a.s = away_id"""
)
def raised_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    confidence = (F.col("o_orderkey") % 80) / 100 + 0.2
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (k % 97).alias("home_id"), (k * 7 % 97).alias("away_id"), (F.col("o_orderstatus") != "P").alias("matched"), confidence.alias("confidence"))
    mapped = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.lit(0.5).alias("confidence"))
    return teams.propagate(mapped, rows, teams.player_overlap(*_team_players(spark, sf_dir)))[1].select("id", "matched", "confidence")


@query(
    """WITH p AS (SELECT DISTINCT s_nationkey AS id, l_suppkey AS s, l_partkey AS player, l_returnflag = 'R' AS hit FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
q AS (SELECT id, s, player, max(hit::INT) AS hit FROM p GROUP BY ALL), r AS (SELECT id, sum(hit) / count(*) AS rate FROM q GROUP BY 1),
l AS (SELECT n_nationkey AS id, (n_nationkey % 10) / 20 + 0.5 AS confidence, CASE WHEN n_nationkey % 3 = 0 THEN 'LEAGUE_NAME_HI' ELSE 'LEAGUE_NAME_MED' END AS rule FROM nation)
SELECT id, rule, CASE WHEN rule = 'LEAGUE_NAME_MED' AND rate IS NOT NULL THEN
floor(greatest(0, least(1, confidence + CASE WHEN rate >= 0.6 THEN 0.05 WHEN rate >= 0.4 THEN 0 WHEN rate >= 0.3 THEN -0.03 ELSE -0.08 END)) * 1000 + 0.5) / 1000 ELSE confidence END AS confidence FROM l LEFT JOIN r USING (id)"""
)
def leagues_fed_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rule = F.when(k % 3 == 0, "LEAGUE_NAME_HI").otherwise("LEAGUE_NAME_MED")
    leagues_ = table(spark, sf_dir, "nation").select(k.alias("id"), F.lit("").alias("competition_id"), ((k % 10) / 20 + 0.5).alias("confidence"), rule.alias("rule"))
    mapped = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("league_id"), F.col("s_suppkey").alias("s"))
    return teams.feed_back(leagues_, teams.league_player_rates(*_team_players(spark, sf_dir), mapped)).select("id", "rule", "confidence")


@query(
    """WITH r AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') / count(*) AS rate FROM orders GROUP BY 1)
SELECT id, CASE WHEN rate >= 0.6 THEN 'HIGH' WHEN rate >= 0.4 THEN 'MEDIUM' WHEN rate >= 0.3 THEN 'LOW' ELSE 'FAIL' END AS level,
(CASE WHEN rate >= 0.6 THEN 0.1 WHEN rate >= 0.4 THEN 0.05 WHEN rate >= 0.3 THEN 0.02 ELSE 0 END)::DOUBLE AS bonus FROM r"""
)
def reverse_rate_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("rate"))
    return rates.select("id", state.rcr_level(F.col("rate")).alias("level"), state.rcr_bonus(F.col("rate")).alias("bonus"))


@query(
    """WITH l AS (SELECT o_orderkey AS id, list_filter([o_orderkey % 11 / 10 - 0.3, o_custkey % 7 / 5 - 0.4, o_custkey % 3 / 2 - 0.5], lambda x: x > 0) AS good, o_orderdate AS d, o_custkey AS k, o_orderpriority AS p FROM orders)
SELECT id, round(CASE WHEN len(good) > 0 THEN least(1.0, list_sum(good) / len(good)) ELSE 0 END, 6)::DOUBLE AS prior,
CASE WHEN k % 9 = 0 THEN 'unknown' ELSE strftime(make_timestamp(k * 8640000 * 1000000), '%Y-%m-%d') END AS born,
CASE WHEN id % 5 = 4 THEN 0 ELSE epoch_us(d) // 1000000 END AS seconds, ['football', 'basketball', 'tennis', 'unknown'][1 + k % 4] AS sport FROM l WHERE k > 0"""
)
def scalar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of positive scores, birthdays kept as seconds, times in several formats, sports by provider ids."""
    k, n, d = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderdate")
    shown = F.when(n % 5 == 4, "soon").when(n % 5 == 3, F.date_format(d, "yyyy-MM-dd")).when(n % 5 == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    born = F.when(k % 9 == 0, "unknown").otherwise((k * 8640000).cast("string"))
    return table(spark, sf_dir, "orders").filter(k > 0).select(
        n.alias("id"), F.round(text.normalize_prior(n % 11 / 10 - 0.3, k % 7 / 5 - 0.4, k % 3 / 2 - 0.5), 6).alias("prior"), timing.dob_of_seconds(born).alias("born"),
        timing.parse_iso(shown, strip_zone=True).alias("seconds"), timing.sport_of(_pick(["6046", "48242", "54094", "7"], k % 4), "ls").alias("sport"),
    )


@query("SELECT floor((o_orderkey % 97) / 96 / 0.1::DOUBLE)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1")
def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = reports.score_histogram(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97 / 96).alias("score")))
    return bins.select(F.round(F.col("bin") * 10).cast("long").alias("bin"), F.col("count").alias("n"))


@query(
    "WITH r AS (SELECT o_orderstatus AS status, ['"
    + "', '".join([*reports.RULES, "EVENT_NO_MATCH"])
    + "'][1 + o_orderkey % 8] AS rule FROM orders) SELECT status, "
    + ", ".join(f"count(*) FILTER (rule = '{r}') AS {r.lower()}" for r in [*reports.RULES, "EVENT_NO_MATCH"])
    + " FROM r GROUP BY 1"
)
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*reports.RULES, "EVENT_NO_MATCH"]
    counts = reports.rule_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), _pick(rules, F.col("o_orderkey") % 8).alias("rule")), ["status"])
    return counts.select("status", *[F.col(r).alias(r.lower()) for r in rules])


@query(
    """WITH n AS (SELECT c_custkey AS id, ['Winner of ', 'WQF', 'Loser R', 'Winners ', ' wsf ', 'Team '][1 + c_custkey % 6] || c_name AS slot,
lower(replace(c_name, '#', ' ')) || [' 2026', ' 25/26', ' cup [2] (x)', ' 20261'][1 + c_custkey % 4] AS league FROM customer)
SELECT id, regexp_matches(lower(trim(slot)), '^(wqf|wsf|winner r|winner of|loser r|loser of)') AS placeholder,
array_to_string(list_filter(string_split_regex(translate(league, '()[]', '    '), '\\s+'), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]{4}|[0-9]+/[0-9]+')), ' ') AS league FROM n"""
)
def slots_and_league_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    slot = F.concat(_pick(["Winner of ", "WQF", "Loser R", "Winners ", " wsf ", "Team "], k % 6), F.col("c_name"))
    league = F.concat(F.translate("c_name", "#", "_"), _pick([" 2026", " 25/26", "-Cup [2] (x)", ". 20261"], k % 4))
    return table(spark, sf_dir, "customer").select(k.alias("id"), text.is_placeholder(slot).alias("placeholder"), text.normalize_league_name(league).alias("league"))


@query(
    f"""WITH {_SQL_PAIRS}, w AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM pairs),
f AS (SELECT a, b, [x] || CASE WHEN len(x) > 2 THEN [[x[1], x[-1]]] ELSE [] END AS p, [y] || CASE WHEN len(y) > 2 THEN [[y[1], y[-1]]] ELSE [] END AS q FROM w),
m AS (SELECT a, b, unnest(p) AS x, q FROM f), n AS (SELECT a, b, x, unnest(q) AS y FROM m)
SELECT a, b, round(max(len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(list_concat(x, y)))), 6) AS similarity FROM n GROUP BY a, b"""
)
def player_name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(text.player_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))
