"""Queries on labels, evaluation, hashes, merges and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempolane.operators import evaluation as E
from tempolane.operators import hashing as H
from tempolane.operators import merging as M
from tempolane.plans import features as P
from tempolane.registry import query
from tempolane.sources.domain import domain, eligible


@query("bt_labels", """
SELECT entry_id, result_status IN ('FINISHED', 'TIED') AND coalesce(rank = 1, false) AS is_win, result_status IN ('FINISHED', 'TIED') AND coalesce(rank <= 2, false) AS is_top2, result_status IN ('FINISHED', 'TIED') AND coalesce(rank <= 3, false) AS is_top3 FROM target
""")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries)
    return e.select("entry_id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in E.labels(F.col("result_status"), F.col("rank")).items()))


REASONS_SQL = """
, g AS (SELECT race_id, any_value(entrants) AS entrants, count(*) AS n, count(DISTINCT player_id) AS players, count(player_id) AS known, count(score) AS scores, count(*) FILTER (score <= 0) AS bad, any_value(race_status) AS race_status,
  count(*) FILTER (rank = 1) AS winners, count(*) FILTER (result_status NOT IN ('FINISHED', 'TIED')) AS abnormal FROM target GROUP BY race_id),
rr AS (SELECT race_id, concat_ws(',', CASE WHEN n <> entrants THEN 'ENTRY_COUNT_MISMATCH' END, CASE WHEN players < known THEN 'DUPLICATE_PLAYER' END, CASE WHEN known < n THEN 'PLAYER_UNRESOLVED' END, CASE WHEN scores < n THEN 'SCORE_MISSING' END,
  CASE WHEN bad > 0 THEN 'SCORE_NON_POSITIVE' END, CASE WHEN race_status NOT IN ('CONFIRMED', 'CORRECTED') THEN 'RESULT_UNCONFIRMED' END, CASE WHEN winners = 0 THEN 'NO_WINNER' END) AS reasons, abnormal = 0 AS all_finished FROM g)
"""


@query("bt_race_exclusions", REASONS_SQL + " SELECT * FROM rr")
def _(spark, sf_dir):
    return E.race_reasons(eligible(domain(spark, sf_dir).entries))


@query("bt_rank_baseline", REASONS_SQL + """
, u AS (SELECT t.*, all_finished, rank() OVER (PARTITION BY race_id ORDER BY score DESC) AS sr FROM target t JOIN rr USING (race_id) WHERE reasons = ''),
r AS (SELECT race_id, year(race_date) AS year, all_finished, max(CAST(sr = 1 AND coalesce(rank = 1, false) AS INT)) AS hit1, max(CAST(sr <= 3 AND coalesce(rank = 1, false) AS INT)) AS hit3, count(*) FILTER (sr = 1) AS n1, count(*) FILTER (sr <= 3) AS n3 FROM u GROUP BY ALL),
c AS (SELECT *, 'OPERATIONAL' AS cohort FROM r UNION ALL SELECT *, 'NORMAL_FINISH' FROM r WHERE all_finished)
SELECT year, cohort, count(*) AS races, round(avg(hit1), 9) AS rank1_hit_rate, round(avg(hit3), 9) AS top3_hit_rate, round(avg(n1), 9) AS mean_set1, round(avg(n3), 9) AS mean_set3 FROM c GROUP BY year, cohort
""")
def _(spark, sf_dir):
    out = E.hit_rates(eligible(domain(spark, sf_dir).entries))
    return out.select("year", "cohort", "races", *(P.r9(F.col(c)).alias(c) for c in ("rank1_hit_rate", "top3_hit_rate", "mean_set1", "mean_set3")))


@query("bt_score_metrics", """
, x AS (SELECT year(race_date) AS year, score / 100 AS p, CAST(result_status IN ('FINISHED', 'TIED') AND rank <= 3 AS INT) AS y FROM target WHERE score > 0),
r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY p) + (count(*) OVER (PARTITION BY year, p) - 1) / 2.0 AS ar FROM x)
SELECT year, round((sum(ar) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * CAST(count(*) FILTER (y = 0) AS DOUBLE)), 9) AS auc, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives,
  round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS log_loss, round(avg((p - y) * (p - y)), 9) AS brier FROM r GROUP BY year
""")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries).where("score > 0").select(F.year("race_date").alias("year"), (F.col("score") / 100).alias("p"), F.coalesce(E.labels(F.col("result_status"), F.col("rank"))["is_top3"].cast("int"), F.lit(0)).alias("y"))
    loss = e.groupBy("year").agg(P.r9(F.avg(E.log_loss(F.col("p"), F.col("y")))).alias("log_loss"), P.r9(F.avg((F.col("p") - F.col("y")) ** 2)).alias("brier"))
    return E.auc(e, ["year"], "p", "y").withColumn("auc", P.r9(F.col("auc"))).join(loss, "year")


@query("bt_effect_bins", """
, x AS (SELECT year(race_date) AS year, score AS v, CAST(coalesce(rank = 1, false) AS INT) AS y FROM target WHERE score > 0),
q AS (SELECT year, unnest([quantile_cont(v, 0.1), quantile_cont(v, 0.2), quantile_cont(v, 0.3), quantile_cont(v, 0.4), quantile_cont(v, 0.5), quantile_cont(v, 0.6), quantile_cont(v, 0.7), quantile_cont(v, 0.8), quantile_cont(v, 0.9)]) AS cut FROM x GROUP BY year),
d AS (SELECT DISTINCT year, cut FROM q),
b AS (SELECT x.year, x.v, x.y, 1 + (SELECT count(*) FROM d WHERE d.year = x.year AND d.cut < x.v) AS bin FROM x)
SELECT year, bin, count(*) AS n, round(avg(y), 9) AS win_rate, round(min(v), 9) AS least, round(max(v), 9) AS most FROM b GROUP BY year, bin
""")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries).where("score > 0").select(F.year("race_date").alias("year"), F.col("score").alias("v"), F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0)).alias("y"))
    out = E.assign_bins(e, E.decile_bins(e, ["year"], "v"), ["year"], "v")
    return out.groupBy("year", "bin").agg(F.count(F.lit(1)).alias("n"), P.r9(F.avg("y")).alias("win_rate"), P.r9(F.min("v")).alias("least"), P.r9(F.max("v")).alias("most"))


_ROW = "sha256(CAST(to_json({'bike': bike, 'frame': frame, 'player_id': player_id, 'rank': rank, 'score': printf('%.17e', CAST(score AS DOUBLE))}) AS VARCHAR))"
_SHORT = "sha256(CAST(to_json({'entry_id': entry_id, 'rank': rank}) AS VARCHAR))"


def tree_sql(source: str, key: str) -> str:
    """The tree of fingerprints of ``source`` (key, h): leaves of four digits, then two, then the key."""
    return f"""
l4 AS (SELECT {key}, substr(h, 1, 4) AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM {source} GROUP BY {key}, substr(h, 1, 4)),
l2 AS (SELECT {key}, substr(p, 1, 2) AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h, sum(n) AS n FROM l4 GROUP BY {key}, substr(p, 1, 2)),
fp AS (SELECT {key}, CAST(sum(n) AS BIGINT) AS row_count, sha256(string_agg(h, chr(10) ORDER BY p)) AS fingerprint FROM l2 GROUP BY {key})"""


@query("hash_row_fingerprints", f"SELECT entry_id, {_ROW} AS row_hash FROM target")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries)
    return e.select("entry_id", H.row_hash(e, ["score", "rank", "player_id", "frame", "bike"]).alias("row_hash"))


@query("hash_manifest_by_year", f", h AS (SELECT year(race_date) AS year, {_SHORT} AS h FROM target), {tree_sql('h', 'year')} SELECT * FROM fp")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries).withColumn("year", F.year("race_date"))
    return H.fingerprints(e, ["year"], ["entry_id", "rank"])


@query("hash_manifest_by_class", f"""
, h AS (SELECT substr(race_type, 1, 2) AS class, year(race_date) AS year, {_SHORT} AS h FROM target), {tree_sql('h', 'class, year')}
SELECT class, count(*) AS parts, CAST(sum(row_count) AS BIGINT) AS row_count, sha256(string_agg(fingerprint, chr(10) ORDER BY year)) AS manifest FROM fp GROUP BY class
""")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries).withColumns({"year": F.year("race_date"), "class": F.substring("race_type", 1, 2)})
    return H.manifest(H.fingerprints(e, ["class", "year"], ["entry_id", "rank"]), ["class"], ["year"])


@query("hash_nested_rows", f"""
, k AS (SELECT race_id, list({{'bike': bike, 'rank': rank, 'score': printf('%.17e', score)}} ORDER BY bike) AS l, any_value(entrants) AS entrants FROM target GROUP BY race_id)
SELECT race_id, sha256(CAST(to_json({{'list': l, 'names': map_from_entries([('a', entrants), ('b', NULL)]), 'nest': {{'a': {{'x': 1, 'y': CASE WHEN race_id % 2 = 0 THEN printf('%.17e', 0.125::DOUBLE) END}}, 'race_id': race_id}}}}) AS VARCHAR)) AS h, true AS same FROM k
""")
def _(spark, sf_dir):
    """Hashes of nested rows, and whether they stay when keys of structs and maps come in another order at every depth."""
    e = eligible(domain(spark, sf_dir).entries)
    nest = lambda *fields: F.struct(*fields).alias("nest")
    eighth, one = F.when(F.col("race_id") % 2 == 0, 0.125).alias("y"), F.lit(1).alias("x")
    shapes = []
    for turn in (False, True):
        fields = ["bike", "rank", "score"][:: -1 if turn else 1]
        order = lambda *x: x[::-1] if turn else x  # noqa: B023, E731
        listed = F.transform(F.array_sort(F.collect_list(F.struct("bike", F.struct(*fields).alias("x")))), lambda v: v["x"]).alias("list")
        g = e.groupBy("race_id").agg(listed, F.first("entrants").alias("entrants"))
        names = F.create_map(*(v for k in order("a", "b") for v in (F.lit(k), F.col("entrants") if k == "a" else F.lit(None).cast("long")))).alias("names")
        rows = g.select("race_id", names, "list", nest(*order(F.struct(*order(one, eighth)).alias("a"), F.col("race_id"))))
        shapes.append(rows.select("race_id", H.row_hash(rows, order("list", "names", "nest")).alias("h" if not turn else "t")))
    return shapes[0].join(shapes[1], "race_id").select("race_id", "h", (F.col("h") == F.col("t")).alias("same"))


def ordered_sql(source: str, scope: str, columns: str) -> str:
    """The ordered tree over ``source`` (scope, race_id, entry_id, line), by position of races: leaves, nodes of 1,000, nodes of those."""
    return f"""
lf AS (SELECT {scope} AS scope, race_id, sha256(string_agg(line, chr(10) ORDER BY entry_id)) AS h, count(*) AS rows FROM {source} GROUP BY ALL), nb AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY race_id) - 1 AS place FROM lf),
o1 AS (SELECT scope, place // 1000 AS place, sha256(string_agg(h, chr(10) ORDER BY place)) AS h, sum(rows) AS rows, count(*) AS groups FROM nb GROUP BY scope, place // 1000),
o2 AS (SELECT scope, place // 1000 AS place, sha256(string_agg(h, chr(10) ORDER BY place)) AS h, sum(rows) AS rows, sum(groups) AS groups FROM o1 GROUP BY scope, place // 1000)
SELECT {columns}, CAST(sum(groups) AS BIGINT) AS groups, CAST(sum(rows) AS BIGINT) AS row_count, sha256(string_agg(h, chr(10) ORDER BY place)) AS manifest FROM o2 GROUP BY scope"""


def _lines(values: str) -> str:
    return f"sha256(CAST(to_json({{{values}}}) AS VARCHAR))"


@query("hash_prediction_manifests", REASONS_SQL + f"""
, tot AS (SELECT race_id, sum(score) AS total FROM target JOIN rr USING (race_id) WHERE reasons = '' GROUP BY race_id),
pb AS (SELECT t.race_id, t.entry_id, year(race_date) AS year, CAST(coalesce(rank = 1, false) AS INT) AS label, score / total AS baseline, score / total * 0.5 + 0.5 / CAST(entrants AS DOUBLE) AS incremental FROM target t JOIN tot USING (race_id)),
ln AS (SELECT 'WF_' || year || '/BASELINE' AS model, race_id, entry_id, {_lines("'entry_id': entry_id, 'p': replace(printf('%.8e', round(baseline, 9)), 'e', '000000000e'), 'race_id': race_id")} AS line FROM pb
 UNION ALL SELECT 'WF_' || year || '/INCREMENTAL', race_id, entry_id, {_lines("'entry_id': entry_id, 'p': replace(printf('%.8e', round(incremental, 9)), 'e', '000000000e'), 'race_id': race_id")} FROM pb
 UNION ALL SELECT 'WF_' || year || '/OUTCOME', race_id, entry_id, {_lines("'entry_id': entry_id, 'label': label, 'race_id': race_id")} FROM pb),
{ordered_sql("ln", "model", "scope AS model")}
""")
def _(spark, sf_dir):
    """Manifest of each model's published predictions (nine digits) and of each year's outcomes, in order of race and entry."""
    from tempolane.catalog.backtest import predictions

    rows = predictions(spark, sf_dir)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), P.r9(F.col(k.lower())).alias("p")) for k in ("BASELINE", "INCREMENTAL"))))
    made = rows.withColumn("k", kinds).select(F.concat_ws("/", "scope", "k.kind").alias("model"), "race_id", "entry_id", "k.p")
    seen = rows.select(F.concat_ws("/", "scope", F.lit("OUTCOME")).alias("model"), "race_id", "entry_id", "label")
    one = H.ordered_fingerprints(made, "model", "race_id", ["entry_id"], ["race_id", "entry_id", "p"])
    return one.unionByName(H.ordered_fingerprints(seen, "model", "race_id", ["entry_id"], ["race_id", "entry_id", "label"]))


@query("hash_player_chains", """
, h AS (SELECT player_id, start_at, race_id, entry_id, sha256(CAST(to_json({'entry_id': entry_id, 'rank': rank}) AS VARCHAR)) AS h FROM hist WHERE normal AND player_id IS NOT NULL)
SELECT player_id, count(*) AS events, list_reduce(list_prepend('', list(h ORDER BY start_at, race_id, entry_id)), lambda x, y: sha256(x || y)) AS chain FROM h GROUP BY player_id
""")
def _(spark, sf_dir):
    h = domain(spark, sf_dir).history.where("normal AND player_id IS NOT NULL")
    return H.chain(h.withColumn("h", H.row_hash(h, ["entry_id", "rank"])), ["player_id"], ["start_at", "race_id", "entry_id"], "h")


@query("hash_input", f"""
, c AS (SELECT entry_id, player_id, sha256(CAST(to_json({{'cutoff': cutoff, 'entry_id': entry_id, 'player_id': player_id}}) AS VARCHAR)) AS context_hash, cutoff FROM target),
h AS (SELECT player_id, start_at, race_id, entry_id, {_SHORT} AS h FROM hist WHERE player_id IS NOT NULL), l AS (SELECT player_id, list(h ORDER BY start_at, race_id, entry_id) AS l FROM h GROUP BY player_id),
k AS (SELECT c.entry_id, any_value(context_hash) AS context_hash, any_value(c.player_id) AS player_id, count(h.h) AS k FROM c LEFT JOIN h ON h.player_id = c.player_id AND h.start_at < c.cutoff GROUP BY c.entry_id),
s AS (SELECT entry_id, context_hash, k, CASE WHEN k = 0 THEN '' ELSE list_reduce(list_prepend('', l[1:k]), lambda x, y: sha256(x || y)) END AS history_hash FROM k LEFT JOIN l USING (player_id))
SELECT entry_id, context_hash, k AS events, history_hash, sha256(context_hash || history_hash) AS input_hash FROM s
""")
def _(spark, sf_dir):
    d = domain(spark, sf_dir)
    e = eligible(d.entries)
    past = d.history.withColumn("h", H.row_hash(d.history, ["entry_id", "rank"]))
    return H.input_hashes(e, past, ["cutoff", "entry_id", "player_id"])


@query("hash_drift", f"""
, a AS (SELECT year(race_date) AS year, {_SHORT} AS h FROM target), b AS (SELECT year, h FROM a WHERE year <> 1997 UNION ALL SELECT 2050, h FROM a WHERE year = 1997)
SELECT year, CASE year WHEN 2050 THEN 'ADDED' ELSE 'REMOVED' END AS change FROM (VALUES (1997), (2050)) v(year)
""")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries).withColumn("year", F.year("race_date"))
    after = e.withColumn("year", F.when(F.col("year") == 1997, 2050).otherwise(F.col("year")))
    one, two = (H.fingerprints(x, ["year"], ["entry_id", "rank"]) for x in (e, after))
    return H.drift(one, two, ["year"]).select("year", "change")


@query("merge_upsert_customers", """
WITH n AS (SELECT o_custkey AS c_custkey, CASE WHEN max(o_totalprice) > 300000 THEN NULL ELSE max(o_totalprice) END AS bal, 'SEEN' AS seg FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey)
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, round(coalesce(bal, c_acctbal), 9) AS c_acctbal, CASE WHEN n.c_custkey IS NOT NULL THEN seg ELSE c_mktsegment END AS c_mktsegment FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey
""", cte=False)
def _(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    top = read("orders").where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    new = top.select("c_custkey", F.when(F.col("m") <= 300000, F.col("m")).alias("c_acctbal"), F.lit("SEEN").alias("c_mktsegment"))
    out = M.upsert(read("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), new, ["c_custkey"], keep_when_null=["c_acctbal"])
    return out.withColumn("c_acctbal", P.r9(F.col("c_acctbal")))


@query("merge_snapshots", """
SELECT o_custkey, sha256(o_orderpriority) AS content, min(o_orderkey) AS first_seen, max(o_orderkey) AS last_seen, count(*) AS times_seen FROM orders GROUP BY ALL
""", cte=False)
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.sha2("o_orderpriority", 256).alias("content"))
    return M.snapshots(o, ["o_custkey"], "content", "o_orderkey")


@query("report_status_by_year", """
SELECT year(race_date) AS year, race_status, count(*) AS entries, count(*) FILTER (score IS NULL) AS missing_scores, count(*) FILTER (score = 0) AS zero_scores, count(DISTINCT race_id) AS races, count(*) FILTER (player_id IS NULL) AS unresolved FROM target GROUP BY ALL
""")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries)
    return e.groupBy(F.year("race_date").alias("year"), "race_status").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("score").isNull()).alias("missing_scores"), F.count_if(F.col("score") == 0).alias("zero_scores"), F.countDistinct("race_id").alias("races"), F.count_if(F.col("player_id").isNull()).alias("unresolved"))


@query("report_duplicate_players", """
SELECT race_id, player_id, count(*) AS times FROM target WHERE player_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
""")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries).where("player_id IS NOT NULL")
    return e.groupBy("race_id", "player_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


