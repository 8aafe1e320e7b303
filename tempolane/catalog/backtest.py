"""Walk-forward evaluation queries: folds, exclusions, paired metrics, effects, models; and their SQL.

The bootstrap queries over closed-form predictions (a score's share of its race's scores, and the mean of that and an even share)
can be stated in SQL; those over fitted models are tested against plain loops. All run the full number of replicates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempolane.catalog.signals import career_signals, position_signal
from tempolane.catalog.tables import REASONS_SQL, tree_sql
from tempolane.operators import bootstrap as B
from tempolane.operators import evaluation as E
from tempolane.operators import ridge as R
from tempolane.operators import validation as V
from tempolane.plans import features as P
from tempolane.registry import ORACLE_SQL, QUERIES, query
from tempolane.sources import sinks as S
from tempolane.sources.domain import domain, eligible
from tempolane.storage import materialise, parts, shared_dir, stored

BOOTSTRAP = B.ITERATIONS
YEARS, FIRST = (1998, 1999, 2000), 1996
TARGETS = ("is_win", "is_top2", "is_top3")
_ROLES = [(f"WF_{y}", role, a, b) for y in YEARS for role, a, b in (("TRAIN", FIRST, y - 1), ("INNER_FIT", FIRST, y - 2), ("INNER_VALIDATION", y - 1, y - 1), ("EVALUATION", y, y))]
_FOLDS_SQL = f", f(fold, role, a, b) AS (VALUES {', '.join(map(str, _ROLES))})"


@query("bt_folds", _FOLDS_SQL + """
SELECT fold, role, a AS first_year, b AS last_year, count(DISTINCT race_id) AS races, count(*) AS entries, b <= 2000 AS before_holdout FROM f JOIN target ON year(race_date) BETWEEN a AND b GROUP BY ALL
""")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries)
    f = E.folds(spark, YEARS, FIRST)
    E.guard_holdout(max(YEARS))
    joined = e.join(F.broadcast(f), F.year("race_date").between(F.col("first_year"), F.col("last_year")))
    return joined.groupBy("fold", "role", "first_year", "last_year").agg(F.countDistinct("race_id").alias("races"), F.count(F.lit(1)).alias("entries")).withColumn("before_holdout", F.col("last_year") <= E.HOLDOUT_AFTER)


@query("bt_exclusions_by_stage", REASONS_SQL + """
, y AS (SELECT race_id, any_value(year(race_date)) AS year FROM target GROUP BY race_id),
x AS (SELECT year, race_id, unnest(string_split(reasons, ',')) AS reason FROM rr JOIN y USING (race_id) WHERE reasons <> ''),
z AS (SELECT year, race_id, CASE WHEN reason IN ('RESULT_UNCONFIRMED', 'NO_WINNER') THEN 'LABEL' ELSE 'FEATURE' END AS stage, reason FROM x
  UNION ALL SELECT year, race_id, 'COHORT', 'ABNORMAL_RESULT' FROM rr JOIN y USING (race_id) WHERE reasons = '' AND NOT all_finished)
SELECT year, stage, reason, count(*) AS races FROM z GROUP BY ALL
""")
def _(spark, sf_dir):
    return E.exclusions(eligible(domain(spark, sf_dir).entries)).groupBy("year", "stage", "reason").agg(F.count(F.lit(1)).alias("races"))


@query("bt_coverage", REASONS_SQL + """
, y AS (SELECT race_id, any_value(year(race_date)) AS year FROM target GROUP BY race_id)
SELECT year, count(*) AS target_races, count(*) FILTER (reasons = '') AS evaluated_races, round(count(*) FILTER (reasons = '') / CAST(count(*) AS DOUBLE), 9) AS coverage FROM rr JOIN y USING (race_id) GROUP BY year
""")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries)
    year = e.groupBy("race_id").agg(F.first(F.year("race_date")).alias("year"))
    out = E.race_reasons(e).join(year, "race_id").groupBy("year").agg(F.count(F.lit(1)).alias("target_races"), F.count_if(F.col("reasons") == "").alias("evaluated_races"))
    return out.withColumn("coverage", P.r9(F.col("evaluated_races") / F.col("target_races")))


@query("bt_outcome_snapshot", """
SELECT year(race_date) AS year, race_id, any_value(entrants) AS entrants, any_value(race_status) AS race_status, count(*) AS results, string_agg(bike || ':' || coalesce(CAST(rank AS VARCHAR), '-') || ':' || result_status, ',' ORDER BY bike) AS outcome,
  count(*) = any_value(entrants) AND any_value(entrants) BETWEEN 5 AND 9 AND count(DISTINCT bike) = count(*) AND count(DISTINCT start_at) = 1 AS consistent FROM target GROUP BY ALL
""")
def _(spark, sf_dir):
    return E.outcome_snapshot(eligible(domain(spark, sf_dir).entries))


@query("bt_snapshot_rows", """
, q AS (SELECT * FROM target WHERE race_status = 'CONFIRMED')
SELECT DISTINCT t.race_id, r.race_date, r.entrants, r.race_status, q.bike, q.rank, q.result_status FROM target t JOIN (SELECT DISTINCT race_id, race_date, entrants, race_status FROM target) r USING (race_id) LEFT JOIN q ON q.race_id = t.race_id
""")
def _(spark, sf_dir):
    """All target races with context, and the results of confirmed ones: races without results keep a row."""
    e = eligible(domain(spark, sf_dir).entries)
    races = e.select("race_id", "race_date", "entrants", "race_status").distinct()
    return E.snapshot_rows(e, races, e.where("race_status = 'CONFIRMED'").select("race_id", "bike", "rank", "result_status"))


_FEATURE_ROWS = """
, f0 AS ({stat01}), s0 AS (SELECT entry_id, score FROM ({labels})),
ft AS (SELECT race_id, entry_id, CASE WHEN race_id % 43 = 0 AND bike = 2 THEN 1 ELSE bike END AS bike, status, quality, score, score_rank, CASE WHEN entry_id % 611 = 0 THEN NULL WHEN entry_id % 499 = 0 THEN cutoff + 100000 ELSE cutoff END AS input_as_of FROM f0 JOIN s0 USING (entry_id) UNION ALL
  SELECT race_id, entry_id, bike, status, quality, score, score_rank, cutoff FROM f0 JOIN s0 USING (entry_id) WHERE race_id % 47 = 0 AND bike = 1),
fr AS (SELECT race_id, any_value(entrants) AS entrants, any_value(start_at) AS start_at, any_value(race_status) AS race_status FROM target GROUP BY race_id),
rs AS (SELECT race_id, concat_ws(',', CASE WHEN count(*) <> any_value(entrants) THEN 'FEATURE_RESULT_COUNT_MISMATCH' END, CASE WHEN count(DISTINCT entry_id) < count(*) THEN 'FEATURE_DUPLICATE_ENTRY' END, CASE WHEN count(DISTINCT bike) < count(*) THEN 'FEATURE_DUPLICATE_BIKE' END,
  CASE WHEN bool_or(status <> 'VALID') THEN 'FEATURE_STATUS_NOT_VALID' END, CASE WHEN bool_or(quality <> 'FULL') THEN 'FEATURE_QUALITY_NOT_FULL' END, CASE WHEN bool_or(score IS NULL) THEN 'FEATURE_SCORE_UNAVAILABLE' END, CASE WHEN bool_or(score IS NULL OR score <= 0) THEN 'FEATURE_SCORE_NON_POSITIVE' END,
  CASE WHEN bool_or(score_rank IS NULL) THEN 'FEATURE_RANK_MISSING' END, CASE WHEN bool_or(input_as_of IS NULL) THEN 'FEATURE_INPUT_AS_OF_MISSING' END, CASE WHEN bool_or(coalesce(input_as_of > start_at, false)) THEN 'FEATURE_INPUT_AS_OF_AFTER_START' END) AS reasons FROM fr JOIN ft USING (race_id) GROUP BY race_id)
"""


def _feature_sql() -> str:
    return _FEATURE_ROWS.replace("{stat01}", ORACLE_SQL["stat01_group_relative"]).replace("{labels}", ORACLE_SQL["bt_labels"].replace("SELECT entry_id,", "SELECT entry_id, score,"))


def feature_rows(spark, sf_dir) -> DataFrame:
    """Features of the rank baseline with faults: bikes and entries twice, moments that are missing or too late. Written once for an
    application, as predictions, reasons and cohorts all read them."""
    return stored(spark, sf_dir, "rank-features", lambda: _feature_rows(spark, sf_dir))


def _feature_rows(spark, sf_dir) -> DataFrame:
    score = eligible(domain(spark, sf_dir).entries).select("entry_id", "score")
    rows = QUERIES["stat01_group_relative"](spark, sf_dir).join(score, "entry_id").select("race_id", "entry_id", "bike", "status", "quality", "score", "score_rank", "cutoff")
    late = F.when(F.col("entry_id") % 611 == 0, None).when(F.col("entry_id") % 499 == 0, F.col("cutoff") + 100000).otherwise(F.col("cutoff"))
    bike = F.when((F.col("race_id") % 43 == 0) & (F.col("bike") == 2), 1).otherwise(F.col("bike"))
    own = rows.withColumns({"input_as_of": late, "bike": bike}).drop("cutoff")
    return own.unionByName(rows.where("race_id % 47 = 0 AND bike = 1").withColumnRenamed("cutoff", "input_as_of"))


def eligibility(spark, sf_dir) -> DataFrame:
    """Reasons against each race, written once for an application."""
    return stored(spark, sf_dir, "rank-eligibility", lambda: E.feature_reasons(feature_rows(spark, sf_dir), race_rows(spark, sf_dir)))


def race_rows(spark, sf_dir) -> DataFrame:
    return eligible(domain(spark, sf_dir).entries).select("race_id", "entrants", "start_at", "race_status").distinct()


@query("bt_feature_eligibility", _feature_sql() + " SELECT race_id, reasons FROM rs")
def _(spark, sf_dir):
    return eligibility(spark, sf_dir)


@query("bt_rank_predictions", _feature_sql() + """
SELECT race_id, entry_id, bike, score, score_rank, score_rank = 1 AS rank1_set, score_rank <= 3 AS top3_set,
  sha256(CAST(to_json({'entry_id': entry_id, 'race_id': race_id, 'rank1_set': score_rank = 1, 'score': printf('%.17e', CAST(score AS DOUBLE)), 'score_rank': score_rank, 'top3_set': score_rank <= 3}) AS VARCHAR)) AS prediction_hash FROM ft JOIN rs USING (race_id) WHERE reasons = ''
""")
def _(spark, sf_dir):
    """Predictions of eligible races: sets by rank, with a hash of each row."""
    good = eligibility(spark, sf_dir).where("reasons = ''").select("race_id")
    return E.rank_predictions(feature_rows(spark, sf_dir).join(good, "race_id"))


@query("bt_cohort_decisions", _feature_sql() + """
, pr AS (SELECT race_id, bike, score_rank = 1 AS r1, score_rank <= 3 AS r3 FROM ft JOIN rs USING (race_id) WHERE reasons = ''),
lb AS (SELECT race_id, bike, result_status, CASE WHEN race_id % 53 = 0 AND bike = 2 THEN NULL ELSE rank END AS rank FROM target WHERE NOT (race_id % 59 = 0 AND bike = 1)),
lg AS (SELECT race_id, count(*) AS n, count(*) FILTER (result_status IN ('FINISHED', 'TIED') AND rank = 1) AS w, count(*) FILTER (result_status IN ('FINISHED', 'TIED') AND rank IS NULL) AS u, count(*) FILTER (result_status NOT IN ('FINISHED', 'TIED') OR rank IS NULL) AS a FROM lb GROUP BY race_id),
pg AS (SELECT pr.race_id, bool_or(r1 AND w.bike IS NOT NULL) AS h1, bool_or(r3 AND w.bike IS NOT NULL) AS h3, count(*) FILTER (r1) AS s1, count(*) FILTER (r3) AS s3 FROM pr LEFT JOIN (SELECT DISTINCT race_id, bike FROM lb WHERE result_status IN ('FINISHED', 'TIED') AND rank = 1) w ON w.race_id = pr.race_id AND w.bike = pr.bike GROUP BY pr.race_id),
cd AS (SELECT race_id, cohort, h1, h3, s1, s3, a, concat_ws(',', CASE WHEN race_status <> 'CONFIRMED' THEN 'LABEL_RACE_NOT_CONFIRMED' END, CASE WHEN coalesce(n, 0) <> entrants THEN 'LABEL_RESULT_COUNT_MISMATCH' END, CASE WHEN coalesce(w, 0) = 0 THEN 'LABEL_NO_WINNER' END, CASE WHEN coalesce(u, 0) > 0 THEN 'LABEL_FINISHED_RANK_MISSING' END) AS r
  FROM fr LEFT JOIN lg USING (race_id) LEFT JOIN pg USING (race_id), (VALUES ('OPERATIONAL'), ('NORMAL_FINISH')) c(cohort)),
ce AS (SELECT *, CASE WHEN r <> '' THEN r WHEN cohort = 'NORMAL_FINISH' AND a > 0 THEN 'LABEL_ABNORMAL_RESULT_PRESENT' ELSE '' END AS reasons FROM cd)
SELECT race_id, cohort, reasons = '' AS included, reasons, CASE WHEN reasons = '' THEN coalesce(h1, false) END AS rank1_hit, CASE WHEN reasons = '' THEN coalesce(h3, false) END AS top3_hit, CASE WHEN reasons = '' THEN coalesce(s1, 0) END AS rank1_set_size, CASE WHEN reasons = '' THEN coalesce(s3, 0) END AS top3_set_size FROM ce
""")
def _(spark, sf_dir):
    """Both cohorts' decision on every race, with labels of which some lack a finisher's rank or a row."""
    labels = eligible(domain(spark, sf_dir).entries).where("NOT (race_id % 59 = 0 AND bike = 1)").select("race_id", "bike", "result_status", F.when(~((F.col("race_id") % 53 == 0) & (F.col("bike") == 2)), F.col("rank")).alias("rank"))
    return E.cohort_decisions(race_rows(spark, sf_dir), QUERIES["bt_rank_predictions"](spark, sf_dir), labels)


@query("audit_replay_values", """
, y AS (SELECT DISTINCT year(race_date) AS y FROM target), b AS (SELECT 'WF_' || y AS scope, y, unnest(range(1, 6)) AS bin FROM y)
SELECT scope, CASE WHEN y % 5 = 0 THEN 1 ELSE 0 END AS missing, CASE WHEN y % 5 = 1 THEN 3 ELSE 0 END AS unknown, CASE WHEN y % 5 = 2 THEN 1 ELSE 0 END AS repeated, CASE WHEN y % 5 = 3 THEN 1 ELSE 0 END AS differing_bins, CASE WHEN y % 5 = 4 THEN 1 ELSE 0 END AS differing_means FROM b GROUP BY scope, y
""")
def _(spark, sf_dir):
    """Effects of five bins for each year and label, each year with one kind of fault."""
    y = eligible(domain(spark, sf_dir).entries).select(F.year("race_date").alias("y")).distinct().withColumn("scope", F.concat(F.lit("WF_"), F.col("y").cast("string")))
    bins = y.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(5))))
    kind, one, two = F.col("y") % 5, F.col("label") == TARGETS[0], F.col("bin") == 2
    effects = bins.withColumn("label", F.explode(F.array(*map(F.lit, TARGETS)))).where(~((kind == 0) & one & two))
    effects = effects.withColumn("times", F.when((kind == 2) & one & two, 2).otherwise(1)).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times"))))
    stray = y.where("y % 5 = 1").withColumn("label", F.explode(F.array(*map(F.lit, TARGETS)))).withColumn("bin", F.lit(0))
    effects = effects.select("y", "scope", "label", "bin").unionByName(stray.select("y", "scope", "label", "bin"))
    values = effects.withColumns({"identity": F.concat_ws("/", "bin", F.when((kind == 3) & one & two, "other").otherwise("same")), "overall_mean": F.when((kind == 4) & one & two, 0.25).otherwise(0.5)})
    return V.replay_faults(values, bins, y.where("false"), TARGETS)


def predictions(spark, sf_dir, **more: Column) -> DataFrame:
    """Entries of usable races with label and two closed-form predictions; also the value that effects are cut by, and ``more``."""
    e = eligible(domain(spark, sf_dir).entries)
    usable = e.join(E.race_reasons(e).where("reasons = ''").select("race_id"), "race_id")
    total = usable.groupBy("race_id").agg(F.sum("score").alias("total"))
    share = F.col("score") / F.col("total")
    out = usable.join(total, "race_id").select("race_id", "entry_id", F.year("race_date").alias("year"), F.col("score").alias("v"), F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0)).alias("label"), share.alias("baseline"), (share * 0.5 + F.lit(0.5) / F.col("entrants")).alias("incremental"), *(c.alias(n) for n, c in more.items()))
    return out.withColumn("scope", F.concat(F.lit("WF_"), F.col("year").cast("string")))


_PREDICTIONS = REASONS_SQL + """
, tot AS (SELECT race_id, sum(score) AS total FROM target JOIN rr USING (race_id) WHERE reasons = '' GROUP BY race_id),
pb AS (SELECT t.race_id, t.entry_id, year(race_date) AS year, 'WF_' || year(race_date) AS scope, score AS v, CAST(coalesce(rank = 1, false) AS INT) AS label, score / total AS baseline, score / total * 0.5 + 0.5 / CAST(entrants AS DOUBLE) AS incremental FROM target t JOIN tot USING (race_id)),
ev AS (SELECT *, -CASE WHEN label = 1 THEN ln(baseline) ELSE ln(1 - baseline) END AS lb, -CASE WHEN label = 1 THEN ln(incremental) ELSE ln(1 - incremental) END AS li, (baseline - label) * (baseline - label) AS bb, (incremental - label) * (incremental - label) AS bi FROM pb WHERE year IN (1998, 1999, 2000))
"""


def _draws_sql(races: str) -> str:
    """Weights of places in the replicates of each scope of ``races`` (scope, race_id), by the closed form of the stream."""
    return f"""
, pl AS (SELECT scope, race_id, row_number() OVER (PARTITION BY scope ORDER BY race_id) - 1 AS place FROM {races}),
sz AS (SELECT scope, count(*) AS n FROM pl GROUP BY scope),
lo AS (SELECT list(a ORDER BY j) AS l FROM (WITH RECURSIVE p(j, a) AS (SELECT 0, CAST(1 AS BIGINT) UNION ALL SELECT j + 1, a * {B.A} % {B.M} FROM p WHERE j < 2047) SELECT * FROM p)),
hi AS (SELECT list(a ORDER BY j) AS h FROM (WITH RECURSIVE p(j, a) AS (SELECT 0, CAST(1 AS BIGINT) UNION ALL SELECT j + 1, a * {pow(B.A, 2048, B.M)} % {B.M} FROM p WHERE j < (SELECT max(n) * {BOOTSTRAP} // 2048 + 1 FROM sz)) SELECT * FROM p)),
dk AS (SELECT scope, n, unnest(range(1, n * {BOOTSTRAP} + 1)) AS k FROM sz),
dr AS (SELECT scope, (k - 1) // n AS replicate, {B.SEED} * h[k // 2048 + 1] % {B.M} * l[k % 2048 + 1] % {B.M} % n AS place FROM dk, lo, hi),
dw AS (SELECT scope, replicate, race_id, count(*) AS w FROM dr JOIN pl USING (scope, place) GROUP BY ALL)
"""


@query("bt_paired_metrics", _PREDICTIONS + _draws_sql("(SELECT DISTINCT scope, race_id FROM ev)") + """
, rs AS (SELECT scope, race_id, count(*) AS k, sum(lb) AS lb, sum(li) AS li, sum(bb) AS bb, sum(bi) AS bi FROM ev GROUP BY ALL),
rep AS (SELECT scope, replicate, (sum(w * li) - sum(w * lb)) / sum(w * k) AS dl, (sum(w * bi) - sum(w * bb)) / sum(w * k) AS db FROM dw JOIN rs USING (scope, race_id) GROUP BY ALL),
aw AS (SELECT scope, replicate, race_id, w FROM dw UNION ALL SELECT scope, -1, race_id, 1 FROM pl),
t1 AS (SELECT scope, replicate, baseline AS s, sum(w * label) AS p, sum(w * (1 - label)) AS n FROM aw JOIN ev USING (scope, race_id) GROUP BY ALL), t2 AS (SELECT scope, replicate, incremental AS s, sum(w * label) AS p, sum(w * (1 - label)) AS n FROM aw JOIN ev USING (scope, race_id) GROUP BY ALL),
u1 AS (SELECT *, sum(n) OVER (PARTITION BY scope, replicate ORDER BY s ROWS UNBOUNDED PRECEDING) - n AS below FROM t1), u2 AS (SELECT *, sum(n) OVER (PARTITION BY scope, replicate ORDER BY s ROWS UNBOUNDED PRECEDING) - n AS below FROM t2),
a1 AS (SELECT scope, replicate, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS one FROM u1 GROUP BY ALL), a2 AS (SELECT scope, replicate, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS two FROM u2 GROUP BY ALL),
au AS (SELECT * FROM a1 JOIN a2 USING (scope, replicate)),
pt AS (SELECT scope, sum(lb) / sum(k) AS lb, sum(li) / sum(k) AS li, sum(bb) / sum(k) AS bb, sum(bi) / sum(k) AS bi FROM rs GROUP BY scope),
al AS (SELECT scope, 'LOG_LOSS' AS metric, lb AS baseline, li AS incremental, quantile_cont(dl, 0.025) AS lo, quantile_cont(dl, 0.975) AS hi, count(dl) AS k FROM rep JOIN pt USING (scope) GROUP BY ALL
 UNION ALL SELECT scope, 'BRIER', bb, bi, quantile_cont(db, 0.025), quantile_cont(db, 0.975), count(db) FROM rep JOIN pt USING (scope) GROUP BY ALL
 UNION ALL SELECT scope, 'AUC', max(one) FILTER (replicate = -1), max(two) FILTER (replicate = -1), quantile_cont(two - one, 0.025) FILTER (replicate >= 0), quantile_cont(two - one, 0.975) FILTER (replicate >= 0), count(two - one) FILTER (replicate >= 0) FROM au GROUP BY scope)
SELECT scope, metric, round(baseline, 9) AS baseline, round(incremental, 9) AS incremental, round(incremental - baseline, 9) AS delta, round(lo, 9) AS ci_lower, round(hi, 9) AS ci_upper, k AS replicates FROM al
""")
def _(spark, sf_dir):
    out = B.paired_metrics(predictions(spark, sf_dir).where(F.col("year").isin(*YEARS)), BOOTSTRAP)
    return out.select("scope", "metric", *(P.r9(F.col(c)).alias(c) for c in ("baseline", "incremental", "delta", "ci_lower", "ci_upper")), "replicates")


def binned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Evaluation rows with the bin of their value, and all bins: deciles of the fold's training years."""
    rows = predictions(spark, sf_dir)
    fold = spark.createDataFrame([(f"WF_{y}", y) for y in YEARS], "scope string, y int")
    training = rows.drop("scope").join(F.broadcast(fold), (F.col("year") < F.col("y")) & (F.col("year") >= FIRST))
    bins = E.decile_bins(training, ["scope"], "v")
    return E.assign_bins(rows.where(F.col("year").isin(*YEARS)), bins, ["scope"], "v"), bins


_BINNED = _PREDICTIONS + """
, fo(scope, y) AS (VALUES ('WF_1998', 1998), ('WF_1999', 1999), ('WF_2000', 2000)),
cu AS (SELECT fo.scope, list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS c FROM pb JOIN fo ON year >= 1996 AND year < y GROUP BY fo.scope),
bn AS (SELECT scope, unnest(range(1, len(c) + 2)) AS bin FROM cu),
eb AS (SELECT ev.*, 1 + len(list_filter(c, lambda x: x < v)) AS bin FROM ev JOIN cu USING (scope))
"""


@query("bt_bin_effects", _BINNED + """
, eq AS (SELECT * EXCLUDE (scope), scope AS fold, scope || '#' || bin AS scope FROM eb)""" + _draws_sql("(SELECT DISTINCT scope, race_id FROM eq)") + """
, rs AS (SELECT scope, race_id, count(*) AS k, sum(label) AS pos, sum(label - baseline) AS br, sum(label - incremental) AS ir, sum(incremental - baseline) AS sh, sum(li - lb) AS ld, sum(bi - bb) AS bd FROM eq GROUP BY ALL),
rep AS (SELECT scope, replicate, sum(w * pos) / sum(w * k) AS o, sum(w * br) / sum(w * k) AS b, sum(w * ir) / sum(w * k) AS i, sum(w * sh) / sum(w * k) AS s, sum(w * ld) / sum(w * k) AS l, sum(w * bd) / sum(w * k) AS d FROM dw JOIN rs USING (scope, race_id) GROUP BY ALL),
ci AS (SELECT scope, """ + ", ".join(f"quantile_cont({c}, 0.025) AS {c}l, quantile_cont({c}, 0.975) AS {c}u" for c in "obisld") + """ FROM rep GROUP BY scope),
pt AS (SELECT scope, count(*) AS races, sum(k) AS k, sum(pos) / sum(k) AS o, sum(br) / sum(k) AS b, sum(ir) / sum(k) AS i, sum(sh) / sum(k) AS s, sum(ld) / sum(k) AS l, sum(bd) / sum(k) AS d FROM rs GROUP BY scope)
SELECT bn.scope, bn.bin, CASE WHEN pt.k IS NULL THEN 'NO_EVALUATION_ROWS' ELSE 'OBSERVED' END AS evaluation, CAST(coalesce(k, 0) AS BIGINT) AS rows, coalesce(races, 0) AS races, """ + ", ".join(f"round({c}, 9) AS {n}, round({c}l, 9) AS {n}_lower, round({c}u, 9) AS {n}_upper" for c, n in zip("obisld", B.EFFECTS, strict=True)) + """
FROM bn LEFT JOIN pt ON pt.scope = bn.scope || '#' || bn.bin LEFT JOIN ci ON ci.scope = pt.scope
""")
def _(spark, sf_dir):
    rows, bins = binned(spark, sf_dir)
    out = B.bin_effects(rows, bins, BOOTSTRAP)
    return out.select("scope", "bin", "evaluation", F.col("rows").cast("long").alias("rows"), "races", *(P.r9(F.col(f"{n}{e}")).alias(f"{n}{e}") for n in B.EFFECTS for e in ("", "_lower", "_upper")))


@query("bt_centred_residuals", _BINNED + _draws_sql("(SELECT DISTINCT scope, race_id FROM eb)") + f"""
, es AS (SELECT scope, bin, race_id, count(*) AS k, sum(label - baseline) AS r FROM eb GROUP BY ALL), rr2 AS (SELECT scope, race_id, sum(k) AS k, sum(r) AS r FROM es GROUP BY ALL),
ov AS (SELECT scope, replicate, sum(w * r) / sum(w * k) AS o FROM dw JOIN rr2 USING (scope, race_id) GROUP BY ALL), ow AS (SELECT scope, bin, replicate, sum(w * r) / sum(w * k) AS m FROM dw JOIN es USING (scope, race_id) GROUP BY ALL),
ci AS (SELECT scope, bin, quantile_cont(m - o, 0.025) AS lo, quantile_cont(m - o, 0.975) AS hi, count(*) AS valid FROM ow JOIN ov USING (scope, replicate) GROUP BY ALL),
om AS (SELECT scope, sum(r) / sum(k) AS o FROM es GROUP BY scope), pm AS (SELECT scope, bin, sum(r) / sum(k) AS m FROM es GROUP BY ALL),
st AS (SELECT bn.scope, bn.bin, o, m, lo, hi, coalesce(valid, 0) AS valid, CASE WHEN m IS NULL THEN 'NO_EVALUATION_ROWS' WHEN valid < {BOOTSTRAP} THEN 'SPARSE_BOOTSTRAP_UNSUPPORTED' ELSE 'AVAILABLE' END AS state FROM bn JOIN om USING (scope) LEFT JOIN pm USING (scope, bin) LEFT JOIN ci USING (scope, bin))
SELECT scope, bin, round(o, 9) AS overall_mean, round(m - o, 9) AS centred_mean, round(CASE WHEN state = 'AVAILABLE' THEN lo END, 9) AS ci_lower, round(CASE WHEN state = 'AVAILABLE' THEN hi END, 9) AS ci_upper, state, valid AS valid_replicates FROM st
""")
def _(spark, sf_dir):
    rows, bins = binned(spark, sf_dir)
    out = B.centred_residuals(rows, bins, BOOTSTRAP)
    return out.select("scope", "bin", *(P.r9(F.col(c)).alias(c) for c in ("overall_mean", "centred_mean", "ci_lower", "ci_upper")), "state", "valid_replicates")


@query("bt_category_bins", """
, x AS (SELECT year(race_date) AS year, race_type AS v, CAST(coalesce(rank = 1, false) AS INT) AS y FROM target), c AS (SELECT v, row_number() OVER (ORDER BY v) AS bin FROM (SELECT DISTINCT v FROM x WHERE year = 1996 AND v <> 'Ｓ級決勝'))
SELECT year, coalesce(bin, 0) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS wins FROM x LEFT JOIN c USING (v) GROUP BY ALL
""")
def _(spark, sf_dir):
    e = eligible(domain(spark, sf_dir).entries).select(F.year("race_date").alias("year"), F.col("race_type").alias("v"), F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0)).alias("y"), F.lit("all").alias("scope"))
    bins = E.category_bins(e.where("year = 1996 AND v <> 'Ｓ級決勝'"), ["scope"], "v")
    return E.assign_categories(e, bins, ["scope"], "v").groupBy("year", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("wins"))


@query("bt_standardised", _PREDICTIONS + """
, m AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM pb WHERE year BETWEEN 1996 AND 1997)
SELECT entry_id, round(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END, 9) AS z, round(m, 9) AS training_mean FROM pb, m WHERE year = 1998
""")
def _(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("g", F.lit(1))
    training = rows.where("year BETWEEN 1996 AND 1997")
    out = R.standardised(rows.where("year = 1998").withColumn("z", F.col("v")), training.withColumn("z", F.col("v")), ["g"], ["z"])
    return out.join(F.broadcast(training.agg(F.avg("v").alias("m")))).select("entry_id", P.r9(F.col("z")).alias("z"), P.r9(F.col("m")).alias("training_mean"))


#: The two kinds of models and their features: the baseline score, and a signal besides.
KINDS = {"BASELINE": ("s",), "INCREMENTAL": ("s", "t")}


def model_rows(spark, sf_dir) -> DataFrame:
    """Rows that all models share, one an entry, whatever the number of folds, roles, labels and kinds: (cell: the year, labels, s, t)."""
    marks = {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in E.labels(F.col("result_status"), F.col("rank")).items()}
    rows = predictions(spark, sf_dir, **marks).where(F.col("year").between(FIRST, max(YEARS)))
    return rows.select(F.col("year").alias("cell"), *TARGETS, F.log(F.col("baseline")).alias("s"), F.col("v").cast("double").alias("t"))


def year_models(moments: dict[int, R.Moments]) -> dict[str, list[R.Model]]:
    """Models of all folds, labels and kinds by role, standardised by their fold's training years."""
    none, out = R.Moments(0, np.zeros(2), np.zeros(2)), {}
    for fold, role, first, last in _ROLES:
        train = next((a, b) for f, r, a, b in _ROLES if f == fold and r == "TRAIN")
        known = sum((moments[y] for y in range(train[0], train[1] + 1) if y in moments), none)
        for target in TARGETS:
            for kind, features in KINDS.items():
                k = len(features)
                out.setdefault(role, []).append(R.Model(f"{fold}/{target}/{kind}", tuple(range(first, last + 1)), target, features, tuple(map(float, known.mean[:k])), tuple(map(float, known.deviation[:k]))))
    return out


@query("bt_ridge_models")
def _(spark, sf_dir):
    """Models of all folds, labels and kinds, each with the penalty that the inner validation chose; evaluated by log loss."""
    rows = materialise(model_rows(spark, sf_dir), "ridge-cells")
    roles = year_models(R.cell_moments(rows, ["s", "t"]))
    losses = R.validate_shared(rows, roles["INNER_VALIDATION"], R.fit_shared(rows, roles["INNER_FIT"], R.LAMBDAS))
    chosen = {r["model"]: [r["penalty"]] for r in R.choose_penalty(losses).collect()}
    final = R.fit_shared(rows, roles["TRAIN"], chosen)
    found, table = {r["model"]: r for r in final.collect()}, []
    for m in roles["EVALUATION"]:
        if m.name in found:
            r, none = found[m.name], [0.0] * (2 - len(m.features))
            table.append((m.name, m.cells[0], m.label, r["intercept"], [*r["coefficients"], *none] if r["coefficients"] else None, [*m.means, *none], [*m.scales, *none]))
    shape = "model string, cell int, target string, b double, c array<double>, m array<double>, d array<double>"
    met = rows.join(F.broadcast(spark.createDataFrame(table, shape)), "cell")
    z = F.col("b")
    for k, c in enumerate(("s", "t")):
        z = z + F.get("c", F.lit(k)) * F.when(F.get("d", F.lit(k)) > 0, (F.col(c) - F.get("m", F.lit(k))) / F.get("d", F.lit(k))).otherwise(0.0)
    label, p = F.coalesce(*(F.when(F.col("target") == c, F.col(c)) for c in TARGETS)), F.col("probability")
    scored = met.select("model", label.alias("label"), R.sigmoid(z).alias("probability"))
    quality = scored.groupBy("model").agg(P.r9(F.avg(E.log_loss(p, F.col("label")))).alias("log_loss"), P.r9(F.avg((p - F.col("label")) ** 2)).alias("brier"), F.count(F.lit(1)).alias("evaluated"))
    return final.join(quality, "model", "left").select("model", "status", "iterations", "objective", "intercept", "coefficients", "n", "penalty", "log_loss", "brier", "evaluated")


COHORTS = ("STRICT", "OPERATIONAL")


def signal_fields(spark, sf_dir) -> DataFrame:
    """Entries of usable races with baseline, labels and an array of the signals that they have: (stat, signal, strict, first), where
    strict says that every entry of the race has this signal, and first marks one entry of the race. Written once for an application.
    """
    return stored(spark, sf_dir, "signal-fields", lambda: _signal_fields(spark, sf_dir))


def _signal_fields(spark, sf_dir) -> DataFrame:
    marks = {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in E.labels(F.col("result_status"), F.col("rank")).items()}
    rows = predictions(spark, sf_dir, **marks).drop("label", "scope")
    stats = entry_signals()
    met = rows
    for table in (career_signals(spark, sf_dir), position_signal(spark, sf_dir)):
        own = [F.when(F.col(f"status_{s[-2:]}") == "VALID", F.col(f"signal_{s[-2:]}")).alias(f"_{k}") for k, s in enumerate(stats) if f"status_{s[-2:]}" in table.columns]
        met = met.join(table.select("entry_id", *own), "entry_id", "left")
    # How many of a race's entries have which signal, and which of them is the first.
    race = Window.partitionBy("race_id")
    met = met.withColumn("_size", F.count(F.lit(1)).over(race)).withColumns({f"_s{k}": F.count(f"_{k}").over(race) == F.col("_size") for k in range(len(stats))} | {f"_f{k}": F.min(F.when(F.col(f"_{k}").isNotNull(), F.col("entry_id"))).over(race) == F.col("entry_id") for k in range(len(stats))})
    each = F.array(*(F.when(F.col(f"_{k}").isNotNull(), F.struct(F.lit(stat).alias("stat"), F.col(f"_{k}").alias("signal"), F.col(f"_s{k}").alias("strict"), F.col(f"_f{k}").alias("first"))) for k, stat in enumerate(stats)))
    return met.select(*rows.columns, F.filter(each, lambda x: x.isNotNull()).alias("signals"))


def signal_rows(spark, sf_dir) -> DataFrame:
    """Entries of usable races with baseline, signal and labels, for every incremental statistic and cohort: (stat, cohort, ...).

    STRICT takes races of which every entry has the signal, OPERATIONAL every entry that has it.
    """
    cohort = F.explode(F.when(F.col("strict"), F.array(*map(F.lit, COHORTS))).otherwise(F.array(F.lit("OPERATIONAL"))))
    return signal_fields(spark, sf_dir).withColumn("_s", F.explode("signals")).drop("signals").select("*", "_s.*").withColumn("cohort", cohort).drop("_s", "strict")


_SIGNAL_ROWS = REASONS_SQL + """
, sg AS (SELECT * FROM ({signals}) WHERE role = 'ENTRY_INCREMENTAL' AND status = 'VALID' AND signal IS NOT NULL),
us AS (SELECT t.*, count(*) OVER (PARTITION BY race_id) AS size FROM target t JOIN rr USING (race_id) WHERE reasons = ''),
mt AS (SELECT us.entry_id, us.race_id, year(race_date) AS year, stat, signal, size, count(*) OVER (PARTITION BY stat, us.race_id) AS k FROM us JOIN sg USING (entry_id)),
sr AS (SELECT *, 'OPERATIONAL' AS cohort FROM mt UNION ALL SELECT *, 'STRICT' FROM mt WHERE k = size)
"""


def _grid_sql() -> str:
    from tempolane.catalog.audits import _SIGNALS_SQL

    return _SIGNAL_ROWS.replace("{signals}", _SIGNALS_SQL) + _FOLDS_SQL + """
SELECT fold, stat, cohort, role, count(*) AS entries, count(DISTINCT race_id) AS races FROM sr JOIN f ON year BETWEEN a AND b GROUP BY ALL
"""


@query("bt_scope_grid", _grid_sql())
def _(spark, sf_dir):
    """Rows and races of every scope (fold x statistic x cohort) and role."""
    # A race lies in one year: years are counted once, then added up for all folds.
    years = stored(spark, sf_dir, "scope-years", lambda: _scope_years(spark, sf_dir))
    return with_folds(spark, years).groupBy("fold", "stat", "cohort", "role").agg(F.sum("entries").alias("entries"), F.sum("races").alias("races"))


#: Bits for the entries of a race that have a signal; an eligible race has at most nine entries.
BITS = 4


def _scope_years(spark, sf_dir) -> DataFrame:
    """Entries and races of each year, statistic and cohort. How many of a race's entries have which signal is one number, so that the
    signals themselves are not dealt by race."""
    stats, packed = entry_signals(), None
    for table, whole in ((career_signals(spark, sf_dir), 1), (position_signal(spark, sf_dir), 0)):
        bits = [F.when((F.col(f"status_{s[-2:]}") == "VALID") & F.col(f"signal_{s[-2:]}").isNotNull(), F.lit(1 << BITS * k).cast("long")).otherwise(0) for k, s in enumerate(stats) if f"status_{s[-2:]}" in table.columns]
        part = table.select("race_id", F.year("race_date").alias("year"), sum(bits[1:], bits[0]).alias("have"), F.lit(whole).alias("entry"))
        packed = part if packed is None else packed.unionByName(part)
    races = packed.groupBy("race_id", "year").agg(F.sum("have").alias("have"), F.sum("entry").alias("size"))
    usable = E.race_reasons(eligible(domain(spark, sf_dir).entries)).where("reasons = ''").select("race_id")
    of = lambda k: F.shiftright("have", BITS * k).bitwiseAND((1 << BITS) - 1)
    strict = lambda k: of(k) == F.col("size")
    sums = [x for k in range(len(stats)) for x in (F.sum(of(k)).alias(f"e{k}"), F.count_if(of(k) > 0).alias(f"r{k}"), F.sum(F.when(strict(k), of(k)).otherwise(0)).alias(f"se{k}"), F.count_if(strict(k)).alias(f"sr{k}"))]
    years = races.join(usable, "race_id").groupBy("year").agg(*sums)
    lines = [F.struct(F.lit(s).alias("stat"), F.lit(c).alias("cohort"), F.col(f"{x}e{k}").alias("entries"), F.col(f"{x}r{k}").alias("races")) for k, s in enumerate(stats) for c, x in zip(COHORTS, ("s", ""), strict=True)]
    return years.select("year", F.inline(F.array(*lines))).where("entries > 0")


def with_folds(spark, rows: DataFrame) -> DataFrame:
    """Each row once for every fold and role that its year has a part in."""
    return rows.join(F.broadcast(E.folds(spark, YEARS, FIRST)), F.col("year").between(F.col("first_year"), F.col("last_year")))


def grid_rows(spark, sf_dir) -> DataFrame:
    """Signal rows of every fold, statistic, cohort and role."""
    return with_folds(spark, signal_rows(spark, sf_dir))


SCOPE = ["fold", "stat", "cohort"]
_NATURAL = r"regexp_replace(regexp_replace({0}, '([0-9]+)', '00000000000000000000\1', 'g'), '0*([0-9]{{20}})', '\1', 'g')"
_TEXT = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


def _signal_bins_sql() -> str:
    from tempolane.catalog.audits import _SIGNALS_SQL

    return _SIGNAL_ROWS.replace("{signals}", _SIGNALS_SQL) + _FOLDS_SQL + f"""
, tv AS (SELECT fold, stat, cohort, CAST(signal AS DOUBLE) + 0.0 AS v FROM sr JOIN f ON role = 'TRAIN' AND year BETWEEN a AND b),
dv AS (SELECT fold, stat, cohort, v, count(*) AS k FROM tv GROUP BY ALL), ds AS (SELECT fold, stat, cohort, count(*) AS d FROM dv GROUP BY ALL),
cb AS (SELECT fold, stat, cohort, v, row_number() OVER (PARTITION BY fold, stat, cohort ORDER BY {_NATURAL.format(_TEXT.format('v'))}) AS bin, {_TEXT.format('v')} AS category, k FROM dv JOIN ds USING (fold, stat, cohort) WHERE d <= 10),
cq AS (SELECT fold, stat, cohort, list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS c FROM tv JOIN ds USING (fold, stat, cohort) WHERE d > 10 GROUP BY ALL),
rb AS (SELECT *, unnest(range(1, len(c) + 2)) AS bin FROM cq)
"""


def signal_bins(spark, sf_dir) -> DataFrame:
    """Bins of all scopes, written once for an application. Signals are counted by year and value once; a fold adds up its years."""

    def make() -> DataFrame:
        counted = signal_rows(spark, sf_dir).groupBy("year", "stat", "cohort", "signal").agg(F.count(F.lit(1)).alias("times"))
        counted = materialise(counted, "signal-counts")
        return E.effect_bins(with_folds(spark, counted).where("role = 'TRAIN'"), SCOPE, "signal", "times")

    return stored(spark, sf_dir, "bt-bins", make)


@query("bt_signal_bins", _signal_bins_sql() + """
SELECT fold, stat, cohort, bin, 'CATEGORY' AS kind, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, category, k AS training_count FROM cb
UNION ALL
SELECT fold, stat, cohort, rb.bin, 'NUMERIC_RANGE', round(c[rb.bin - 1], 9), round(c[rb.bin], 9), NULL, count(tv.v) FROM rb LEFT JOIN tv USING (fold, stat, cohort)
WHERE tv.v IS NULL OR 1 + len(list_filter(c, lambda x: x < v)) = rb.bin GROUP BY fold, stat, cohort, rb.bin, c
""")
def _(spark, sf_dir):
    """Bins of every fold, statistic and cohort from its training signals: categories where there are few values, else deciles."""
    bins = signal_bins(spark, sf_dir)
    return bins.select(*SCOPE, "bin", "kind", P.r9(F.col("lower")).alias("lower"), P.r9(F.col("upper")).alias("upper"), "category", "training_count")


@query("bt_signal_bin_rows", _signal_bins_sql() + """
, ev AS (SELECT fold, stat, cohort, race_id, CAST(signal AS DOUBLE) + 0.0 AS v FROM sr JOIN f ON role = 'EVALUATION' AND year BETWEEN a AND b),
eb AS (SELECT ev.*, CASE WHEN c IS NOT NULL THEN 1 + len(list_filter(c, lambda x: x < ev.v)) ELSE coalesce(cb.bin, 0) END AS bin FROM ev JOIN ds USING (fold, stat, cohort) LEFT JOIN cq USING (fold, stat, cohort) LEFT JOIN cb ON (cb.fold, cb.stat, cb.cohort, cb.v) = (ev.fold, ev.stat, ev.cohort, ev.v))
SELECT fold, stat, cohort, bin, count(*) AS entries, count(DISTINCT race_id) AS races FROM eb GROUP BY ALL
""")
def _(spark, sf_dir):
    """Evaluation rows in the bins of the training signals; 0 holds categories that training did not have."""
    met = E.assign_effect_bins(grid_rows(spark, sf_dir).where("role = 'EVALUATION'"), signal_bins(spark, sf_dir), SCOPE, "signal").where("bin IS NOT NULL")
    return met.groupBy(*SCOPE, "bin").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("race_id").alias("races"))


def entry_signals() -> list[str]:
    from tempolane.catalog.audits import SIGNALS

    return [stat for stat, (*_, role) in SIGNALS.items() if role == "ENTRY_INCREMENTAL"]


def cell(stat, year, strict):
    """Number of a statistic (its place in the list), year and whether every entry of the race has the signal."""
    return (year * 100 + stat) * 2 + strict


def matrix_cells(spark, sf_dir) -> DataFrame:
    """Rows that all models share, one an entry and signal, whatever the number of folds, roles, cohorts, labels and kinds of models:
    (cell, labels, s, t)."""
    rows = signal_fields(spark, sf_dir).where(F.col("year").between(FIRST, max(YEARS) - 1)).withColumn("_s", F.explode("signals"))
    stat = F.array_position(F.array(*map(F.lit, entry_signals())), F.col("_s.stat"))
    own = rows.select(cell(stat, F.col("year"), F.col("_s.strict").cast("int")).cast("int").alias("cell"), "entry_id", *TARGETS, F.col("v").alias("s"), F.col("_s.signal").cast("double").alias("t"))
    return own.repartitionByRange(parts(spark), "cell", "entry_id").sortWithinPartitions("cell").drop("entry_id")


def matrix_models(moments: dict[int, R.Moments]) -> dict[str, list[R.Model]]:
    """All models by role: fold x statistic x cohort x label x kind, with the cells of the role's years.

    Inner rows are standardised by the inner fit, the others by all training rows, as each is all that its models may know.
    """
    none = R.Moments(0, np.zeros(2), np.zeros(2))
    out: dict[str, list[R.Model]] = {}
    for fold, role, first, last in _ROLES:
        basis = next((a, b) for f, r, a, b in _ROLES if f == fold and r == ("INNER_FIT" if role.startswith("INNER") else "TRAIN"))
        for nth, stat in enumerate(entry_signals(), 1):
            for cohort in COHORTS:
                of = lambda a, b: tuple(cell(nth, y, k) for y in range(a, b + 1) for k in ((0, 1) if cohort == "OPERATIONAL" else (1,)))  # noqa: B023, E731
                known = sum((moments[c] for c in of(*basis) if c in moments), none)
                for target in TARGETS:
                    for kind, features in KINDS.items():
                        k = len(features)
                        out.setdefault(role, []).append(R.Model(f"{fold}/{stat}/{cohort}/{target}/{kind}", of(first, last), target, features, tuple(map(float, known.mean[:k])), tuple(map(float, known.deviation[:k]))))
    return out


def fitted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All models, each at the penalty of its own inner validation; and the evaluation rows with both models' probabilities of every
    label, one row an entry and scope (NULL for a label without models). Both are made once for an application."""
    models = stored(spark, sf_dir, "bt-models", lambda: _models(spark, sf_dir))
    return models, stored(spark, sf_dir, "bt-pairs", lambda: _pairs(spark, sf_dir, models))


def _cells(spark, sf_dir) -> tuple[DataFrame, dict[str, list[R.Model]]]:
    cells = stored(spark, sf_dir, "bt-cells", lambda: matrix_cells(spark, sf_dir))
    return cells, matrix_models(R.cell_moments(cells, ["s", "t"]))


def _models(spark, sf_dir) -> DataFrame:
    cells, roles = _cells(spark, sf_dir)
    return R.fit_chosen_shared(cells, roles["TRAIN"], roles["INNER_FIT"], roles["INNER_VALIDATION"])


def _pairs(spark, sf_dir, models: DataFrame) -> DataFrame:
    own = {r["model"]: [r["intercept"], *r["coefficients"]] for r in models.where("status LIKE 'CONVERGED%'").collect()}
    table, scales = [], {m.name: m for m in _cells(spark, sf_dir)[1]["TRAIN"]}
    for fold, _, _, year in (r for r in _ROLES if r[1] == "EVALUATION"):
        for stat in entry_signals():
            for cohort in COHORTS:
                scope = f"{fold}/{stat}/{cohort}"
                both = {t: [f"{scope}/{t}/{k}" for k in KINDS] for t in TARGETS}
                fits = [[own[m] for m in names] if all(m in own for m in names) else [None, None] for names in both.values()]
                if any(one for one, _ in fits):
                    m = scales[f"{scope}/{TARGETS[0]}/INCREMENTAL"]  # rows, and so their scales, are the same for all labels
                    table.append((fold, year, stat, cohort, scope, *(b for two in fits for b in two), [*m.means], [*m.scales]))
    fields = ", ".join(f"b1_{t} array<double>, b2_{t} array<double>" for t in TARGETS)
    shape = f"fold string, year int, stat string, cohort string, scope string, {fields}, m array<double>, d array<double>"
    # A row of parameters for each scope; a signal row meets those of its fold and cohort.
    met = signal_rows(spark, sf_dir).where(F.col("year").isin(*YEARS)).join(F.broadcast(spark.createDataFrame(table, shape)), ["year", "stat", "cohort"])
    s, t = (F.when(F.get("d", F.lit(k)) > 0, (F.col(c) - F.get("m", F.lit(k))) / F.get("d", F.lit(k))).otherwise(0.0) for k, c in enumerate(("v", "signal")))
    at = lambda b, k: F.get(b, F.lit(k))
    found = []
    for c in TARGETS:
        b1, b2 = f"b1_{c}", f"b2_{c}"
        found += [F.when(F.col(b1).isNotNull(), F.col(c)).alias(f"label_{c}"), R.sigmoid(at(b1, 0) + at(b1, 1) * s).alias(f"baseline_{c}"), R.sigmoid(at(b2, 0) + at(b2, 1) * s + at(b2, 2) * t).alias(f"incremental_{c}")]
    return met.select(*SCOPE, "scope", "race_id", "signal", *found)


@query("bt_signal_matrix")
def _(spark, sf_dir):
    """Every scope and label: both models' penalties, and AUC, log loss and Brier with the interval of their difference."""
    models, pairs = fitted(spark, sf_dir)
    side = lambda k, c: F.max(F.when(F.col("model").endswith(k), F.col(c)))
    wide = models.groupBy(F.regexp_replace("model", "/[A-Z]+$", "").alias("scope")).agg(*(side(k, c).alias(f"{k.lower()}_{c}") for k in ("BASELINE", "INCREMENTAL") for c in ("status", "penalty")))
    # A label has models for all rows of a scope or for none.
    sizes = pairs.groupBy("scope").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("race_id").alias("races"), *(F.count(f"label_{t}").alias(t) for t in TARGETS))
    each = F.explode(F.array(*(F.when(F.col(t) > 0, F.concat_ws("/", "scope", F.lit(t))) for t in TARGETS))).alias("scope")
    sizes = sizes.select(each, "rows", "races").where("scope IS NOT NULL")
    metrics = B.paired_metrics(pairs, targets=TARGETS)
    out = wide.withColumn("metric", F.explode(F.array(*map(F.lit, ("AUC", "LOG_LOSS", "BRIER"))))).join(metrics, ["scope", "metric"], "left").join(sizes, "scope", "left")
    return out.select("scope", "metric", *(f"{k}_{c}" for k in ("baseline", "incremental") for c in ("status", "penalty")), *(P.r9(F.col(c)).alias(c) for c in ("baseline", "incremental", "delta", "ci_lower", "ci_upper")), "replicates", "rows", "races")


@query("bt_signal_replay")
def _(spark, sf_dir):
    """Stored models scored again over the evaluation years, for every scope and label: the effect of each bin of the training
    signals with its intervals, and its centred residual on draws of all races. Bin 0 (unseen category) shows where it has rows."""
    _, pairs = fitted(spark, sf_dir)
    bins = signal_bins(spark, sf_dir)
    met = E.assign_effect_bins(pairs, bins, SCOPE, "signal").drop(*SCOPE, "signal")
    out = B.replayed(met, bins.select(F.concat_ws("/", *SCOPE).alias("scope"), "bin"), targets=TARGETS)
    numbers = [f"{n}{e}" for n in B.EFFECTS for e in ("", "_lower", "_upper")] + ["overall_mean", "centred_mean", "ci_lower", "ci_upper"]
    return out.select("scope", "bin", "evaluation", "rows", "races", *(P.r9(F.col(c)).alias(c) for c in numbers), "state", "valid_replicates")


# --- a run's tables ------------------------------------------------------------------------------------------------------

_RUN_FOLDS = ("WF_1997", "WF_1998", "WF_1999", "WF_2000")


def run_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """What a run of the rank baseline stores: predictions, reasons of exclusion, and metrics of both cohorts, by fold."""
    races = eligible(domain(spark, sf_dir).entries).groupBy("race_id").agg(F.concat(F.lit("WF_"), F.year(F.max("race_date")).cast("string")).alias("fold")).where(F.col("fold").isin(*_RUN_FOLDS))
    predictions = QUERIES["bt_rank_predictions"](spark, sf_dir).join(races, "race_id")
    reasons = QUERIES["bt_feature_eligibility"](spark, sf_dir).where("reasons <> ''").join(races, "race_id")
    exclusions = reasons.select("fold", "race_id", F.lit("FEATURE").alias("stage"), F.explode(F.split("reasons", ",")).alias("reason"))
    hits = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("hit")) for m, c in (("RANK1_HIT", "rank1_hit"), ("TOP3_HIT", "top3_hit")))))
    decided = QUERIES["bt_cohort_decisions"](spark, sf_dir).where("included").join(races, "race_id").select("fold", F.col("cohort").alias("scope"), hits.alias("m"))
    metrics = decided.groupBy("fold", "scope", F.col("m.metric").alias("metric")).agg(F.count_if("m.hit").alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    return {"predictions": predictions, "exclusions": exclusions, "metrics": metrics}


@query("sink_backtest_run", f"""
, rf AS (SELECT race_id, 'WF_' || year(max(race_date)) AS fold FROM target GROUP BY race_id HAVING year(max(race_date)) BETWEEN 1997 AND 2000),
p1 AS (SELECT * FROM ({ORACLE_SQL["bt_rank_predictions"]}) JOIN rf USING (race_id)), p2 AS (SELECT * FROM p1 UNION ALL SELECT * FROM p1 WHERE fold = 'WF_1997' AND race_id % 7 = 0),
dd AS (SELECT fold, cohort, rank1_hit, top3_hit FROM ({ORACLE_SQL["bt_cohort_decisions"]}) JOIN rf USING (race_id) WHERE included),
mm AS (SELECT fold, cohort AS scope, 'RANK1_HIT' AS metric, rank1_hit AS hit FROM dd UNION ALL SELECT fold, cohort, 'TOP3_HIT', top3_hit FROM dd),
mt AS (SELECT fold, scope, metric, count(*) FILTER (hit) AS numerator, count(*) AS denominator FROM mm GROUP BY ALL),
xx AS (SELECT fold, race_id, unnest(string_split(reasons, ',')) AS reason FROM ({ORACLE_SQL["bt_feature_eligibility"]}) JOIN rf USING (race_id) WHERE reasons <> ''),
h AS (
  SELECT 'predictions' AS kind, fold, sha256(CAST(to_json({{'bike': bike, 'entry_id': entry_id, 'prediction_hash': prediction_hash, 'race_id': race_id, 'rank1_set': rank1_set, 'score': printf('%.17e', CAST(score AS DOUBLE)), 'score_rank': score_rank, 'top3_set': top3_set}}) AS VARCHAR)) AS h FROM p2
  UNION ALL SELECT 'exclusions', fold, sha256(CAST(to_json({{'race_id': race_id, 'reason': reason, 'stage': 'FEATURE'}}) AS VARCHAR)) FROM xx
  UNION ALL SELECT 'metrics', fold, sha256(CAST(to_json({{'denominator': denominator, 'metric': metric, 'numerator': numerator, 'scope': scope}}) AS VARCHAR)) FROM mt),
{tree_sql("h", "kind, fold")},
twice AS (SELECT count(*) > 0 AS any FROM p1 WHERE fold = 'WF_1997' AND race_id % 7 = 0)
SELECT kind, fold, row_count AS rows, fingerprint, CASE WHEN fold = 'WF_1997' AND twice.any THEN 'REFUSED' WHEN fold = 'WF_1998' THEN 'LOCKED' WHEN fold = 'WF_1999' THEN 'KEPT' ELSE 'WRITTEN' END AS write,
  CASE WHEN fold = 'WF_1997' AND twice.any THEN 'PREDICTIONS_KEY_REPEATED' ELSE '' END AS faults FROM fp, twice
""")
def _(spark, sf_dir):
    """A run stored twice. The first time, 1998's predictions were others and are locked now, 1999 was stored as it is; the second
    time, 1997 has predictions twice and is refused with all its tables."""
    tables = {kind: materialise(rows, f"own-{kind}") for kind, rows in run_tables(spark, sf_dir).items()}
    run, path = S.run_id(), f"{shared_dir(spark)}/backtest-{S.run_id()}"
    before = {kind: rows.where("fold IN ('WF_1998', 'WF_1999')") for kind, rows in tables.items()}
    before["predictions"] = before["predictions"].withColumn("score", F.when(F.col("fold") == "WF_1998", F.col("score") + 1).otherwise(F.col("score")))
    S.store_run(path, run, before)
    again = tables["predictions"]
    return S.store_run(path, run, tables | {"predictions": again.unionByName(again.where("fold = 'WF_1997' AND race_id % 7 = 0"))})


@query("sink_signal_run")
def _(spark, sf_dir):
    """The whole signal matrix as a run's tables: models and metrics, a scope's two and three or nothing, bins and their effects."""
    models, _ = fitted(spark, sf_dir)
    metrics, effects = QUERIES["bt_signal_matrix"](spark, sf_dir), QUERIES["bt_signal_replay"](spark, sf_dir)
    fold = F.substring_index("scope", "/", 1).alias("fold")
    bins = QUERIES["bt_signal_bins"](spark, sf_dir).withColumn("scope", F.concat_ws("/", *SCOPE)).drop("stat", "cohort")
    own = models.withColumn("scope", F.regexp_replace("model", "/[A-Z]+$", ""))
    tables = {"models": own.select("*", fold), "metrics": metrics.select("*", fold), "bins": bins, "effects": effects.select("*", fold)}
    return S.store_run(f"{shared_dir(spark)}/backtest-{S.run_id()}", S.run_id(), tables, S.PAIRED)
