"""Feature queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempolane.plans import features as P
from tempolane.registry import query
from tempolane.sources.domain import CONFIRMED_AT, MEETING_GRADE, domain


@query("stat01_group_relative", """
, g AS (SELECT *, CASE WHEN score > 0 THEN score END AS v FROM target),
h AS (SELECT *, count(v) OVER r AS n, count(*) FILTER (score IS NULL) OVER r AS missing, count(*) FILTER (score <= 0) OVER r AS invalid, avg(v) OVER r AS mean, max(v) OVER r AS top, stddev_pop(v) OVER r AS sd,
  CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY race_id ORDER BY v DESC NULLS LAST) END AS score_rank, CASE WHEN v IS NOT NULL THEN dense_rank() OVER (PARTITION BY race_id ORDER BY v DESC NULLS LAST) END AS dense
  FROM g WINDOW r AS (PARTITION BY race_id))
SELECT race_id, entry_id, bike, n AS valid_count, missing AS missing_count, invalid AS invalid_count, score_rank, dense AS dense_rank,
  round(CASE WHEN v IS NOT NULL THEN CASE WHEN n > 1 THEN (n - score_rank) / (n - 1.0) ELSE 1.0 END END, 9) AS strength_pct,
  round(v - mean, 9) AS diff_mean, round(top - v, 9) AS gap_max, round(mean, 9) AS race_mean, round(sd, 9) AS race_sd, round(CASE WHEN sd > 0 THEN (v - mean) / sd END, 9) AS z_score,
  CASE WHEN score IS NULL THEN 'MISSING_INPUT' WHEN score <= 0 THEN 'INVALID_INPUT' WHEN actual <> entrants OR missing + invalid > 0 OR player_id IS NULL THEN 'PARTIAL' ELSE 'VALID' END AS status,
  CASE WHEN player_id IS NULL THEN 'DEGRADED' WHEN actual <> entrants OR missing + invalid > 0 THEN 'PARTIAL' ELSE 'FULL' END AS quality,
  concat_ws(',', CASE WHEN actual <> entrants THEN 'ENTRY_COUNT_MISMATCH' END, CASE WHEN player_id IS NULL THEN 'PLAYER_ID_UNRESOLVED' END, CASE WHEN score IS NULL THEN 'RACE_SCORE_MISSING' WHEN score <= 0 THEN 'RACE_SCORE_NON_POSITIVE_UNRESOLVED' END, CASE WHEN sd = 0 THEN 'ZERO_VARIANCE' END) AS reasons,
  CASE WHEN close_at IS NOT NULL THEN 'SALES_CLOSE' WHEN start_at IS NOT NULL THEN 'SCHEDULED_START' ELSE 'MISSING' END AS cutoff_source, cutoff FROM h
""")
def _(spark, sf_dir):
    return P.group_relative(domain(spark, sf_dir))


@query("stat41_group_structure", """
, g AS (SELECT *, CASE WHEN score > 0 THEN score END AS v FROM target),
n AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY v DESC NULLS LAST, entry_id) AS nth FROM g),
a AS (SELECT race_id, any_value(entrants) AS entrants, count(*) AS actual, count(v) AS u, count(*) FILTER (score IS NULL) AS missing, count(*) FILTER (score <= 0) AS invalid, avg(v) AS mean, min(v) AS lowest, max(v) AS highest, stddev_pop(v) AS sd, var_pop(v) AS variance,
  median(v) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, mad(v) AS mad, max(v) FILTER (nth = 1) AS t1, max(v) FILTER (nth = 2) AS t2, max(v) FILTER (nth = 3) AS t3, max(v) FILTER (nth = 4) AS t4 FROM n GROUP BY race_id),
p AS (SELECT x.race_id, count(*) AS k, avg(abs(x.v - y.v)) AS gm, max(abs(x.v - y.v)) AS gx, min(abs(x.v - y.v)) AS gi FROM n x JOIN n y ON x.race_id = y.race_id AND x.nth < y.nth WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY x.race_id),
t AS (SELECT n.race_id, count(*) AS ties FROM n JOIN a USING (race_id) WHERE v = highest GROUP BY n.race_id),
s AS (SELECT *, CASE WHEN u = 0 AND invalid > 0 THEN 'INVALID_INPUT' WHEN u = 0 THEN 'MISSING_INPUT' WHEN u = 1 OR actual <> entrants OR missing + invalid > 0 THEN 'PARTIAL' ELSE 'VALID' END AS status FROM a LEFT JOIN p USING (race_id) LEFT JOIN t USING (race_id))
SELECT race_id, u AS usable_count, missing AS missing_count, invalid AS invalid_count, round(u / CAST(entrants AS DOUBLE), 9) AS coverage, round(mean, 9) AS mean, round(lowest, 9) AS lowest, round(highest, 9) AS highest, round(sd, 9) AS sd, round(variance, 9) AS variance, round(median, 9) AS median,
  round(q25, 9) AS q25, round(q75, 9) AS q75, round(mad, 9) AS mad, round(q75 - q25, 9) AS iqr, round(highest - lowest, 9) AS spread, round(sd / mean, 9) AS variation, round(t1 - t2, 9) AS gap_1_2, round(t1 - t3, 9) AS gap_1_3, round(t2 - t3, 9) AS gap_2_3, round(t3 - t4, 9) AS gap_3_4,
  ties AS ties_at_top, coalesce(k, 0) AS pair_count, round(gm, 9) AS pair_gap_mean, round(gx, 9) AS pair_gap_max, round(gi, 9) AS pair_gap_min, status, CASE WHEN status = 'VALID' THEN 'FULL' ELSE 'PARTIAL' END AS quality FROM s
""")
def _(spark, sf_dir):
    return P.group_structure(domain(spark, sf_dir))


@query("history_events", """
SELECT entry_id, race_id, player_id, start_at, state, normal, started, abnormal, whole_scores, rank, round(finish_pct, 9) AS finish_pct, round(score_pct, 9) AS score_pct, round(residual, 9) AS residual, round(score_mean, 9) AS score_mean, round(score_sd, 9) AS score_sd FROM hist
""")
def _(spark, sf_dir):
    r = P.r9
    return domain(spark, sf_dir).history.select("entry_id", "race_id", "player_id", "start_at", "state", "normal", "started", "abnormal", "whole_scores", "rank", *(r(F.col(c)).alias(c) for c in ("finish_pct", "score_pct", "residual", "score_mean", "score_sd")))


def _performance_sql(alias: str, prefix: str, when: str) -> str:
    f = f"FILTER ({when})"
    return f"""count({alias}.entry_id) {f} AS {prefix}n, count({alias}.residual) {f} AS {prefix}rn, avg(CAST({alias}.rank = 1 AS INT)) {f} AS {prefix}win_rate, avg(CAST({alias}.rank <= 2 AS INT)) {f} AS {prefix}top2_rate, avg(CAST({alias}.rank <= 3 AS INT)) {f} AS {prefix}top3_rate,
    avg({alias}.rank) {f} AS {prefix}mean_rank, avg({alias}.fin_u) {f} / 840.0 AS {prefix}mean_finish, avg({alias}.res_u) {f} / 840.0 AS {prefix}mean_residual"""


_STAGE_SQL = "CASE WHEN contains(race_type, '準決') THEN 'SEMIFINAL' WHEN contains(race_type, '決勝') THEN 'FINAL' WHEN contains(race_type, '一般') THEN 'GENERAL' WHEN contains(race_type, '予選') THEN 'QUALIFYING' ELSE 'OTHER' END"


def _conditioned_sql(match: str, days, exclude: bool = False, more: str = "", quality: str = "'FULL'") -> str:
    """Range self-join from each target to its player's earlier normal finishes."""
    m = {"hour": "CAST(floor(((start_at + 32400) % 86400) / 3600) AS INT)", "stage": _STAGE_SQL}.get(match, match)
    blocks, shown = [], []
    for w in days:
        name = "all" if w is None else w
        inside = "true" if w is None else f"h.start_at >= t.cutoff - {w} * 86400"
        blocks += [_performance_sql("h", f"m{name}_", f"h.m = t.m AND {inside}"), _performance_sql("h", f"b{name}_", inside)]
        shown += [f"m{name}_n AS match_sample_{name}", f"b{name}_n AS base_sample_{name}", *(f"round(m{name}_{k}, 9) AS match_{k}_{name}" for k in ("mean_rank", "mean_finish", "mean_residual"))]
        shown += [f"round(m{name}_{k} - b{name}_{k}, 9) AS delta_{k}_{name}" for k in P.DELTAS]
        if w is not None:
            shown.append(f"cutoff - {w} * 86400 >= 788918400 AS complete_{name}")
    out = "AND h.meeting_id <> t.meeting_id" if exclude else ""
    last = "" if exclude else "round((cutoff - last_at) / 86400.0, 9) AS days_since_match,"
    invalid = "WHEN day_number < 1 OR day_number > duration THEN 'INVALID_INPUT'" if exclude else ""
    return f"""
, t AS (SELECT *, {m} AS m FROM target), h AS (SELECT *, {m} AS m FROM hist WHERE normal),
j AS (SELECT t.entry_id, any_value(t.player_id) AS player_id, any_value(t.cutoff) AS cutoff, any_value(t.start_at) AS start_at, any_value(t.day_number) AS day_number, any_value(t.duration) AS duration, any_value(t.m) AS m,
  count(h.entry_id) FILTER (h.m = t.m) AS ever, max(h.start_at) FILTER (h.m = t.m) AS last_at, count(h.entry_id) FILTER (h.day_number = h.duration) AS fn, avg(CAST(h.rank = 1 AS INT)) FILTER (h.day_number = h.duration) AS fw, avg(h.res_u) FILTER (h.day_number = h.duration) / 840.0 AS fr, {", ".join(blocks)}
  FROM t LEFT JOIN h ON h.player_id = t.player_id AND h.start_at < t.cutoff {out} GROUP BY t.entry_id),
s AS (SELECT *, CASE WHEN player_id IS NULL OR m IS NULL THEN 'MISSING_INPUT' {invalid} WHEN ever = 0 THEN 'NO_HISTORY' ELSE 'VALID' END AS status FROM j)
SELECT entry_id, {", ".join(shown)}, {last} {more} status, CASE WHEN status = 'VALID' THEN {quality} ELSE 'DEGRADED' END AS quality FROM s
"""


@query("stat07_same_track", _conditioned_sql("track_id", P.CONTEXT_DAYS))
def _(spark, sf_dir):
    return P.conditioned(domain(spark, sf_dir), "track_id")


_CIRCLE = """CAST(floor(((start_at + 32400) % 86400) / 60) AS INT) AS minute_of_day, round(sin(2 * pi() * (((start_at + 32400) % 86400) / 86400.0)), 9) AS time_sin,
  round(cos(2 * pi() * (((start_at + 32400) % 86400) / 86400.0)), 9) AS time_cos,"""


@query("stat08_same_hour", _conditioned_sql("hour", P.CONTEXT_DAYS, more=_CIRCLE))
def _(spark, sf_dir):
    return P.conditioned(domain(spark, sf_dir), "hour")


@query("stat32_same_stage", _conditioned_sql("stage", P.CONTEXT_DAYS, quality="CASE WHEN m = 'OTHER' THEN 'DEGRADED' ELSE 'FULL' END"))
def _(spark, sf_dir):
    return P.conditioned(domain(spark, sf_dir), "stage")


_FINAL = """round(CASE WHEN duration > 1 THEN (day_number - 1) / (duration - 1.0) END, 9) AS meeting_progress, day_number = duration AS is_final_day,
  fn AS final_sample, round(fw, 9) AS final_win_rate, round(fr, 9) AS final_mean_residual,"""


@query("stat23_same_meeting_day", _conditioned_sql("day_number", (None,), exclude=True, more=_FINAL))
def _(spark, sf_dir):
    return P.conditioned(domain(spark, sf_dir), "day_number", (None,), exclude_meeting=True)


def _verdict_sql(complete: str) -> str:
    """Status, quality and reasons of the features over a player's own history, from counts ``ever`` and ``inside``."""
    return f"""CASE WHEN t.player_id IS NULL THEN 'MISSING_INPUT' WHEN coalesce(c.ever, 0) = 0 THEN 'NO_HISTORY' WHEN NOT ({complete}) THEN 'PARTIAL_HISTORY' ELSE 'VALID' END AS status,
  CASE WHEN t.player_id IS NULL OR coalesce(c.ever, 0) = 0 THEN 'DEGRADED' WHEN NOT ({complete}) THEN 'PARTIAL' WHEN coalesce(c.inside, 0) > 0 THEN 'DEGRADED' ELSE 'FULL' END AS quality,
  concat_ws(',', CASE WHEN coalesce(c.inside, 0) > 0 THEN 'IN_MEETING_RESULT_CONFIRMATION_NOT_RECONSTRUCTED' END, CASE WHEN coalesce(c.ever, 0) > 0 AND NOT ({complete}) THEN 'HISTORY_WINDOW_INCOMPLETE' END) AS reasons"""


_EVER = "c AS (SELECT t.entry_id, count(*) AS ever, count(*) FILTER ({inside}) AS inside FROM target t JOIN hist h ON h.player_id = t.player_id AND h.start_at < t.cutoff GROUP BY t.entry_id)"
_EVER_ALL = _EVER.format(inside="h.meeting_id = t.meeting_id")


def _recent_form_sql() -> str:
    counts, days = (3, 5, 10, 20), (30, 60, 90, 180, 365)
    a, b = [], []
    for n in counts:
        a += [f"count(*) FILTER (nth <= {n}) AS n_{n}", f"avg(CAST(rank = 1 AS INT)) FILTER (nth <= {n}) AS win_{n}", f"avg(CAST(rank <= 3 AS INT)) FILTER (nth <= {n}) AS top3_{n}", f"avg(fin_u) FILTER (nth <= {n}) / 840.0 AS finish_{n}", f"avg(res_u) FILTER (nth <= {n}) / 840.0 AS residual_{n}", f"min(start_at) FILTER (nth <= {n}) AS start_{n}", f"max(start_at) FILTER (nth <= {n}) AS end_{n}"]
        b += [f"coalesce(n_{n}, 0) AS sample_{n}", f"coalesce(n_{n}, 0) >= {n} AS complete_{n}", f"start_{n}", f"end_{n}", *(f"round({k}_{n}, 9) AS {k}_last_{n}" for k in ("win", "top3", "finish", "residual"))]
    for w in days:
        inside = f"FILTER (start_at >= cutoff - {w} * 86400)"
        a += [f"count(*) {inside} AS n_{w}d", f"avg(fin_u) {inside} / 840.0 AS f_{w}d", f"avg(res_u) {inside} / 840.0 AS r_{w}d", f"avg(CAST(rank <= 3 AS INT)) {inside} AS t_{w}d"]
        b += [f"coalesce(n_{w}d, 0) AS sample_{w}d", f"round(f_{w}d, 9) AS finish_{w}d", f"round(r_{w}d, 9) AS residual_{w}d", f"round(t_{w}d, 9) AS top3_{w}d"]
    complete = " AND ".join([f"coalesce(n_{n}, 0) >= {n}" for n in counts] + [f"t.cutoff - {w} * 86400 >= 788918400" for w in days])
    return f"""
, pre AS (SELECT t.entry_id, t.cutoff, h.start_at, h.rank, h.finish_pct, h.residual, h.fin_u, h.res_u, row_number() OVER (PARTITION BY t.entry_id ORDER BY h.start_at DESC, h.race_id DESC, h.entry_id DESC) AS nth
  FROM target t JOIN hist h ON h.player_id = t.player_id AND h.start_at < t.cutoff AND h.normal AND h.meeting_id <> t.meeting_id),
a AS (SELECT entry_id, {", ".join(a)}, CASE WHEN min(nth) FILTER (rank <= 3) = 1 THEN coalesce(min(nth) FILTER (rank > 3) - 1, count(*)) ELSE 0 END AS s_in, CASE WHEN min(nth) FILTER (rank > 3) = 1 THEN coalesce(min(nth) FILTER (rank <= 3) - 1, count(*)) ELSE 0 END AS s_out FROM pre GROUP BY entry_id),
i AS (SELECT t.entry_id, count(*) AS i_n, avg(CAST(h.rank <= 3 AS INT)) AS i_top3, avg(h.fin_u) / 840.0 AS i_finish FROM target t JOIN hist h ON h.player_id = t.player_id AND h.start_at < t.cutoff AND h.normal AND h.meeting_id = t.meeting_id GROUP BY t.entry_id),
{_EVER_ALL}
SELECT entry_id, {", ".join(b)}, round(finish_3 - finish_10, 9) AS finish_3_minus_10, round(residual_3 - residual_10, 9) AS residual_3_minus_10, round(finish_5 - finish_20, 9) AS finish_5_minus_20, round(residual_5 - residual_20, 9) AS residual_5_minus_20,
  coalesce(s_in, 0) AS top3_streak, coalesce(s_out, 0) AS outside_top3_streak, coalesce(i_n, 0) AS meeting_sample, round(i_top3, 9) AS meeting_top3, round(i_finish, 9) AS meeting_finish, {_verdict_sql(complete)}
FROM target t LEFT JOIN a USING (entry_id) LEFT JOIN i USING (entry_id) LEFT JOIN c USING (entry_id)
"""


@query("stat10_recent_form", _recent_form_sql())
def _(spark, sf_dir):
    return P.recent_form(domain(spark, sf_dir))


def _abnormal_sql() -> str:
    a, b = [], []
    for n in (3, 5, 10):
        a += [f"count(*) FILTER (started AND nth <= {n}) AS s_{n}", f"count(*) FILTER (started AND abnormal AND nth <= {n}) AS a_{n}", f"min(start_at) FILTER (started AND nth <= {n}) AS start_{n}", f"max(start_at) FILTER (started AND nth <= {n}) AS end_{n}"]
        b += [f"coalesce(s_{n}, 0) AS started_last_{n}", f"coalesce(s_{n}, 0) >= {n} AS complete_{n}", f"start_{n}", f"end_{n}", f"round(a_{n} / nullif(CAST(s_{n} AS DOUBLE), 0), 9) AS abnormal_last_{n}"]
    for w in (30, 90, 180, "all"):
        i = "true" if w == "all" else f"start_at >= cutoff - {w} * 86400"
        a += [f"count(*) FILTER ({c} AND {i}) AS {k}_{w}" for k, c in (("st", "started"), ("ab", "abnormal"), ("dns", "state = 'DID_NOT_START'"), ("dq", "state = 'DISQUALIFIED'"), ("fall", "state = 'FALL_DNF'"))]
        b += [f"coalesce(st_{w}, 0) AS started_{w}", f"coalesce(dns_{w}, 0) AS dns_{w}", *(f"round({k}_{w} / nullif(CAST(st_{w} AS DOUBLE), 0), 9) AS {o}_{w}" for k, o in (("ab", "abnormal_rate"), ("dq", "dq_rate"), ("fall", "fall_rate")))]
    complete = " AND ".join([f"coalesce(s_{n}, 0) >= {n}" for n in (3, 5, 10)] + [f"t.cutoff - {w} * 86400 >= 788918400" for w in (30, 90, 180)])
    return f"""
, p AS (SELECT t.entry_id, t.cutoff, h.start_at, h.state, h.started, h.abnormal, row_number() OVER (PARTITION BY t.entry_id, h.started ORDER BY h.start_at DESC, h.race_id DESC, h.entry_id DESC) AS nth FROM target t JOIN hist h ON h.player_id = t.player_id AND h.start_at < t.cutoff),
a AS (SELECT entry_id, {", ".join(a)}, max(start_at) FILTER (abnormal) AS bad_at, min(nth) FILTER (abnormal) AS bad_nth, min(nth) FILTER (started AND NOT abnormal) AS good_nth, count(*) FILTER (started) AS starts FROM p GROUP BY entry_id),
{_EVER_ALL}
SELECT t.entry_id, {", ".join(b)}, round((t.cutoff - bad_at) / 86400.0, 9) AS days_since, bad_nth - 1 AS started_since, coalesce(coalesce(good_nth - 1, starts), 0) AS streak,
  {_verdict_sql(complete)} FROM target t LEFT JOIN a USING (entry_id) LEFT JOIN c USING (entry_id)
"""


@query("stat11_abnormal_results", _abnormal_sql())
def _(spark, sf_dir):
    return P.abnormal_rates(domain(spark, sf_dir))


def _volatility_sql() -> str:
    a, b = [], []
    windows = {str(n): f"nth <= {n}" for n in (3, 5, 10, 20, 30)} | {f"{w}d": f"start_at >= cutoff - {w} * 86400" for w in (60, 90, 180, 365)}
    for k, inside in windows.items():
        f = f"FILTER ({inside})"
        a += [f"count(*) {f} AS n_{k}"]
        a += [f"stddev_pop({c}) {f} AS {x}_sd_{k}, mad({c}) {f} AS {x}_mad_{k}, quantile_cont({c}, 0.75) {f} - quantile_cont({c}, 0.25) {f} AS {x}_iqr_{k}" for x, c in (("finish", "finish_pct"), ("residual", "residual"))]
        a += [f"avg(CAST(residual > 0 AS INT)) {f} AS up_rate_{k}, avg(res_u) FILTER ({inside} AND residual < 0) / 840.0 AS down_mean_{k}, avg(res_u) FILTER ({inside} AND residual > 0) / 840.0 AS up_mean_{k}, count(*) FILTER ({inside} AND nth > 1 AND (rank <= 3) <> newer) AS switches_{k}"]
        b += [f"coalesce(n_{k}, 0) AS sample_{k}", f"coalesce(switches_{k}, 0) AS switches_{k}", *(f"round({x}, 9) AS {x}" for x in [f"{x}_{y}_{k}" for x in ("finish", "residual") for y in ("sd", "mad", "iqr")] + [f"up_rate_{k}", f"down_mean_{k}", f"up_mean_{k}"])]
    for n in (3, 5, 10, 20, 30):
        a += [f"min(start_at) FILTER (nth <= {n}) AS start_{n}", f"max(start_at) FILTER (nth <= {n}) AS end_{n}"]
        b += [f"coalesce(n_{n}, 0) >= {n} AS complete_{n}", f"start_{n}", f"end_{n}"]
    complete = " AND ".join([f"coalesce(n_{n}, 0) >= {n}" for n in (3, 5, 10, 20, 30)] + [f"t.cutoff - {w} * 86400 >= 788918400" for w in (60, 90, 180, 365)])
    return f"""
, p AS (SELECT t.entry_id, t.cutoff, h.start_at, h.rank, h.finish_pct, h.residual, h.fin_u, h.res_u, row_number() OVER w AS nth, lag(h.rank <= 3) OVER w AS newer FROM target t JOIN hist h ON h.player_id = t.player_id AND h.start_at < t.cutoff AND h.normal AND h.meeting_id <> t.meeting_id
  WINDOW w AS (PARTITION BY t.entry_id ORDER BY h.start_at DESC, h.race_id DESC, h.entry_id DESC)),
a AS (SELECT entry_id, {", ".join(a)} FROM p GROUP BY entry_id),
{_EVER_ALL}
SELECT t.entry_id, {", ".join(b)}, {_verdict_sql(complete)} FROM target t LEFT JOIN a USING (entry_id) LEFT JOIN c USING (entry_id)
"""


@query("stat24_volatility", _volatility_sql())
def _(spark, sf_dir):
    return P.volatility(domain(spark, sf_dir))


@query("stat12_rest_gaps", """
, p AS (SELECT t.entry_id, t.start_at AS t_at, h.start_at, h.normal, h.abnormal, h.meeting_id = t.meeting_id AS same, h.race_id, h.entry_id AS h_id FROM target t JOIN hist h ON h.player_id = t.player_id AND h.start_at < t.cutoff AND h.started),
g AS (SELECT entry_id, t_at, start_at, (start_at - lag(start_at) OVER (PARTITION BY entry_id ORDER BY start_at, race_id, h_id)) / 86400.0 AS gap, (t_at - max(start_at) OVER (PARTITION BY entry_id)) / 86400.0 AS cur FROM p WHERE NOT same),
q AS (SELECT entry_id, any_value(cur) AS cur, count(gap) AS n, avg(gap) AS mean, median(gap) AS med, quantile_cont(gap, 0.25) AS q25, quantile_cont(gap, 0.75) AS q75, avg(CAST(gap <= cur AS INT)) AS pct FROM g GROUP BY entry_id),
a AS (SELECT entry_id, min(t_at - start_at) AS s, min(t_at - start_at) FILTER (normal) AS n, min(t_at - start_at) FILTER (abnormal) AS b, min(t_at - start_at) FILTER (same) AS i FROM p GROUP BY entry_id),
""" + _EVER.format(inside="h.meeting_id = t.meeting_id AND h.started") + """
SELECT t.entry_id, round(a.s / 86400.0, 9) AS gap_started, round(a.n / 86400.0, 9) AS gap_normal, round(a.b / 86400.0, 9) AS gap_abnormal, round(q.cur, 9) AS gap_pre, round(a.i / 86400.0, 9) AS gap_in_meeting, coalesce(q.n, 0) AS gap_sample, round(mean, 9) AS gap_mean, round(med, 9) AS gap_median,
  round(q25, 9) AS gap_q25, round(q75, 9) AS gap_q75, round(cur - med, 9) AS gap_minus_median, round(pct, 9) AS gap_percentile, """ + _verdict_sql("coalesce(q.n, 0) > 0") + """ FROM target t LEFT JOIN a USING (entry_id) LEFT JOIN q USING (entry_id) LEFT JOIN c USING (entry_id)
""")
def _(spark, sf_dir):
    return P.rest_gaps(domain(spark, sf_dir))


def _load_sql() -> str:
    out = []
    for w in (7, 14, 21, 30, 45, 60):
        out.append(f"""w{w} AS (SELECT t.entry_id, h.start_at, h.meeting_id, h.track_id, h.start_at // 86400 AS d, lag(h.track_id) OVER (PARTITION BY t.entry_id ORDER BY h.start_at, h.race_id, h.entry_id) AS before FROM target t JOIN hist h ON h.player_id = t.player_id AND h.start_at < t.cutoff AND h.start_at >= t.cutoff - {w} * 86400 AND h.started),
r{w} AS (SELECT entry_id, max(k) AS run FROM (SELECT entry_id, i, count(*) AS k FROM (SELECT entry_id, d, d - row_number() OVER (PARTITION BY entry_id ORDER BY d) AS i FROM (SELECT DISTINCT entry_id, d FROM w{w})) GROUP BY entry_id, i) GROUP BY entry_id),
a{w} AS (SELECT entry_id, count(*) AS n, count(DISTINCT meeting_id) AS m, count(DISTINCT d) AS d, count(*) FILTER (before <> track_id) AS c, count(*) FILTER (track_id IS NULL) AS u FROM w{w} GROUP BY entry_id)""")
    shown = ", ".join(f"coalesce(a{w}.n, 0) AS started_{w}, coalesce(a{w}.m, 0) AS meetings_{w}, coalesce(a{w}.d, 0) AS active_days_{w}, {w} - coalesce(a{w}.d, 0) AS idle_days_{w}, round(a{w}.n / CAST(a{w}.d AS DOUBLE), 9) AS starts_per_day_{w}, coalesce(a{w}.c, 0) AS track_changes_{w}, coalesce(a{w}.u, 0) AS missing_track_{w}, coalesce(r{w}.run, 0) AS longest_run_{w}" for w in (7, 14, 21, 30, 45, 60))
    joins = " ".join(f"LEFT JOIN a{w} USING (entry_id) LEFT JOIN r{w} USING (entry_id)" for w in (7, 14, 21, 30, 45, 60))
    complete = " AND ".join(f"t.cutoff - {w} * 86400 >= 788918400" for w in (7, 14, 21, 30, 45, 60))
    return f", {', '.join(out)}, {_EVER_ALL} SELECT t.entry_id, {shown}, {_verdict_sql(complete)} FROM target t {joins} LEFT JOIN c USING (entry_id)"


@query("stat26_schedule_load", _load_sql())
def _(spark, sf_dir):
    return P.schedule_load(domain(spark, sf_dir))


def _position_sql() -> str:
    parts, shown = [], []
    for name, keys in P.SCOPES.items():
        on = " AND ".join(f"h.{k} = t.{k}" for k in keys)
        parts.append(f"{name} AS (SELECT t.entry_id, count(*) AS n, avg(CAST(h.rank = 1 AS INT)) AS win_rate, avg(CAST(h.rank <= 3 AS INT)) AS top3_rate, avg(h.fin_u) / 840.0 AS mean_finish, avg(h.res_u) / 840.0 AS mean_residual FROM target t JOIN hist h ON h.normal AND {on} AND h.start_at < t.cutoff GROUP BY t.entry_id)")
        shown += [f"coalesce({name}.n, 0) AS {name}_sample", *(f"round({name}.{k}, 9) AS {name}_{k}" for k in ("win_rate", "top3_rate", "mean_finish", "mean_residual"))]
    for name, (one, two) in P.SCOPE_DELTAS.items():
        shown += [f"round({one}.{k} - {two}.{k}, 9) AS delta_{name}_{k}" for k in ("win_rate", "mean_finish", "mean_residual")]
    joins = " ".join(f"LEFT JOIN {name} ON {name}.entry_id = t.entry_id" for name in P.SCOPES)
    status = "CASE WHEN t.entrants <> t.actual THEN 'INVALID_INPUT' WHEN coalesce(field_bike.n, 0) = 0 THEN 'NO_HISTORY' ELSE 'VALID' END"
    return f"""
, {", ".join(parts)},
o AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY bike) AS nth, count(*) OVER (PARTITION BY race_id) AS of FROM target)
SELECT t.entry_id, {", ".join(shown)}, nth AS order_index, round(CASE WHEN of > 1 THEN (nth - 1) / (of - 1.0) END, 9) AS order_percentile, {status} AS status,
  CASE WHEN {status} <> 'VALID' OR frame IS NULL OR player_id IS NULL THEN 'DEGRADED' ELSE 'FULL' END AS quality,
  concat_ws(',', CASE WHEN frame IS NULL THEN 'MISSING_FRAME_NUMBER' END, CASE WHEN player_id IS NULL THEN 'PLAYER_ID_UNRESOLVED_FOR_PLAYER_SPECIFIC_COMPONENT' END) AS reasons FROM o t {joins}
"""


@query("stat39_position_bias", _position_sql())
def _(spark, sf_dir):
    return P.position_bias(domain(spark, sf_dir))


@query("stat42_head_to_head", """
, o AS (SELECT *, count(*) OVER (PARTITION BY race_id, player_id) AS k FROM hist WHERE player_id IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY race_id, player_id) AS k FROM target WHERE player_id IS NOT NULL),
t AS (SELECT a.entry_id, a.player_id, b.player_id AS other_id, a.cutoff FROM n a JOIN n b ON a.race_id = b.race_id AND a.player_id <> b.player_id AND a.k = 1 AND b.k = 1),
h AS (SELECT a.player_id, b.player_id AS other_id, a.start_at, a.normal AND b.normal AS ok, a.rank AS ar, b.rank AS br, a.fin_u - b.fin_u AS pd, a.res_u - b.res_u AS rd FROM o a JOIN o b ON a.race_id = b.race_id AND a.player_id <> b.player_id AND a.k = 1 AND b.k = 1)
SELECT t.entry_id, t.other_id, count(h.ok) AS direct_count, count(*) FILTER (ok) AS normal_count, count(*) FILTER (ok AND ar < br) AS ahead_count, count(*) FILTER (ok AND ar > br) AS behind_count, count(*) FILTER (ok AND ar = br) AS tied_count, round(avg(CAST(ar < br AS INT)) FILTER (ok), 9) AS ahead_rate,
  round(avg(br - ar) FILTER (ok), 9) AS mean_rank_diff, round(avg(pd) FILTER (ok) / 840.0, 9) AS mean_pct_diff, round(avg(rd) FILTER (ok) / 840.0, 9) AS mean_residual_diff, count(rd) FILTER (ok) AS residual_sample, count(h.ok) - count(*) FILTER (ok) AS abnormal_count FROM t LEFT JOIN h ON h.player_id = t.player_id AND h.other_id = t.other_id AND h.start_at < t.cutoff GROUP BY t.entry_id, t.other_id
""")
def _(spark, sf_dir):
    return P.head_to_head(domain(spark, sf_dir))


@query("stat42_pair_summary", """
, o AS (SELECT *, count(*) OVER (PARTITION BY race_id, player_id) AS k FROM hist WHERE player_id IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY race_id, player_id) AS k, count(player_id) OVER (PARTITION BY race_id) AS known, count(*) OVER (PARTITION BY race_id) AS of FROM target),
h AS (SELECT a.player_id, b.player_id AS other_id, a.start_at, a.normal AND b.normal AS ok, a.rank AS ar, b.rank AS br, a.fin_u - b.fin_u AS pd, a.res_u - b.res_u AS rd FROM o a JOIN o b ON a.race_id = b.race_id AND a.player_id <> b.player_id AND a.k = 1 AND b.k = 1),
g AS (SELECT t.entry_id, count(DISTINCT h.other_id) AS opponents, count(h.ok) AS direct, count(*) FILTER (ok) AS normal, count(*) FILTER (ok AND ar < br) AS ahead, count(*) FILTER (ok AND ar > br) AS behind, count(*) FILTER (ok AND ar = br) AS tied,
  avg(br - ar) FILTER (ok) AS rank_diff, avg(pd) FILTER (ok) / 840.0 AS pct_diff, avg(rd) FILTER (ok) / 840.0 AS res, count(rd) FILTER (ok) AS rn
  FROM n t JOIN n c ON c.race_id = t.race_id AND c.player_id <> t.player_id AND c.k = 1 AND t.k = 1 JOIN h ON h.player_id = t.player_id AND h.other_id = c.player_id AND h.start_at < t.cutoff GROUP BY t.entry_id),
s AS (SELECT n.*, g.* EXCLUDE (entry_id), CASE WHEN player_id IS NULL THEN 'MISSING_INPUT' WHEN k > 1 THEN 'INVALID_INPUT' WHEN known - 1 = 0 THEN 'MISSING_INPUT' WHEN coalesce(direct, 0) = 0 THEN 'NO_HISTORY' WHEN normal = 0 THEN 'PARTIAL' ELSE 'VALID' END AS status,
  of - known - CASE WHEN player_id IS NULL THEN 1 ELSE 0 END AS unresolved FROM n LEFT JOIN g USING (entry_id))
SELECT entry_id, coalesce(opponents, 0) AS opponents_met, coalesce(direct, 0) AS direct_count, coalesce(normal, 0) AS normal_count, coalesce(direct - normal, 0) AS abnormal_count, coalesce(ahead, 0) AS ahead_count, coalesce(behind, 0) AS behind_count, coalesce(tied, 0) AS tied_count,
  round(ahead / nullif(CAST(normal AS DOUBLE), 0), 9) AS ahead_rate, round(rank_diff, 9) AS mean_rank_diff, round(pct_diff, 9) AS mean_pct_diff, round(res, 9) AS weighted_residual, status,
  CASE WHEN status = 'PARTIAL' THEN 'PARTIAL' WHEN status <> 'VALID' OR unresolved > 0 OR coalesce(rn, 0) < coalesce(normal, 0) THEN 'DEGRADED' ELSE 'FULL' END AS quality,
  concat_ws(',', CASE WHEN unresolved > 0 THEN 'UNRESOLVED_CURRENT_COENTRANTS' END, CASE WHEN coalesce(rn, 0) < coalesce(normal, 0) THEN 'MISSING_HISTORICAL_SCORE_CONTEXT_FOR_RESIDUAL' END) AS reasons FROM s
""")
def _(spark, sf_dir):
    return P.pair_summary(domain(spark, sf_dir))


@query("stat33_meeting_transition", f"""
, e AS (SELECT *, {_STAGE_SQL} AS stage, {CONFIRMED_AT} AS c FROM hist WHERE started AND player_id IS NOT NULL), t AS (SELECT *, {_STAGE_SQL} AS stage FROM target),
l AS (SELECT *, lag(stage) OVER w AS prev_stage, lag(rank) OVER w AS prev_rank, lag(normal) OVER w AS prev_normal FROM e WINDOW w AS (PARTITION BY player_id, meeting_id ORDER BY start_at, race_id, entry_id)),
v AS (SELECT t.entry_id, e.stage AS prev_stage, e.rank AS prev_rank, e.normal AS prev_normal, e.start_at AS prev_at, e.c AS prev_c, row_number() OVER (PARTITION BY t.entry_id ORDER BY e.start_at DESC, e.race_id DESC, e.entry_id DESC) AS nth FROM t JOIN e ON e.player_id = t.player_id AND e.meeting_id = t.meeting_id AND e.start_at < t.cutoff),
a AS (SELECT t.entry_id, count(*) AS n, avg(l.prev_rank - l.rank) AS change, count(*) FILTER (l.prev_rank > l.rank) AS up, count(*) FILTER (l.prev_rank < l.rank) AS down, count(*) FILTER (l.prev_rank <= 3 AND l.rank <= 3) AS top3, avg(l.res_u) / 840.0 AS res, count(*) FILTER (l.prev_rank = v.prev_rank) AS xn, avg(l.prev_rank - l.rank) FILTER (l.prev_rank = v.prev_rank) AS xc
  FROM t JOIN v ON v.entry_id = t.entry_id AND v.nth = 1 JOIN l ON l.player_id = t.player_id AND l.start_at < t.cutoff AND l.normal AND l.prev_normal AND l.prev_stage = v.prev_stage AND l.stage = t.stage AND l.meeting_id <> t.meeting_id GROUP BY t.entry_id),
n AS (SELECT *, lag(normal) OVER w AS nb, lead(normal) OVER w AS na, lead(start_at) OVER w AS ns FROM e WINDOW w AS (PARTITION BY player_id, meeting_id ORDER BY start_at, race_id, entry_id)),
o AS (SELECT t.entry_id, count(*) FILTER (c <= cutoff) AS ob, count(*) FILTER (c > cutoff) AS oa, count(*) FILTER (c IS NULL) AS ou FROM t JOIN (SELECT player_id, meeting_id, c, CASE WHEN nb THEN start_at ELSE ns END AS entered FROM n WHERE normal AND (nb OR na)) n ON n.player_id = t.player_id AND n.meeting_id <> t.meeting_id AND n.entered < t.cutoff GROUP BY t.entry_id),
r AS (SELECT t.*, v.prev_stage, v.prev_rank, v.prev_normal, v.prev_at, v.entry_id AS v_id, CASE WHEN v.prev_at IS NOT NULL THEN v.prev_c <= t.cutoff END AS prev_observed, coalesce(ob, 0) AS ob, coalesce(oa, 0) AS oa, coalesce(ou, 0) AS ou FROM t LEFT JOIN v ON v.entry_id = t.entry_id AND v.nth = 1 LEFT JOIN o ON o.entry_id = t.entry_id),
z AS (SELECT r.entry_id, r.stage, r.prev_stage, r.prev_rank, round((r.start_at - r.prev_at) / 3600.0, 9) AS hours_since, coalesce(n, 0) AS like_steps, round(change, 9) AS mean_rank_change, coalesce(up, 0) AS improved, coalesce(down, 0) AS worsened, coalesce(n - up - down, 0) AS same,
  coalesce(top3, 0) AS top3_kept, round(res, 9) AS mean_next_residual, coalesce(xn, 0) AS exact_steps, round(xc, 9) AS exact_rank_change,
  CASE WHEN r.player_id IS NULL THEN 'MISSING_INPUT' WHEN v_id IS NULL THEN 'NOT_APPLICABLE' WHEN NOT r.prev_normal THEN 'PARTIAL' WHEN n IS NULL THEN 'NO_HISTORY' ELSE 'VALID' END AS status, prev_observed, ob AS steps_observed_before, oa AS steps_observed_after, ou AS steps_observation_unknown, v_id IS NOT NULL AS has_prev
FROM r LEFT JOIN a ON a.entry_id = r.entry_id),
y AS (SELECT *, concat_ws(',', CASE status WHEN 'MISSING_INPUT' THEN 'PLAYER_ID_UNRESOLVED' WHEN 'PARTIAL' THEN 'ABNORMAL_PREVIOUS_RESULT' WHEN 'NO_HISTORY' THEN 'NO_OBSERVED_TRANSITION_HISTORY' END, CASE WHEN has_prev AND NOT coalesce(prev_observed, false) OR steps_observed_after + steps_observation_unknown > 0 THEN 'OFFICIAL_RESULT_AVAILABILITY_NOT_RECONSTRUCTED' END) AS reasons FROM z)
SELECT * EXCLUDE (has_prev), CASE WHEN status IN ('VALID', 'NOT_APPLICABLE') THEN CASE WHEN reasons <> '' THEN 'DEGRADED' ELSE 'FULL' END WHEN status = 'PARTIAL' THEN 'PARTIAL' ELSE 'DEGRADED' END AS quality FROM y
""")
def _(spark, sf_dir):
    return P.meeting_transition(domain(spark, sf_dir))


@query("stat33_transitions", f"""
, e AS (SELECT *, {_STAGE_SQL} AS stage FROM hist WHERE started AND player_id IS NOT NULL),
s AS (SELECT *, lag(stage) OVER w AS prev_stage, lag(rank) OVER w AS prev_rank, lag(normal) OVER w AS prev_normal FROM e WINDOW w AS (PARTITION BY player_id, meeting_id ORDER BY start_at, race_id, entry_id))
SELECT prev_stage, stage, count(*) AS steps, round(avg(prev_rank - rank), 9) AS mean_rank_change, count(*) FILTER (prev_rank > rank) AS improved, count(*) FILTER (prev_rank < rank) AS worsened, count(*) FILTER (prev_rank = rank) AS same, count(*) FILTER (prev_rank <= 3 AND rank <= 3) AS top3_kept, round(avg(res_u) / 840.0, 9) AS mean_next_residual
FROM s WHERE normal AND prev_normal GROUP BY prev_stage, stage
""")
def _(spark, sf_dir):
    return P.transitions(domain(spark, sf_dir))


def _experience_sql() -> str:
    groups = {"late": "stage IN ('SEMIFINAL', 'FINAL')", "sf": "stage = 'SEMIFINAL'", "fi": "stage = 'FINAL'", "other": "stage NOT IN ('SEMIFINAL', 'FINAL')"}
    shown = [f"count(*) FILTER ({c} AND normal) AS {k}_sample, round(avg(CAST(h.rank = 1 AS INT)) FILTER ({c} AND normal), 9) AS {k}_win_rate, round(avg(h.res_u) FILTER ({c} AND normal) / 840.0, 9) AS {k}_mean_residual" for k, c in groups.items()]
    a, s = ("count(*) FILTER (substr(h.race_type, 1, 2) = '" + c + "級')" for c in "ＡＳ")
    return f"""
, h AS (SELECT *, {_STAGE_SQL} AS stage, {MEETING_GRADE} AS grade FROM hist), t AS (SELECT *, {MEETING_GRADE} AS tg FROM target),
gd AS (SELECT entry_id, string_agg(g || '=' || n, ',' ORDER BY g) AS grade_distribution FROM (SELECT t.entry_id, coalesce(h.grade, 'UNKNOWN') AS g, count(*) AS n FROM t JOIN h ON h.player_id = t.player_id AND h.start_at < t.cutoff GROUP BY ALL) GROUP BY entry_id),
x AS (SELECT t.entry_id, count(h.entry_id) AS event_count, count(*) FILTER (started) AS started_count, count(*) FILTER (started AND stage = 'SEMIFINAL') AS semifinal_starts, count(*) FILTER (started AND stage = 'FINAL') AS final_starts, {", ".join(shown)},
  any_value(tg) AS target_grade, count(*) FILTER (h.grade = tg) AS same_grade_events, count(*) FILTER (h.grade = tg AND normal) AS same_grade_sample, round(avg(CAST(h.rank = 1 AS INT)) FILTER (h.grade = tg AND normal), 9) AS same_grade_win_rate, round(avg(h.res_u) FILTER (h.grade = tg AND normal) / 840.0, 9) AS same_grade_mean_residual,
  concat_ws(',', CASE WHEN {a} > 0 THEN 'A=' || {a} END, CASE WHEN {s} > 0 THEN 'S=' || {s} END) AS class_distribution, count(h.score_mean) FILTER (normal) AS context_sample, round(avg(h.mean_u) FILTER (normal) / 5040.0, 9) AS field_mean_score, round(avg(h.score_max) FILTER (normal), 9) AS field_best_score,
  round(avg(round(h.score_sd * 1000000)) FILTER (normal) / 1000000, 9) AS field_score_sd, round(avg(round(h.score_pct * 840)) FILTER (normal) / 840.0, 9) AS mean_score_percentile,
  CASE WHEN any_value(t.player_id) IS NULL THEN 'MISSING_INPUT' WHEN count(h.entry_id) = 0 THEN 'NO_HISTORY' ELSE 'VALID' END AS status
FROM t LEFT JOIN h ON h.player_id = t.player_id AND h.start_at < t.cutoff GROUP BY t.entry_id)
SELECT x.*, coalesce(grade_distribution, '') AS grade_distribution, CASE WHEN status = 'VALID' THEN 'FULL' ELSE 'DEGRADED' END AS quality, CASE status WHEN 'MISSING_INPUT' THEN 'PLAYER_ID_UNRESOLVED' WHEN 'NO_HISTORY' THEN 'NO_ACQUIRED_HISTORY' ELSE '' END AS reasons FROM x LEFT JOIN gd USING (entry_id)
"""


@query("stat31_stage_experience", _experience_sql())
def _(spark, sf_dir):
    return P.stage_experience(domain(spark, sf_dir))
