"""Race-relative and point-in-time feature plans: DataFrame in, one row per target out."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempolane.operators.asof import Request, asof, asof_map, asof_rows, asof_sums, name_of, scoped_sums, two_clocks
from tempolane.operators.careers import Careers, counted, doubles, ragged
from tempolane.operators.validation import checked_aggregate
from tempolane.sources.domain import CONFIRMED_AT, DAY, HISTORY_FROM, MEETING_GRADE, UNIT, Domain, eligible

def performance_sums() -> dict[str, Column]:
    """Sums from which the performance metrics come, all of whole numbers; rows are normal finishes."""
    known = lambda c: F.col(c).isNotNull().cast("int")
    top = lambda n: (F.col("rank") <= n).cast("int")
    some = lambda c: F.coalesce(c, F.lit(0))
    finish = {"fin_n": known("fin_u"), "fin_sum": some("fin_u"), "res_n": known("res_u"), "res_sum": some("res_u")}
    return {"n": F.lit(1), "win": top(1), "top2": top(2), "top3": top(3), "rank_sum": F.col("rank")} | finish


#: Metric: sum, count and unit.
RATES = {"win_rate": ("win", "n", 1), "top2_rate": ("top2", "n", 1), "top3_rate": ("top3", "n", 1), "mean_rank": ("rank_sum", "n", 1), "mean_finish": ("fin_sum", "fin_n", UNIT), "mean_residual": ("res_sum", "res_n", UNIT)}
DELTAS = ("win_rate", "top2_rate", "top3_rate", "mean_finish", "mean_residual")
CONTEXT_DAYS = (365, 730, 1095, 1825)


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole, NULL where whole is 0 or NULL."""
    return F.when(whole > 0, part / whole)


def r9(c: Column) -> Column:
    """Nine digits, half up, by plain arithmetic: the same in every engine for the same number."""
    return F.floor(c.cast("double") * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def performance(df: DataFrame, prefix: str, window: object) -> dict[str, Column]:
    """Metrics of one window from its sums; names end with the window."""
    w = "all" if window is None else window
    at = lambda n: F.coalesce(df[f"{prefix}{n}_{w}"], F.lit(0.0))
    out = {f"{prefix}sample_{w}": at("n").cast("long"), f"{prefix}residual_sample_{w}": at("res_n").cast("long")}
    return out | {f"{prefix}{k}_{w}": safe_rate(at(a), at(b)) / unit for k, (a, b, unit) in RATES.items()}


def status_ladder(rules: Sequence[tuple[Column, str]], otherwise: str = "VALID") -> Column:
    """First rule that holds names the status."""
    return F.coalesce(*(F.when(c, s) for c, s in rules), F.lit(otherwise))


def quality(status: Column, reasons: Column) -> Column:
    """FULL or DEGRADED by reasons for a valid or inapplicable result, PARTIAL for partial ones, else DEGRADED."""
    return F.when(status.isin("VALID", "NOT_APPLICABLE"), F.when(F.size(reasons) > 0, "DEGRADED").otherwise("FULL")).when(status.isin("PARTIAL", "PARTIAL_HISTORY"), "PARTIAL").otherwise("DEGRADED")


def stage(kind: Column) -> Column:
    """Stage of a race from its type; the order of the rules decides (a semifinal is no final)."""
    t = F.trim(kind)
    has = lambda *words: reduce(lambda a, b: a | b, (t.contains(w) for w in words))
    # The words that mark a stage.
    return F.coalesce(
        F.when(t.isNull() | (t == ""), "UNKNOWN"), F.when(has("準決"), "SEMIFINAL"), F.when(has("決勝"), "FINAL"), F.when(has("一予"), "FIRST_QUALIFYING"), F.when(has("二予"), "SECOND_QUALIFYING"),
        F.when(has("特一般", "一般"), "GENERAL"), F.when(has("初特選", "特選", "特秀"), "SPECIAL_SELECTION"), F.when(has("選抜", "優秀"), "SELECTION"), F.when(has("予選") | t.rlike("予[１２12]$"), "QUALIFYING"),
        F.when(has("慰安"), "CONSOLATION"), F.when(has("敗者"), "LOSER_STAGE"), F.when(has("ポイント"), "POINTS_STAGE"), F.when(has("順位決"), "PLACEMENT_RACE"), F.when(has("予備"), "PRELIMINARY"), F.lit("OTHER"),
    )


def local_hour(time: str = "start_at") -> Column:
    """Hour of the day nine hours ahead of the data's zone."""
    return (F.pmod(F.col(time) + 9 * 3600, F.lit(DAY)) / 3600).cast("int")


def group_relative(d: Domain) -> DataFrame:
    """Race-relative score of every entry: ranks, percentile, distances, z, and the status and quality verdict."""
    race = Window.partitionBy("race_id")
    good = F.col("score") > 0
    by = race.orderBy(F.desc("valid_score"))
    df = eligible(d.entries).withColumn("valid_score", F.when(good, F.col("score")))
    df = df.withColumns({"n": F.count("valid_score").over(race), "missing": F.count_if(F.col("score").isNull()).over(race), "invalid": F.count_if(F.col("score") <= 0).over(race), "mean": F.avg("valid_score").over(race), "max": F.max("valid_score").over(race), "sd": F.stddev_pop("valid_score").over(race)})
    own = F.col("valid_score")
    df = df.withColumns({"score_rank": F.when(good, F.rank().over(by)), "dense": F.when(good, F.dense_rank().over(race.orderBy(F.round("valid_score", 2).desc())))})
    mismatch, incomplete = F.col("actual") != F.col("entrants"), (F.col("missing") + F.col("invalid")) > 0
    no_player, no_cutoff = F.col("player_id").isNull(), F.col("cutoff").isNull()
    status = status_ladder([(F.col("score").isNull(), "MISSING_INPUT"), (F.col("score") <= 0, "INVALID_INPUT"), (mismatch | incomplete | no_player | no_cutoff, "PARTIAL")])
    verdict = F.when(no_player | no_cutoff, "DEGRADED").when(mismatch | incomplete, "PARTIAL").otherwise("FULL")
    reasons = F.concat_ws(",", F.when(mismatch, "ENTRY_COUNT_MISMATCH"), F.when(no_player, "PLAYER_ID_UNRESOLVED"), F.when(no_cutoff, "INPUT_AS_OF_MISSING"), F.when(F.col("score").isNull(), "RACE_SCORE_MISSING"), F.when(F.col("score") <= 0, "RACE_SCORE_NON_POSITIVE_UNRESOLVED"), F.when(F.col("sd") == 0, "ZERO_VARIANCE"))
    return df.select(
        "race_id", "entry_id", "bike", F.col("n").alias("valid_count"), F.col("missing").alias("missing_count"), F.col("invalid").alias("invalid_count"), "score_rank", F.col("dense").alias("dense_rank"),
        r9(F.when(good, F.when(F.col("n") > 1, (F.col("n") - F.col("score_rank")) / (F.col("n") - 1)).otherwise(1.0))).alias("strength_pct"),
        r9(F.when(good, own - F.col("mean"))).alias("diff_mean"), r9(F.when(good, F.col("max") - own)).alias("gap_max"), r9(F.col("mean")).alias("race_mean"), r9(F.col("sd")).alias("race_sd"),
        r9(F.when(good & (F.col("sd") > 0), (own - F.col("mean")) / F.col("sd"))).alias("z_score"),
        status.alias("status"), verdict.alias("quality"), reasons.alias("reasons"), F.when(F.col("close_at").isNotNull(), "SALES_CLOSE").when(F.col("start_at").isNotNull(), "SCHEDULED_START").otherwise("MISSING").alias("cutoff_source"), "cutoff",
    )


def group_structure(d: Domain) -> DataFrame:
    """Score structure of every race: coverage, distribution, gaps of the best four and of all pairs, status."""
    e = eligible(d.entries)
    good = F.col("score") > 0
    top = Window.partitionBy("race_id").orderBy(F.col("score").desc_nulls_last(), "entry_id")
    e = e.withColumn("usable", F.when(good, F.col("score"))).withColumn("nth", F.when(good, F.row_number().over(top)))
    g = e.groupBy("race_id").agg(
        F.first("entrants").alias("entrants"), F.count(F.lit(1)).alias("actual"), F.count("usable").alias("usable_count"), F.count_if(F.col("score").isNull()).alias("missing_count"), F.count_if(F.col("score") <= 0).alias("invalid_count"),
        F.avg("usable").alias("mean"), F.min("usable").alias("lowest"), F.max("usable").alias("highest"), F.stddev_pop("usable").alias("sd"), F.var_pop("usable").alias("variance"), F.median("usable").alias("median"),
        F.percentile("usable", F.lit(0.25)).alias("q25"), F.percentile("usable", F.lit(0.75)).alias("q75"), F.array_sort(F.collect_list("usable")).alias("all"),
        *(F.max(F.when(F.col("nth") == k, F.col("usable"))).alias(f"t{k}") for k in (1, 2, 3, 4)),
    )
    gaps = F.flatten(F.transform("all", lambda a, i: F.transform(F.expr("slice(`all`, 1, size(`all`))"), lambda b, j: F.when(j > i, b - a))))
    g = g.withColumn("gaps", F.filter(gaps, lambda x: x.isNotNull())).withColumn("ties_at_top", F.size(F.filter("all", lambda x: x == F.col("highest"))))
    g = g.withColumn("mad", F.expr("CASE WHEN size(`all`) > 0 THEN (array_sort(transform(`all`, x -> abs(x - median)))[int((size(`all`) - 1) / 2)] + array_sort(transform(`all`, x -> abs(x - median)))[int(size(`all`) / 2)]) / 2 END"))
    u = F.col("usable_count")
    status = status_ladder([((u == 0) & (F.col("invalid_count") > 0), "INVALID_INPUT"), (u == 0, "MISSING_INPUT"), ((u == 1) | (F.col("actual") != F.col("entrants")) | (F.col("missing_count") + F.col("invalid_count") > 0), "PARTIAL")])
    mean_gap = F.when(F.size("gaps") > 0, F.aggregate("gaps", F.lit(0.0), lambda a, x: a + x) / F.size("gaps"))
    return g.select(
        "race_id", "usable_count", "missing_count", "invalid_count", r9(u / F.col("entrants")).alias("coverage"), *(r9(F.col(c)).alias(c) for c in ("mean", "lowest", "highest", "sd", "variance", "median", "q25", "q75", "mad")),
        r9(F.col("q75") - F.col("q25")).alias("iqr"), r9(F.col("highest") - F.col("lowest")).alias("spread"), r9(F.when(F.col("mean") != 0, F.col("sd") / F.col("mean"))).alias("variation"),
        *(r9(F.col(f"t{a}") - F.col(f"t{b}")).alias(f"gap_{a}_{b}") for a, b in ((1, 2), (1, 3), (2, 3), (3, 4))), F.when(u > 0, F.col("ties_at_top")).alias("ties_at_top"),
        F.size("gaps").cast("long").alias("pair_count"), r9(mean_gap).alias("pair_gap_mean"), r9(F.array_max("gaps")).alias("pair_gap_max"), r9(F.array_min("gaps")).alias("pair_gap_min"), status.alias("status"), F.when(status == "VALID", "FULL").otherwise("PARTIAL").alias("quality"),
    )


def missing_target(match: str) -> Column | None:
    """When the target's own condition is unknown, by the column that is matched."""
    return {"track_id": F.col("track_id").isNull(), "hour": F.col("start_at").isNull(), "stage": F.col("stage") == "UNKNOWN", "day_number": F.col("meeting_id").isNull() | F.col("day_number").isNull() | F.col("duration").isNull()}.get(match)


def with_condition(df: DataFrame, match: str) -> DataFrame:
    if match == "hour":
        return df.withColumn("hour", local_hour())
    return df.withColumn("stage", stage(F.col("race_type"))) if match == "stage" else df


def conditioned(d: Domain, match: str, days: Sequence[int | None] = CONTEXT_DAYS, exclude_meeting: bool = False) -> DataFrame:
    """Performance of the player under the target's condition (column ``match``) against all conditions, and their difference.

    exclude_meeting: events of the target's meeting don't count; their sums are taken off again. By meeting day there is also the
    profile of final days, and a day outside the meeting is an invalid input.
    """
    own = dict.fromkeys(["entry_id", "player_id", "cutoff", "start_at", "meeting_id", "day_number", "duration", "track_id", match])
    targets, events = with_condition(eligible(d.entries), match).select(*own), with_condition(d.history.where("normal"), match)
    sums, ever = performance_sums(), {"n": F.lit(1)}
    requests = [Request("match_", sums, days, [match]), Request("base_", sums, days), Request("ever_", ever, [None], [match], highs={"last_at": F.col("start_at")})]
    by_day = match == "day_number"
    if by_day:
        final = {k: F.when(F.col("day_number") == F.col("duration"), v) for k, v in sums.items()}
        requests.append(Request("final_", final))
    if exclude_meeting:
        requests += [Request(f"in_{r.prefix}", r.sums, r.days, [*r.keys, "meeting_id"]) for r in requests]
    out = asof_rows(targets, events, requests)
    if exclude_meeting:
        taken = [c for c in out.columns if f"in_{c}" in out.columns]
        out = out.withColumns({c: F.col(c) - F.col(f"in_{c}") for c in taken})
    shown: dict[str, Column] = {}
    for w in days:
        name = name_of(w)
        m, b = performance(out, "match_", w), performance(out, "base_", w)
        shown |= {f"match_sample_{name}": m[f"match_sample_{name}"], f"base_sample_{name}": b[f"base_sample_{name}"]}
        shown |= {k: r9(v) for k, v in m.items() if "mean_" in k}
        shown |= {f"delta_{k}_{name}": r9(m[f"match_{k}_{name}"] - b[f"base_{k}_{name}"]) for k in DELTAS}
        if w is not None:
            shown[f"complete_{name}"] = F.col("cutoff") - w * DAY >= HISTORY_FROM
    if not exclude_meeting:
        shown["days_since_match"] = r9((F.col("cutoff") - F.col("ever_last_at")) / DAY)
    absent = F.col("player_id").isNull() | F.coalesce(missing_target(match), F.lit(False))
    rules = [(absent, "MISSING_INPUT"), (F.coalesce("ever_n_all", F.lit(0.0)) == 0, "NO_HISTORY")]
    reasons = F.array().cast("array<string>")
    if match == "hour":
        angle = F.pmod(F.col("start_at") + 9 * 3600, F.lit(DAY)) / DAY * (2 * math.pi)
        shown |= {"minute_of_day": (F.pmod(F.col("start_at") + 9 * 3600, F.lit(DAY)) / 60).cast("int"), "time_sin": r9(F.sin(angle)), "time_cos": r9(F.cos(angle))}
    if match == "stage":
        reasons = F.when(F.col("stage") == "OTHER", F.array(F.lit("CURRENT_STAGE_OTHER"))).otherwise(reasons)
    if by_day:
        f = performance(out, "final_", None)
        shown |= {"meeting_progress": r9(F.when(F.col("duration") > 1, (F.col("day_number") - 1) / (F.col("duration") - 1))), "is_final_day": F.col("day_number") == F.col("duration"), "final_sample": f["final_sample_all"], "final_win_rate": r9(f["final_win_rate_all"]), "final_mean_residual": r9(f["final_mean_residual_all"])}
        rules.insert(1, ((F.col("day_number") < 1) | (F.col("day_number") > F.col("duration")), "INVALID_INPUT"))
    status = status_ladder(rules)
    return out.select("entry_id", *(v.alias(k) for k, v in shown.items()), status.alias("status"), quality(status, reasons).alias("quality"))


OWN = ("entry_id", "player_id", "cutoff", "meeting_id")


def last_finishes(c: Careers, n: int, days: int = 0, older: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The newest normal finishes of each target outside its meeting: at least ``n`` and those of ``days``, where there are so many,
    and up to ``older`` more before these. Owner, number of the event, whether it is one of those ``older`` ones and its place among
    the normal finishes, newest first; and how many each target has. Where a meeting is unknown, nothing is left out.
    """
    o, m = c.order(chosen="normal"), c.order("meeting_id", chosen="normal")
    end, last = o.before(c.cutoff), m.before(c.cutoff)
    place = np.zeros(len(c.time), np.int64)
    place[o.index] = np.arange(len(o.index))
    met = last > m.start
    first = np.where(met, place[m.index[np.where(met, m.start, 0)]], end) if len(m.index) else end
    span = np.maximum(n + last - m.start, end - first)
    if days:
        span = np.maximum(span, end - o.before(c.cutoff - days * DAY))
    owner, at = ragged(end, np.minimum(span + older, end - o.start))
    event, meeting = o.index[at], c.codes("meeting_id")[0]
    left = (meeting[: c.n][owner] < 0) | (meeting[: c.n][owner] != meeting[c.n :][event])
    owner, event, at = owner[left], event[left], at[left]
    return owner, event, at < (end - span)[owner], at, np.bincount(owner, minlength=c.n)


def put(n: int, owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One value for each owner, the last of several; NaN without one."""
    out = np.full(n, np.nan)
    out[owner] = values
    return out


def history_reasons(any_history: Column, inside: Column, complete: Column) -> Column:
    """Reasons of the features over a player's own history, in their fixed order."""
    known = F.col("player_id").isNotNull()
    return F.array_compact(F.array(
        F.when(F.col("meeting_id").isNull(), "MEETING_CONTEXT_MISSING"),
        F.when(known & (inside > 0), "IN_MEETING_RESULT_CONFIRMATION_NOT_RECONSTRUCTED"),
        F.when(known & (any_history > 0) & ~complete, "HISTORY_WINDOW_INCOMPLETE"),
    ))


def history_status(any_history: Column, complete: Column) -> Column:
    return status_ladder([(F.col("player_id").isNull(), "MISSING_INPUT"), (any_history == 0, "NO_HISTORY"), (~complete, "PARTIAL_HISTORY")])


def verdict(any_history: Column, inside: Column, complete: Column) -> list[Column]:
    """status, quality and reasons (comma-separated)."""
    status, reasons = history_status(any_history, complete), history_reasons(any_history, inside, complete)
    return [status.alias("status"), quality(status, reasons).alias("quality"), F.concat_ws(",", reasons).alias("reasons")]


def day_complete(days: Sequence[int]) -> list[Column]:
    return [F.col("cutoff") - w * DAY >= HISTORY_FROM for w in days]


def every(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def newest_form(c: Careers, counts: Sequence[int]) -> dict[str, np.ndarray]:
    """Form over the last finishes of each target and, for streaks, the one before the longest of these windows."""
    owner, event, old, at, have = last_finishes(c, max(counts), older=1)
    nth = counted(have) + 1
    rank, o = c.event("rank"), c.order(chosen="normal")
    top3 = rank <= 3
    # How many finishes of a kind, in the top three or not, stand in a row up to each one.
    ordered, subject = top3[o.index], c.subject[c.n :][o.index]
    breaks = np.concatenate(([True], (ordered[1:] != ordered[:-1]) | (subject[1:] != subject[:-1]))) if len(ordered) else np.zeros(0, bool)
    run = np.arange(len(ordered)) - np.maximum.accumulate(np.where(breaks, np.arange(len(ordered)), 0)) + 1
    good = top3[event]
    # Newest first: written backwards, the newest stays.
    first = lambda chosen: put(c.n, owner[chosen][::-1], nth[chosen][::-1])
    out = {"m": np.bincount(owner[~old], minlength=c.n).astype(float), "first_in": first(~old & good), "first_out": first(~old & ~good)}
    out |= {"older_in": put(c.n, owner[old & good], run[at[old & good]]), "older_out": put(c.n, owner[old & ~good], run[at[old & ~good]])}
    out["to"] = put(c.n, owner[nth == 1], c.time[event[nth == 1]])
    values = {"win": (rank == 1).astype(float), "top3": top3.astype(float), "finish": c.event("fin_u"), "residual": c.event("res_u")}
    for n in counts:
        inside = nth <= n
        own, at_event = owner[inside], event[inside]
        out |= {f"n_{n}": np.bincount(own, minlength=c.n).astype(float), f"from_{n}": put(c.n, own, c.time[at_event])}
        for k, v in values.items():
            some = ~np.isnan(v[at_event])
            size, total = np.bincount(own[some], minlength=c.n), np.bincount(own[some], v[at_event][some], minlength=c.n)
            mean = np.divide(total, size, out=np.full(c.n, np.nan), where=size > 0)
            out[f"{k}_{n}"] = mean / UNIT if k in ("finish", "residual") else mean
    return out


def recent_form(d: Domain, counts: Sequence[int] = (3, 5, 10, 20), days: Sequence[int] = (30, 60, 90, 180, 365)) -> DataFrame:
    """Form before the meeting: last-N and day windows over normal finishes, short minus long, streaks, and inside the meeting."""
    targets = eligible(d.entries).select(*OWN)
    sums = {k: F.when(F.col("normal"), v) for k, v in performance_sums().items()}
    # Every event of the meeting, whatever its result, tells that results inside the meeting were at hand.
    one = F.lit(1)
    requests = [Request("a_", sums, [*days, None]), Request("m_", sums | {"any": one}, [*days, None], ["meeting_id"]), Request("e_", {"any": one})]
    names = ["m", "first_in", "first_out", "older_in", "older_out", "to", *(f"{k}_{n}" for n in counts for k in ("n", "win", "top3", "finish", "residual", "from"))]
    columns = {k: F.col(k) for k in ("normal", "rank", "fin_u", "res_u")}
    out = asof_rows(targets, d.history, requests, columns=columns, more=lambda c: newest_form(c, counts), outputs=doubles(names), order=["race_id", "entry_id"])
    left = lambda n, w: F.coalesce(out[f"a_{n}_{w}"], F.lit(0.0)) - F.coalesce(out[f"m_{n}_{w}"], F.lit(0.0))
    shown: dict[str, Column] = {}
    for n in counts:
        shown |= {f"sample_{n}": F.coalesce(F.col(f"n_{n}").cast("long"), F.lit(0)), f"complete_{n}": F.coalesce(F.col(f"n_{n}"), F.lit(0.0)) >= n, f"start_{n}": F.col(f"from_{n}").cast("long"), f"end_{n}": F.col("to").cast("long")}
        shown |= {f"{k}_last_{n}": r9(F.col(f"{k}_{n}")) for k in ("win", "top3", "finish", "residual")}
    for w in days:
        shown |= {f"sample_{w}d": left("n", w).cast("long"), f"finish_{w}d": r9(safe_rate(left("fin_sum", w), left("fin_n", w)) / UNIT)}
        shown |= {f"residual_{w}d": r9(safe_rate(left("res_sum", w), left("res_n", w)) / UNIT), f"top3_{w}d": r9(safe_rate(left("top3", w), left("n", w)))}
    shown |= {f"{k}_{a}_minus_{b}": r9(F.col(f"{k}_{a}") - F.col(f"{k}_{b}")) for k in ("finish", "residual") for a, b in ((3, 10), (5, 20))}
    for own, first, other, older in (("top3", "first_in", "first_out", "older_in"), ("outside_top3", "first_out", "first_in", "older_out")):
        run = F.coalesce(F.col(other) - 1, F.col("m") + F.coalesce(older, F.lit(0)))
        shown[f"{own}_streak"] = F.coalesce(F.when(F.col(first) == 1, run), F.lit(0)).cast("long")
    shown |= {"meeting_sample": F.coalesce(F.col("m_n_all"), F.lit(0.0)).cast("long"), "meeting_top3": r9(safe_rate(F.col("m_top3_all"), F.col("m_n_all"))), "meeting_finish": r9(safe_rate(F.col("m_fin_sum_all"), F.col("m_fin_n_all")) / UNIT)}
    complete = every([shown[f"complete_{n}"] for n in counts] + day_complete(days))
    return out.select("entry_id", *(v.alias(k) for k, v in shown.items()), *verdict(F.coalesce("e_any_all", F.lit(0.0)), F.coalesce("m_any_all", F.lit(0.0)), complete))


def abnormal_rates(d: Domain, counts: Sequence[int] = (3, 5, 10), days: Sequence[int] = (30, 90, 180)) -> DataFrame:
    """Rates of abnormal results over the last started events and over day windows, and how long ago the last one was.

    The last N started events are a difference of running counts: the count at the newest one less the count N before it.
    """
    targets = eligible(d.entries).select(*OWN)
    sums = {"st": F.col("started").cast("int"), "ab": F.col("abnormal").cast("int"), "dns": (F.col("state") == "DID_NOT_START").cast("int"), "dq": (F.col("state") == "DISQUALIFIED").cast("int"), "fall": (F.col("state") == "FALL_DNF").cast("int"), "ev": F.lit(1)}
    requests = [Request("w_", sums, [*days, None], highs={"bad_at": F.when(F.col("abnormal"), F.col("start_at"))}), Request("in_", {"ev": sums["ev"]}, keys=["meeting_id"])]
    names = ["end", "bad_k", "good_k", *(f"{k}_{n}" for n in counts for k in ("bad", "start"))]

    def newest(c: Careers) -> dict[str, np.ndarray]:
        o = c.order(chosen="started")
        end, at = o.before(c.cutoff), c.time[o.index]
        moment = lambda place: np.where(end > o.start, at[np.minimum(place, len(at) - 1)], np.nan) if len(at) else np.full(c.n, np.nan)
        bad = o.sums(c.event("abnormal"))
        number = lambda kind: o.highest(np.where(c.event(kind) == 1, place, np.nan), end) - o.start + 1
        place = np.full(len(c.time), np.nan)
        place[o.index] = np.arange(len(o.index))
        out = {"end": moment(end - 1), "bad_k": number("abnormal"), "good_k": number("normal")}
        for n in counts:
            first = np.maximum(end - n, o.start)
            out |= {f"bad_{n}": bad(first), f"start_{n}": moment(first)}
        return out

    columns = {k: F.col(k) for k in ("started", "abnormal", "normal")}
    out = asof_rows(targets, d.history, requests, columns=columns, more=newest, outputs=doubles(names), order=["race_id", "entry_id"])
    total = F.coalesce("w_st_all", F.lit(0.0))
    shown: dict[str, Column] = {}
    for n in counts:
        have = F.least(total, F.lit(n))
        shown |= {f"started_last_{n}": have.cast("long"), f"abnormal_last_{n}": r9(safe_rate(F.col("w_ab_all") - F.coalesce(f"bad_{n}", F.lit(0.0)), have)), f"complete_{n}": total >= n, f"start_{n}": F.col(f"start_{n}").cast("long"), f"end_{n}": F.col("end").cast("long")}
    for w in [*days, "all"]:
        at = lambda c, w=w: F.coalesce(F.col(f"w_{c}_{w}"), F.lit(0.0))
        shown |= {f"started_{w}": at("st").cast("long"), f"dns_{w}": at("dns").cast("long"), f"abnormal_rate_{w}": r9(safe_rate(at("ab"), at("st"))), f"dq_rate_{w}": r9(safe_rate(at("dq"), at("st"))), f"fall_rate_{w}": r9(safe_rate(at("fall"), at("st")))}
    shown |= {"days_since": r9((F.col("cutoff") - F.col("w_bad_at")) / DAY), "started_since": (total - F.col("bad_k")).cast("long"), "streak": (total - F.coalesce("good_k", F.lit(0.0))).cast("long")}
    complete = every([total >= n for n in counts] + day_complete(days))
    return out.select("entry_id", *(v.alias(k) for k, v in shown.items()), *verdict(F.coalesce("w_ev_all", F.lit(0.0)), F.coalesce("in_ev_all", F.lit(0.0)), complete))


def flips(rows: Column, field: str) -> Column:
    """How many rows differ in ``field`` from the row before."""
    return F.size(F.filter(F.transform(rows, lambda x, i: (i > 0) & (x[field] != F.get(rows, F.greatest(i - 1, F.lit(0)))[field])), lambda x: x))


def since(field: str, border: Column):
    return lambda x: x[field] >= border


#: What is measured of each window, and the most numbers that are laid out at once.
SPREAD = ("sample", "switches", "up_rate", "up_mean", "down_mean", "finish_sd", "finish_mad", "finish_iqr", "residual_sd", "residual_mad", "residual_iqr")
CELLS = 2_000_000


def spreads(c: Careers, counts: Sequence[int], days: Sequence[int]) -> dict[str, np.ndarray]:
    """Measures of each window of the last finishes. Every window is a beginning of these, newest first, so that the targets of a
    part are the rows of one matrix."""
    owner, event, _, _, have = last_finishes(c, max(counts), max(days))
    starts, at = np.concatenate(([0], np.cumsum(have))), c.time[event]
    sizes = {str(n): np.minimum(have, n) for n in counts} | {f"{w}d": np.bincount(owner[c.cutoff[owner] - at <= w * DAY], minlength=c.n) for w in days}
    out = {f"{m}_{w}": np.full(c.n, np.nan) for w in sizes for m in SPREAD}
    some = np.flatnonzero(have)
    for n in counts:
        last = starts[some] + np.minimum(have[some], n) - 1
        out |= {f"start_{n}": put(c.n, some, at[last]), f"end_{n}": put(c.n, some, at[starts[some]])}
    values = {k: c.event(f)[event] for k, f in (("finish", "finish_pct"), ("residual", "residual"), ("units", "res_u"), ("rank", "rank"))}
    # Targets with alike many finishes share a matrix.
    some, done = some[np.argsort(have[some], kind="stable")], 0
    while done < len(some):
        # As many targets as fit at the width of the last of them.
        fit = np.arange(1, len(some) - done + 1) * have[some[done:]] <= CELLS
        rows = some[done : done + max(1, int(fit.argmin()) if not fit.all() else len(fit))]
        done += len(rows)
        column = np.arange(have[rows[-1]])
        inside = column < have[rows][:, None]
        cell = np.where(inside, starts[rows][:, None] + column, 0)
        laid = {k: np.where(inside, v[cell], np.nan) for k, v in values.items()}
        top3 = laid["rank"] <= 3
        switched = np.cumsum(np.concatenate((np.zeros((len(rows), 1), int), top3[:, 1:] != top3[:, :-1]), axis=1), axis=1)
        for w, size in sizes.items():
            n = size[rows]
            width = max(1, int(n.max()))
            mine = column[:width] < n[:, None]
            found = {"sample": n, "switches": switched[np.arange(len(rows)), np.maximum(n - 1, 0)]}
            found |= sides(np.where(mine, laid["units"][:, :width], np.nan))
            for k in ("finish", "residual"):
                found |= {f"{k}_{m}": v for m, v in spread(np.where(mine, laid[k][:, :width], np.nan)).items()}
            for m, v in found.items():
                out[f"{m}_{w}"][rows] = v
    return out


def rate(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.full(len(whole), np.nan), where=whole > 0)


def sides(units: np.ndarray) -> dict[str, np.ndarray]:
    """Share of values above 0, and the means of those above and below; a row is a target, NaN no value."""
    up, down = units > 0, units < 0
    mean = lambda chosen: rate(np.where(chosen, units, 0.0).sum(1), chosen.sum(1)) / UNIT
    return {"up_rate": rate(up.sum(1), (~np.isnan(units)).sum(1)), "up_mean": mean(up), "down_mean": mean(down)}


def spread(values: np.ndarray) -> dict[str, np.ndarray]:
    """Standard deviation, median distance from the median and distance of the quartiles; a row is a target, NaN no value."""
    ordered = np.sort(values, axis=1)
    known = ~np.isnan(ordered)
    n = known.sum(1)
    away = np.sort(np.abs(ordered - quantile(ordered, n, 0.5)[:, None]), axis=1)
    return {"sd": deviation(ordered), "mad": quantile(away, n, 0.5), "iqr": quantile(ordered, n, 0.75) - quantile(ordered, n, 0.25)}


def deviation(ordered: np.ndarray) -> np.ndarray:
    """Standard deviation of each row's values, which are in order; NaN no value."""
    known = ~np.isnan(ordered)
    n = known.sum(1)
    mean = rate(np.where(known, ordered, 0.0).sum(1), n)[:, None]
    return np.sqrt(rate(np.where(known, (ordered - mean) ** 2, 0.0).sum(1), n))


def quantile(ordered: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Linear on (n - 1) p, of the first n values of each row."""
    place = np.maximum(n - 1, 0) * p
    low, high = (np.take_along_axis(ordered, f(place).astype(int)[:, None], 1)[:, 0] for f in (np.floor, np.ceil))
    return np.where(n > 0, low + (high - low) * (place - np.floor(place)), np.nan)


def volatility(d: Domain, counts: Sequence[int] = (3, 5, 10, 20, 30), days: Sequence[int] = (60, 90, 180, 365)) -> DataFrame:
    """Spread of finish percentile and residual over the last normal finishes before the meeting, upside and downside, switches."""
    targets, one = eligible(d.entries).select(*OWN), F.lit(1)
    requests = [Request("m_", {"any": one}, keys=["meeting_id"]), Request("e_", {"any": one})]
    windows = [*counts, *(f"{w}d" for w in days)]
    names = [*(f"{m}_{w}" for w in windows for m in SPREAD), *(f"{k}_{n}" for n in counts for k in ("start", "end"))]
    columns = {k: F.col(k) for k in ("normal", "rank", "finish_pct", "residual", "res_u")}
    out = asof_rows(targets, d.history, requests, columns=columns, more=lambda c: spreads(c, counts, days), outputs=doubles(names), order=["race_id", "entry_id"])
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    shown = {f"{m}_{w}": whole(f"{m}_{w}") if m in ("sample", "switches") else r9(F.col(f"{m}_{w}")) for w in windows for m in SPREAD}
    shown |= {f"{k}_{n}": F.col(f"{k}_{n}").cast("long") for n in counts for k in ("start", "end")} | {f"complete_{n}": whole(f"sample_{n}") >= n for n in counts}
    complete = every([shown[f"sample_{n}"] >= n for n in counts] + day_complete(days))
    return out.select("entry_id", *(v.alias(k) for k, v in shown.items()), *verdict(F.coalesce("e_any_all", F.lit(0.0)), F.coalesce("m_any_all", F.lit(0.0)), complete))


GAPS = "entry_id long, started long, normal long, abnormal long, pre long, inside long, n long, total long, q25 double, q50 double, q75 double, at_most long"


def career_gaps(targets: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    """One player's targets in one pass over the career: moments of the newest events, and order statistics of the gaps before.

    All gaps so far are kept in order. A target leaves the starts of its own meeting out, which are few: their gaps are taken out of
    the order, the gaps that bridge them put in, and both undone after the look-up.
    """
    events = events.sort_values(["start_at", "race_id", "entry_id"])
    at, normal, abnormal = (events[c].tolist() for c in ("start_at", "normal", "abnormal"))
    meetings = [None if pd.isna(m) else int(m) for m in events["meeting_id"]]
    gaps: list[int] = []
    of_meeting: dict[int, list[int]] = {}
    newest = {"started": None, "normal": None, "abnormal": None}
    done, out = 0, []
    targets = targets.sort_values("cutoff")
    for entry, cutoff, start, meeting in zip(targets["entry_id"].tolist(), targets["cutoff"].tolist(), targets["start_at"].tolist(), targets["meeting_id"], strict=True):
        while done < len(at) and at[done] < cutoff:
            if done:
                insort(gaps, at[done] - at[done - 1])
            newest |= {"started": at[done]} | ({"normal": at[done]} if normal[done] else {}) | ({"abnormal": at[done]} if abnormal[done] else {})
            if meetings[done] is not None:
                of_meeting.setdefault(meetings[done], []).append(done)
            done += 1
        own = [] if pd.isna(meeting) else of_meeting.get(int(meeting), [])
        out_gaps, bridges, k = [], [], 0
        while k < len(own):
            first = own[k]
            while k + 1 < len(own) and own[k + 1] == own[k] + 1:
                k += 1
            last = own[k]
            out_gaps += [at[x] - at[x - 1] for x in range(max(first, 1), min(last + 1, done - 1) + 1)]
            if first > 0 and last + 1 < done:
                bridges.append(at[last + 1] - at[first - 1])
            k += 1
        # Runs with one event between them share none of their gaps: each gap is named by its later event, once.
        for g in out_gaps:
            del gaps[bisect_left(gaps, g)]
        for g in bridges:
            insort(gaps, g)
        left = set(own)
        pre = next((x for x in range(done - 1, -1, -1) if x not in left), None)
        since = None if pre is None else start - at[pre]
        n = len(gaps)
        q = [None if not n else gaps[lo := int((n - 1) * p)] + (gaps[min(lo + 1, n - 1)] - gaps[lo]) * ((n - 1) * p - lo) for p in (0.25, 0.5, 0.75)]
        first_pre = next((x for x in range(done) if x not in left), None)
        total = at[pre] - at[first_pre] if n else None
        out.append((entry, newest["started"], newest["normal"], newest["abnormal"], None if pre is None else at[pre], at[own[-1]] if own else None, n, total, *q, bisect_right(gaps, since) if n else None))
        for g in bridges:
            del gaps[bisect_left(gaps, g)]
        for g in out_gaps:
            insort(gaps, g)
    return pd.DataFrame(out, columns=[c.split()[0] for c in GAPS.split(", ")]).astype({c.split()[0]: "Int64" if c.endswith("long") else "float64" for c in GAPS.split(", ")})


def rest_gaps(d: Domain) -> DataFrame:
    """Days since the previous event of each kind, and where the current gap stands among the gaps before the meeting.

    Gaps run between started events before the target's meeting. A player's targets and starts meet in one task, which goes over
    them once; no target carries a career. Where the meeting is unknown, all events are before it.
    """
    targets, events = eligible(d.entries), d.history
    started = events.where("started AND player_id IS NOT NULL").select("player_id", "start_at", "race_id", "entry_id", "meeting_id", "normal", "abnormal")
    asked = targets.where("player_id IS NOT NULL").select("player_id", "entry_id", "cutoff", "start_at", "meeting_id")
    found = asked.groupBy("player_id").cogroup(started.groupBy("player_id")).applyInPandas(career_gaps, GAPS)
    asked = targets.select("entry_id", "player_id", "start_at", "meeting_id", "cutoff")
    out = asof_rows(asked, events, [Request("", {"any": F.lit(1)})]).join(found, "entry_id", "left")
    age = lambda c: (F.col("start_at") - F.col(c)) / DAY
    n, gap = F.coalesce("n", F.lit(0)), age("pre")
    days = lambda c: F.col(c) / DAY
    status = verdict(F.coalesce("any_all", F.lit(0.0)), F.col("inside").isNotNull().cast("int"), n > 0)
    return out.select(
        "entry_id", r9(age("started")).alias("gap_started"), r9(age("normal")).alias("gap_normal"), r9(age("abnormal")).alias("gap_abnormal"), r9(gap).alias("gap_pre"), r9(age("inside")).alias("gap_in_meeting"),
        n.cast("long").alias("gap_sample"), r9(F.when(n > 0, F.col("total") / DAY / n)).alias("gap_mean"), r9(days("q50")).alias("gap_median"), r9(days("q25")).alias("gap_q25"), r9(days("q75")).alias("gap_q75"),
        r9(gap - days("q50")).alias("gap_minus_median"), r9(F.when(n > 0, F.col("at_most") / n)).alias("gap_percentile"), *status,
    )


def schedule_load(d: Domain, days: Sequence[int] = (7, 14, 21, 30, 45, 60)) -> DataFrame:
    """Starts, meetings, active days, track changes and longest run of active days in the windows before the cutoff.

    Only events inside the longest window meet a target: both sides are cut into blocks of that length and a target looks into
    its own block and the one before. What it finds is one short array, from which all windows are taken.
    """
    longest = max(days) * DAY
    all_targets = eligible(d.entries)
    targets = all_targets.select("entry_id", "player_id", "cutoff")
    events = d.history.where("started AND player_id IS NOT NULL").select("player_id", "start_at", "race_id", F.col("entry_id").alias("event_id"), "meeting_id", "track_id", F.floor(F.col("start_at") / longest).alias("block"))
    looked = targets.withColumn("block", F.explode(F.array(F.floor(F.col("cutoff") / longest), F.floor(F.col("cutoff") / longest) - 1)))
    met = looked.join(events, ["player_id", "block"]).where((F.col("start_at") < F.col("cutoff")) & (F.col("start_at") >= F.col("cutoff") - longest))
    row = F.struct("start_at", "race_id", "event_id", "meeting_id", "track_id", F.floor(F.col("start_at") / DAY).alias("day"))
    history = asof_rows(all_targets.select(*OWN), d.history, [Request("e_", {"any": F.lit(1)}), Request("m_", {"any": F.lit(1)}, keys=["meeting_id"])])
    out = history.join(met.groupBy("entry_id").agg(F.array_sort(F.collect_list(row)).alias("rows")), "entry_id", "left")
    out = out.withColumns({f"w_{w}": F.filter("rows", since("start_at", F.col("cutoff") - w * DAY)) for w in days})
    out = out.withColumns({f"d_{w}": F.array_distinct(F.transform(f"w_{w}", lambda x: x["day"])) for w in days})
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))
    zero = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"), F.lit(-9).cast("long").alias("last"))

    def step(a, x):
        now = F.when(x == a["last"] + 1, a["now"] + 1).otherwise(1)
        return F.struct(F.greatest(a["best"], now).alias("best"), now.alias("now"), x.alias("last"))

    shown: dict[str, Column] = {}
    for w in days:
        rows, active = F.col(f"w_{w}"), size(F.col(f"d_{w}"))
        unknown = F.filter(rows, lambda x: x["track_id"].isNull())
        run = F.aggregate(f"d_{w}", zero, step, lambda a: a["best"])
        shown |= {f"started_{w}": size(rows).cast("long"), f"meetings_{w}": size(F.array_distinct(F.transform(rows, lambda x: x["meeting_id"]))).cast("long"), f"active_days_{w}": active.cast("long"), f"idle_days_{w}": (w - active).cast("long")}
        shown |= {f"starts_per_day_{w}": r9(safe_rate(size(rows), active)), f"track_changes_{w}": F.coalesce(F.when(rows.isNotNull(), flips(rows, "track_id")), F.lit(0)).cast("long"), f"missing_track_{w}": size(unknown).cast("long"), f"longest_run_{w}": F.coalesce(run, F.lit(0)).cast("long")}
    return out.select("entry_id", *(v.alias(k) for k, v in shown.items()), *verdict(F.coalesce("e_any_all", F.lit(0.0)), F.coalesce("m_any_all", F.lit(0.0)), every(day_complete(days))))


def head_to_head(d: Domain) -> DataFrame:
    """The published columns of :func:`pair_history`."""
    return pair_history(d).drop("_rank_diff", "_pct_diff", "_res_diff")


def pair_history(d: Domain) -> DataFrame:
    """For each target and co-entrant: their earlier races together, who was ahead, and mean differences, seen from the target.

    Pair events are made once per confirmed race for unordered pairs of different players that stand once in it (five to nine
    entrants, so few pairs a race) and are summed as-of the target's cutoff per pair.
    """
    once = lambda df: df.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("race_id", "player_id"))).where("player_id IS NOT NULL AND _k = 1")
    dealt = lambda df, *names: once(df.select("race_id", *names).repartition("race_id"))
    columns = ("race_id", "player_id", "start_at", "normal", "rank", "fin_u", "res_u")
    past = dealt(d.history, *columns[1:]).select(*columns)
    a, b = (past.select(F.col("race_id"), *(F.col(c).alias(f"{x}_{c}") for c in columns[1:])) for x in "ab")
    both = F.col("a_normal") & F.col("b_normal")
    events = a.join(b, "race_id").where("a_player_id < b_player_id").select(
        F.col("a_player_id").alias("p"), F.col("b_player_id").alias("q"), F.col("a_start_at").alias("start_at"), both.cast("int").alias("normal"), (both & (F.col("a_rank") < F.col("b_rank"))).cast("int").alias("p_ahead"), (both & (F.col("a_rank") > F.col("b_rank"))).cast("int").alias("q_ahead"),
        F.when(both, F.col("b_rank") - F.col("a_rank")).alias("rank_diff"), F.when(both, F.col("a_fin_u") - F.col("b_fin_u")).alias("pct_diff"), F.when(both, F.col("a_res_u") - F.col("b_res_u")).alias("res_diff"),
    )
    now = dealt(eligible(d.entries), "entry_id", "player_id", "cutoff")
    p, q = (now.select("race_id", F.col("player_id").alias(x), F.col("entry_id").alias(f"{x}_entry"), "cutoff") for x in "pq")
    # Both of a pair ask for the same sums, so that it is one target.
    target = p.join(q.drop("cutoff"), "race_id").where("p < q").drop("race_id")
    sums = {"direct": F.lit(1), "normal": F.col("normal"), "p_ahead": F.col("p_ahead"), "q_ahead": F.col("q_ahead"), "rank_diff": F.coalesce("rank_diff", F.lit(0)), "pct_diff": F.coalesce("pct_diff", F.lit(0)), "res_n": F.col("res_diff").isNotNull().cast("int"), "res_diff": F.coalesce("res_diff", F.lit(0))}
    side = lambda entry, other, first: F.struct(F.col(entry).alias("entry_id"), F.col(other).alias("other_id"), F.lit(first).alias("first"))
    out = asof_rows(target, events, [Request("", sums, keys=["q"])], "p").withColumn("_s", F.explode(F.array(side("p_entry", "q", True), side("q_entry", "p", False))))
    first = F.col("_s.first")
    sign = F.when(first, 1).otherwise(-1)
    at = lambda n: F.coalesce(F.col(f"{n}_all"), F.lit(0.0))
    return out.select(
        "_s.entry_id", "_s.other_id", at("direct").cast("long").alias("direct_count"), at("normal").cast("long").alias("normal_count"), F.when(first, at("p_ahead")).otherwise(at("q_ahead")).cast("long").alias("ahead_count"), F.when(first, at("q_ahead")).otherwise(at("p_ahead")).cast("long").alias("behind_count"),
        (at("normal") - at("p_ahead") - at("q_ahead")).cast("long").alias("tied_count"), r9(safe_rate(F.when(first, at("p_ahead")).otherwise(at("q_ahead")), at("normal"))).alias("ahead_rate"), r9(safe_rate(sign * at("rank_diff"), at("normal"))).alias("mean_rank_diff"), r9(safe_rate(sign * at("pct_diff"), at("normal")) / UNIT).alias("mean_pct_diff"), r9(safe_rate(sign * at("res_diff"), at("res_n")) / UNIT).alias("mean_residual_diff"),
        *((sign * at(n)).alias(f"_{n}") for n in sums if n.endswith("_diff")), at("res_n").cast("long").alias("residual_sample"), (at("direct") - at("normal")).cast("long").alias("abnormal_count"),
    )


def pair_summary(d: Domain) -> DataFrame:
    """Head-to-head of every target against all its co-entrants together: totals, weighted means and status.

    Rates weigh each opponent by the normal meetings with it; the residual mean weighs by its samples.
    """
    race = Window.partitionBy("race_id")
    own = Window.partitionBy("race_id", "player_id")
    e = eligible(d.entries).withColumn("twice", F.col("player_id").isNotNull() & (F.count(F.lit(1)).over(own) > 1))
    e = e.withColumns({"others": F.count("player_id").over(race) - F.col("player_id").isNotNull().cast("int"), "unresolved": F.count_if(F.col("player_id").isNull()).over(race) - F.col("player_id").isNull().cast("int"), "any_twice": F.max("twice").over(race)})
    n = F.col("normal_count")
    sums = pair_history(d).groupBy("entry_id").agg(
        F.count_if(F.col("direct_count") > 0).alias("opponents"), F.sum("direct_count").alias("direct"), F.sum(n).alias("normal"), F.sum("ahead_count").alias("ahead"), F.sum("behind_count").alias("behind"), F.sum("tied_count").alias("tied"),
        F.sum("_rank_diff").alias("ranks"), F.sum("_pct_diff").alias("pcts"), F.sum("_res_diff").alias("residuals"), F.sum("residual_sample").alias("residual_sample"),
    )
    out = e.join(sums, "entry_id", "left")
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = status_ladder([(F.col("player_id").isNull(), "MISSING_INPUT"), (F.col("twice"), "INVALID_INPUT"), (F.col("others") == 0, "MISSING_INPUT"), (at("direct") == 0, "NO_HISTORY"), (at("normal") == 0, "PARTIAL")])
    reasons = F.array_compact(F.array(F.when(F.col("unresolved") > 0, "UNRESOLVED_CURRENT_COENTRANTS"), F.when(at("residual_sample") < at("normal"), "MISSING_HISTORICAL_SCORE_CONTEXT_FOR_RESIDUAL")))
    return out.select(
        "entry_id", at("opponents").alias("opponents_met"), at("direct").alias("direct_count"), at("normal").alias("normal_count"), (at("direct") - at("normal")).alias("abnormal_count"), at("ahead").alias("ahead_count"), at("behind").alias("behind_count"), at("tied").alias("tied_count"),
        r9(safe_rate(F.col("ahead"), F.col("normal"))).alias("ahead_rate"), r9(safe_rate(F.col("ranks"), F.col("normal"))).alias("mean_rank_diff"), r9(safe_rate(F.col("pcts"), F.col("normal")) / UNIT).alias("mean_pct_diff"),
        r9(safe_rate(F.col("residuals"), F.col("residual_sample")) / UNIT).alias("weighted_residual"), status.alias("status"), quality(status, reasons).alias("quality"), F.concat_ws(",", reasons).alias("reasons"),
    )


def steps(d: Domain) -> DataFrame:
    """Adjacent started events of a player inside a meeting, with the stage and result of the one before."""
    order = Window.partitionBy("player_id", "meeting_id").orderBy("start_at", "race_id", "entry_id")
    e = d.history.where("started AND player_id IS NOT NULL").withColumn("stage", stage(F.col("race_type")))
    return e.withColumns({"prev_stage": F.lag("stage").over(order), "prev_rank": F.lag("rank").over(order), "prev_normal": F.lag("normal").over(order)})


def transitions(d: Domain) -> DataFrame:
    """Steps from one start to the next inside a player's meeting, by the stages of both: how the rank changed."""
    step = steps(d).where("normal AND prev_normal")
    change = F.col("prev_rank") - F.col("rank")
    return step.groupBy("prev_stage", "stage").agg(
        F.count(F.lit(1)).alias("steps"), r9(F.avg(change)).alias("mean_rank_change"), F.count_if(change > 0).alias("improved"), F.count_if(change < 0).alias("worsened"), F.count_if(change == 0).alias("same"),
        F.count_if((F.col("prev_rank") <= 3) & (F.col("rank") <= 3)).alias("top3_kept"), r9(F.avg("res_u") / UNIT).alias("mean_next_residual"),
    )


def meeting_transition(d: Domain) -> DataFrame:
    """The target's previous start in its meeting, and how the player fared in earlier meetings after a like step.

    A like step goes from the same stage to the same stage, with both results normal; a subset has the same previous rank too.
    """
    staged = lambda df: df.withColumn("stage", stage(F.col("race_type")))
    targets, started = staged(eligible(d.entries)).select(*OWN, "start_at", "stage"), staged(d.history.where("started"))
    before = {"prev_stage": F.col("stage"), "prev_rank": F.col("rank"), "prev_normal": F.col("normal"), "prev_at": F.col("start_at"), "prev_confirmed_at": F.expr(CONFIRMED_AT)}
    shape, names = started.select(*(c.alias(n) for n, c in before.items())).schema, list(before)

    def newest(c: Careers) -> dict[str, object]:
        o = c.order("meeting_id")
        return {n: c.taken(n, o.newest(o.before(c.cutoff))) for n in names}

    targets = asof_rows(targets, started, [Request("own_", {"n": F.lit(1)}, keys=["meeting_id"])], columns=before, more=newest, outputs=shape, order=["race_id", "entry_id"]).drop("own_n_all")
    change = F.col("prev_rank") - F.col("rank")
    sums = {"n": F.lit(1), "change": change, "up": (change > 0).cast("int"), "down": (change < 0).cast("int"), "top3": ((F.col("prev_rank") <= 3) & (F.col("rank") <= 3)).cast("int"), "res_n": F.col("res_u").isNotNull().cast("int"), "res": F.coalesce("res_u", F.lit(0))}
    few = {k: sums[k] for k in ("n", "change")}
    like, exact = ["prev_stage", "stage"], ["prev_stage", "stage", "prev_rank"]
    requests = [Request("t_", sums, keys=like), Request("x_", few, keys=exact), Request("it_", sums, keys=[*like, "meeting_id"]), Request("ix_", few, keys=[*exact, "meeting_id"])]
    out = observed_steps(d, asof_rows(targets, steps(d).where("normal AND prev_normal"), requests))
    at = lambda p, n: F.coalesce(F.col(f"{p}{n}_all") - F.col(f"i{p}{n}_all"), F.lit(0.0))
    n = at("t_", "n")
    status = status_ladder([
        (F.col("player_id").isNull() | F.col("meeting_id").isNull() | (F.col("stage") == "UNKNOWN"), "MISSING_INPUT"), (F.col("prev_at").isNull(), "NOT_APPLICABLE"), (~F.col("prev_normal"), "PARTIAL"),
        (F.col("prev_stage") == "UNKNOWN", "MISSING_INPUT"), (n == 0, "NO_HISTORY"),
    ])
    seen = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    # Known is a result of which the confirmation was seen by the cutoff; without any confirmation that is not known.
    prev_observed = F.when(F.col("prev_at").isNotNull(), F.col("prev_confirmed_at") <= F.col("cutoff"))
    named = F.coalesce(F.when(F.col("player_id").isNull(), "PLAYER_ID_UNRESOLVED"), F.when(F.col("meeting_id").isNull(), "TARGET_MEETING_MISSING"), F.when(F.col("stage") == "UNKNOWN", "UNKNOWN_CURRENT_STAGE"), F.when(F.col("prev_at").isNull(), ""), F.when(~F.col("prev_normal"), "ABNORMAL_PREVIOUS_RESULT"), F.when(F.col("prev_stage") == "UNKNOWN", "UNKNOWN_PREVIOUS_STAGE"), F.when(n == 0, "NO_OBSERVED_TRANSITION_HISTORY"))
    unseen = (F.col("prev_at").isNotNull() & ~F.coalesce(prev_observed, F.lit(False))) | (seen("steps_after") + seen("steps_unknown") > 0)
    reasons = F.array_compact(F.array(F.when(named != "", named), F.when(unseen, "OFFICIAL_RESULT_AVAILABILITY_NOT_RECONSTRUCTED")))
    evidence = {"prev_observed": prev_observed, "steps_observed_before": seen("steps_before"), "steps_observed_after": seen("steps_after"), "steps_observation_unknown": seen("steps_unknown"), "quality": quality(status, reasons), "reasons": F.concat_ws(",", reasons)}
    return out.select(
        *(v.alias(k) for k, v in evidence.items()), "entry_id", "stage", "prev_stage", "prev_rank", r9((F.col("start_at") - F.col("prev_at")) / 3600).alias("hours_since"), n.cast("long").alias("like_steps"), r9(safe_rate(at("t_", "change"), n)).alias("mean_rank_change"),
        at("t_", "up").cast("long").alias("improved"), at("t_", "down").cast("long").alias("worsened"), (n - at("t_", "up") - at("t_", "down")).cast("long").alias("same"), at("t_", "top3").cast("long").alias("top3_kept"),
        r9(safe_rate(at("t_", "res"), at("t_", "res_n")) / UNIT).alias("mean_next_residual"), at("x_", "n").cast("long").alias("exact_steps"), r9(safe_rate(at("x_", "change"), at("x_", "n"))).alias("exact_rank_change"), status.alias("status"),
    )


def observed_steps(d: Domain, targets: DataFrame) -> DataFrame:
    """``targets`` with how many results of normal steps in other meetings were confirmed by its cutoff, later, or never.

    A result takes part from the moment that its first normal step is complete: its own start if it ends one, else the next start.
    """
    order = Window.partitionBy("player_id", "meeting_id").orderBy("start_at", "race_id", "entry_id")
    e = d.history.where("started AND player_id IS NOT NULL").withColumn("_c", F.expr(CONFIRMED_AT))
    e = e.withColumns({"_before": F.lag("normal").over(order), "_after": F.lead("normal").over(order), "_next": F.lead("start_at").over(order)})
    entered = F.when(F.col("_before"), F.col("start_at")).when(F.col("_after"), F.col("_next"))
    events = two_clocks(e.where("normal AND (_before OR _after)").withColumn("_entered", entered), F.col("_entered"), F.col("_c"))
    first = F.col("_clock") == 1
    sums = {"in": first.cast("int"), "never": (first & F.col("_c").isNull()).cast("int"), "known": (~first).cast("int")}
    found = asof_rows(targets, events, [Request("o_", sums), Request("om_", sums, keys=["meeting_id"])])
    at = lambda n: F.col(f"o_{n}_all") - F.col(f"om_{n}_all")
    return found.withColumns({"steps_before": at("known"), "steps_after": at("in") - at("known") - at("never"), "steps_unknown": at("never")})


def stage_experience(d: Domain) -> DataFrame:
    """Starts and performance in semifinals and finals before the cutoff, meetings of the target's grade, grades and classes of all
    events, and the strength of the fields of normal finishes."""
    graded = lambda df: df.withColumns({"stage": stage(F.col("race_type")), "grade": F.expr(MEETING_GRADE)})
    targets, events = graded(eligible(d.entries)).select(*OWN, "grade"), graded(d.history)
    late, started = F.col("stage").isin("SEMIFINAL", "FINAL"), F.col("started")
    pick = lambda c, cond: F.when(cond, c).otherwise(0)
    count = lambda cond: cond.cast("int")
    sums = {"events": F.lit(1), "all": count(started), "semi": count(started & (F.col("stage") == "SEMIFINAL")), "final": count(started & (F.col("stage") == "FINAL"))}
    shares = lambda name, own: {f"{name}_n": pick(F.lit(1), own), f"{name}_win": pick(count(F.col("rank") == 1), own), f"{name}_res_n": pick(count(F.col("res_u").isNotNull()), own), f"{name}_res": pick(F.coalesce("res_u", F.lit(0)), own)}
    groups = {"late": late, "sf": F.col("stage") == "SEMIFINAL", "fi": F.col("stage") == "FINAL", "other": ~late}
    for name, cond in groups.items():
        sums |= shares(name, cond & started & F.col("normal"))
    sums |= {f"class_{k}": count(class_bucket(F.col("race_type")) == k) for k in ("A", "S", "UNKNOWN")}
    whole = F.col("normal") & F.col("score_mean").isNotNull()
    sums |= {"ctx": count(whole), "ctx_mean": pick(F.coalesce("mean_u", F.lit(0)), whole), "ctx_max": pick(F.coalesce("score_max", F.lit(0.0)), whole), "ctx_sd": pick(F.coalesce(F.round(F.col("score_sd") * 10**6), F.lit(0)), whole), "ctx_pct": pick(F.coalesce(F.round(F.col("score_pct") * UNIT), F.lit(0)), whole)}
    same = shares("grade", F.col("normal")) | {"grade_events": F.lit(1)}
    grades = asof_map(targets, events.withColumn("grade", F.coalesce("grade", F.lit("UNKNOWN"))), "grade")
    out = asof_rows(targets, events, [Request("", sums), Request("g_", same, keys=["grade"])]).join(grades, "entry_id", "left")
    at = lambda n: F.coalesce(F.col(f"{n}_all"), F.lit(0.0))
    status = status_ladder([(F.col("player_id").isNull(), "MISSING_INPUT"), (at("events") == 0, "NO_HISTORY")])
    reasons = F.array_compact(F.array(F.when(F.col("player_id").isNull(), "PLAYER_ID_UNRESOLVED").when(at("events") == 0, "NO_ACQUIRED_HISTORY")))
    classes = F.concat_ws(",", *(F.when(at(f"class_{k}") > 0, F.concat(F.lit(f"{k}="), at(f"class_{k}").cast("long").cast("string"))) for k in ("A", "S", "UNKNOWN")))
    listed = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    shown = {"event_count": at("events").cast("long"), "started_count": at("all").cast("long"), "semifinal_starts": at("semi").cast("long"), "final_starts": at("final").cast("long")}
    for name in groups:
        shown |= {f"{name}_sample": at(f"{name}_n").cast("long"), f"{name}_win_rate": r9(safe_rate(at(f"{name}_win"), at(f"{name}_n"))), f"{name}_mean_residual": r9(safe_rate(at(f"{name}_res"), at(f"{name}_res_n")) / UNIT)}
    section = lambda n: (at(f"{n}_res_n"), safe_rate(at(f"{n}_res"), at(f"{n}_res_n")) / UNIT)
    shown["late_mean_residual"] = r9(checked_aggregate(section("late")[1], [section("sf"), section("fi")], "late_mean_residual"))
    shown |= {"target_grade": F.col("grade"), "same_grade_events": at("g_grade_events").cast("long"), "same_grade_sample": at("g_grade_n").cast("long"), "same_grade_win_rate": r9(safe_rate(at("g_grade_win"), at("g_grade_n"))), "same_grade_mean_residual": r9(safe_rate(at("g_grade_res"), at("g_grade_res_n")) / UNIT)}
    shown |= {"grade_distribution": F.coalesce(listed, F.lit("")), "class_distribution": classes, "context_sample": at("ctx").cast("long"), "field_mean_score": r9(safe_rate(at("ctx_mean"), at("ctx")) / (6 * UNIT)), "field_best_score": r9(safe_rate(at("ctx_max"), at("ctx")))}
    shown |= {"field_score_sd": r9(safe_rate(at("ctx_sd"), at("ctx")) / 10**6), "mean_score_percentile": r9(safe_rate(at("ctx_pct"), at("ctx")) / UNIT), "status": status, "quality": quality(status, reasons), "reasons": F.concat_ws(",", reasons)}
    return out.select("entry_id", *(v.alias(k) for k, v in shown.items()))


def stage_sections(d: Domain) -> DataFrame:
    """Residual samples and unrounded means of semifinals, finals and both together before each target's cutoff."""
    events = d.history.where("started AND normal AND res_u IS NOT NULL").withColumn("stage", stage(F.col("race_type")))
    groups = {"sf": F.col("stage") == "SEMIFINAL", "fi": F.col("stage") == "FINAL", "late": F.col("stage").isin("SEMIFINAL", "FINAL")}
    sums = {f"{k}_n": c.cast("int") for k, c in groups.items()} | {f"{k}_u": F.when(c, F.col("res_u")).otherwise(0) for k, c in groups.items()}
    out = asof_rows(eligible(d.entries).select(*OWN), events, [Request("", sums)])
    at = lambda n: F.coalesce(F.col(f"{n}_all"), F.lit(0.0))
    return out.select("entry_id", *(x for k in groups for x in (at(f"{k}_n").cast("long").alias(f"{k}_n"), (safe_rate(at(f"{k}_u"), at(f"{k}_n")) / UNIT).alias(f"{k}_mean"))))


def class_bucket(kind: Column) -> Column:
    """Class by the first two characters of the race type."""
    # The prefixes of the two classes.
    return F.coalesce(F.when(F.substring(kind, 1, 2) == "Ａ級", "A"), F.when(F.substring(kind, 1, 2) == "Ｓ級", "S"), F.lit("UNKNOWN"))


#: Scopes of the position statistics: name and keys.
SCOPES = {"field_bike": ("entrants", "bike"), "field": ("entrants",), "track_field_bike": ("track_id", "entrants", "bike"), "track_field": ("track_id", "entrants"), "field_frame": ("entrants", "frame"), "track_field_frame": ("track_id", "entrants", "frame")}
SCOPE_DELTAS = {"bike": ("field_bike", "field"), "track_bike": ("track_field_bike", "track_field"), "frame": ("field_frame", "field"), "track_frame": ("track_field_frame", "track_field")}


def position_bias(d: Domain) -> DataFrame:
    """What all earlier normal finishes say about the target's position, in six scopes, and the differences between scopes."""
    race = Window.partitionBy("race_id")
    targets = eligible(d.entries).select("race_id", "entry_id", "player_id", "cutoff", "track_id", "entrants", "actual", "bike", "frame").repartition("race_id")
    targets = targets.withColumns({"same_bike": F.count(F.lit(1)).over(Window.partitionBy("race_id", "bike")), "nth": F.row_number().over(race.orderBy("bike")), "n": F.count(F.lit(1)).over(race)})
    out = scoped_sums(targets, d.history.where("normal"), SCOPES, performance_sums())
    found = {name: performance(out, f"{name}_", None) for name in SCOPES}
    shown: dict[str, Column] = {}
    for name, p in found.items():
        shown |= {f"{name}_sample": p[f"{name}_sample_all"]} | {f"{name}_{k}": r9(p[f"{name}_{k}_all"]) for k in ("win_rate", "top3_rate", "mean_finish", "mean_residual")}
    for name, (one, two) in SCOPE_DELTAS.items():
        shown |= {f"delta_{name}_{k}": r9(found[one][f"{one}_{k}_all"] - found[two][f"{two}_{k}_all"]) for k in ("win_rate", "mean_finish", "mean_residual")}
    status = status_ladder([(F.col("bike").isNull() | F.col("entrants").isNull(), "MISSING_INPUT"), ((F.col("entrants") != F.col("actual")) | (F.col("same_bike") > 1), "INVALID_INPUT"), (found["field_bike"]["field_bike_sample_all"] == 0, "NO_HISTORY")])
    reasons = F.array_compact(F.array(F.when(F.col("frame").isNull(), "MISSING_FRAME_NUMBER"), F.when(F.col("player_id").isNull(), "PLAYER_ID_UNRESOLVED_FOR_PLAYER_SPECIFIC_COMPONENT"), F.when(F.col("track_id").isNull(), "RACETRACK_MISSING_FOR_TRACK_COMPONENT")))
    nth, n = F.col("nth"), F.col("n")
    order = {"order_index": nth.cast("long"), "order_percentile": r9(F.when(n > 1, (nth - 1) / (n - 1)))}
    return out.select("entry_id", *(v.alias(k) for k, v in (shown | order).items()), status.alias("status"), quality(status, reasons).alias("quality"), F.concat_ws(",", reasons).alias("reasons"))
