"""The shared pass of the signals against the statistics themselves, plain loops and made careers."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tempolane.queries  # noqa: F401  (registers what the signals are compared with)
from tempolane.catalog import audits as A
from tempolane.operators import bootstrap as B
from tempolane.operators import ridge as R
from tempolane.operators.careers import Careers, Unnested
from tempolane.plans import features as P
from tempolane.plans import signals as G
from tempolane.registry import QUERIES
from tempolane.sources.domain import domain


@pytest.mark.parametrize("stat", list(A.SIGNALS))
def test_one_pass_gives_what_the_statistics_publish(spark, small, stat):
    name, column, _ = A.SIGNALS[stat]
    want = QUERIES[name](spark, small).select("entry_id", "status", F.col(column).cast("double").alias("signal"))
    got = A.of_stat(spark, small, stat)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_statistics_share_one_dealing_by_player(spark, small):
    """Each statistic used to deal targets and events by player for itself."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    whole = G.career_signals(domain(spark, small))
    assert plan(whole).count("Exchange hashpartitioning(_s") == 1 and plan(whole).count("MapInArrow") == 1
    for name in ("signals_run_summary", "report_coherent_batch"):
        assert "Exchange hashpartitioning(_s" not in plan(QUERIES[name](spark, small)) and "Join" not in plan(QUERIES[name](spark, small)).replace("BroadcastNestedLoopJoin", "")


def test_quantiles_keep_no_statistic_in_one_task(spark, small):
    """a percentile held all values of a statistic."""
    assert "percentile" not in QUERIES["report_quantiles"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_counts_of_values_up_to_a_limit():
    r = np.random.default_rng(3)
    for size in (0, 1, 2, 7, 300):
        values = r.integers(0, 20, size)
        start = r.integers(0, size + 1, 200)
        end = np.array([r.integers(s, size + 1) for s in start])
        limit = r.integers(-2, 23, 200)
        assert G.at_most(values, start, end, limit).tolist() == [int((values[s:e] <= x).sum()) for s, e, x in zip(start, end, limit, strict=True)]


def made(seed: int, players: int = 6, events: int = 30, targets: int = 25) -> tuple[Careers, pd.DataFrame, pd.DataFrame]:
    r = random.Random(seed)
    past = pd.DataFrame([(p, r.randrange(60), r.choice([1, 2, 3, 4, None]), r.random() < 0.8) for p in range(players) for _ in range(r.randrange(events))], columns=["player", "start_at", "meeting_id", "started"])
    past = past.sort_values(["player", "start_at"], kind="stable").reset_index(drop=True)
    past["race_id"] = past["entry_id"] = past.index
    asked = pd.DataFrame([(p, c, c + r.randrange(5), r.choice([1, 2, 3, 4, None])) for p in range(players) for c in [r.randrange(70) for _ in range(targets)]], columns=["player", "cutoff", "start_at", "meeting_id"])
    asked["entry_id"] = asked.index
    rows = [(int(x.player), int(x.cutoff), None if pd.isna(x.meeting_id) else int(x.meeting_id), {"start_at": int(x.start_at)}, None, None) for x in asked.itertuples()]
    rows += [(int(x.player), int(x.start_at), None if pd.isna(x.meeting_id) else int(x.meeting_id), None, {"started": bool(x.started)}, None) for x in past.itertuples()]
    rows.sort(key=lambda x: x[:2])
    # Targets in the order in which the careers have them.
    order = [(x[0], x[1], x[2], x[3]["start_at"]) for x in rows if x[3]]
    asked = pd.DataFrame(order, columns=["player", "cutoff", "meeting_id", "start_at"])
    asked["entry_id"] = asked.index
    cols = list(zip(*rows, strict=True))
    table = pa.table({"_s": pa.array(cols[0], pa.int64()), "_t": pa.array(cols[1], pa.int64()), "_k_meeting_id": pa.array(cols[2], pa.int64()), "_r": pa.array(cols[3], pa.struct([("start_at", pa.int64())])), "_e": pa.array(cols[4], pa.struct([("started", pa.bool_())]))})
    return Careers(table, ["meeting_id"]), asked, past


@pytest.mark.parametrize("seed", range(8))
def test_gaps_equal_those_of_a_career_kept_in_order(seed):
    c, asked, past = made(seed)
    n, found = G.gaps(c)
    for player, own in asked.groupby("player"):
        events = past[(past["player"] == player) & past["started"]].assign(normal=True, abnormal=False)
        want = P.career_gaps(own, events).set_index("entry_id")
        for k in own["entry_id"]:
            assert n[k] == want.loc[k, "n"] and (n[k] == 0 or found[k] == want.loc[k, "at_most"]), (player, k)


def test_a_career_without_events():
    c, asked, _ = made(1, events=1)
    assert [x.tolist() for x in G.gaps(c)] == [[0] * len(asked)] * 2


def test_lists_meet_element_by_element():
    """Targets and events stand once for each rival; rows that are both are dealt once."""
    table = pa.table({
        "_s": pa.array([1, 1, 1], pa.int64()), "_t": pa.array([10, 20, 30], pa.int64()), "_c": pa.array([9, 19, 30], pa.int64()), "_r": pa.array([{"x": 1}] * 3), "_e": pa.array([{"x": 1}, {"x": 1}, None]),
        "_k_rivals": pa.array([[7, 8], [8], [7, 8, 9]], pa.list_(pa.int64())), "_k_marks": pa.array([[1.0, None], [3.0], [0.0, 0.0, 0.0]], pa.list_(pa.float64())),
    })
    met = Unnested(Careers(table, ["rivals", "marks"]), "rivals", "marks")
    o = met.order("rivals")
    assert met.owner.tolist() == [0, 0, 1, 2, 2, 2] and met.of.tolist() == [0, 0, 1]
    assert (o.before(met.cutoff) - o.start).tolist() == [0, 0, 1, 1, 2, 0] and met.also.to_pylist() == [1.0, None, 3.0]


@pytest.mark.parametrize(("ties", "levels"), [(128, 5), (1, 5), (1, 40), (1, 4000), (128, 4000)])
def test_orders_give_what_pairs_win(monkeypatch, ties, levels):
    """Few and many scores, ties across chunks, several labels: twice the pairs won by brute force."""
    monkeypatch.setattr(B, "TIES", ties)
    monkeypatch.setattr(B, "CHUNK", 100)
    r = np.random.default_rng(levels)
    n, places = 700, 120
    at, score, drawn = r.integers(0, places, n), r.integers(0, levels, n) / 7, r.integers(0, 4, (places, 6)).astype(np.int32)
    label = np.where(r.random(n) < 0.1, np.nan, r.random(n) < 0.3)
    second = np.where(np.isnan(label), np.nan, (label == 1) | (r.random(n) < 0.3))
    scores = [(score, label), (-score, second), (r.random(n), label), (score, np.full(n, np.nan))]
    found = B.rankings(at, scores)
    assert sorted(k for _, members in found for k, _ in members) == [0, 1, 2]
    assert len(found) == (2 if ties >= min(levels, n) else 3)
    for one, members in found:
        for (k, back), (won, p, q) in zip(members, one.won(drawn), strict=True):
            s, y = scores[k]
            pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
            pairs = 2 * (s[pos][:, None] > s[neg]) + (s[pos][:, None] == s[neg])
            w = drawn[at]
            want = np.einsum("ir,ij,jr->r", w[pos].astype(np.int64), pairs.astype(np.int64), w[neg].astype(np.int64))
            assert (p == w[pos].sum(0)).all() and (q == w[neg].sum(0)).all()
            assert ((2 * p * q - won if back else won) == want).all()


def test_a_scope_of_one_task_makes_its_draws_once(spark, monkeypatch):
    """losses and AUC took the draws apart, and arrays of all replicates were dealt for the intervals. Both ways agree."""
    made, chunks = [], B.weight_chunks
    r = random.Random(4)
    rows = [(s, race, int(r.random() < 0.4), r.random(), r.choice([0.2, 0.3, 0.7]), 1 + race % 3) for s in "st" for race in range(20) for _ in range(4)]
    df = spark.createDataFrame(rows, "scope string, race_id long, label int, baseline double, incremental double, bin int")
    monkeypatch.setattr(B, "weight_chunks", lambda *args: made.append(1) or chunks(*args))
    assert len(B.whole_metrics(df.where("scope = 's'").toPandas(), {"": ""}, 30, 5)) == 3 and made == [1]
    monkeypatch.setattr(B, "weight_chunks", chunks)
    one = {(x["scope"], x["metric"]): x for x in B.paired_metrics(df, 30, 5).collect()}
    assert len(one) == 6
    columns, names, rate = ["k", "r"], ["x"], lambda own, whole: [own["r"] / own["k"] - whole["r"] / whole["k"]]
    sums = df.groupBy("scope", "bin", "race_id").agg(F.count(F.lit(1)).alias("k"), F.sum("label").cast("double").alias("r"))
    first = {(x["scope"], x["_by"]): x for x in B.intervals(sums, columns, names, rate, 30, 5, by="bin").collect()}
    monkeypatch.setattr(B, "ROWS", 5)
    monkeypatch.setattr(B, "PLACES", 4)
    two = {(x["scope"], x["metric"]): x for x in B.paired_metrics(df, 30, 5).collect()}
    second = {(x["scope"], x["_by"]): x for x in B.intervals(sums, columns, names, rate, 30, 5, by="bin").collect()}
    for a, b in ((one, two), (first, second)):
        assert sorted(a) == sorted(b)
        for k, x in a.items():
            assert all(abs(v - b[k][c]) < 1e-12 if isinstance(v, float) else v == b[k][c] for c, v in x.asDict().items()), k


@pytest.mark.parametrize("rows_held", [1 << 20, 5])
def test_replay_of_a_scope_equals_effects_and_centred_residuals(spark, monkeypatch, rows_held):
    """the sums of each race and bin were written and dealt twice. One scope a task gives the same, blocks too."""
    r = random.Random(8)
    found = lambda t, s: (None, None, None) if (t, s) == ("b", "t") else (int(r.random() < 0.3), r.random(), r.random())
    rows = [(s, race, (race + k) % 3 if race < 27 else 5, *(x for t in "ab" for x in found(t, s))) for s in "st" for race in range(30) for k in range(3)]
    df = spark.createDataFrame(rows, "scope string, race_id long, bin int, " + ", ".join(f"label_{t} int, baseline_{t} double, incremental_{t} double" for t in "ab"))
    bins = spark.createDataFrame([(s, b) for s in "stu" for b in (1, 2, 4, 5)], "scope string, bin int")
    every = bins.union(spark.createDataFrame([("s", 0), ("t", 0)], "scope string, bin int"))
    want = B.bin_effects(df, every, 25, 5, "ab").where("bin > 0 OR rows > 0").join(B.centred_residuals(df, every, 25, 5, "ab"), ["scope", "bin"], "left")
    want = {(x["scope"], x["bin"]): x.asDict() for x in want.collect()}
    monkeypatch.setattr(B, "ROWS", rows_held)
    got = {(x["scope"], x["bin"]): x.asDict() for x in B.replayed(df, bins, 25, 5, "ab").collect()}
    assert sorted(got) == sorted(want) and len(got) == 27
    for k, w in want.items():
        assert sorted(got[k]) == sorted(w)
        assert all(abs(got[k][c] - v) < 1e-12 if isinstance(v, float) else got[k][c] == v for c, v in w.items()), (k, got[k], w)


def test_penalties_that_try_the_same_take_its_sums_once(spark, monkeypatch):
    """all penalties start from the same candidate, which was summed up for each of them; fits stay those of rows of their own."""
    r = random.Random(12)
    rows = [(k % 3, int(r.random() < 0.3 + 0.3 * (x > 0)), x) for k in range(240) for x in [r.gauss(0, 1)]]
    tried, sums = [], R.shared_sums
    monkeypatch.setattr(R, "shared_sums", lambda rows, work, of: tried.append([len(b) for _, b in work]) or sums(rows, work, of))
    models = [R.Model("m", (0, 1), "y", ("x",), (0.0,), (1.0,))]
    got = {x["penalty"]: x for x in R.fit_shared(spark.createDataFrame(rows, "cell int, y int, x double"), models, R.LAMBDAS).collect()}
    assert tried[0] == [1] and tried[1] == [len(R.LAMBDAS)]
    own = spark.createDataFrame([("m", y, [x]) for c, y, x in rows if c < 2], "model string, label int, x array<double>")
    for x in R.fit_grid(own, R.LAMBDAS, 1).collect():
        g = got[x["penalty"]]
        assert (g["status"], g["n"]) == (x["status"], x["n"]) and abs(g["intercept"] - x["intercept"]) < 1e-9 and abs(g["coefficients"][0] - x["coefficients"][0]) < 1e-9


def test_scopes_are_counted_without_the_signal_fields(spark, small, monkeypatch):
    """the grid of scopes had all signals dealt by entry and by race; it counts what the fields give."""
    from tempolane.catalog import backtest as C

    want = C.signal_rows(spark, small).groupBy("year", "stat", "cohort").agg(F.count(F.lit(1)).alias("entries"), F.count_if("first").alias("races"))
    monkeypatch.setattr(C, "signal_fields", None)
    got = C._scope_years(spark, small)
    assert got.count() == want.count() > 0 and got.select(*want.columns).exceptAll(want).count() == 0
