"""Two clocks, maps, scoped sums, ordered manifests, commit records, status folds, eligibility: small rows and brute force."""

import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tempolane.operators import evaluation as E
from tempolane.operators import hashing as H
from tempolane.operators import merging as M
from tempolane.operators import validation as V
from tempolane.operators.asof import Request, asof, asof_map, blocked_sums, scoped_sums, two_clocks
from tempolane.sources import sinks as S


def test_two_clocks_equal_brute_force(spark):
    r = random.Random(2)
    events = [(p, t, r.choice([None, t, t + r.randrange(40)])) for p in range(4) for t in [r.randrange(60) for _ in range(25)]]
    targets = [(k, r.randrange(5), r.randrange(70)) for k in range(80)]
    e = spark.createDataFrame(events, "player_id int, start_at long, seen long")
    first = F.col("_clock") == 1
    sums = {"all": first.cast("int"), "known": (~first).cast("int"), "never": (first & F.col("seen").isNull()).cast("int")}
    got = {x["entry_id"]: (x["all_all"], x["known_all"], x["never_all"]) for x in asof(spark.createDataFrame(targets, "entry_id int, player_id int, cutoff long"), two_clocks(e, F.col("start_at"), F.col("seen")), [Request("", sums)]).collect()}
    for k, p, c in targets:
        own = [x for x in events if x[0] == p and x[1] < c]
        assert got.get(k, (0, 0, 0)) == (len(own), sum(x[2] is not None and x[2] <= c for x in own), sum(x[2] is None for x in own))


def test_maps_as_of_each_target(spark):
    r = random.Random(3)
    events = [(r.randrange(4), r.randrange(50), r.choice(["a", "b", "ü", "long one", None])) for _ in range(120)]
    targets = [(k, r.randrange(5), r.randrange(60)) for k in range(60)] + [(99, None, 40)]
    got = {x["entry_id"]: x["counts"] for x in asof_map(spark.createDataFrame(targets, "entry_id int, player_id int, cutoff long"), spark.createDataFrame(events, "player_id int, start_at long, grade string"), "grade").collect()}
    for k, p, c in targets:
        want = {}
        for q, t, g in events:
            if q == p and t < c and g is not None:
                want[g] = want.get(g, 0) + 1
        assert got.get(k, {}) == want


def test_scoped_sums_equal_blocked_ones(spark):
    r = random.Random(4)
    events = spark.createDataFrame([(r.randrange(3), r.choice([None, 1, 2]), r.randrange(40_000), float(r.randrange(9))) for _ in range(400)], "a int, b int, start_at long, v double")
    targets = spark.createDataFrame([(k, r.randrange(4), r.choice([None, 1, 2]), r.randrange(45_000)) for k in range(200)], "entry_id int, a int, b int, cutoff long")
    got = {x["entry_id"]: x for x in scoped_sums(targets, events, {"one": ("a",), "two": ("a", "b")}, {"v": F.col("v"), "n": F.lit(1)}).collect()}
    for scope, keys in (("one", ["a"]), ("two", ["a", "b"])):
        want = {x["entry_id"]: (x["v_all"], x["n_all"]) for x in blocked_sums(targets, events, keys, {"v": F.col("v"), "n": F.lit(1)}).collect()}
        assert {k: (x[f"{scope}_v_all"], x[f"{scope}_n_all"]) for k, x in got.items() if x[f"{scope}_n_all"] is not None} == want


def test_ordered_manifests_keep_the_order_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 3)
    rows = [("m", race, race * 10 + k, race % 7 + k) for race in range(40) for k in range(3)]
    df = spark.createDataFrame(rows, "model string, race_id long, entry_id long, p int")
    make = lambda d: H.ordered_fingerprints(d, "model", "race_id", ["entry_id"], ["race_id", "entry_id", "p"]).first()
    one = make(df)
    assert one == make(df.repartition(7).orderBy(F.desc("p"))) and (one["groups"], one["row_count"]) == (40, 120)

    def sha(parts):
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()

    lines = {x["entry_id"]: x["h"] for x in df.select("entry_id", H.row_hash(df, ["race_id", "entry_id", "p"]).alias("h")).collect()}
    level = [sha(lines[race * 10 + k] for k in range(3)) for race in range(40)]
    for _ in range(2):
        level = [sha(level[k : k + 3]) for k in range(0, len(level), 3)]
    assert one["manifest"] == sha(level)
    changed = df.withColumn("p", F.when(F.col("entry_id") == 11, -1).otherwise(F.col("p")))
    swapped = df.withColumn("entry_id", F.when(F.col("entry_id") == 10, 12).when(F.col("entry_id") == 12, 10).otherwise(F.col("entry_id")))
    assert len({one["manifest"], make(changed)["manifest"], make(swapped)["manifest"]}) == 3


def test_canonical_rows_at_every_depth(spark):
    one = spark.sql("SELECT named_struct('b', map('y', 1.5D, 'x', CAST(NULL AS DOUBLE)), 'a', array(named_struct('d', 1, 'c', CAST(NULL AS STRING)))) AS v, map(10, 'p', 9, 'q') AS m")
    two = spark.sql("SELECT named_struct('a', array(named_struct('c', CAST(NULL AS STRING), 'd', 1)), 'b', map('x', CAST(NULL AS DOUBLE), 'y', 1.5D)) AS v, map(9, 'q', 10, 'p') AS m")
    texts = [x.select(H.canonical(["v", "m"], dict(x.dtypes)).alias("c")).first()["c"] for x in (one, two)]
    assert texts[0] == texts[1] == '{"m":{"10":"p","9":"q"},"v":{"a":[{"c":null,"d":1}],"b":{"x":null,"y":"1.50000000000000000e+00"}}}'
    none = spark.sql("SELECT CAST(NULL AS STRUCT<a: DOUBLE>) AS v")
    assert none.select(H.canonical(["v"], dict(none.dtypes))).first()[0] == '{"v":null}'


def test_a_scope_is_kept_only_with_its_record_and_its_content(spark, tmp_path):
    rows = spark.createDataFrame([("S", y, k, float(k)) for y in (2000, 2001, 2002, 2003) for k in range(5)], "stat_code string, year int, entry_id int, v double")
    path = str(tmp_path / "out")
    S.write_features(rows.where("year < 2003"), path)
    S.commit(S.feature_rows(rows).where("year < 2002"), path)  # 2002 broke off before its record
    one = {x["year"]: x["write"] for x in S.resume(rows, path).collect()}
    assert one == {2000: "KEPT", 2001: "KEPT", 2002: "WRITTEN", 2003: "WRITTEN"}
    assert {x["write"] for x in S.resume(rows, path).collect()} == {"KEPT"}
    # As many rows, one value altered in the store; as many rows, one value altered in the input.
    S.write_features(rows.where("year = 2000").withColumn("v", F.when(F.col("entry_id") == 3, 9.0).otherwise(F.col("v"))), path)
    new = rows.withColumn("v", F.when((F.col("year") == 2001) & (F.col("entry_id") == 1), -1.0).otherwise(F.col("v")))
    assert {x["year"]: x["write"] for x in S.resume(new, path).collect()} == {2000: "WRITTEN", 2001: "WRITTEN", 2002: "KEPT", 2003: "KEPT"}
    assert spark.read.parquet(path).where("year = 2000 AND entry_id = 3").first()["v"] == 3.0 and {x["write"] for x in S.resume(new, path).collect()} == {"KEPT"}


def test_folds_start_from_stored_states_and_clear_children(spark):
    first = M.fold_status(spark.createDataFrame([(1, 1, "CONFIRMED"), (2, 1, "PROVISIONAL"), (3, 1, "UNDER_REVIEW")], "k int, n int, status string"), "k", "n", "status")
    second = M.fold_status(spark.createDataFrame([(1, 2, "CORRECTED"), (2, 2, "CANCELLED"), (2, 3, "CONFIRMED"), (4, 2, "CONFIRMED")], "k int, n int, status string"), "k", "n", "status", first)
    got = {x["k"]: (x["status"], x["confirmed_at"], x["clear_children"], x["confirmation"], x["applied"], x["rejected"]) for x in second.collect()}
    assert got == {1: ("CORRECTED", 1, False, "KEPT", 1, 0), 2: ("CANCELLED", None, True, "KEPT", 1, 1), 3: ("UNDER_REVIEW", None, False, "KEPT", 0, 0), 4: ("CONFIRMED", 2, False, "SET", 1, 0)}
    kids = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "d")], "k int, v string")
    assert sorted(x["v"] for x in M.without_cleared(kids, second, "k").collect()) == ["a", "d"]
    again = M.fold_status(spark.createDataFrame([(2, 9, "CANCELLED")], "k int, n int, status string"), "k", "n", "status", second)
    assert not any(x["clear_children"] for x in again.collect())


def test_features_and_labels_give_all_their_reasons(spark):
    races = spark.createDataFrame([(1, 2, 100, "CONFIRMED"), (2, 2, 100, "CORRECTED"), (3, 2, None, "CONFIRMED")], "race_id int, entrants int, start_at long, race_status string")
    shape = "race_id int, entry_id int, bike int, status string, quality string, score double, score_rank int, input_as_of long"
    good = [(1, 11, 1, "VALID", "FULL", 80.0, 1, 100), (1, 12, 2, "VALID", "FULL", 70.0, 2, 90)]
    bad = [(2, 21, 1, "PARTIAL", "PARTIAL", 0.0, None, None), (2, 21, 1, "VALID", "FULL", None, 1, 101), (2, 23, 3, "VALID", "FULL", 1.0, 1, 1)]
    got = {x["race_id"]: x["reasons"].split(",") for x in E.feature_reasons(spark.createDataFrame(good + bad, shape), races).collect()}
    assert got == {1: [""], 2: list(E.FEATURE_REASONS), 3: ["FEATURE_RESULT_COUNT_MISMATCH"]}
    p = E.rank_predictions(spark.createDataFrame(good, shape))
    labels = spark.createDataFrame([(1, 1, "CRASHED", None), (1, 2, "FINISHED", 1), (2, 1, "FINISHED", None)], "race_id int, bike int, result_status string, rank int")
    out = {(x["race_id"], x["cohort"]): x for x in E.cohort_decisions(races, p, labels).collect()}
    assert out[1, "OPERATIONAL"]["included"] and not out[1, "OPERATIONAL"]["rank1_hit"] and out[1, "OPERATIONAL"]["top3_hit"] and out[1, "OPERATIONAL"]["rank1_set_size"] == 1
    assert out[1, "NORMAL_FINISH"]["reasons"] == E.ABNORMAL and out[2, "OPERATIONAL"]["reasons"].split(",") == list(E.LABEL_REASONS)
    assert out[3, "NORMAL_FINISH"]["reasons"].split(",") == ["LABEL_RESULT_COUNT_MISMATCH", "LABEL_NO_WINNER"] and out[3, "NORMAL_FINISH"]["rank1_hit"] is None


def test_a_snapshot_without_its_race_stops_the_run(spark):
    races, results = spark.createDataFrame([(1, "x")], "race_id long, c string"), spark.createDataFrame([(1, 5)], "race_id long, bike int")
    assert [tuple(x) for x in E.snapshot_rows(spark.createDataFrame([(1,), (1,)], "race_id long"), races, results).collect()] == [(1, "x", 5)]
    with pytest.raises(PySparkException, match="no race for target 2"):
        E.snapshot_rows(spark.createDataFrame([(2,)], "race_id long"), races, results).collect()


def test_completeness_of_pages(spark):
    pages = spark.createDataFrame([(u, "RESULTS_AVAILABLE") for u in "abcdef"] + [("g", "CANCELLED")], "url string, state string")
    results = spark.createDataFrame([(u, b) for u, bs in {"a": [1, 2], "b": [1, 1], "c": [1], "d": [1, 3], "e": [1, 2]}.items() for b in bs], "url string, bike int")
    payouts = spark.createDataFrame([("a", "EXACTA", "1-2", 5), ("e", "EXACTA", "", 5)], "url string, bet_type string, combination string, amount int")
    expected = spark.createDataFrame([(u, b) for u in "abcdefg" for b in (2, 1)], "url string, bike int")
    got = {x["url"]: x["verdict"] for x in V.page_completeness(pages, results, payouts, expected).collect()}
    assert got == {"a": "COMPLETE", "b": "DUPLICATE_BIKE", "c": "RESULT_COUNT_MISMATCH", "d": "BIKE_SET_MISMATCH", "e": "PARTIAL_PAYOUT", "f": "NO_RESULTS", "g": "NO_RESULT_PAGE"}


def test_career_gaps_equal_plain_lists():
    """Meetings that lie inside each other, equal starts, targets of no meeting and of one without starts."""
    import numpy as np
    import pandas as pd

    from tempolane.plans.features import career_gaps

    r = random.Random(12)
    for _ in range(60):
        events = [(t, k, k, r.choice([1, 2, 3, None]), bool(r.randrange(2)), bool(r.randrange(2))) for k, t in enumerate(sorted(r.randrange(300) for _ in range(r.randrange(0, 25))))]
        targets = [(100 + k, c, c + 5, r.choice([1, 2, 3, 9, None])) for k, c in enumerate(r.randrange(330) for _ in range(12))]
        frame = career_gaps(pd.DataFrame(targets, columns=["entry_id", "cutoff", "start_at", "meeting_id"]), pd.DataFrame(events, columns=["start_at", "race_id", "entry_id", "meeting_id", "normal", "abnormal"]))
        got = {x["entry_id"]: x for x in frame.replace({pd.NA: None}).to_dict("records")}
        for entry, cutoff, start, meeting in targets:
            past = [e for e in events if e[0] < cutoff]
            pre = [e[0] for e in past if meeting is None or e[3] is None or e[3] != meeting]
            gaps = [b - a for a, b in zip(pre, pre[1:], strict=False)]
            x = got[entry]
            assert (x["started"], x["pre"], x["n"]) == (past[-1][0] if past else None, pre[-1] if pre else None, len(gaps))
            assert x["inside"] == next((e[0] for e in reversed(past) if meeting is not None and e[3] == meeting), None)
            if gaps:
                assert np.allclose([x["q25"], x["q50"], x["q75"]], np.quantile(gaps, [0.25, 0.5, 0.75])) and x["total"] == sum(gaps) and x["at_most"] == sum(g <= start - pre[-1] for g in gaps)


def run_rows(spark, folds=("A", "B"), metrics=("AUC", "LOG_LOSS", "BRIER"), score=0.5):
    models = [(f, f"{f}/x", f"{f}/x/{k}", 1.0) for f in folds for k in ("BASELINE", "INCREMENTAL")]
    return {
        "predictions": spark.createDataFrame([(f, 1, k, score) for f in folds for k in range(3)], "fold string, race_id int, entry_id int, score double"),
        "models": spark.createDataFrame(models, "fold string, scope string, model string, weight double"),
        "metrics": spark.createDataFrame([(f, f"{f}/x", m, 0.1) for f in folds for m in (metrics if f == "A" else ("AUC", "LOG_LOSS", "BRIER"))], "fold string, scope string, metric string, value double"),
    }


def states(df):
    return {(r["kind"], r["fold"]): (r["write"], r["faults"]) for r in df.collect()}


def test_a_run_is_stored_by_fold_once(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    first = states(S.store_run(path, "r1", run_rows(spark, ("A",)), S.PAIRED))
    assert set(first.values()) == {("WRITTEN", "")} and len(first) == 3
    again = states(S.store_run(path, "r1", run_rows(spark), S.PAIRED))
    assert {k: w for (k, f), (w, _) in again.items() if f == "A"} == dict.fromkeys(("predictions", "models", "metrics"), "KEPT")
    assert {w for (k, f), (w, _) in again.items() if f == "B"} == {"WRITTEN"}
    assert spark.read.parquet(f"{path}/models").count() == 4
    # Another run has its own rows; the first one's predictions stay as they were.
    assert {w for w, _ in states(S.store_run(path, "r2", run_rows(spark, ("A",), score=0.7))).values()} == {"WRITTEN"}
    assert {w for w, _ in states(S.store_run(path, "r1", run_rows(spark, ("A",), score=0.7), S.PAIRED)).values()} == {"LOCKED"}
    assert [r["score"] for r in spark.read.parquet(f"{path}/predictions").where("run = 'r1' AND fold = 'A'").select("score").distinct().collect()] == [0.5]


def test_rows_changed_behind_the_record_are_written_again(spark, tmp_path):
    path, rows = f"file://{tmp_path}/run", run_rows(spark, ("A",))
    S.store_run(path, "r", rows, S.PAIRED)
    rows["metrics"].withColumns({"value": F.lit(9.0), "run": F.lit("r")}).write.partitionBy("run", "fold").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/metrics")
    got = states(S.store_run(path, "r", rows, S.PAIRED))
    assert got["metrics", "A"][0] == "WRITTEN" and got["models", "A"][0] == "KEPT"
    assert [r["value"] for r in spark.read.parquet(f"{path}/metrics").select("value").distinct().collect()] == [0.1]


def test_folds_with_faults_are_refused_whole(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    got = states(S.store_run(path, "r", run_rows(spark, metrics=("AUC", "BRIER")), S.PAIRED))
    assert {got[k, "A"] for k in ("predictions", "models", "metrics")} == {("REFUSED", "SCOPE_INCOMPLETE")}
    assert {got[k, "B"][0] for k in ("predictions", "models", "metrics")} == {"WRITTEN"}
    rows = run_rows(spark, ("C", "D"))
    more = spark.createDataFrame([("C", 1, 0, 0.5), ("D", 1, None, 0.5)], "fold string, race_id int, entry_id int, score double")
    got = states(S.store_run(path, "r", rows | {"predictions": rows["predictions"].unionByName(more)}, S.PAIRED))
    assert got["models", "C"] == ("REFUSED", "PREDICTIONS_KEY_REPEATED") and got["models", "D"] == ("REFUSED", "PREDICTIONS_KEY_MISSING")
    assert {r["fold"] for r in spark.read.parquet(f"{path}/predictions").select("fold").distinct().collect()} == {"B"}
    empty = {k: v.limit(0) for k, v in rows.items()}
    assert S.store_run(path, "r", empty, S.PAIRED).count() == 0


def test_aggregates_must_agree_with_their_sections(spark):
    rows = [(0.5, 1, 0.25, 1, 0.75, "MATCH"), (0.5 + 5e-13, 1, 0.25, 1, 0.75, "MATCH"), (0.5 + 3e-12, 1, 0.25, 1, 0.75, "MISMATCH"), (None, 1, 0.25, 0, None, "MISMATCH"), (0.0, 0, None, 0, None, "MISMATCH"), (None, 0, None, 0, None, "NO_VALUE"),
            (0.5, 1, None, 1, 0.5, "INVALID_SECTION"), (0.5, None, 0.5, 1, 0.5, "INVALID_SECTION"), (0.5, -1, 0.5, 2, 0.5, "INVALID_SECTION"), (1e6 + 1e-7, 3, 1e6, 0, None, "MATCH"), (0.25, 3, 0.25, 0, 9.0, "MATCH")]
    df = spark.createDataFrame(rows, "stored double, a int, am double, b int, bm double, want string")
    sections = [(F.col("a"), F.col("am")), (F.col("b"), F.col("bm"))]
    assert df.where(V.aggregate_integrity(F.col("stored"), sections) != F.col("want")).count() == 0
    checked = df.select(V.checked_aggregate(F.col("stored"), sections, "late mean").alias("x"), "want")
    assert checked.where("want IN ('MATCH', 'NO_VALUE')").count() == 5
    with pytest.raises(PySparkException, match="late mean: MISMATCH"):
        df.where("want = 'MISMATCH'").select(V.checked_aggregate(F.col("stored"), sections, "late mean")).collect()


def test_windows_of_several_keys_equal_brute_force(spark, monkeypatch):
    """Windows, keys, highs and lows of many subjects, few rows at a time; one subject holds more than that. What is dealt is one row
    a target, however many windows there are, and a target without a subject stays."""
    from tempolane.operators import careers as C

    r = random.Random(9)
    monkeypatch.setattr(C, "ROWS", 50)
    day = 86400
    events = [(r.choice([0, 0, 1, 2, 3, None]), r.choice([None, "a", "b"]), r.randrange(40) * day, r.choice([None, 1.0, 2.0, 0.1])) for _ in range(400)]
    targets = [(k, r.choice([0, 1, 2, 3, 4, None]), r.choice([None, "a", "b"]), r.randrange(45) * day + r.choice([0, 1])) for k in range(150)]
    e, t = spark.createDataFrame(events, "player_id int, g string, start_at long, v double"), spark.createDataFrame(targets, "entry_id int, player_id int, g string, cutoff long")
    v = F.col("v")
    requests = [Request("x_", {"v": v, "n": F.lit(1)}, [3, 10, None], highs={"hi": v}), Request("k_", {"v": v}, [5, None], ["g"], lows={"lo": v})]
    from tempolane.operators.asof import asof_rows

    rows = asof_rows(t, e, requests)
    assert "Expand" not in rows._jdf.queryExecution().optimizedPlan().toString() and "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {x["entry_id"]: x for x in rows.collect()}
    assert len(got) == len(targets)
    for k, p, g, c in targets:
        if p is None:
            assert got[k]["x_n_all"] is None and got[k]["g"] == g
            continue
        own = [x for x in events if x[0] == p and x[2] < c]
        keyed = [x for x in own if g is not None and x[1] == g]
        total = lambda rows, d=None: sum(x[3] or 0 for x in rows if d is None or x[2] >= c - d * day)
        for d in (3, 10, None):
            w = "all" if d is None else d
            assert abs(got[k][f"x_v_{w}"] - total(own, d)) < 1e-9 and got[k][f"x_n_{w}"] == sum(d is None or x[2] >= c - d * day for x in own)
        assert abs(got[k]["k_v_5"] - total(keyed, 5)) < 1e-9 and abs(got[k]["k_v_all"] - total(keyed)) < 1e-9
        known = lambda rows: [x[3] for x in rows if x[3] is not None]
        assert got[k]["x_hi"] == max(known(own), default=None) and got[k]["k_lo"] == min(known(keyed), default=None)


def test_each_statistic_of_the_signals_is_a_job_of_its_own(spark, small, monkeypatch):
    """Thirteen unions in one write kept the shuffles of all statistics on disk together."""
    from tempolane import queries  # noqa: F401  (registers what the signals read)
    from tempolane.catalog import audits as A

    written = []
    monkeypatch.setattr(A, "stored", lambda spark, sf_dir, name, build: written.append(name) or build())
    rows = A.signals(spark, small)
    assert written == [f"signals-{s}" for s in A.SIGNALS] and rows.columns == ["entry_id", "stat", "role", "status", "signal"]


def test_lines_are_dealt_once_for_all_windows_of_a_race(spark, small):
    """Each window used to deal the lines again, and history dealt all entries a fifth time."""
    from tempolane.sources import domain as D

    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(race_id")
    races = spark.createDataFrame([], D.races(spark, small).schema)
    found = D.entries(spark, small, races)
    assert exchanges(found) <= 2 and exchanges(D.history(spark.createDataFrame([], found.schema))) == 0


def test_scopes_are_counted_without_dealing_rows_again(spark, small):
    """rows and races of a scope come from one count by year; nothing is dealt by race once the fields are written."""
    from tempolane import queries as Q
    from tempolane.catalog import backtest

    fields = backtest.signal_fields(spark, small)
    assert fields.count() == fields.select("entry_id").distinct().count()
    grid = Q.QUERIES["bt_scope_grid"](spark, small)
    assert "race_id" not in grid._jdf.queryExecution().executedPlan().toString()


def test_counted_values_give_the_bins_of_single_ones(spark):
    """bins of values that carry how often they are there are those of the values one by one."""
    from tempolane.operators import evaluation

    values = [("a", float(k % 37) / 7, 1 + k % 5) for k in range(200)] + [("b", float(k % 3), 2) for k in range(9)] + [("a", None, 4), ("a", float("nan"), 4)]
    counted = spark.createDataFrame(values, "g string, x double, n int")
    single = counted.selectExpr("g", "x", "explode(sequence(1, n))").drop("col")
    one, two = (sorted(map(tuple, f.collect()), key=repr) for f in (evaluation.effect_bins(counted, ["g"], "x", "n"), evaluation.effect_bins(single, ["g"], "x")))
    assert one == two and len(one) == 13


def test_models_share_a_row_an_entry_and_rank_features_are_made_once(spark, small):
    """rows of all folds, roles, labels and kinds of models are one row an entry. F31: predictions, reasons and cohorts read the
    same written features and reasons."""
    import tempolane.queries  # noqa: F401
    from tempolane.catalog import backtest as C

    rows = C.model_rows(spark, small)
    assert rows.count() == C.predictions(spark, small).where("year BETWEEN 1996 AND 2000").count()
    read = [set(C.feature_rows(spark, small).inputFiles()), set(C.feature_rows(spark, small).inputFiles())]
    assert read[0] == read[1] and all("rank-features" in f for f in read[0])
    assert all("rank-eligibility" in f for f in C.QUERIES["bt_feature_eligibility"](spark, small).inputFiles())
