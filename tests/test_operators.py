"""Operators on small rows with hand-computed or brute-force results."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolane.functions import text as T
from tempolane.operators import bootstrap as B
from tempolane.operators import evaluation as E
from tempolane.operators import hashing as H
from tempolane.operators import merging as M
from tempolane.operators import ridge as R
from tempolane.sources import documents as D
from tempolane.sources import pages as G
from tempolane.sources import sinks as S
from tempolane.sources.domain import selected


def test_golden_ridge_fit(spark):
    rows = []
    for k in range(8000):
        x = ((k * 7919) % 2001 - 1000) / 400.0
        rows.append(("m", int((k * 104729 + 12345) % 1000 < 138 + round(40.0 * x)), [x]))
    assert sum(r[1] for r in rows) == 1114
    got = R.fit(spark.createDataFrame(rows, "model string, label int, x array<double>"), 10.0, 1).first()
    assert (got["status"], got["iterations"], got["n"]) == ("CONVERGED_GRADIENT", 5, 8000)
    assert abs(got["objective"] - 0.4032475436526494) < 1e-12 and abs(got["intercept"] + 1.8215930512231404) < 1e-9 and abs(got["coefficients"][0] - 0.008289165654652745) < 1e-9


def test_many_models_and_a_single_class(spark):
    r = random.Random(1)
    rows = [(m, int(r.random() < 0.3 + 0.2 * (x > 0)) if m != "one" else 1, [x, x * x][: 1 + (m == "b")]) for m in ("a", "b", "one") for x in [r.gauss(0, 1) for _ in range(300)]]
    df = spark.createDataFrame(rows, "model string, label int, x array<double>")
    got = {x["model"]: x for x in R.fit(df, {"a": 0.1, "b": 1.0, "one": 1.0}, 2).collect()}
    assert got["one"]["status"] == "FAILED_SINGLE_CLASS_TRAINING" and got["one"]["intercept"] is None
    for m, lam in (("a", 0.1), ("b", 1.0)):
        own = [x for x in rows if x[0] == m]
        xs, y, b = np.array([[1.0, *x[2]] for x in own]), np.array([x[1] for x in own]), np.array([got[m]["intercept"], *got[m]["coefficients"]])
        gradient = xs.T @ (1 / (1 + np.exp(-xs @ b)) - y) / len(y) + lam * np.array([0, *b[1:]])
        assert got[m]["status"].startswith("CONVERGED") and np.abs(gradient).max() < 1e-6
    scored = R.score(df.where("model <> 'one'"), R.fit(df.where("model <> 'one'"), 1.0, 2))
    assert scored.where("probability <= 0 OR probability >= 1 OR probability IS NULL").count() == 0


def test_penalty_ties_go_to_the_larger(spark):
    losses = spark.createDataFrame([("m", 0.1, 0.5), ("m", 1.0, 0.5 + 5e-13), ("m", 10.0, 0.6)], "model string, penalty double, loss double")
    assert R.choose_penalty(losses).first()["penalty"] == 1.0


def sequential(n, iterations, seed):
    state = seed % B.M
    for _ in range(iterations):
        out = []
        for _ in range(n):
            state = state * B.A % B.M
            out.append(state % n)
        yield out


def test_draws_equal_the_sequential_stream(monkeypatch):
    monkeypatch.setattr(B, "CELLS", 7)
    for n, wanted in ((5, [0, 2, 4]), (3, [0, 1, 2]), (20, list(range(20)))):
        got = np.concatenate([w for _, w in B.weight_chunks(n, np.array(wanted), 6, 99)])
        want = np.array([np.bincount(places, minlength=n) for places in sequential(n, 6, 99)])[:, wanted]
        assert (got == want).all() and [f for f, _ in B.weight_chunks(n, np.array(wanted), 6, 99)][0] == 0


@pytest.mark.parametrize(("places", "rows_held"), [(1 << 16, 200_000), (4, 5)])
def test_paired_metrics_equal_naive_replicates(spark, monkeypatch, places, rows_held):
    """Also in blocks of four races and five rows: sums add up, and no tie is cut."""
    monkeypatch.setattr(B, "PLACES", places)
    monkeypatch.setattr(B, "ROWS", rows_held)
    r = random.Random(5)
    rows = [("s", race, int(k == 0), r.random(), r.choice([0.2, 0.4, 0.6])) for race in range(3, 15) for k in range(4)]
    df = spark.createDataFrame(rows, "scope string, race_id long, label int, baseline double, incremental double")
    got = {x["metric"]: x for x in B.paired_metrics(df, 40, 7).collect()}

    def auc(sample, c):
        p, n = ([x[c] for x in sample if x[2] == y] for y in (1, 0))
        return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))

    def log_loss(sample, c):
        return sum(-np.log(x[c] if x[2] else 1 - x[c]) for x in sample) / len(sample)

    by = [[x for x in rows if x[1] == race] for race in range(3, 15)]
    for metric, f in (("AUC", auc), ("LOG_LOSS", log_loss)):
        deltas = []
        for places in sequential(12, 40, 7):
            sample = [x for p in places for x in by[p]]
            deltas.append(f(sample, 4) - f(sample, 3))
        assert abs(got[metric]["delta"] - (f(rows, 4) - f(rows, 3))) < 1e-9
        assert np.allclose([got[metric]["ci_lower"], got[metric]["ci_upper"]], np.quantile(deltas, [0.025, 0.975]))


def test_places_are_dense_over_blocks(spark):
    races = spark.createDataFrame([("s", k * 50_000) for k in range(20)], "scope string, race_id long")
    assert [r["place"] for r in B.placed(races).orderBy("race_id").collect()] == list(range(20))


def test_category_bins_in_natural_order(spark):
    rows = spark.createDataFrame([("g", v) for v in ("10", "9", "9", "2")] + [("h", v) for v in ("b", "a", "10")], "g string, v string")
    bins = E.category_bins(rows, ["g"], "v")
    assert {(r["g"], r["v"]): (r["bin"], r["training_count"]) for r in bins.collect()} == {("g", "2"): (1, 1), ("g", "9"): (2, 2), ("g", "10"): (3, 1), ("h", "10"): (1, 1), ("h", "a"): (2, 1), ("h", "b"): (3, 1)}
    probe = spark.createDataFrame([("g", "9"), ("g", "C"), ("g", None)], "g string, v string")
    assert {(r["v"], r["bin"]) for r in E.assign_categories(probe, bins, ["g"], "v").collect()} == {("9", 2), ("C", 0), (None, None)}


@pytest.mark.parametrize("slots", [2, 1024])
def test_quantiles_narrow_down_to_the_exact_value(spark, monkeypatch, slots):
    monkeypatch.setattr(E, "SLOTS", slots)
    r = random.Random(8)
    groups = {"ties": [1.0] * 500 + [2.0] * 3, "one": [-0.0], "two": [3.5, -1e300], "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300], "close": [1 + k * 2**-52 for k in range(40)], "many": [r.gauss(0, 1) ** 3 for _ in range(3000)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None), ("many", float("nan"))]
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(x["g"], x["share"]): x["quantile"] for x in E.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    for g, vs in groups.items():
        vs = sorted(vs)
        for p in shares:
            h = (len(vs) - 1) * p
            k = int(h)
            want = vs[k] + (vs[min(k + 1, len(vs) - 1)] - vs[k]) * (h - k)
            assert got[g, p] == want or abs(got[g, p] - want) <= 1e-12 * abs(want), (g, p)
    assert len(got) == len(groups) * len(shares)
    assert E.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", shares).count() == 0


def test_effect_bins_change_from_categories_to_ranges(spark):
    few = [10.0, 9.0, 9.0, 2.0, -1.0, -2.0, 0.5, 0.25]
    rows = [("few", v) for v in few] + [("many", float(k % 11)) for k in range(110)] + [("few", None), ("none", None)]
    bins = E.effect_bins(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    own = sorted((x["bin"], x["category"], x["training_count"]) for x in bins.where("g = 'few'").collect())
    # Natural order of texts: minus signs come first and don't turn numbers around; runs of digits compare as numbers.
    assert own == [(1, "-1", 1), (2, "-2", 1), (3, "0.5", 1), (4, "0.25", 1), (5, "2", 1), (6, "9", 2), (7, "10", 1)]
    many = sorted((x["bin"], x["kind"], x["lower"], x["upper"], x["training_count"]) for x in bins.where("g = 'many'").collect())
    assert [m[:2] for m in many] == [(k, "NUMERIC_RANGE") for k in range(1, len(many) + 1)] and sum(m[4] for m in many) == 110
    assert many[0][2] is None and many[-1][3] is None and all(a[3] == b[2] for a, b in zip(many, many[1:], strict=False))
    probe = spark.createDataFrame([("few", 9.0), ("few", 7.0), ("few", None), ("many", -5.0), ("many", 99.0), ("none", 1.0)], "g string, v double")
    got = {(x["g"], x["v"]): x["bin"] for x in E.assign_effect_bins(probe, bins, ["g"], "v").collect()}
    assert got == {("few", 9.0): 6, ("few", 7.0): 0, ("few", None): None, ("many", -5.0): 1, ("many", 99.0): len(many), ("none", 1.0): None}


def test_chosen_penalties_have_the_least_validation_loss(spark):
    r = random.Random(3)
    make = lambda n: [(m, int(r.random() < 1 / (1 + np.exp(-slope * x))), [x]) for m, slope in (("flat", 0.0), ("steep", 2.0)) for x in [r.gauss(0, 1) for _ in range(n)]]
    shape = "model string, label int, x array<double>"
    train, fit, valid = (spark.createDataFrame(make(n) + ([("lone", 1, [0.0])] if n == 80 else [("lone", k % 2, [1.0 * k]) for k in range(8)]), shape) for n in (120, 80, 60))
    got = {x["model"]: x for x in R.fit_chosen(train, fit, valid, 1).collect()}
    assert got["lone"]["status"] == "FAILED_INNER_FIT" and got["lone"]["coefficients"] is None
    for m in ("flat", "steep"):
        losses = {}
        for lam in R.LAMBDAS:
            one = R.fit(fit.where(F.col("model") == m), lam, 1)
            p = R.score(valid.where(F.col("model") == m), one)
            losses[lam] = p.agg(F.avg(-F.when(F.col("label") == 1, F.log("probability")).otherwise(F.log(1 - F.col("probability"))))).first()[0]
        assert got[m]["penalty"] == max(k for k, v in losses.items() if v <= min(losses.values()) + R.TIE)
        want = R.fit(train.where(F.col("model") == m), got[m]["penalty"], 1).first()
        assert abs(got[m]["intercept"] - want["intercept"]) < 1e-9 and abs(got[m]["coefficients"][0] - want["coefficients"][0]) < 1e-9


def test_centred_residuals_equal_naive_replicates(spark, monkeypatch):
    monkeypatch.setattr(B, "PLACES", 4)
    r = random.Random(6)
    rows = [("s", race, r.choice([1, 2, 2]) if race > 3 else 3, int(k == 0), r.random(), r.random()) for race in range(1, 12) for k in range(3)]
    df = spark.createDataFrame(rows, "scope string, race_id long, bin int, label int, baseline double, incremental double")
    bins = spark.createDataFrame([("s", b) for b in (1, 2, 3, 4)], "scope string, bin int")
    got = {x["bin"]: x for x in B.centred_residuals(df, bins, 60, 11).collect()}
    by = [[x for x in rows if x[1] == race] for race in range(1, 12)]
    mean = lambda xs: sum(x[3] - x[4] for x in xs) / len(xs)
    deltas = {b: [] for b in (1, 2, 3)}
    for places in sequential(11, 60, 11):
        sample = [x for p in places for x in by[p]]
        for b, d in deltas.items():
            own = [x for x in sample if x[2] == b]
            if own:
                d.append(mean(own) - mean(sample))
    for b, d in deltas.items():
        assert got[b]["valid_replicates"] == len(d) and got[b]["state"] == ("AVAILABLE" if len(d) == 60 else "SPARSE_BOOTSTRAP_UNSUPPORTED")
        if len(d) == 60:
            assert np.allclose([got[b]["ci_lower"], got[b]["ci_upper"]], np.quantile(d, [0.025, 0.975]))
        assert abs(got[b]["centred_mean"] - (mean([x for x in rows if x[2] == b]) - mean(rows))) < 1e-12
    assert got[4]["state"] == "NO_EVALUATION_ROWS"


def test_holdout_and_selection_guards(spark):
    with pytest.raises(ValueError, match="holdout"):
        E.guard_holdout(E.HOLDOUT_AFTER + 1)
    with pytest.raises(ValueError, match="race or a range"):
        selected(spark.range(1))


def test_row_hashes_do_not_collide_and_see_small_changes(spark):
    rows = spark.createDataFrame([("x", "y|b=Vz", 1.0), ("x|b=Vy", "z", 1.0), ("x", "y|b=Vz", 1.0 + 2**-52), (None, "null", 1.0), ("null", None, 1.0)], "a string, b string, v double")
    assert rows.select(H.row_hash(rows, ["a", "b", "v"]).alias("h")).distinct().count() == 5
    assert json.loads(rows.select(H.canonical(["v", "a"], dict(rows.dtypes)).alias("c")).first()["c"]) == {"a": "x", "v": "1.00000000000000000e+00"}
    big = spark.range(3000).withColumn("g", F.lit(1))
    one, two = (H.fingerprints(x, ["g"], ["id"]).first()["fingerprint"] for x in (big, big.repartition(5).orderBy(F.desc("id"))))
    assert one == two != H.fingerprints(big.where("id < 2999"), ["g"], ["id"]).first()["fingerprint"]


def test_locked_rows_may_not_change(spark):
    old, new = (spark.createDataFrame(x, "k long, v double") for x in ([(1, 1.0), (2, None)], [(1, 1.0), (2, 3.0)]))
    assert S.locked(old, old, ["k"]).count() == 0 and [r["k"] for r in S.locked(old, new, ["k"]).collect()] == [2]


def test_dry_run_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("S", 2000, 1)], "stat_code string, year int, v int")
    assert S.write_features(rows, str(tmp_path / "x"), dry_run=True).count() == 1 and not (tmp_path / "x").exists()


def test_confirmation_time_is_kept_until_cleared(spark):
    rows = [(1, 1, "CONFIRMED"), (1, 2, "CORRECTED"), (2, 1, "PROVISIONAL"), (3, 4, "CONFIRMED"), (3, 5, "UNDER_REVIEW")]
    got = {r["k"]: r["confirmed_at"] for r in M.fold_status(spark.createDataFrame(rows, "k long, n int, status string"), "k", "n", "status").collect()}
    assert got == {1: 1, 2: None, 3: 4}


def test_text_functions(spark):
    df = spark.createDataFrame([("\u00a0 a&amp;b\r\n c ",), ("－",), ("-",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalise(F.col("t"))).collect()] == ["a&b c", None, None, None, None]
    clock = spark.createDataFrame([("09:30",), ("24:00",), ("x",), (None,)], "c string").withColumn("d", F.lit("1970-01-02").cast("date"))
    assert [r[0] for r in clock.select(T.local_moment(F.col("d"), F.col("c"))).collect()] == [86400 + 1800, None, None, None]
    numbers = spark.createDataFrame([("1.5",), ("-2",), ("nan",), ("inf",), ("007",), ("x",)], "t string")
    assert [r[0] for r in numbers.select(T.positive_number(F.col("t"))).collect()] == [1.5, None, None, None, 7.0, None]
    assert [r[0] for r in numbers.select(T.whole_number(F.col("t"))).collect()] == [None, None, None, None, 7, None]


ROW = "<tr><td>{}</td><td></td><td>{}</td><td>{}</td></tr>"
BAD = [
    ("results", "<p>nothing</p>", "not found"),
    ("results", "<tbody id=pitbodyBs>" + ROW.format(1, 1, "a") + ROW.format(2, 1, "b"), "twice"),
    ("results", "<tbody id=pitbodyBs>" + ROW.format("?", 1, "a"), "unknown rank"),
    ("results", "<tbody id=pitbodyBs>" + ROW.format(1, 10, "a"), "invalid"),
    ("results", "<tbody id=pitbodyBs><tr><th>x</th><td>1</td></tr>", "mixes"),
    ("payouts", "<tbody id=pitbodyHarai><tr><td>ワイド</td><td>1-2</td><td>450円</td></tr><tr><td>単</td><td>1</td><td>9</td></tr>", "incomplete"),
    ("schedule", "<table></table>", "year and month"),
    ("entry_list", "[", "invalid JSON"),
    ("entry_list", '{"resultCd": 0, "keirinCd": "1", "kaisaihi": "20200101", "reqprm": {"bkcd": "2", "kday": "20200101"}}', "different"),
    ("day_metadata", "{}", "no day metadata"),
    ("race_detail", '<script>jsonData["PC0201"] = {"C0201data": {}}; jsonData["PJ0315"] = {"sensyuTypeInfo": [{"syaban": 1}]</script>', "incomplete"),
    ("race_detail", '<script>jsonData["PC0201"] = {"C0201data": {"C0201racedtl": {"C0201sensyu": [{"carNum": 1, "numPlayer": "1"}]}}}; jsonData["PJ0315"] = {"sensyuTypeInfo": [{"syaban": 2, "sensyuRegistNo": "1"}]}</script>', "differ"),
    ("live_result", '<script>jsonData["PC0201"] = {"C0201data": {"state": "確定"}}; jsonData["PJ0326"] = {"tyakujyunItemSubData": [{"syaban": 1, "kojinStateItemSubData": [{"kojinState": "x"}]}]}</script>', "unknown state"),
    ("player_list", "<p></p>", "no page of search results"),
    ("player_detail", "<dl><dt>a</dt></dl>", "registration number"),
    ("retired_player", "<p>登録番号 12</p>", "0 retirement"),
]


@pytest.mark.parametrize(("kind", "body", "message"), BAD)
def test_broken_pages_are_refused_as_a_whole(kind, body, message):
    with pytest.raises(D.ParseError, match=message):
        (D.PARSERS.get(kind) or G.PAGES[kind])[0](body)


def test_decoding_and_quarantine(spark):
    word = "確定"
    assert D.decode(word.encode("cp932"), "text/html; charset=Shift_JIS") == D.decode(word.encode("cp932"), None) == D.decode(b"<meta charset='utf-8'>" + word.encode(), None)[-2:] == word
    pages = [("a", None, word.encode()), ("b", "text/html; charset=utf-8", word.encode("cp932")), ("c", None, None)]
    good, bad = D.parse(spark.createDataFrame(pages, "url string, content_type string, body binary"), "text")
    assert [(r["url"], r["chars"]) for r in good.collect()] == [("a", 2)] and {(r["url"], r["error_type"]) for r in bad.collect()} == {("b", "PARSE"), ("c", "PARSE")}


def test_embedded_json_ends_where_it_is_balanced():
    page = """<script>x = "}"; jsonData['K'] = {"a": "\\"}{", "b": [1, {"c": 2}]}; more()</script>"""
    assert D.embedded(page, "K") == {"a": '"}{', "b": [1, {"c": 2}]}


def test_months_and_days_get_the_nearest_year():
    from datetime import date

    assert G.near_date("12/30", date(2024, 1, 2)) == date(2023, 12, 30) and G.near_date("01/02", date(2023, 12, 30)) == date(2024, 1, 2)
    with pytest.raises(D.ParseError):
        G.near_date("02/30", date(2024, 1, 2))


def test_stream_of_updates_merges_by_key(spark, tmp_path):
    from tempolane.streaming.updates import current, merge_stream

    schema = "k long, at long, v double"
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    for rows in ([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 5.0)], [(1, 3, None), (3, 1, 7.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        merge_stream(spark.readStream.schema(schema).parquet(source), table, checkpoint, ["k"], "at", ["v"]).awaitTermination(60)
    got = current(spark, table, spark.createDataFrame([], schema).schema)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 2.0), (2, 1, 5.0), (3, 1, 7.0)]


def test_all_named_and_numbered_references(spark):
    from html import unescape
    from html.entities import html5

    names = [f"a&{n}b" for n in html5 if n.endswith(";")]
    numbers = [f"&#{k};&#x{k:X};&#000{k};" for k in (9, 10, 12, 32, 39, 126, 160, 0x3042, 0xFEFF, 0x1F600, 0x10FFFD)]
    stay = ["&#0;", "&#11;", "&#13;", "&#127;", "&#128;", "&#xD800;", "&#xFDD0;", "&#xFFFE;", "&#x1FFFF;", "&#x110000;", "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFFF;", "&amp", "&;", "&", "&&", "&unknown;", "& amp;", ""]
    rows = [(t, unescape(t)) for t in names] + [(t, chr(int(t[2 : t.index(";")])) * 3) for t in numbers] + [(t, t) for t in stay] + [("&amp;amp;&lt;", "&amp;<"), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    wrong = df.withColumn("got", T.decode_entities(F.col("t"))).where("NOT got <=> want").collect()
    assert wrong == []
    got = [r[0] for r in spark.createDataFrame([("\x0b a&nbsp;\r\n b\x00",), ("&nbsp;－ ",)], "t string").select(T.normalise(F.col("t"))).collect()]
    assert got == ["a b", None]


def test_blocks_of_scores_are_as_many_as_the_rows_need(spark, monkeypatch):
    """a scope just above a block's rows is cut in two, not in BLOCKS, as every block makes the whole stream of draws again."""
    monkeypatch.setattr(B, "ROWS", 100)
    made, chunks = spark.sparkContext.accumulator(0), B.weight_chunks

    def counted(*args):
        made.add(1)
        return chunks(*args)

    monkeypatch.setattr(B, "weight_chunks", counted)
    rows = spark.createDataFrame([("a", k // 5, int(k % 5 == 0), (k * 37 % 150) / 150, (k * 53 % 150) / 150) for k in range(150)], "scope string, race_id long, label int, one double, two double")
    got = {r["replicate"]: r["one"] for r in B.replicate_auc(rows, ["one", "two"], 5, 7).collect()}
    assert sorted(got) == [-1, 0, 1, 2, 3, 4]
    positive, negative = ([(k * 37 % 150) for k in range(150) if (k % 5 == 0) == side] for side in (True, False))
    assert abs(got[-1] - sum((p > q) + (p == q) / 2 for p in positive for q in negative) / len(positive) / len(negative)) < 1e-12
    assert 2 <= made.value <= 4


def test_models_on_shared_rows_are_those_on_rows_of_their_own(spark):
    """a row is there once, whatever the number of models, labels and penalties that take it."""
    r = random.Random(4)
    rows = [(cell, int(r.random() < 1 / (1 + np.exp(-s - cell * t))), int(r.random() < 0.4), s, t) for cell in (1, 2, 3) for s, t in [(r.gauss(1, 2), r.gauss(0, 3)) for _ in range(60)]] + [(4, 1, 1, 0.5, 0.5)]
    shared = spark.createDataFrame(rows, "cell int, a int, b int, s double, t double")
    moments = R.cell_moments(shared, ["s", "t"])
    parts = {"TRAIN": {"wide": (1, 2, 3), "near": (1, 2), "one": (4,), "none": (9,)}, "FIT": {"wide": (1, 2), "near": (1,), "one": (4,), "none": (9,)}, "VALID": {"wide": (3,), "near": (2,), "one": (4,), "none": (9,)}}
    models, plain = {p: [] for p in parts}, {p: [] for p in parts}
    for part, scopes in parts.items():
        for scope, cells in scopes.items():
            basis = [x for x in rows if x[0] in parts["TRAIN" if part == "TRAIN" else "FIT"][scope]]
            m, d = (f([x[3:] for x in basis], axis=0) if basis else np.zeros(2) for f in (np.mean, np.std))
            known = [moments[c] for c in parts["TRAIN" if part == "TRAIN" else "FIT"][scope] if c in moments]
            if known:
                joined = sum(known[1:], known[0])
                assert np.allclose(joined.mean, m, atol=1e-12) and np.allclose(joined.deviation, d, atol=1e-12)
            for k, label in ((1, "a"), (2, "b")):
                for features in (("s",), ("s", "t")):
                    name = f"{scope}/{label}/{len(features)}"
                    models[part].append(R.Model(name, cells, label, features, tuple(m[: len(features)]), tuple(d[: len(features)])))
                    scaled = lambda x: [float((x[3 + j] - m[j]) / d[j]) if d[j] > 0 else 0.0 for j in range(len(features))]  # noqa: B023, E731
                    plain[part] += [(name, x[k], scaled(x)) for x in rows if x[0] in cells]
    shape = "model string, label int, x array<double>"
    want = {x["model"]: x for x in R.fit_chosen(*(spark.createDataFrame(plain[p], shape) for p in ("TRAIN", "FIT", "VALID")), 2).collect()}
    got = {x["model"]: x for x in R.fit_chosen_shared(shared, models["TRAIN"], models["FIT"], models["VALID"]).collect()}
    assert set(got) == set(want) and len(got) == 12
    for name, w in want.items():
        g = got[name]
        assert (g["status"], g["penalty"], g["n"], g["iterations"]) == (w["status"], w["penalty"], w["n"], w["iterations"])
        if w["coefficients"] is not None:
            assert np.allclose([g["intercept"], *g["coefficients"]], [w["intercept"], *w["coefficients"]], atol=1e-9)


def test_a_block_leaves_one_row_of_replicates(spark):
    """sums of all replicates leave a task as arrays, one row for each value, not one for each replicate."""
    rows = spark.createDataFrame([("s", race, b, 1.0, float(race)) for race in range(6) for b in (1, 2) if (race, b) != (0, 2)], "scope string, race_id long, bin int, k double, r double")
    got = {x["_by"]: x for x in B.replicate_sums(rows, ["k", "r"], 50, 3, by="bin").collect()}
    assert sorted(got) == [1, 2]
    draws = list(sequential(6, 50, 3))
    assert list(got[1]["r"]) == [float(sum(d)) for d in draws] and list(got[2]["k"]) == [float(sum(p > 0 for p in d)) for d in draws]


def test_labels_of_a_scope_share_their_draws(spark, monkeypatch):
    """all labels and kinds of scores of a scope take the same draws, which are made once; results are those of each label alone."""
    made, chunks = spark.sparkContext.accumulator(0), B.weight_chunks

    def counted(*args):
        made.add(1)
        return chunks(*args)

    r = random.Random(9)
    # Label c has no models in scope "t"; bin 2 of "s" has few races.
    rows = [(scope, race, 1 + (race % 7 == 0), *(x for t in "abc" for x in ((int(r.random() < 0.3) if (scope, t) != ("t", "c") else None), r.choice([0.2, 0.3, 0.7]) if (scope, t) != ("t", "c") else None, r.random() if (scope, t) != ("t", "c") else None))) for scope in "st" for race in range(30) for _ in range(5)]
    names = [f"{c}_{t}" for t in "abc" for c in ("label", "baseline", "incremental")]
    wide = spark.createDataFrame(rows, "scope string, race_id long, bin int, " + ", ".join(f"{c} {'int' if c.startswith('label') else 'double'}" for c in names))
    bins = spark.createDataFrame([(s, b) for s in "st" for b in (1, 2, 3)], "scope string, bin int")
    monkeypatch.setattr(B, "weight_chunks", counted)
    auc = B.auc_arrays(wide, {f"{c}_{t}": f"label_{t}" for t in "abc" for c in ("baseline", "incremental")}, 20, 5).select("scope", "kind").collect()
    assert len(auc) == 10 and made.value == 2
    monkeypatch.setattr(B, "weight_chunks", chunks)
    asked = lambda df, keys: {tuple(x[k] for k in keys): x.asDict() for x in df.collect()}
    # Few scores are summed by products; with TIES of 1 all go by running sums.
    got = (asked(B.paired_metrics(wide, 20, 5, "abc"), ("scope", "metric")), asked(B.bin_effects(wide, bins, 20, 5, "abc"), ("scope", "bin")), asked(B.centred_residuals(wide, bins, 20, 5, "abc"), ("scope", "bin")))
    assert [len(x) for x in got] == [15, 18, 15] and got[1]["t/c", 1]["evaluation"] == "NO_EVALUATION_ROWS"
    monkeypatch.setattr(B, "TIES", 1)
    one = wide.where("label_c IS NOT NULL").select("scope", "race_id", "bin", *(F.col(f"{c}_c").alias(c) for c in ("label", "baseline", "incremental")))
    own = (asked(B.paired_metrics(one, 20, 5), ("scope", "metric")), asked(B.bin_effects(one, bins, 20, 5), ("scope", "bin")), asked(B.centred_residuals(one, bins, 20, 5), ("scope", "bin")))
    for found, want in zip(got, own, strict=True):
        for (scope, key), w in want.items():
            g = found[f"{scope}/c", key]
            assert all(abs(g[c] - x) < 1e-12 if isinstance(x, float) else g[c] == x for c, x in w.items() if c != "scope"), (scope, key)
