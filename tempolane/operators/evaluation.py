"""Walk-forward evaluation: labels, eligibility, hit rates, bins and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempolane.operators.hashing import row_hash
from tempolane.storage import materialise

EPSILON = 1e-15


def labels(status: Column, rank: Column) -> dict[str, Column]:
    """IS_WIN, IS_TOP2, IS_TOP3; abnormal results are false, a finish without a rank stops the run."""
    finished = status.isin("FINISHED", "TIED")
    lost = finished & rank.isNull()
    return {n: F.when(lost, F.raise_error(F.lit("finish without a rank")).cast("boolean")).otherwise(finished & (rank <= k)) for n, k in (("is_win", 1), ("is_top2", 2), ("is_top3", 3))}


#: Last year that may be evaluated; later ones are the final holdout.
HOLDOUT_AFTER = 2000


def guard_holdout(year: int, last: int = HOLDOUT_AFTER) -> None:
    """Refuse an evaluation inside the final holdout, before any label is read."""
    if year > last:
        raise ValueError(f"evaluation year {year} lies in the final holdout after {last}")


def folds(spark, years: Sequence[int], first: int) -> DataFrame:
    """Walk-forward folds by role: train to the year before, of which the last validates the inner fit, and evaluate the year."""
    roles = lambda y: (("TRAIN", first, y - 1), ("INNER_FIT", first, y - 2), ("INNER_VALIDATION", y - 1, y - 1), ("EVALUATION", y, y))
    rows = [(f"WF_{y}", *r) for y in years for r in roles(y)]
    return spark.createDataFrame(rows, "fold string, role string, first_year int, last_year int")


def exclusions(entry: DataFrame) -> DataFrame:
    """year, race_id, stage and reason: what kept a race from prediction (FEATURE), from its labels (LABEL) or from the cohort of
    races that all finished (COHORT). Features are judged first; labels take no part in that."""
    reasons = race_reasons(entry).join(entry.groupBy("race_id").agg(F.first(F.year("race_date")).alias("year")), "race_id")
    each = reasons.where("reasons <> ''").withColumn("reason", F.explode(F.split("reasons", ",")))
    stage = F.when(F.col("reason").isin("RESULT_UNCONFIRMED", "NO_WINNER"), "LABEL").otherwise("FEATURE")
    cohort = reasons.where("reasons = '' AND NOT all_finished").select("year", "race_id", F.lit("COHORT").alias("stage"), F.lit("ABNORMAL_RESULT").alias("reason"))
    return each.select("year", "race_id", stage.alias("stage"), "reason").unionByName(cohort)


def outcome_snapshot(entry: DataFrame) -> DataFrame:
    """One row per race: its context, its results in order of bike, and whether all rows agree on the context."""
    row = F.struct("bike", F.concat_ws(":", F.col("bike").cast("string"), F.coalesce(F.col("rank").cast("string"), F.lit("-")), "result_status").alias("text"))
    g = entry.groupBy(F.year("race_date").alias("year"), "race_id").agg(
        F.first("entrants").alias("entrants"), F.first("race_status").alias("race_status"), F.count(F.lit(1)).alias("results"), F.array_sort(F.collect_list(row)).alias("rows"), F.countDistinct("bike").alias("bikes"), F.countDistinct("start_at").alias("starts"))
    good = (F.col("results") == F.col("entrants")) & F.col("entrants").between(5, 9) & (F.col("bikes") == F.col("results")) & (F.col("starts") == 1)
    return g.select("year", "race_id", "entrants", "race_status", "results", F.array_join(F.transform("rows", lambda x: x["text"]), ",").alias("outcome"), good.alias("consistent"))


#: Reasons against a race's features and against its labels, in their order.
FEATURE_REASONS = ("FEATURE_RESULT_COUNT_MISMATCH", "FEATURE_DUPLICATE_ENTRY", "FEATURE_DUPLICATE_BIKE", "FEATURE_STATUS_NOT_VALID", "FEATURE_QUALITY_NOT_FULL", "FEATURE_SCORE_UNAVAILABLE", "FEATURE_SCORE_NON_POSITIVE", "FEATURE_RANK_MISSING", "FEATURE_INPUT_AS_OF_MISSING", "FEATURE_INPUT_AS_OF_AFTER_START")
LABEL_REASONS = ("LABEL_RACE_NOT_CONFIRMED", "LABEL_RESULT_COUNT_MISMATCH", "LABEL_NO_WINNER", "LABEL_FINISHED_RANK_MISSING")
ABNORMAL = "LABEL_ABNORMAL_RESULT_PRESENT"


def feature_reasons(features: DataFrame, races: DataFrame) -> DataFrame:
    """Per race (race_id, entrants, start_at) all reasons against its features (race_id, entry_id, bike, status, quality, score,
    score_rank, input_as_of), comma-separated in their order; empty for an eligible race. A race without features has the first."""
    bad = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) > 0
    own = features.join(races.select("race_id", "start_at"), "race_id")
    after = F.col("input_as_of").isNotNull() & (F.col("start_at").isNull() | (F.col("input_as_of") > F.col("start_at")))
    faults = [~F.col("status").eqNullSafe("VALID"), ~F.col("quality").eqNullSafe("FULL"), F.col("score").isNull(), F.col("score").isNull() | (F.col("score") <= 0), F.col("score_rank").isNull(), F.col("input_as_of").isNull(), after]
    g = own.groupBy("race_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entry_id").alias("entries"), F.countDistinct("bike").alias("bikes"), *(bad(c).alias(f"f{k}") for k, c in enumerate(faults)))
    out = races.join(g, "race_id", "left")
    n = F.coalesce("n", F.lit(0))
    held = [n != F.col("entrants"), F.col("entries") < n, F.col("bikes") < n, *(F.col(f"f{k}") for k in range(len(faults)))]
    return out.select("race_id", F.concat_ws(",", *(F.when(c, r) for c, r in zip(held, FEATURE_REASONS, strict=True))).alias("reasons"))


def rank_predictions(features: DataFrame) -> DataFrame:
    """The rank baseline's prediction of each entry: its rank, whether it is in the best set and among the best three (ties kept), and
    a hash of all that."""
    sets = {"rank1_set": F.col("score_rank") == 1, "top3_set": F.col("score_rank") <= 3}
    out = features.where("score_rank IS NOT NULL").select("race_id", "entry_id", "bike", "score", "score_rank", *(c.alias(k) for k, c in sets.items()))
    return out.withColumn("prediction_hash", row_hash(out, ["race_id", "entry_id", "score", "score_rank", "rank1_set", "top3_set"]))


def cohort_decisions(races: DataFrame, predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per race and cohort: whether it is included, the reasons against it, hits and sizes of the predicted sets.

    Labels (race_id, bike, result_status, rank) may not be those of a confirmed race, may be too few, lack a winner or a finisher's
    rank: then both cohorts leave the race out. NORMAL_FINISH also leaves out a race with an abnormal result.
    """
    finished, ranked = F.col("result_status").isin("FINISHED", "TIED"), F.col("rank").isNotNull()
    won = finished & ranked & (F.col("rank") == 1)
    l = labels.groupBy("race_id").agg(F.count(F.lit(1)).alias("labels"), F.count_if(won).alias("winners"), F.count_if(finished & ~ranked).alias("unranked"), F.count_if(~(finished & ranked)).alias("abnormal"))
    winners = labels.where(won).select("race_id", "bike", F.lit(1).alias("won"))
    hit = lambda c: F.coalesce(F.max((F.col(c) & F.col("won").isNotNull()).cast("int")), F.lit(0)) == 1
    p = predictions.join(winners, ["race_id", "bike"], "left").groupBy("race_id").agg(hit("rank1_set").alias("rank1_hit"), hit("top3_set").alias("top3_hit"), F.count_if("rank1_set").alias("rank1_set_size"), F.count_if("top3_set").alias("top3_set_size"))
    out = races.select("race_id", "entrants", "race_status").join(l, "race_id", "left").join(p, "race_id", "left").withColumn("cohort", F.explode(F.array(F.lit("OPERATIONAL"), F.lit("NORMAL_FINISH"))))
    n = F.coalesce("labels", F.lit(0))
    held = [~F.col("race_status").eqNullSafe("CONFIRMED"), n != F.col("entrants"), F.coalesce("winners", F.lit(0)) == 0, F.coalesce("unranked", F.lit(0)) > 0]
    against = F.concat_ws(",", *(F.when(c, r) for c, r in zip(held, LABEL_REASONS, strict=True)))
    reasons = F.when(against != "", against).when((F.col("cohort") == "NORMAL_FINISH") & (F.col("abnormal") > 0), ABNORMAL).otherwise("")
    out = out.withColumn("reasons", reasons).withColumn("included", F.col("reasons") == "")
    shown = [F.when(F.col("included"), F.coalesce(c, F.lit(False))).alias(c) for c in ("rank1_hit", "top3_hit")] + [F.when(F.col("included"), F.coalesce(c, F.lit(0))).alias(c) for c in ("rank1_set_size", "top3_set_size")]
    return out.select("race_id", "cohort", "included", "reasons", *shown)


def snapshot_rows(targets: DataFrame, races: DataFrame, results: DataFrame) -> DataFrame:
    """The target races with their context and each of their results; races without results have one row. A target race that is not
    among the races stops the run."""
    there = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no race for target "), F.col("race_id").cast("string"))).cast("long")).otherwise(F.col("race_id"))
    out = targets.select("race_id").distinct().join(races.withColumn("_there", F.lit(1)), "race_id", "left").withColumn("race_id", there).drop("_there")
    return out.join(results, "race_id", "left")


def race_reasons(entry: DataFrame) -> DataFrame:
    """Per race, all reasons against its use, in fixed order, comma-separated; empty for a usable race."""
    g = entry.groupBy("race_id").agg(
        F.first("entrants").alias("entrants"), F.count(F.lit(1)).alias("n"), F.countDistinct("player_id").alias("players"), F.count("player_id").alias("known"), F.count("score").alias("scores"), F.count_if(F.col("score") <= 0).alias("bad"),
        F.first("race_status").alias("race_status"), F.first("cutoff").alias("cutoff"), F.first("start_at").alias("start_at"), F.count_if(F.col("rank") == 1).alias("winners"), F.count_if(~F.col("result_status").isin("FINISHED", "TIED")).alias("abnormal"),
    )
    rules = [("ENTRY_COUNT_MISMATCH", F.col("n") != F.col("entrants")), ("DUPLICATE_PLAYER", F.col("players") < F.col("known")), ("PLAYER_UNRESOLVED", F.col("known") < F.col("n")), ("SCORE_MISSING", F.col("scores") < F.col("n")), ("SCORE_NON_POSITIVE", F.col("bad") > 0), ("RESULT_UNCONFIRMED", ~F.col("race_status").isin("CONFIRMED", "CORRECTED")), ("NO_WINNER", F.col("winners") == 0)]
    return g.select("race_id", F.concat_ws(",", *(F.when(c, n) for n, c in rules)).alias("reasons"), (F.col("abnormal") == 0).alias("all_finished"))


def hit_rates(entry: DataFrame) -> DataFrame:
    """Rank baseline by year and cohort: does the best-scored set, or the best three, contain a winner (ties kept)?"""
    usable = entry.join(race_reasons(entry).where("reasons = ''"), "race_id")
    score_rank = F.rank().over(Window.partitionBy("race_id").orderBy(F.desc("score")))
    race = usable.withColumn("sr", score_rank).groupBy("race_id", F.year("race_date").alias("year"), "all_finished").agg(
        F.max(((F.col("sr") == 1) & (F.col("rank") == 1)).cast("int")).alias("hit1"), F.max(((F.col("sr") <= 3) & (F.col("rank") == 1)).cast("int")).alias("hit3"), F.count_if(F.col("sr") == 1).alias("n1"), F.count_if(F.col("sr") <= 3).alias("n3"))
    cohort = race.withColumn("cohort", F.explode(F.when(F.col("all_finished"), F.array(F.lit("OPERATIONAL"), F.lit("NORMAL_FINISH"))).otherwise(F.array(F.lit("OPERATIONAL")))))
    return cohort.groupBy("year", "cohort").agg(F.count(F.lit(1)).alias("races"), F.avg("hit1").alias("rank1_hit_rate"), F.avg("hit3").alias("top3_hit_rate"), F.avg("n1").alias("mean_set1"), F.avg("n3").alias("mean_set3"))


def log_loss(p: Column, label: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -F.when(label == 1, F.log(q)).otherwise(F.log(1 - q))


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve per key by average ranks; NULL with one class. Equal scores meet before the window."""
    ties = df.groupBy(*keys, score).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    ties = ties.withColumn("won", F.col("_p") * (F.coalesce(below, F.lit(0)) + 0.5 * F.col("_n")))
    g = ties.groupBy(*keys).agg(F.sum("won").alias("w"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    return g.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc"), F.col("p").cast("long").alias("positives"), F.col("n").cast("long").alias("negatives"))


#: Slots of a histogram that narrows a quantile down.
SLOTS = 1024


def order_statistics(values: DataFrame, keys: Sequence[str], ranks: DataFrame) -> DataFrame:
    """``ranks`` (keys, rank from 0) with ``at``: the value with that rank among the key's ``v``, each of which counts ``w`` times.

    All ranks of all keys narrow down together. A rank knows a range that holds its value and how many values lie below; a pass
    counts the values of each open range in SLOTS slots, with the least and greatest of each slot, and the slot in which the rank
    falls is the next range. It ends when a range is one value. A pass leaves at most SLOTS rows a range, so no task ever holds
    the values of a key. Keys and values are not NULL; ``values`` is read once a pass.
    """
    keys = list(keys)
    bounds = values.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    states = materialise(ranks.join(bounds, keys).withColumn("below", F.lit(0).cast("long")), "ranks")
    while not states.where("lo < hi").isEmpty():
        wide = states.where("lo < hi")
        ranges = wide.select(*keys, "lo", "hi", "below").distinct()
        # Halves, so that the widest range of doubles does not overflow.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        slot = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), SLOTS - 1).otherwise(F.least(F.lit(SLOTS - 1), F.floor(share * SLOTS)).cast("int"))
        inside = values.join(F.broadcast(ranges), keys).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        counted = inside.groupBy(*keys, "lo", "hi", slot.alias("slot")).agg(F.sum("w").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("slot"))
        met = wide.join(counted.withColumn("upto", upto), [*keys, "lo", "hi"]).where((F.col("rank") - F.col("below") < F.col("upto")) & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("c")))
        narrowed = met.select(*keys, "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"))
        states = materialise(states.where("lo >= hi").select(*narrowed.columns).unionByName(narrowed), "ranks")
    return states.select(*keys, "rank", F.col("lo").alias("at"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], times: str | None = None) -> DataFrame:
    """(keys, share, quantile): exact Type-7 quantiles, linear on (n - 1) x share, of all keys at once. NULL and NaN don't count.
    ``times``: how often a row's value is there."""
    keys = list(keys)
    own = (F.col(times) if times else F.lit(1)).cast("long").alias("w")
    values = materialise(df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("v"), own), "values")
    n = values.groupBy(*keys).agg((F.sum("w") - 1).alias("last"))
    wanted = n.select(*keys, "last", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("place", F.col("last") * F.col("share"))
    wanted = wanted.withColumn("rank", F.floor("place")).withColumn("next", F.least(F.col("rank") + 1, F.col("last")))
    ranks = wanted.select(*keys, F.explode(F.array("rank", "next")).alias("rank")).distinct()
    found = order_statistics(values, keys, ranks)
    two = wanted.join(found.withColumnRenamed("at", "a"), [*keys, "rank"]).join(found.select(*keys, F.col("rank").alias("next"), F.col("at").alias("b")), [*keys, "next"])
    return two.select(*keys, "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("rank"))).alias("quantile"))


def decile_bins(df: DataFrame, keys: Sequence[str], value: str, times: str | None = None) -> DataFrame:
    """Right-closed decile bins of each key: bin 1.. with bounds; equal borders are one; outermost bounds are open (NULL)."""
    cuts = quantiles(df, keys, value, [k / 10 for k in range(1, 10)], times).groupBy(*keys).agg(F.array_sort(F.collect_set("quantile")).alias("c"))
    each = cuts.select(*keys, "c", F.posexplode(F.concat("c", F.array(F.lit(None).cast("double")))).alias("i", "upper"))
    return each.select(*keys, (F.col("i") + 1).alias("bin"), F.when(F.col("i") > 0, F.get("c", F.col("i") - 1)).alias("lower"), "upper")


def natural(text: Column) -> Column:
    """A text to sort by, in which runs of digits (up to 20) compare as numbers and everything else as it stands."""
    return F.regexp_replace(F.regexp_replace(text, "([0-9]+)", "00000000000000000000$1"), "0*([0-9]{20})", "$1")


def number_text(value: Column) -> Column:
    """A number as text: whole numbers without a point."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


#: With more distinct training values than this, bins are ranges.
CATEGORIES = 10


def effect_bins(df: DataFrame, keys: Sequence[str], value: str, times: str | None = None) -> DataFrame:
    """Bins of each key's training values: one for each value in natural order of its text where there are at most CATEGORIES, else
    decile ranges. (keys, bin, kind, lower, upper, category, training_count). ``times``: how often a row's value is there."""
    keys = list(keys)
    own = F.col(times) if times else F.lit(1)
    values = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("v"), own.cast("long").alias("w"))
    counted = materialise(values.groupBy(*keys, "v").agg(F.sum("w").alias("training_count")), "distinct")
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct"))
    few = counted.join(sizes.where(F.col("_distinct") <= CATEGORIES), keys).withColumn("category", number_text(F.col("v")))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(natural(F.col("category"))))
    none = F.lit(None).cast("double")
    categories = few.select(*keys, nth.alias("bin"), F.lit("CATEGORY").alias("kind"), none.alias("lower"), none.alias("upper"), "category", "training_count")
    many = counted.join(sizes.where(F.col("_distinct") > CATEGORIES).select(*keys), keys, "left_semi")
    # The distinct values and how often they occur are all that the borders take.
    ranges = materialise(decile_bins(many, keys, "v", "training_count"), "ranges")
    held = assign_bins(many, ranges, keys, "v").groupBy(*keys, "bin").agg(F.sum("training_count").alias("training_count"))
    ranges = ranges.join(held, [*keys, "bin"], "left").select(*keys, "bin", F.lit("NUMERIC_RANGE").alias("kind"), "lower", "upper", F.lit(None).cast("string").alias("category"), F.coalesce("training_count", F.lit(0)).alias("training_count"))
    return categories.unionByName(ranges)


def cuts_below(cuts: Column, value: Column) -> Column:
    """How many of ``cuts`` lie below the value; the few of decile bins one by one, which costs less than a function over the array."""
    few = sum((F.coalesce((F.get(cuts, F.lit(k)) < value).cast("int"), F.lit(0)) for k in range(1, CATEGORIES - 1)), F.coalesce((F.get(cuts, F.lit(0)) < value).cast("int"), F.lit(0)))
    return F.when(F.size(cuts) < CATEGORIES, few).otherwise(F.size(F.filter(cuts, lambda c: c < value)))


def assign_effect_bins(df: DataFrame, bins: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``df`` with bin: the value's range or category, 0 for a category that training did not have, NULL for no value. A key's few
    bins travel as one row."""
    keys = list(keys)
    own = bins.groupBy(*keys).agg(F.max("kind").alias("_kind"), F.array_sort(F.collect_list("upper")).alias("_cuts"), F.map_from_entries(F.collect_list(F.when(F.col("kind") == "CATEGORY", F.struct("category", "bin")))).alias("_categories"))
    v = F.col(value).cast("double") + F.lit(0.0)
    ranged = 1 + cuts_below(F.col("_cuts"), v)
    bin_ = F.when(v.isNull() | F.isnan(v) | F.col("_kind").isNull(), F.lit(None).cast("int")).when(F.col("_kind") == "CATEGORY", F.coalesce(F.try_element_at("_categories", number_text(v)), F.lit(0))).otherwise(ranged)
    return df.join(F.broadcast(own), keys, "left").withColumn("bin", bin_).drop("_kind", "_cuts", "_categories")


def assign_bins(df: DataFrame, bins: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bin of each value: lower < v <= upper. A key's few borders travel as one array, so no range join is needed, and keys are few."""
    cuts = bins.where("upper IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list("upper")).alias("_cuts"))
    joined = df.join(F.broadcast(cuts), list(keys), "left")
    return joined.withColumn("bin", F.when(F.col(value).isNotNull(), 1 + F.when(F.col("_cuts").isNull(), 0).otherwise(cuts_below(F.col("_cuts"), F.col(value))))).drop("_cuts")


def category_bins(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One bin for each of a key's few values, from 1 on: in order of number where all are numbers, else of text."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("training_count"))
    number = F.col(value).cast("string").try_cast("double") if hasattr(F.col(value), "try_cast") else F.col(value).cast("double")
    whole = Window.partitionBy(*keys)
    numeric = F.min(number.isNotNull()).over(whole)
    nth = F.row_number().over(whole.orderBy(F.when(F.col("_numeric"), number), F.col(value).cast("string")))
    return distinct.withColumn("_numeric", numeric).withColumn("bin", nth).drop("_numeric")


def assign_categories(df: DataFrame, bins: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bin of each value; 0 for a value that training did not have, NULL for none."""
    joined = df.join(F.broadcast(bins.select(*keys, value, "bin")), [*keys, value], "left")  # few bins by definition
    return joined.withColumn("bin", F.when(F.col(value).isNotNull(), F.coalesce("bin", F.lit(0))))
