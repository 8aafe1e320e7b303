"""Checks: each gives rows or counts of what is wrong, and never changes the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Text markers of a result's status in order of weight, and page states that admit a requested status.
MARKERS = (("訂正", "CORRECTED"), ("審議", "UNDER_REVIEW"), ("暫定", "PROVISIONAL"), ("確定", "CONFIRMED"), ("中止", "CANCELLED"))
ADMITS = {"AVAILABLE": ("PROVISIONAL", "CONFIRMED", "CORRECTED"), "UNDER_REVIEW": ("UNDER_REVIEW",), "CANCELLED": ("CANCELLED",), "UNAVAILABLE": ("UNAVAILABLE",)}
#: Reasons that a signal may carry and still count as operational; statistics without an entry allow none.
ALLOWED_REASONS = {"STAT-10": ("IN_MEETING_RESULT_CONFIRMATION_NOT_RECONSTRUCTED",), "STAT-12": ("IN_MEETING_RESULT_CONFIRMATION_NOT_RECONSTRUCTED",), "STAT-24": ("IN_MEETING_RESULT_CONFIRMATION_NOT_RECONSTRUCTED",), "STAT-39": ("MISSING_FRAME_NUMBER",)}


def decide_status(race_cancel: Column, section_cancel: Column, words: Column, ended: Column, received: Column, refunded: Column, shown: Column, paid: Column, code: Column) -> tuple[Column, Column]:
    """Result status and the evidence for it: cancellation flags, then markers in the text, then what has been received."""
    open_ = ~race_cancel & ~section_cancel
    whole = open_ & ended & received & refunded & shown & paid & (code == 0)
    nothing = open_ & ~ended & ~received & ~shown
    rules = [(race_cancel, "CANCELLED", "race cancelled"), (section_cancel, "CANCELLED", "section cancelled"), *((words.contains(m), s, f"marker {m}") for m, s in MARKERS)]
    rules += [(whole, "CONFIRMED", "race ended, result and refund received and shown"), (nothing, "UNAVAILABLE", "race not ended, nothing received")]
    return F.coalesce(*(F.when(c, s) for c, s, _ in rules)), F.coalesce(*(F.when(c, e) for c, _, e in rules), F.lit("no evidence"))


def admits(page: Column, requested: Column) -> Column:
    """Whether a page in this state may bring the requested status."""
    return F.coalesce(*(F.when(page == p, requested.isin(*s)) for p, s in ADMITS.items()), F.lit(False))


def completeness(races: DataFrame, entries: DataFrame, results: DataFrame) -> DataFrame:
    """Per race: expected entrants (the entries' bikes, else the declared number), what the results have, and the verdict."""
    e = entries.groupBy("race_id").agg(F.array_sort(F.collect_set("bike")).alias("bikes"))
    r = results.groupBy("race_id").agg(F.array_sort(F.collect_list("bike")).alias("found"))
    out = races.select("race_id", "entrants").join(e, "race_id", "left").join(r, "race_id", "left")
    n = F.coalesce(F.size("bikes"), F.lit(-1))
    expected = F.when(n > 0, n).otherwise(F.col("entrants"))
    found = F.coalesce(F.when(F.col("found").isNotNull(), F.size("found")), F.lit(0))
    verdict = F.coalesce(
        F.when((n > 0) & (n != F.col("entrants")), "ENTRANT_COUNT_MISMATCH"), F.when(~expected.between(5, 9), "ENTRANT_COUNT_UNSUPPORTED"), F.when(found == 0, "NO_RESULTS"),
        F.when(found != expected, "RESULT_COUNT_MISMATCH"), F.when((n > 0) & (F.col("found") != F.col("bikes")), "BIKE_SET_MISMATCH"), F.lit("COMPLETE"))
    return out.select("race_id", expected.alias("expected"), found.alias("found"), verdict.alias("verdict"))


def duplicates(df: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per named key: how many of its values occur more than once, and how many rows these have."""
    out = None
    for name, columns in keys.items():
        g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        part = g.agg(F.lit(name).alias("key"), F.count(F.lit(1)).alias("values"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def constraints(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Violations of each check in one pass; a NULL outcome is no violation."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(~c).alias(n) for n, c in checks.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks)))
    return one.select("rows", each.alias("x")).select("x.check", "rows", "x.violations")


def contiguous(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Groups with their count and whether numbers are 1..n, each once."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(number).alias("distinct"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    return g.select(*keys, "n", ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("distinct") == F.col("n"))).alias("contiguous"))


def pagination(pages: DataFrame, keys: Sequence[str], limit: int = 100) -> DataFrame:
    """From (keys, requested, parsed, last, sha256, players): what is wrong with each page. A page must be the one that was asked for
    and not lie beyond the last, of which there are ``limit`` at most; two neighbours must differ in body and in players."""
    order = Window.partitionBy(*keys).orderBy("requested")
    same = lambda c: F.col(c) == F.lag(c).over(order)
    last = F.col("last")
    rules = [(F.col("requested") != F.col("parsed"), "PAGE_MISMATCH"), (last.isNull() | (last < 1) | (last < F.col("parsed")), "BEYOND_LAST_PAGE"), (last > limit, "TOO_MANY_PAGES"), (same("sha256"), "REPEATED_PAGE"), (same("players"), "REPEATED_PLAYERS")]
    return pages.select(*keys, "requested", F.coalesce(*(F.when(c, p) for c, p in rules), F.lit("OK")).alias("problem"))


def page_completeness(pages: DataFrame, results: DataFrame, payouts: DataFrame, expected: DataFrame, key: str = "url") -> DataFrame:
    """Verdict on each result page (key, state) against the expected bikes (key, bike): results of just these, and whole payouts."""
    r = results.groupBy(key).agg(F.array_sort(F.collect_list("bike")).alias("found"))
    e = expected.groupBy(key).agg(F.array_sort(F.collect_set("bike")).alias("bikes"))
    p = payouts.groupBy(key).agg(F.count_if(F.col("amount").isNull() | F.col("combination").isNull() | (F.col("combination") == "") | F.col("bet_type").isNull()).alias("partial"))
    out = pages.select(key, "state").join(r, key, "left").join(e, key, "left").join(p, key, "left")
    found = F.coalesce(F.size("found"), F.lit(0))
    rules = [(F.col("state") != "RESULTS_AVAILABLE", "NO_RESULT_PAGE"), (F.col("found").isNull(), "NO_RESULTS"), (F.size(F.array_distinct("found")) < found, "DUPLICATE_BIKE"), (F.col("bikes").isNull() | (found != F.size("bikes")), "RESULT_COUNT_MISMATCH"), (F.col("found") != F.col("bikes"), "BIKE_SET_MISMATCH"), (F.col("partial") > 0, "PARTIAL_PAYOUT")]
    return out.select(key, F.coalesce(*(F.when(c, v) for c, v in rules), F.lit("COMPLETE")).alias("verdict"))


def replay_faults(effects: DataFrame, bins: DataFrame, unseen: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per scope what is wrong with a replay's effects (scope, label, bin, identity, overall_mean): bins twice or missing for a label, bins
    that are no training bin (bin 0 only in scopes with ``unseen`` rows), identities that differ between labels, and overall means that
    differ inside a label. A scope without a fault has zeros."""
    every = bins.select("scope", "bin").union(unseen.select("scope", F.lit(0).alias("bin"))).distinct()
    wanted = every.withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    has = effects.groupBy("scope", "label", "bin").agg(F.count(F.lit(1)).alias("times"))
    both = wanted.withColumn("_want", F.lit(1)).join(has, ["scope", "label", "bin"], "full_outer")
    sets = both.groupBy("scope").agg(F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("_want").isNull()).alias("unknown"), F.count_if(F.col("times") > 1).alias("repeated"))
    identities = effects.where("bin > 0").groupBy("scope", "bin").agg(F.countDistinct("identity").alias("k")).groupBy("scope").agg(F.count_if(F.col("k") > 1).alias("differing_bins"))
    means = effects.groupBy("scope", "label").agg((F.min("overall_mean") != F.max("overall_mean")).alias("x")).groupBy("scope").agg(F.count_if("x").alias("differing_means"))
    out = sets.join(identities, "scope", "left").join(means, "scope", "left")
    return out.select("scope", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("missing", "unknown", "repeated", "differing_bins", "differing_means")))


def cutoffs(entry: DataFrame) -> DataFrame:
    """Races whose entries have no cutoff or several."""
    g = entry.groupBy("race_id").agg(F.countDistinct("cutoff").alias("cutoffs"), F.count_if(F.col("cutoff").isNull()).alias("missing"))
    return g.where("cutoffs <> 1 OR missing > 0")


def against_manifest(actual: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each expected or actual group with the columns that differ, comma-separated; empty where all agree."""
    a, e = (df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in columns)) for p, df in (("a", actual), ("e", expected)))
    both = a.join(e, list(keys), "full_outer")
    differ = F.concat_ws(",", *(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"e_{c}")), c) for c in columns))
    return both.select(*keys, *(F.col(f"a_{c}") for c in columns), *(F.col(f"e_{c}") for c in columns), differ.alias("differs"))


def signal_eligible(stat: str, status: Column, quality: Column, reasons: Column) -> dict[str, Column]:
    """STRICT: valid and full. OPERATIONAL: valid, not partial, and no reasons but the allowed ones."""
    allowed = F.array(*map(F.lit, ALLOWED_REASONS.get(stat, ()))).cast("array<string>")
    given = F.filter(F.split(reasons, ","), lambda x: x != "")
    return {"strict": (status == "VALID") & (quality == "FULL"), "operational": (status == "VALID") & (quality != "PARTIAL") & (F.size(F.array_except(given, allowed)) == 0)}


def complete_races(eligible: DataFrame, official: DataFrame) -> DataFrame:
    """Races whose eligible entries are exactly the official ones."""
    one, two = (df.groupBy("race_id").agg(F.array_sort(F.collect_set("entry_id")).alias(n)) for df, n in ((eligible, "own"), (official, "all")))
    return two.join(one, "race_id", "left").select("race_id", F.coalesce(F.col("own") == F.col("all"), F.lit(False)).alias("complete"))


def bins_complete(effects: DataFrame, bins: DataFrame) -> DataFrame:
    """Per scope and label: missing and unknown bins of a replay's summary; labels must have the same bins."""
    wanted = bins.select("scope", "bin").crossJoin(F.broadcast(effects.select("label").distinct()))  # labels are three
    has = effects.select("scope", "label", "bin", F.lit(1).alias("has"))
    both = wanted.withColumn("want", F.lit(1)).join(has, ["scope", "label", "bin"], "full_outer")
    return both.groupBy("scope", "label").agg(F.count_if(F.col("has").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unknown"), F.count("has").alias("bins"))


#: How far a stored aggregate may be from the weighted mean of its sections, relative to the larger of both and 1.
INTEGRITY = 1e-12


def aggregate_integrity(stored: Column, sections: Sequence[tuple[Column, Column]]) -> Column:
    """Whether a stored mean is that of its sections (sample count, mean): MATCH, MISMATCH, NO_VALUE where neither exists, and
    INVALID_SECTION where a section lacks its count, has a negative one, or a positive one without a mean."""
    bad, total, weighted = F.lit(False), F.lit(0), F.lit(0.0)
    for n, mean in sections:
        bad = bad | n.isNull() | (n < 0) | ((n > 0) & mean.isNull())
        total, weighted = total + F.coalesce(n, F.lit(0)), weighted + F.coalesce(n * mean, F.lit(0.0))
    derived = F.when(total > 0, weighted / total)
    close = F.abs(derived - stored) <= INTEGRITY * F.greatest(F.lit(1.0), F.abs(derived), F.abs(stored))
    return F.when(bad, "INVALID_SECTION").when(derived.isNull() & stored.isNull(), "NO_VALUE").when(F.coalesce(close, F.lit(False)), "MATCH").otherwise("MISMATCH")


def checked_aggregate(stored: Column, sections: Sequence[tuple[Column, Column]], name: str) -> Column:
    """``stored`` where it agrees with its sections; elsewhere the job fails and says which aggregate did not."""
    state = aggregate_integrity(stored, sections)
    return F.when(state.isin("MATCH", "NO_VALUE"), stored).otherwise(F.raise_error(F.concat(F.lit(f"{name}: "), state)).cast("double"))
