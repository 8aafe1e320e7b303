"""Merge and reconcile operators; each gives the next version of a table and can run inside foreachBatch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Result states in order of their rank.
STATUS_ORDER = ("UNAVAILABLE", "UNDER_REVIEW", "PROVISIONAL", "CONFIRMED", "CORRECTED", "CANCELLED")


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], keep_when_null: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``stored`` by key; a new NULL keeps the stored value of the named columns."""
    rest = [c for c in stored.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in rest), F.lit(True).alias("n__"))
    joined = stored.join(n, list(keys), "full_outer")
    return joined.select(*keys, *((F.coalesce(f"n_{c}", c) if c in keep_when_null else F.when(F.col("n__"), F.col(f"n_{c}")).otherwise(F.col(c))).alias(c) for c in rest))


def replace_children(stored: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` are replaced; children of other parents stay."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def snapshots(rows: DataFrame, keys: Sequence[str], content: str, time: str) -> DataFrame:
    """One row for each key and content hash: the first time it was seen stays, the last moves on."""
    return rows.groupBy(*keys, content).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count(F.lit(1)).alias("times_seen"))


def can_follow(current, new):
    """Whether a status may replace another: no regression; CANCELLED is final; what is confirmed can't be cancelled."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, STATUS_ORDER)), c)
    return (current == new) | ((current != "CANCELLED") & ~((new == "CANCELLED") & current.isin("CONFIRMED", "CORRECTED")) & (rank(new) >= rank(current)))


def fold_status(updates: DataFrame, key: str, order: str, status: str, stored: DataFrame | None = None) -> DataFrame:
    """The status after all updates of a key in order, illegal ones rejected, the numbers of both kinds, and the order value of the
    first confirmation that still holds (a correction keeps it, any other status clears it).

    The fold starts from the ``stored`` states (key, status, confirmed_at), of which it keeps those without an update, and says what
    the batch changes: ``clear_children`` where it brought a cancellation, ``confirmation`` SET, CLEARED or KEPT. A key's updates are
    one array: a race has a handful in its life, and the fold needs them in order.
    """
    order_type = dict(updates.dtypes)[order]
    seq = updates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, status))).alias("u"))
    none = F.lit(None).cast(order_type)
    if stored is None:
        seq = seq.withColumns({"_status": F.lit(None).cast("string"), "_confirmed": none})
    else:
        seq = seq.join(stored.select(key, F.col("status").alias("_status"), F.col("confirmed_at").alias("_confirmed")), key, "full_outer")
    zero = F.struct(F.coalesce("_status", F.lit("UNAVAILABLE")).alias("status"), F.lit(0).alias("applied"), F.lit(0).alias("rejected"), F.col("_confirmed").cast(order_type).alias("confirmed_at"))

    def step(acc, u):
        ok = can_follow(acc["status"], u[status])
        now = F.when(ok, u[status]).otherwise(acc["status"])
        confirmed = F.when(now.isin("CONFIRMED", "CORRECTED"), F.coalesce(acc["confirmed_at"], u[order]))
        return F.struct(now.alias("status"), (acc["applied"] + ok.cast("int")).alias("applied"), (acc["rejected"] + (~ok).cast("int")).alias("rejected"), confirmed.alias("confirmed_at"))

    out = seq.withColumn("x", F.aggregate(F.coalesce("u", F.array().cast(seq.schema["u"].dataType)), zero, step))
    was, now = F.col("_confirmed"), F.col("x.confirmed_at")
    change = F.when(now.isNotNull() & was.isNull(), "SET").when(now.isNull() & was.isNotNull(), "CLEARED").otherwise("KEPT")
    cleared = (F.col("x.status") == "CANCELLED") & (F.coalesce("_status", F.lit("")) != "CANCELLED")
    return out.select(key, "x.status", F.col("x.applied").cast("long").alias("applied"), F.col("x.rejected").cast("long").alias("rejected"), "x.confirmed_at", cleared.alias("clear_children"), change.alias("confirmation"))


def without_cleared(children: DataFrame, fold: DataFrame, key: str) -> DataFrame:
    """The children that stay when a fold's change set is applied: none of a parent that the batch cancelled."""
    return children.join(fold.where("clear_children").select(key), key, "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The row of each key that comes last in order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def renumbered(days: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Days with their number 1..n by date, and the first and last day of their group."""
    w = Window.partitionBy(*keys)
    return days.withColumns({"day_number": F.row_number().over(w.orderBy(day)), "starts_on": F.min(day).over(w), "ends_on": F.max(day).over(w)})


def reconcile_days(stored: DataFrame, wanted: DataFrame, used: DataFrame, key: str, day: str) -> DataFrame:
    """Days of a meeting after reconciliation: wanted ones are added, others go unless races use them; then renumbered."""
    keep = stored.select(key, day).join(used.select(key, day).distinct(), [key, day], "left_semi")
    days = keep.unionByName(wanted.select(key, day)).distinct()
    return renumbered(days, [key], day)


def link_players(entries: DataFrame, players: DataFrame, name_key) -> tuple[DataFrame, DataFrame]:
    """Unresolved entries (external_id, name) with the player of that number whose name agrees; conflicts are set apart."""
    open_ = entries.where("player_id IS NULL AND external_id IS NOT NULL").drop("player_id")
    p = players.select(F.col("external_id"), F.col("player_id"), F.col("name").alias("player_name"))
    met = open_.join(p, "external_id")
    same = name_key(F.col("name")).eqNullSafe(name_key(F.col("player_name"))) | F.col("name").isNull()
    return met.where(same).drop("player_name"), met.where(~same)


def run_accounting(items: DataFrame, run: str) -> DataFrame:
    """Per run: attempts, outcomes and the run's status."""
    count = lambda s: F.count_if(F.col("outcome") == s)
    g = items.groupBy(run).agg(F.count(F.lit(1)).alias("attempts"), count("SUCCESS").alias("success"), count("SKIPPED").alias("skipped"), count("FAILURE").alias("failure"))
    status = F.when(F.col("failure") == 0, "SUCCEEDED").when(F.col("success") + F.col("skipped") > 0, "PARTIALLY_FAILED").otherwise("FAILED")
    return g.withColumn("status", status)
