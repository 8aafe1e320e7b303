"""As-of operators: what was known about a key strictly before a cutoff.

Histories are never multiplied with targets. Sums over any number of windows come from running sums: whole subjects meet in a task
(:mod:`.careers`), where each border is looked up in the running sums of its key; a window is the difference of two borders. Several
requests (keys, sums, windows) of one subject share one shuffle. Last-N windows number a key's events and fetch N of them by
equality.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempolane.operators.careers import Careers, careers, doubles

DAY = 86400


@dataclass(frozen=True)
class Request:
    """Sums over the events that share ``keys`` with the target, for windows of ``days`` (None: all before the cutoff)."""

    prefix: str
    sums: Mapping[str, Column]
    days: Sequence[int | None] = (None,)
    keys: Sequence[str] = field(default_factory=tuple)
    #: All-time greatest and least values before the cutoff, named ``{prefix}{name}``; NULL without an event.
    highs: Mapping[str, Column] = field(default_factory=dict)
    lows: Mapping[str, Column] = field(default_factory=dict)


def name_of(days: int | None) -> str:
    return "all" if days is None else str(days)


def asof_rows(targets: DataFrame, events: DataFrame, requests: Sequence[Request], by: str = "player_id", cutoff: str = "cutoff", time: str = "start_at", columns: Mapping[str, Column] | None = None, more: Callable[[Careers], Mapping[str, object]] | None = None, outputs: StructType | None = None, order: Sequence[str] = ()) -> DataFrame:
    """``targets`` with ``{prefix}{sum}_{days}`` of all requests, over events in [cutoff - days, cutoff).

    ``by`` is the subject; a request's further keys match within it. Keys that are null match nothing, and a target without a
    subject has NULLs. Events and targets are dealt by the subject once; every window of every request runs on that, and so does
    ``more``, which adds ``outputs`` from the events' ``columns``, in order of time and ``order``.
    """
    # A column that several requests sum up travels once.
    values: dict[int, tuple[str, Column]] = {}
    field_of = lambda c: values.setdefault(id(c), (f"_v{len(values)}", c))[0]
    sums = [(r.prefix, tuple(r.keys), tuple(r.days), {n: field_of(c) for n, c in r.sums.items()}, {n: field_of(c) for n, c in r.highs.items()}, {n: field_of(c) for n, c in r.lows.items()}) for r in requests]
    keys = list(dict.fromkeys(k for r in requests for k in r.keys))
    names = [x for prefix, _, days, own, highs, lows in sums for x in (*(f"{prefix}{n}_{name_of(d)}" for n in own for d in days), *(f"{prefix}{n}" for n in (*highs, *lows)))]

    def run(c: Careers) -> dict[str, object]:
        out: dict[str, object] = {}
        for prefix, on, days, own, highs, lows in sums:
            o = c.order(*on)
            end = o.before(c.cutoff)
            borders = {d: o.before(c.cutoff - d * DAY) for d in days if d is not None}
            for n, field in own.items():
                upto = o.sums(c.event(field))
                whole = upto(end)
                out |= {f"{prefix}{n}_{name_of(d)}": whole if d is None else whole - upto(borders[d]) for d in days}
            out |= {f"{prefix}{n}": o.highest(c.event(field), end) for n, field in highs.items()}
            out |= {f"{prefix}{n}": -o.highest(-c.event(field), end) for n, field in lows.items()}
        return out | (more(c) if more else {})

    dealt = {n: c.cast("double") for n, c in values.values()} | dict(columns or {})
    shape = StructType([*doubles(names), *(outputs or [])])
    return careers(targets, events, dealt, run, shape, by, keys, cutoff, time, order)


def asof(targets: DataFrame, events: DataFrame, requests: Sequence[Request], by: str = "player_id", id_col: str = "entry_id", cutoff: str = "cutoff", time: str = "start_at") -> DataFrame:
    """For each target with a subject: id and the sums of :func:`asof_rows`."""
    keys = dict.fromkeys(k for r in requests for k in r.keys)
    own = list(dict.fromkeys([id_col, by, cutoff, *keys]))
    found = asof_rows(targets.where(F.col(by).isNotNull()).select(*own), events, requests, by, cutoff, time)
    return found.drop(*(c for c in own if c != id_col))


def asof_sums(targets: DataFrame, events: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], days: Sequence[int | None], id_col: str = "entry_id", cutoff: str = "cutoff", time: str = "start_at", prefix: str = "") -> DataFrame:
    """One request of :func:`asof`; the first key is the subject."""
    return asof(targets, events, [Request(prefix, sums, days, keys[1:])], keys[0], id_col, cutoff, time)


def two_clocks(events: DataFrame, entered: Column, known: Column, time: str = "start_at") -> DataFrame:
    """Every event at the time it ``entered`` history (clock 1) and, where that is ever the case, at the time from which it had both
    entered and been ``known`` (clock 2), for one as-of over both.

    An event counts for a cutoff c if it entered before c and was known by c at the latest: if max(entered, known - 1) is before c.
    Sums of one clock are taken where ``_clock`` is its number; no target is joined with its events.
    """
    clocks = F.array(F.struct(F.lit(1).alias("c"), entered.cast("long").alias("t")), F.when(known.isNotNull(), F.struct(F.lit(2).alias("c"), F.greatest(entered, known - 1).cast("long").alias("t"))))
    each = events.withColumn("_e", F.explode(F.array_compact(clocks)))
    return each.withColumns({"_clock": F.col("_e.c"), time: F.col("_e.t")}).drop("_e")


def asof_map(targets: DataFrame, events: DataFrame, category: str, by: str = "player_id", id_col: str = "entry_id", cutoff: str = "cutoff", time: str = "start_at") -> DataFrame:
    """For each target: id and ``counts``, a map from every category of its subject's events before the cutoff to their number.

    Categories are open-ended: a target asks for those that its subject ever had, few next to all there are, and each of these is a
    running count of its own. A target without an earlier event has no row.
    """
    own = events.where(F.col(by).isNotNull() & F.col(category).isNotNull()).select(by, category).distinct()
    asked = targets.select(by, cutoff, F.col(id_col).alias("_target")).join(own, by).withColumn("_ask", F.struct("_target", category))
    counted = asof(asked, events, [Request("", {"n": F.lit(1)}, keys=[category])], by, "_ask", cutoff, time).where("n_all > 0")
    entries = F.array_sort(F.collect_list(F.struct(F.col(f"_ask.{category}").alias("key"), F.col("n_all").cast("long").alias("value"))))
    return counted.groupBy(F.col("_ask._target").alias(id_col)).agg(F.map_from_entries(entries).alias("counts"))


def blocked_sums(targets: DataFrame, events: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], id_col: str = "entry_id", cutoff: str = "cutoff", time: str = "start_at", prefix: str = "", block_days: int = 30) -> DataFrame:
    """All-time sums before the cutoff for keys with few values and very many events each.

    A key's time is cut into blocks: totals of blocks are summed up over the blocks before (a few hundred rows a key, whatever the
    number of events) and the order inside a block is a task of its own, so no task holds a whole key.
    """
    block = lambda t: F.floor(F.col(t) / (block_days * DAY))
    names = [f"{prefix}{n}" for n in sums]
    values = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"{prefix}{n}") for n, c in sums.items()]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    facts = events.where(known).select(*keys, block(time).alias("_b"), F.lit(None).cast(dict(targets.dtypes)[id_col]).alias("_id"), F.col(time).alias("_t"), *values)
    points = targets.where(known).select(*keys, block(cutoff).alias("_b"), F.col(id_col).alias("_id"), F.col(cutoff).alias("_t"), *(F.lit(0.0).alias(n) for n in names))
    line = facts.unionByName(points)
    inside = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = line.groupBy(*keys, "_b").agg(*(F.sum(n).alias(n) for n in names))
    totals = totals.select(*keys, "_b", *(F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"_{n}") for n in names))
    at = line.select(*keys, "_b", "_id", *(F.coalesce(F.sum(n).over(inside), F.lit(0.0)).alias(n) for n in names)).where("_id IS NOT NULL")
    return at.join(totals, [*keys, "_b"]).select(F.col("_id").alias(id_col), *((F.col(n) + F.col(f"_{n}")).alias(f"{n}_all") for n in names))


def scoped_sums(targets: DataFrame, events: DataFrame, scopes: Mapping[str, Sequence[str]], sums: Mapping[str, Column], cutoff: str = "cutoff", time: str = "start_at", block: int = 10 * DAY) -> DataFrame:
    """``targets`` with all-time sums before the cutoff by several lists of keys with few values and very many events each:
    ``{scope}_{sum}_all``, NULL where one of the scope's keys is.

    Time is cut into blocks, and a block of the keys that all scopes share is what meets in a task: each target and event once, for
    all scopes. What was before a block comes in as one row for each of the keys' values, so that it depends on the length of time
    and the number of these, not on the number of events.
    """
    keys, names = list(dict.fromkeys(k for ks in scopes.values() for k in ks)), list(sums)
    shared = [k for k in keys if all(k in ks for ks in scopes.values())]
    known = lambda ks: reduce(lambda a, k: a & F.col(k).isNotNull(), ks, F.lit(True))
    place = lambda moment: F.floor(F.col(moment) / block).cast("long")
    asked = targets.withColumn("_b", place(cutoff))
    facts = events.where(known(shared)).select(*keys, place(time).alias("_b"), F.col(time).cast("long").alias("_t"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()))
    upto = Window.partitionBy(*keys).orderBy("_b")
    totals = facts.groupBy(*keys, "_b").agg(*(F.sum(n).alias(n) for n in names))
    totals = totals.select(*keys, "_b", F.lead("_b").over(upto).alias("_next"), *(F.sum(n).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names))
    # One row: the last block that a target asks for.
    totals = totals.join(F.broadcast(asked.agg(F.max("_b").alias("_last")))).where("_b < _last")
    before = totals.select(*keys, F.explode(F.sequence(F.col("_b") + 1, F.least(F.coalesce("_next", "_last"), "_last"))).alias("_b"), *names)
    before = before.withColumn("_t", F.col("_b") * block - 1)
    dealt = F.when(known(shared), F.concat_ws("/", *(F.col(k).cast("string") for k in shared), F.col("_b").cast("string")))
    values = {n: F.col(n) for n in names}
    requests = [Request(f"{name}_", values, keys=[k for k in ks if k not in shared]) for name, ks in scopes.items()]
    found = asof_rows(asked.withColumn("_scope", dealt), facts.unionByName(before).withColumn("_scope", dealt), requests, "_scope", cutoff, "_t")
    return found.withColumns({f"{name}_{n}_all": F.when(known(ks), F.col(f"{name}_{n}_all")) for name, ks in scopes.items() for n in names}).drop("_b", "_scope")


def last_events(counted: DataFrame, events: DataFrame, span: Column, last: Column, columns: Sequence[str], by: str = "player_id", id_col: str = "entry_id", exclude: str | None = None, carry: Sequence[str] = (), order: Sequence[str] = ("start_at", "race_id", "entry_id")) -> DataFrame:
    """The ``span`` newest of the ``last`` events before each target's cutoff: id, nth (1 = newest), ``carry`` and ``columns``.

    ``counted`` has the targets with the number of their subject's events before the cutoff. ``exclude``: events that share this
    column's value with the target are left out (a null on either side excludes nothing).
    """
    numbered = events.where(F.col(by).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    numbered = numbered.select(by, "_n", *dict.fromkeys([*columns, *([exclude] if exclude else [])]))
    own = [F.col(exclude).alias("_x")] if exclude else []
    wanted = counted.where(F.col(by).isNotNull() & (last > 0)).select(id_col, by, *carry, *own, F.explode(F.sequence(F.greatest(F.lit(1), last - span + 1), last)).alias("_n"))
    found = wanted.join(numbered, [by, "_n"])
    if exclude:
        found = found.where(F.col("_x").isNull() | F.col(exclude).isNull() | (F.col("_x") != F.col(exclude)))
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("_n")))
    return found.select(id_col, nth.alias("nth"), *carry, *columns)


def recent(targets: DataFrame, events: DataFrame, key: str, n: int, columns: Sequence[str], exclude: str | None = None, id_col: str = "entry_id", cutoff: str = "cutoff", time: str = "start_at") -> DataFrame:
    """The last ``n`` events of each target's key before its cutoff, newest first: id, nth (1 = newest) and ``columns``."""
    one = {"seen": F.lit(1)}
    counts = asof(targets, events, [Request("", one), *([Request("in_", one, keys=[exclude])] if exclude else [])], key, id_col, cutoff, time)
    counted = targets.join(counts, id_col)
    span = F.lit(n) + (F.col("in_seen_all").cast("int") if exclude else F.lit(0))
    return last_events(counted, events, span, F.col("seen_all").cast("int"), columns, key, id_col, exclude).where(F.col("nth") <= n)
