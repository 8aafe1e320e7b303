"""Queries on functions, audits, joins, merges, sinks and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempolane.catalog.signals import career_signals, position_signal
from tempolane.functions import text as T
from tempolane.operators import merging as M
from tempolane.operators import ridge as R
from tempolane.operators import validation as V
from tempolane.operators.asof import Request, asof_rows, two_clocks
from tempolane.plans import features as P
from tempolane.plans.signals import CONTEXT_COLUMNS
from tempolane.registry import ORACLE_SQL, QUERIES, query
from tempolane.sources.domain import CONFIRMED_AT, FETCHED_AT, domain, eligible
from tempolane.storage import materialise, shared_dir, stored


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def targets(spark, sf_dir: str) -> DataFrame:
    return eligible(domain(spark, sf_dir).entries)


# --- functions ----------------------------------------------------------------------------------------------------------

@query("fn_entities", """
WITH x AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 33 + c_custkey % 90 WHEN 1 THEN 128 + c_custkey % 32 WHEN 2 THEN 55296 + c_custkey % 2048 WHEN 3 THEN 128512 + c_custkey % 60 WHEN 4 THEN 1114112 + c_custkey WHEN 5 THEN 64976 + c_custkey % 32 ELSE 19968 + c_custkey % 20000 END AS code,
  ['&hellip;', '&NotEqualTilde;', '&yen;', '&copy', '&amp;lt;', '&none;', '&#;'][1 + c_custkey % 7] AS n, ['…', chr(8770) || chr(824), '¥', '&copy', '&lt;', '&none;', '&#;'][1 + c_custkey % 7] AS want FROM customer),
y AS (SELECT *, c_custkey % 8 NOT IN (1, 2, 4, 5) AS good FROM x)
SELECT c_custkey, 'a' || CASE WHEN good THEN chr(CASE WHEN good THEN code ELSE 33 END::INT) || chr(CASE WHEN good THEN code ELSE 33 END::INT) ELSE '&#' || code || ';&#x00' || lower(to_hex(code)) || ';' END || want || '&' AS decoded FROM y
""", cte=False)
def _(spark, sf_dir):
    """References by number, of which some mean no character, by name, and in wrong form."""
    k = F.col("c_custkey")
    turn = k % 8
    code = F.when(turn == 0, 33 + k % 90).when(turn == 1, 128 + k % 32).when(turn == 2, 55296 + k % 2048).when(turn == 3, 128512 + k % 60).when(turn == 4, 1114112 + k).when(turn == 5, 64976 + k % 32).otherwise(19968 + k % 20000)
    name = F.element_at(F.array(*map(F.lit, ("&hellip;", "&NotEqualTilde;", "&yen;", "&copy", "&amp;lt;", "&none;", "&#;"))), (1 + k % 7).cast("int"))
    raw = F.concat(F.lit("a&#"), code.cast("string"), F.lit(";&#x00"), F.lower(F.hex(code.cast("long"))), F.lit(";"), name, F.lit("&"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.decode_entities(raw).alias("decoded"))


_RAW = """concat('  ', {k}, '&amp;&nbsp;', {n}, chr(9), ' x  y ')"""


@query("fn_text", """
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN ' － ' WHEN c_custkey % 11 = 0 THEN '' ELSE '  ' || c_mktsegment || '&amp;&nbsp;' || c_custkey || chr(9) || ' x  y ' END AS raw, '第' || translate(CAST(c_custkey AS VARCHAR), '0123456789', '０１２３４５６７８９') || '-円' AS num,
  CASE c_custkey % 4 WHEN 0 THEN 'Ｓ級１班' WHEN 1 THEN 'A 3' WHEN 2 THEN 'ＳＳ' ELSE '無' END AS gr, '山田　 ' || c_custkey || ' 太郎' AS nm, CASE c_custkey % 4 WHEN 0 THEN 'Ｌ級ガールズ' WHEN 1 THEN 'Ａ級予選' WHEN 2 THEN 'S級' ELSE '他' END AS rt, CASE c_custkey % 5 WHEN 0 THEN '１着失格' WHEN 1 THEN '落車 再乗' WHEN 2 THEN '未完走' WHEN 3 THEN '欠場' END AS st, CASE c_custkey % 3 WHEN 0 THEN '３連 単' WHEN 1 THEN 'ワイド' ELSE '単勝' END AS bt FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE regexp_replace(trim(replace(split_part(raw, '&amp;', 1) || '& ' || c_custkey || ' x y', chr(9), ' ')), ' +', ' ', 'g') END AS plain,
  CAST(c_custkey AS VARCHAR) AS digits, CASE c_custkey % 4 WHEN 0 THEN 'S1' WHEN 1 THEN 'A3' WHEN 2 THEN 'SS' ELSE '無' END AS grade, '山田' || c_custkey || '太郎' AS name_key, '山田 ' || c_custkey || ' 太郎' AS display_name, CASE c_custkey % 4 WHEN 0 THEN 'GIRLS' WHEN 3 THEN 'UNKNOWN' ELSE 'MEN' END AS category,
  CASE c_custkey % 5 WHEN 0 THEN 'DISQUALIFIED' WHEN 1 THEN 'CRASHED' WHEN 2 THEN 'DID_NOT_FINISH' WHEN 3 THEN 'DID_NOT_START' END AS entry_state, CASE c_custkey % 3 WHEN 0 THEN 'TRIFECTA' WHEN 1 THEN 'QUINELLA_PLACE' END AS bet_type, (c_custkey % 9) || '-' || (c_custkey % 7) AS combination FROM r
""", cte=False)
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    case = lambda m, values: F.get(F.array(*(F.lit(v) for v in values)), F.pmod(F.col("c_custkey"), F.lit(m)).cast("int"))
    raw = F.when(F.col("c_custkey") % 7 == 0, " － ").when(F.col("c_custkey") % 11 == 0, "").otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit("&amp;&nbsp;"), k, F.lit("\t x  y ")))
    wide = F.concat(F.lit("第"), F.translate(k, "0123456789", "０１２３４５６７８９"), F.lit("-円"))
    bet = F.concat((F.col("c_custkey") % 9).cast("string"), F.lit(" － "), (F.col("c_custkey") % 7).cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", T.normalise(raw).alias("plain"), T.digits(wide).alias("digits"), T.grade(case(4, ["Ｓ級１班", "A 3", "ＳＳ", "無"])).alias("grade"), T.name_key(F.concat(F.lit("山田　 "), k, F.lit(" 太郎"))).alias("name_key"),
        T.display_name(F.concat(F.lit("山田　 "), k, F.lit(" 太郎"))).alias("display_name"), T.category(case(4, ["Ｌ級ガールズ", "Ａ級予選", "S級", "他"])).alias("category"), T.entry_state(case(5, ["１着失格", "落車 再乗", "未完走", "欠場", ""])).alias("entry_state"),
        T.bet_type(case(3, ["３連 単", "ワイド", "単勝"])).alias("bet_type"), T.combination(bet).alias("combination"),
    )


@query("fn_numbers", """
WITH r AS (SELECT o_orderkey, o_totalprice AS x, (o_totalprice - 150000) / 20000 AS z, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '-' || o_orderkey WHEN 2 THEN o_orderkey || '.5' ELSE 'x' || o_orderkey END AS t FROM orders)
SELECT o_orderkey, CAST(CAST(floor(x * 50 + 0.5) / 100 AS DECIMAL(18, 2)) AS VARCHAR) AS fixed, CASE o_orderkey % 4 WHEN 0 THEN nullif(CAST(o_orderkey AS DOUBLE), 0) WHEN 2 THEN o_orderkey + 0.5 END AS positive, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey END AS whole,
  round(1 / (1 + exp(-z)), 9) AS sigmoid, round(CASE WHEN z > 0 THEN z + ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END, 9) AS softplus FROM r
""", cte=False)
def _(spark, sf_dir):
    k, z = F.col("o_orderkey"), (F.col("o_totalprice") - 150000) / 20000
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("-"), k.cast("string"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    half = F.floor(F.col("o_totalprice") * 50 + 0.5) / 100
    return table(spark, sf_dir, "orders").select("o_orderkey", T.fixed2(half).alias("fixed"), T.positive_number(text).alias("positive"), T.whole_number(text).alias("whole"), P.r9(R.sigmoid(z)).alias("sigmoid"), P.r9(R.softplus(z)).alias("softplus"))


@query("fn_times", """
, r AS (SELECT race_id, track_id, race_date, day_number, start_at, CAST(floor(((start_at + 32400) % 86400) / 60) AS INT) AS m FROM race)
SELECT race_id, m AS minute, m // 60 AS hour, m % 60 AS minute_in_hour, round(sin(2 * pi() * m / 1440.0), 9) AS time_sin, round(cos(2 * pi() * m / 1440.0), 9) AS time_cos, track_id || ':' || strftime(race_date, '%Y%m%d') || ':' || lpad(CAST(day_number AS VARCHAR), 2, '0') AS code,
  CAST(epoch(CAST(race_date AS TIMESTAMP)) AS BIGINT) + m * 60 - 32400 AS moment FROM r
""")
def _(spark, sf_dir):
    minute = T.minute_of_day(F.col("start_at"))
    sin, cos = T.on_circle(F.col("minute"))
    clock = F.format_string("%02d:%02d", (F.col("minute") / 60).cast("int"), F.col("minute") % 60)
    r = domain(spark, sf_dir).races.withColumn("minute", minute)
    return r.select("race_id", "minute", (F.col("minute") / 60).cast("int").alias("hour"), (F.col("minute") % 60).alias("minute_in_hour"), P.r9(sin).alias("time_sin"), P.r9(cos).alias("time_cos"), T.race_code(F.col("track_id"), F.col("race_date"), F.col("day_number")).alias("code"), T.local_moment(F.col("race_date"), clock).alias("moment"))


@query("fn_json_and_arrays", """
WITH p AS (SELECT user_id, event_type, CAST(json_extract_string('{"A": {"B": ' || props || '}}', '$.A.B.k') AS BIGINT) AS k FROM events),
g AS (SELECT user_id, sum(k) AS total, list_sort(list_distinct(list(event_type))) AS kinds, list_sort(list_distinct(list(k % 10))) AS tens FROM p GROUP BY user_id)
SELECT user_id, CAST(total AS BIGINT) AS total, array_to_string(kinds, ',') AS kinds, array_to_string(list_filter(kinds, lambda x: x NOT IN ('view', 'click')), ',') AS others, list_has_any(tens, [1, 2]) AS overlaps, array_to_string(tens[1:3], ',') AS first_three, coalesce(list_position(tens, 7), 0) AS place_of_seven FROM g
""", cte=False)
def _(spark, sf_dir):
    nested = F.concat(F.lit('{"A": {"B": '), "props", F.lit("}}"))
    p = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object(nested, "$.A.B.k").cast("long").alias("k"))
    g = p.groupBy("user_id").agg(F.sum("k").alias("total"), F.array_sort(F.collect_set("event_type")).alias("kinds"), F.array_sort(F.collect_set(F.col("k") % 10)).alias("tens"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return g.select("user_id", "total", text(F.col("kinds")).alias("kinds"), text(F.array_except("kinds", F.array(F.lit("view"), F.lit("click")))).alias("others"), F.arrays_overlap("tens", F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("overlaps"), text(F.slice("tens", 1, 3)).alias("first_three"), F.array_position("tens", F.lit(7).cast("long")).alias("place_of_seven"))


# --- scans --------------------------------------------------------------------------------------------------------------


@query("scan_selection", """
SELECT count(DISTINCT race_id) AS races, count(*) AS entries, min(race_date) AS first_day, max(cutoff) AS last_cutoff, 788918400 < min(start_at) AS history_before FROM target WHERE race_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
""")
def _(spark, sf_dir):
    from tempolane.sources.domain import HISTORY_FROM, selected

    e = selected(domain(spark, sf_dir).entries, first="1997-01-01", last="1999-12-31")
    return e.agg(F.countDistinct("race_id").alias("races"), F.count(F.lit(1)).alias("entries"), F.min("race_date").alias("first_day"), F.max("cutoff").alias("last_cutoff"), (F.lit(HISTORY_FROM) < F.min("start_at")).alias("history_before"))


@query("scan_run_targets", """
, f AS (SELECT entry_id, race_id, 'SUCCEEDED' AS run_status FROM target WHERE race_id % 3 <> 0 UNION ALL SELECT entry_id, race_id, 'FAILED' FROM target WHERE race_id % 3 = 0)
SELECT f.entry_id, race.race_date, race.meeting_id, race.day_number, race.duration FROM f JOIN race USING (race_id) WHERE run_status = 'SUCCEEDED'
""")
def _(spark, sf_dir):
    d = domain(spark, sf_dir)
    features = targets(spark, sf_dir).select("entry_id", "race_id", F.when(F.col("race_id") % 3 == 0, "FAILED").otherwise("SUCCEEDED").alias("run_status"))
    days = d.races.select("meeting_id", "race_date", "day_number").distinct()
    meetings = d.races.select("meeting_id", "duration").distinct()
    races = d.races.select("race_id", "race_date", "meeting_id").join(days, ["meeting_id", "race_date"], "left").join(meetings, "meeting_id", "left")
    return features.where("run_status = 'SUCCEEDED'").join(races, "race_id").select("entry_id", "race_date", "meeting_id", "day_number", "duration")


@query("scan_labels", """
SELECT race_id, bike, rank, result_status FROM target WHERE race_status IN ('CONFIRMED', 'CORRECTED')
""")
def _(spark, sf_dir):
    return targets(spark, sf_dir).where(F.col("race_status").isin("CONFIRMED", "CORRECTED")).select("race_id", "bike", "rank", "result_status")


# --- audits -------------------------------------------------------------------------------------------------------------


@query("audit_status_decision", """
, r AS (SELECT race_id, race_id % 23 = 0 AS rc, race_id % 29 = 0 AS sc, CASE race_id % 7 WHEN 0 THEN '結果 訂正 審議' WHEN 1 THEN '審議中' WHEN 2 THEN '暫定' WHEN 3 THEN '確定' ELSE '' END AS w, race_id % 2 = 0 AS en, race_id % 5 <> 0 AS sh FROM race)
SELECT race_id, CASE WHEN rc OR sc THEN 'CANCELLED' WHEN w LIKE '%訂正%' THEN 'CORRECTED' WHEN w LIKE '%審議%' THEN 'UNDER_REVIEW' WHEN w LIKE '%暫定%' THEN 'PROVISIONAL' WHEN w LIKE '%確定%' THEN 'CONFIRMED' WHEN en AND sh THEN 'CONFIRMED' WHEN NOT en AND NOT sh THEN 'UNAVAILABLE' END AS status,
  CASE WHEN rc THEN 'race cancelled' WHEN sc THEN 'section cancelled' WHEN w LIKE '%訂正%' THEN 'marker 訂正' WHEN w LIKE '%審議%' THEN 'marker 審議' WHEN w LIKE '%暫定%' THEN 'marker 暫定' WHEN w LIKE '%確定%' THEN 'marker 確定' WHEN en AND sh THEN 'race ended, result and refund received and shown' WHEN NOT en AND NOT sh THEN 'race not ended, nothing received' ELSE 'no evidence' END AS evidence FROM r
""")
def _(spark, sf_dir):
    k = F.col("race_id")
    words = F.when(k % 7 == 0, "結果 訂正 審議").when(k % 7 == 1, "審議中").when(k % 7 == 2, "暫定").when(k % 7 == 3, "確定").otherwise("")
    ended, shown = k % 2 == 0, k % 5 != 0
    status, evidence = V.decide_status(k % 23 == 0, k % 29 == 0, words, ended, ended, ended, shown, shown, F.lit(0))
    return domain(spark, sf_dir).races.select("race_id", status.alias("status"), evidence.alias("evidence"))


_STATES = "['UNAVAILABLE', 'UNDER_REVIEW', 'PROVISIONAL', 'CONFIRMED', 'CORRECTED', 'CANCELLED']"


@query("audit_transitions", f"""
, r AS (SELECT race_id, {_STATES}[1 + race_id % 6] AS old, {_STATES}[1 + (race_id // 6) % 6] AS new, ['AVAILABLE', 'UNDER_REVIEW', 'CANCELLED', 'UNAVAILABLE'][1 + race_id % 4] AS page FROM race)
SELECT race_id, old, new, old = new OR (old <> 'CANCELLED' AND NOT (new = 'CANCELLED' AND old IN ('CONFIRMED', 'CORRECTED')) AND list_position({_STATES}, new) >= list_position({_STATES}, old)) AS legal,
  CASE page WHEN 'AVAILABLE' THEN new IN ('PROVISIONAL', 'CONFIRMED', 'CORRECTED') WHEN 'UNDER_REVIEW' THEN new = 'UNDER_REVIEW' WHEN 'CANCELLED' THEN new = 'CANCELLED' ELSE new = 'UNAVAILABLE' END AS admitted FROM r
""")
def _(spark, sf_dir):
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    k = F.col("race_id")
    r = domain(spark, sf_dir).races.select("race_id", pick(M.STATUS_ORDER, k % 6).alias("old"), pick(M.STATUS_ORDER, F.floor(k / 6) % 6).alias("new"), pick(list(V.ADMITS), k % 4).alias("page"))
    return r.select("race_id", "old", "new", M.can_follow(F.col("old"), F.col("new")).alias("legal"), V.admits(F.col("page"), F.col("new")).alias("admitted"))


@query("audit_completeness", """
, en AS (SELECT race_id, count(*) AS n FROM target WHERE race_id % 37 <> 0 GROUP BY race_id), re AS (SELECT race_id, count(*) AS n, max(bike) AS hi FROM target WHERE NOT (race_id % 31 = 0 AND bike = 1) AND race_id % 41 <> 0 GROUP BY race_id), ra AS (SELECT DISTINCT race_id, entrants FROM target)
SELECT race_id, coalesce(en.n, entrants) AS expected, coalesce(re.n, 0) AS found, CASE WHEN en.n <> entrants THEN 'ENTRANT_COUNT_MISMATCH' WHEN coalesce(en.n, entrants) NOT BETWEEN 5 AND 9 THEN 'ENTRANT_COUNT_UNSUPPORTED' WHEN re.n IS NULL THEN 'NO_RESULTS' WHEN re.n <> coalesce(en.n, entrants) THEN 'RESULT_COUNT_MISMATCH' ELSE 'COMPLETE' END AS verdict
FROM ra LEFT JOIN en USING (race_id) LEFT JOIN re USING (race_id)
""")
def _(spark, sf_dir):
    e = targets(spark, sf_dir)
    return V.completeness(e.select("race_id", "entrants").distinct(), e.where("race_id % 37 <> 0"), e.where("NOT (race_id % 31 = 0 AND bike = 1) AND race_id % 41 <> 0"))


@query("audit_duplicate_keys", """
, k AS (SELECT 'entry' AS key, count(*) AS n FROM target GROUP BY entry_id UNION ALL SELECT 'bike', count(*) FROM target GROUP BY race_id, bike UNION ALL SELECT 'player', count(*) FROM target WHERE player_id IS NOT NULL GROUP BY race_id, player_id)
SELECT key, count(*) FILTER (n > 1) AS values, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows FROM k GROUP BY key
""")
def _(spark, sf_dir):
    e = targets(spark, sf_dir)
    return V.duplicates(e, {"entry": ["entry_id"], "bike": ["race_id", "bike"]}).unionByName(V.duplicates(e.where("player_id IS NOT NULL"), {"player": ["race_id", "player_id"]}))


@query("audit_constraints", """
SELECT unnest(['bike_range', 'rank_positive', 'status_known', 'rank_needs_finish', 'close_before_start', 'score_range']) AS check, count(*) AS rows, unnest([count(*) FILTER (NOT bike BETWEEN 1 AND 9), count(*) FILTER (NOT rank > 0), count(*) FILTER (NOT result_status IN ('FINISHED', 'TIED', 'DISQUALIFIED')), count(*) FILTER (NOT ((rank IS NULL) = (result_status NOT IN ('FINISHED', 'TIED')))), count(*) FILTER (NOT close_at < start_at), count(*) FILTER (NOT score BETWEEN 1 AND 99)]) AS violations FROM target
""")
def _(spark, sf_dir):
    c = F.col
    checks = {"bike_range": c("bike").between(1, 9), "rank_positive": c("rank") > 0, "status_known": c("result_status").isin("FINISHED", "TIED", "DISQUALIFIED"), "rank_needs_finish": c("rank").isNull() == ~c("result_status").isin("FINISHED", "TIED"), "close_before_start": c("close_at") < c("start_at"), "score_range": c("score").between(1, 99)}
    return V.constraints(targets(spark, sf_dir), checks)


@query("audit_two_sources", """
, n AS (SELECT track_id, race_date, race_id, row_number() OVER (PARTITION BY track_id, race_date ORDER BY race_id) + CASE WHEN race_id % 43 = 0 THEN 1 ELSE 0 END AS no FROM race), e AS (SELECT track_id, race_date, count(DISTINCT race_id) AS n FROM entry WHERE race_id % 47 <> 0 GROUP BY ALL),
m AS (SELECT track_id, race_date, count(*) AS n, min(no) = 1 AND max(no) = count(*) AND count(DISTINCT no) = count(*) AS contiguous FROM n GROUP BY ALL)
SELECT m.track_id, m.race_date, m.n AS metadata_races, coalesce(e.n, 0) AS entry_races, contiguous, m.n = coalesce(e.n, 0) AS equal FROM m LEFT JOIN e USING (track_id, race_date)
""")
def _(spark, sf_dir):
    d = domain(spark, sf_dir)
    key = ["track_id", "race_date"]
    no = F.row_number().over(Window.partitionBy(*key).orderBy("race_id")) + F.when(F.col("race_id") % 43 == 0, 1).otherwise(0)
    meta = V.contiguous(d.races.withColumn("no", no), key, "no")
    entry = d.entries.where("race_id % 47 <> 0").groupBy(*key).agg(F.countDistinct("race_id").alias("e"))
    return meta.join(entry, key, "left").select(*key, F.col("n").alias("metadata_races"), F.coalesce("e", F.lit(0)).alias("entry_races"), "contiguous", (F.col("n") == F.coalesce("e", F.lit(0))).alias("equal"))


@query("audit_pagination", """
WITH p AS (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS requested, count(*) OVER (PARTITION BY s_nationkey) - CASE WHEN s_nationkey % 5 = 0 THEN 1 ELSE 0 END AS last, s_suppkey FROM supplier),
q AS (SELECT *, requested + CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END AS parsed, sha256(CAST(s_suppkey // 40 AS VARCHAR)) AS h, s_suppkey // 60 AS players FROM p)
SELECT s_nationkey, requested, CASE WHEN requested <> parsed THEN 'PAGE_MISMATCH' WHEN last < 1 OR last < parsed THEN 'BEYOND_LAST_PAGE' WHEN last > 5 THEN 'TOO_MANY_PAGES' WHEN h = lag(h) OVER w THEN 'REPEATED_PAGE' WHEN players = lag(players) OVER w THEN 'REPEATED_PLAYERS' ELSE 'OK' END AS problem FROM q WINDOW w AS (PARTITION BY s_nationkey ORDER BY requested)
""", cte=False)
def _(spark, sf_dir):
    w = Window.partitionBy("s_nationkey")
    s = table(spark, sf_dir, "supplier").withColumn("requested", F.row_number().over(w.orderBy("s_suppkey")))
    s = s.withColumn("last", F.count(F.lit(1)).over(w) - F.when(F.col("s_nationkey") % 5 == 0, 1).otherwise(0)).withColumn("parsed", F.col("requested") + F.when(F.col("s_suppkey") % 13 == 0, 1).otherwise(0))
    return V.pagination(s.withColumns({"sha256": F.sha2(F.expr("s_suppkey div 40").cast("string"), 256), "players": F.sha2(F.expr("s_suppkey div 60").cast("string"), 256)}), ["s_nationkey"], 5)


@query("audit_context_match", """
, doc AS (SELECT race_id, track_id + CASE WHEN race_id % 53 = 0 THEN 1 ELSE 0 END AS track_id, race_date + CASE WHEN race_id % 59 = 0 THEN 1 ELSE 0 END AS race_date, day_number FROM race)
SELECT race_id, concat_ws(',', CASE WHEN doc.track_id <> race.track_id THEN 'track_id' END, CASE WHEN doc.race_date <> race.race_date THEN 'race_date' END) AS differs FROM race JOIN doc USING (race_id)
""")
def _(spark, sf_dir):
    r = domain(spark, sf_dir).races.select("race_id", "track_id", "race_date", "day_number")
    doc = r.withColumns({"track_id": F.col("track_id") + F.when(F.col("race_id") % 53 == 0, 1).otherwise(0), "race_date": F.expr("date_add(race_date, CASE WHEN race_id % 59 = 0 THEN 1 ELSE 0 END)")})
    return V.against_manifest(doc, r, ["race_id"], ["track_id", "race_date", "day_number"]).select("race_id", "differs")


@query("audit_cutoffs", """
, c AS (SELECT race_id, CASE WHEN entry_id % 997 = 0 THEN NULL WHEN entry_id % 991 = 0 THEN cutoff - 60 ELSE cutoff END AS cutoff FROM target)
SELECT race_id, count(DISTINCT cutoff) AS cutoffs, count(*) FILTER (cutoff IS NULL) AS missing FROM c GROUP BY race_id HAVING count(DISTINCT cutoff) <> 1 OR count(*) FILTER (cutoff IS NULL) > 0
""")
def _(spark, sf_dir):
    cutoff = F.when(F.col("entry_id") % 997 == 0, None).when(F.col("entry_id") % 991 == 0, F.col("cutoff") - 60).otherwise(F.col("cutoff"))
    return V.cutoffs(targets(spark, sf_dir).withColumn("cutoff", cutoff))


@query("audit_manifest", """
, a AS (SELECT year(race_date) AS year, count(DISTINCT race_id) AS races, count(*) AS entries, count(DISTINCT result_status) AS states FROM target GROUP BY ALL), e AS (SELECT year + CASE WHEN year = 2001 THEN 1 ELSE 0 END AS year, races, entries + CASE WHEN year = 1997 THEN 1 ELSE 0 END AS entries, states FROM a)
SELECT year, a.races AS a_races, a.entries AS a_entries, a.states AS a_states, e.races AS e_races, e.entries AS e_entries, e.states AS e_states, concat_ws(',', CASE WHEN a.races IS DISTINCT FROM e.races THEN 'races' END, CASE WHEN a.entries IS DISTINCT FROM e.entries THEN 'entries' END, CASE WHEN a.states IS DISTINCT FROM e.states THEN 'states' END) AS differs FROM a FULL JOIN e USING (year)
""")
def _(spark, sf_dir):
    a = targets(spark, sf_dir).groupBy(F.year("race_date").alias("year")).agg(F.countDistinct("race_id").alias("races"), F.count(F.lit(1)).alias("entries"), F.countDistinct("result_status").alias("states"))
    e = a.withColumns({"entries": F.col("entries") + F.when(F.col("year") == 1997, 1).otherwise(0), "year": F.col("year") + F.when(F.col("year") == 2001, 1).otherwise(0)})
    return V.against_manifest(a, e, ["year"], ["races", "entries", "states"])


@query("audit_replay_bins", """
, e AS (SELECT DISTINCT year(race_date) AS scope, CASE WHEN rank = 1 THEN 'IS_WIN' ELSE 'OTHER' END AS label, bike AS bin FROM target), b AS (SELECT scope, unnest(range(1, 8)) AS bin FROM (SELECT DISTINCT scope FROM e)), w AS (SELECT * FROM b, (SELECT DISTINCT label FROM e))
SELECT scope, label, count(*) FILTER (h.bin IS NULL) AS missing, count(*) FILTER (w.bin IS NULL) AS unknown, count(h.bin) AS bins FROM (SELECT scope, label, bin FROM w UNION SELECT scope, label, bin FROM e) u LEFT JOIN (SELECT scope, label, bin FROM e) h USING (scope, label, bin) LEFT JOIN w USING (scope, label, bin) GROUP BY ALL
""")
def _(spark, sf_dir):
    e = targets(spark, sf_dir).select(F.year("race_date").alias("scope"), F.when(F.col("rank") == 1, "IS_WIN").otherwise("OTHER").alias("label"), F.col("bike").alias("bin")).distinct()
    bins = e.select("scope").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return V.bins_complete(e, bins)


@query("audit_stage_aggregate", """
, s AS (SELECT t.entry_id, count(*) FILTER (race_type LIKE '%準決%') AS sn, sum(res_u) FILTER (race_type LIKE '%準決%') AS su, count(*) FILTER (race_type LIKE '%決勝%' AND race_type NOT LIKE '%準決%') AS fn, sum(res_u) FILTER (race_type LIKE '%決勝%' AND race_type NOT LIKE '%準決%') AS fu
  FROM (SELECT entry_id, player_id, cutoff FROM target) t JOIN hist h ON h.player_id = t.player_id AND h.start_at < t.cutoff AND started AND normal AND res_u IS NOT NULL GROUP BY t.entry_id),
m AS (SELECT t.entry_id, coalesce(sn, 0) AS sn, su / CAST(sn AS DOUBLE) / 840 AS sm, coalesce(fn, 0) AS fn, fu / CAST(fn AS DOUBLE) / 840 AS fm, sn + fn AS n, (coalesce(su, 0) + coalesce(fu, 0)) / CAST(nullif(sn + fn, 0) AS DOUBLE) / 840 AS lm FROM target t LEFT JOIN s USING (entry_id))
SELECT entry_id, sn AS semifinal_sample, fn AS final_sample, round(lm, 9) AS late_mean, CASE WHEN entry_id % 19 = 0 AND sn > 0 THEN 'INVALID_SECTION' WHEN coalesce(n, 0) = 0 THEN CASE WHEN entry_id % 17 = 0 THEN 'MISMATCH' ELSE 'NO_VALUE' END WHEN entry_id % 13 = 0 OR entry_id % 23 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS integrity FROM m
""")
def _(spark, sf_dir):
    """The stored mean of semifinals and finals against its two sections; some means are off by a billionth, missing, or too many."""
    rows = P.stage_sections(domain(spark, sf_dir))
    hit = lambda k: F.col("entry_id") % k == 0
    mean = F.when(hit(13), F.col("late_mean") + 1e-9).when(hit(23), None).otherwise(F.col("late_mean"))
    kept = F.when(F.col("late_n") > 0, mean).when(hit(17), 0.0)
    semifinal = F.when(~hit(19), F.col("sf_mean"))
    state = V.aggregate_integrity(kept, [(F.col("sf_n"), semifinal), (F.col("fi_n"), F.col("fi_mean"))])
    return rows.select("entry_id", F.col("sf_n").alias("semifinal_sample"), F.col("fi_n").alias("final_sample"), P.r9(F.col("late_mean")).alias("late_mean"), state.alias("integrity"))


@query("audit_signal_eligibility", f"""
WITH f AS ({ORACLE_SQL["stat10_recent_form"]}), e AS ({ORACLE_SQL["bt_labels"].replace("SELECT entry_id,", "SELECT entry_id, race_id, year(race_date) AS year,")}),
x AS (SELECT e.race_id, year, status = 'VALID' AND quality = 'FULL' AS strict, status = 'VALID' AND quality <> 'PARTIAL' AND reasons IN ('', 'IN_MEETING_RESULT_CONFIRMATION_NOT_RECONSTRUCTED') AS operational FROM f JOIN e USING (entry_id)),
r AS (SELECT race_id, year, count(*) AS n, count(*) FILTER (strict) AS s, count(*) FILTER (operational) AS o FROM x GROUP BY ALL)
SELECT year, CAST(sum(s) AS BIGINT) AS strict, CAST(sum(o) AS BIGINT) AS operational, count(*) FILTER (o = n) AS complete_races, count(*) AS races FROM r GROUP BY year
""", cte=False)
def _(spark, sf_dir):
    e = targets(spark, sf_dir).select("entry_id", "race_id", F.year("race_date").alias("year"))
    f = QUERIES["stat10_recent_form"](spark, sf_dir)
    own = f.join(e, "entry_id").withColumns(V.signal_eligible("STAT-10", F.col("status"), F.col("quality"), F.col("reasons")))
    own = stored(spark, sf_dir, "signal-eligibility", lambda: own.select("entry_id", "race_id", "year", "strict", "operational"))
    complete = V.complete_races(own.where("operational"), e).join(e.select("race_id", "year").distinct(), "race_id")
    sums = own.groupBy("year").agg(F.count_if("strict").alias("strict"), F.count_if("operational").alias("operational"))
    return sums.join(complete.groupBy("year").agg(F.count_if("complete").alias("complete_races"), F.count(F.lit(1)).alias("races")), "year")


# --- joins --------------------------------------------------------------------------------------------------------------


@query("join_results_outer", """
, res AS (SELECT entry_id, rank FROM target WHERE race_status <> 'UNAVAILABLE')
SELECT year(race_date) AS year, count(*) AS entries, count(res.entry_id) AS with_result, count(*) FILTER (res.entry_id IS NULL) AS without_result FROM target LEFT JOIN res USING (entry_id) GROUP BY ALL
""")
def _(spark, sf_dir):
    e = targets(spark, sf_dir)
    results = e.where("race_status <> 'UNAVAILABLE'").select("entry_id", F.lit(1).alias("has"))
    out = e.join(results, "entry_id", "left")
    return out.groupBy(F.year("race_date").alias("year")).agg(F.count(F.lit(1)).alias("entries"), F.count("has").alias("with_result"), F.count_if(F.col("has").isNull()).alias("without_result"))


@query("join_semi_and_anti", """
, c AS (SELECT DISTINCT player_id FROM target WHERE year(race_date) = 2000 AND player_id IS NOT NULL AND player_id % 4 = 0), m AS (SELECT race_id FROM target JOIN c USING (player_id) GROUP BY race_id HAVING count(DISTINCT player_id) >= 2)
SELECT year(race_date) AS year, count(DISTINCT race_id) FILTER (race_id IN (SELECT race_id FROM m)) AS races_with_pairs, count(*) FILTER (NOT EXISTS (SELECT 1 FROM target r WHERE r.entry_id = t.entry_id AND r.rank IS NOT NULL)) AS without_rank,
  count(DISTINCT race_date) FILTER (EXISTS (SELECT 1 FROM race r WHERE r.race_date = t.race_date AND r.race_status = 'CORRECTED')) AS days_with_correction FROM target t GROUP BY ALL
""")
def _(spark, sf_dir):
    e, races = targets(spark, sf_dir).withColumn("year", F.year("race_date")), domain(spark, sf_dir).races
    chosen = e.where("year = 2000 AND player_id % 4 = 0").select("player_id").distinct()
    pairs = e.join(chosen, "player_id", "left_semi").groupBy("race_id").agg(F.countDistinct("player_id").alias("k")).where("k >= 2")
    one = e.join(pairs, "race_id", "left_semi").groupBy("year").agg(F.countDistinct("race_id").alias("races_with_pairs"))
    two = e.join(e.where("rank IS NOT NULL").select("entry_id"), "entry_id", "left_anti").groupBy("year").agg(F.count(F.lit(1)).alias("without_rank"))
    three = e.join(races.where("race_status = 'CORRECTED'").select("race_date"), "race_date", "left_semi").groupBy("year").agg(F.countDistinct("race_date").alias("days_with_correction"))
    out = e.select("year").distinct().join(one, "year", "left").join(two, "year", "left").join(three, "year", "left")
    return out.fillna(0)


@query("join_compare_versions", """
, o AS (SELECT entry_id, score FROM target WHERE entry_id % 10 <> 0), n AS (SELECT entry_id, CASE WHEN entry_id % 7 = 0 THEN score + 1 ELSE score END AS score FROM target WHERE entry_id % 11 <> 0)
SELECT entry_id, CASE WHEN o.entry_id IS NULL THEN 'ADDED' WHEN n.entry_id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change, round(-(o.score - n.score), 9) AS difference FROM o FULL JOIN n USING (entry_id) WHERE o.entry_id IS NULL OR n.entry_id IS NULL OR o.score IS DISTINCT FROM n.score
""")
def _(spark, sf_dir):
    e = targets(spark, sf_dir)
    old = e.where("entry_id % 10 <> 0").select("entry_id", F.col("score").alias("old"), F.lit(1).alias("o"))
    new = e.where("entry_id % 11 <> 0").select("entry_id", F.when(F.col("entry_id") % 7 == 0, F.col("score") + 1).otherwise(F.col("score")).alias("new"), F.lit(1).alias("n"))
    both = old.join(new, "entry_id", "full_outer").where("o IS NULL OR n IS NULL OR NOT old <=> new")
    change = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "REMOVED").otherwise("CHANGED")
    return both.select("entry_id", change.alias("change"), P.r9(F.col("new") - F.col("old")).alias("difference"))


@query("join_link_players", """
WITH p AS (SELECT s_suppkey AS player_id, CAST(100000 + s_suppkey AS VARCHAR) AS external_id, s_name AS name FROM supplier), e AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(100000 + l_suppkey AS VARCHAR) AS external_id, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN replace(s_name, '#', ' #') ELSE 'other' END AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_tax > 0.07)
SELECT p.player_id, count(*) FILTER (e.name IS NULL OR replace(e.name, ' ', '') = p.name) AS linked, count(*) FILTER (e.name IS NOT NULL AND replace(e.name, ' ', '') <> p.name) AS conflicts FROM e JOIN p USING (external_id) GROUP BY p.player_id
""", cte=False)
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    players = s.select(F.col("s_suppkey").alias("player_id"), (F.col("s_suppkey") + 100000).cast("string").alias("external_id"), F.col("s_name").alias("name"))
    name = F.when(F.col("l_linenumber") % 3 == 1, F.replace("s_name", F.lit("#"), F.lit(" #"))).when(F.col("l_linenumber") % 3 == 2, "other")
    entries = table(spark, sf_dir, "lineitem").where("l_tax > 0.07").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select((F.col("l_suppkey") + 100000).cast("string").alias("external_id"), name.alias("name"), F.lit(None).cast("long").alias("player_id"))
    linked, conflicts = M.link_players(entries, players, T.name_key)
    both = linked.select("player_id", F.lit(1).alias("l"), F.lit(0).alias("c")).unionByName(conflicts.select("player_id", F.lit(0).alias("l"), F.lit(1).alias("c")))
    return both.groupBy("player_id").agg(F.sum("l").alias("linked"), F.sum("c").alias("conflicts"))


# --- merges -------------------------------------------------------------------------------------------------------------


@query("merge_status_fold", f"""
WITH RECURSIVE u AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey AS tm, {_STATES}[1 + o_orderkey % 6] AS s FROM orders),
f(k, i, status, applied, rejected, confirmed_at) AS (SELECT DISTINCT k, CAST(0 AS BIGINT), 'UNAVAILABLE', 0, 0, CAST(NULL AS BIGINT) FROM u
 UNION ALL SELECT f.k, u.i, CASE WHEN ok THEN s ELSE status END, applied + CASE WHEN ok THEN 1 ELSE 0 END, rejected + CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN (CASE WHEN ok THEN s ELSE status END) IN ('CONFIRMED', 'CORRECTED') THEN coalesce(confirmed_at, tm) END
 FROM f JOIN (SELECT * FROM u) u ON u.k = f.k AND u.i = f.i + 1, LATERAL (SELECT status = s OR (status <> 'CANCELLED' AND NOT (s = 'CANCELLED' AND status IN ('CONFIRMED', 'CORRECTED')) AND list_position({_STATES}, s) >= list_position({_STATES}, status)) AS ok) o)
SELECT k AS o_custkey, arg_max(status, i) AS status, CAST(max(applied) AS BIGINT) AS applied, CAST(max(rejected) AS BIGINT) AS rejected, (max_by(struct_pack(c := confirmed_at), i)).c AS confirmed_at FROM f GROUP BY k
""", cte=False)
def _(spark, sf_dir):
    pick = F.get(F.array(*map(F.lit, M.STATUS_ORDER)), (F.col("o_orderkey") % 6).cast("int"))
    return M.fold_status(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", pick.alias("status")), "o_custkey", "o_orderkey", "status").drop("clear_children", "confirmation")


@query("merge_status_batches", f"""
WITH RECURSIVE u AS (SELECT o_custkey AS k, o_orderkey % 2 AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS i, o_orderkey AS tm, {_STATES}[1 + (o_orderkey // 2 + o_custkey) % 6] AS s FROM orders),
f(k, i, b, status, confirmed_at) AS (SELECT DISTINCT k, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'UNAVAILABLE', CAST(NULL AS BIGINT) FROM u
 UNION ALL SELECT f.k, u.i, u.b, CASE WHEN ok THEN s ELSE status END, CASE WHEN (CASE WHEN ok THEN s ELSE status END) IN ('CONFIRMED', 'CORRECTED') THEN coalesce(confirmed_at, tm) END
 FROM f JOIN (SELECT * FROM u) u ON u.k = f.k AND u.i = f.i + 1, LATERAL (SELECT status = s OR (status <> 'CANCELLED' AND NOT (s = 'CANCELLED' AND status IN ('CONFIRMED', 'CORRECTED')) AND list_position({_STATES}, s) >= list_position({_STATES}, status)) AS ok) o),
one AS (SELECT k, arg_max(status, i) AS status, (max_by(struct_pack(c := confirmed_at), i)).c AS c FROM f WHERE b = 0 GROUP BY k), two AS (SELECT k, arg_max(status, i) AS status, (max_by(struct_pack(c := confirmed_at), i)).c AS c FROM f GROUP BY k),
kids AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL), late AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 GROUP BY ALL)
SELECT two.k AS o_custkey, two.status, two.c AS confirmed_at, CASE WHEN two.c IS NOT NULL AND one.c IS NULL THEN 'SET' WHEN two.c IS NULL AND one.c IS NOT NULL THEN 'CLEARED' ELSE 'KEPT' END AS confirmation,
  two.status = 'CANCELLED' AND one.status <> 'CANCELLED' AS clear_children, CASE WHEN two.status = 'CANCELLED' AND one.status <> 'CANCELLED' THEN 0 WHEN one.status = 'CANCELLED' THEN coalesce(late.n, 0) ELSE coalesce(kids.n, 0) END AS children
FROM two JOIN one USING (k) LEFT JOIN kids USING (k) LEFT JOIN late USING (k)
""", cte=False)
def _(spark, sf_dir):
    """Two batches of status reports with children: what the second changes, on the states and children that the first left."""
    o = table(spark, sf_dir, "orders")
    pick = F.get(F.array(*map(F.lit, M.STATUS_ORDER)), ((F.expr("o_orderkey div 2") + F.col("o_custkey")) % 6).cast("int"))
    reports, kids = o.select("o_custkey", "o_orderkey", pick.alias("status")), o.where("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey")
    states, children = None, None
    for batch in (0, 1):
        here = F.col("o_orderkey") % 2 == batch
        fold = M.fold_status(reports.where(here), "o_custkey", "o_orderkey", "status", states)
        arrived = kids.where(here) if children is None else children.unionByName(kids.where(here))
        states, children = materialise(fold, "states"), materialise(M.without_cleared(arrived, fold, "o_custkey"), "children")
    held = children.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("children"))
    return states.join(held, "o_custkey", "left").select("o_custkey", "status", "confirmed_at", "confirmation", "clear_children", F.coalesce("children", F.lit(0)).alias("children"))


@query("merge_replace_children", """
WITH n AS (SELECT l_orderkey, l_linenumber + 100 AS l_linenumber FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber <= 2)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT * FROM n
""", cte=False)
def _(spark, sf_dir):
    stored_rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    new = stored_rows.where("l_orderkey % 5 = 0 AND l_linenumber <= 2").withColumn("l_linenumber", F.col("l_linenumber") + 100)
    return M.replace_children(stored_rows, new, "l_orderkey")


@query("merge_reconcile_days", """
, d AS (SELECT DISTINCT meeting_id, race_date FROM race), st AS (SELECT meeting_id, race_date FROM d WHERE day(race_date) % 3 <> 0 UNION SELECT meeting_id, race_date + 40 FROM d WHERE day(race_date) % 4 = 0), us AS (SELECT meeting_id, race_date FROM d WHERE day(race_date) % 2 = 0), wa AS (SELECT meeting_id, race_date FROM d WHERE day(race_date) % 5 = 0),
k AS (SELECT meeting_id, race_date FROM st WHERE (meeting_id, race_date) IN (SELECT meeting_id, race_date FROM us) UNION SELECT * FROM wa)
SELECT meeting_id, race_date, row_number() OVER (PARTITION BY meeting_id ORDER BY race_date) AS day_number, min(race_date) OVER (PARTITION BY meeting_id) AS starts_on, max(race_date) OVER (PARTITION BY meeting_id) AS ends_on FROM k
""")
def _(spark, sf_dir):
    d = domain(spark, sf_dir).races.select("meeting_id", "race_date").distinct()
    day = F.dayofmonth("race_date")
    later = d.where(day % 4 == 0).withColumn("race_date", F.date_add("race_date", 40))
    return M.reconcile_days(d.where(day % 3 != 0).unionByName(later).distinct(), d.where(day % 5 == 0), d.where(day % 2 == 0), "meeting_id", "race_date")


@query("merge_grade_history", """
SELECT o_custkey, o_orderpriority AS grade, CAST(o_orderdate AS DATE) AS assigned_on, max(o_orderkey) AS source FROM orders GROUP BY ALL
""", cte=False)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("grade"), F.col("o_orderdate").cast("date").alias("assigned_on"), F.col("o_orderkey").alias("source"))
    return M.latest(o, ["o_custkey", "grade", "assigned_on"], [F.desc("source")])


@query("merge_candidates", """
WITH x AS (SELECT CAST(CASE WHEN l_suppkey % 9 = 0 THEN l_suppkey ELSE 100000 + l_suppkey END AS VARCHAR) AS external_id, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_tax > 0.05)
SELECT external_id, count(*) AS entries, min(day) AS first_day, max(day) AS last_day FROM x WHERE regexp_full_match(external_id, '[0-9]{6}') AND day BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' GROUP BY external_id ORDER BY entries DESC, external_id LIMIT 20
""", cte=False)
def _(spark, sf_dir):
    own = F.when(F.col("l_suppkey") % 9 == 0, F.col("l_suppkey")).otherwise(F.col("l_suppkey") + 100000).cast("string")
    x = table(spark, sf_dir, "lineitem").where("l_tax > 0.05").select(own.alias("external_id"), F.col("l_shipdate").cast("date").alias("day"))
    x = x.where(F.col("external_id").rlike("^[0-9]{6}$") & F.col("day").between("1997-01-01", "2000-12-31"))
    return x.groupBy("external_id").agg(F.count(F.lit(1)).alias("entries"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).orderBy(F.desc("entries"), "external_id").limit(20)


@query("merge_run_accounting", """
WITH g AS (SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) AS success, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS failure FROM events GROUP BY user_id)
SELECT *, CASE WHEN failure = 0 THEN 'SUCCEEDED' WHEN success + skipped > 0 THEN 'PARTIALLY_FAILED' ELSE 'FAILED' END AS status FROM g
""", cte=False)
def _(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "error", "FAILURE").when(F.col("event_type") == "view", "SKIPPED").otherwise("SUCCESS")
    return M.run_accounting(table(spark, sf_dir, "events").select("user_id", outcome.alias("outcome")), "user_id")


# --- sinks --------------------------------------------------------------------------------------------------------------


@query("sink_resumed_scopes", """
SELECT 'STAT-01' AS stat_code, year(race_date) AS year, count(*) AS rows, CAST(NULL AS DOUBLE) AS raw_points, CASE WHEN year(race_date) IN (1998, 2000) THEN 'KEPT' ELSE 'WRITTEN' END AS write FROM target GROUP BY ALL
""")
def _(spark, sf_dir):
    """Feature results by year: a first run left the even years, of which 1996 was changed since and 1994 and 2002 were never
    committed. A second run keeps what is as it should be and writes the rest."""
    from tempolane.sources import sinks as S

    rows = targets(spark, sf_dir).select(F.lit("STAT-01").alias("stat_code"), F.year("race_date").alias("year"), "entry_id", F.col("score").alias("value"))
    path = f"{shared_dir(spark)}/feature-results-{S.run_id()}"
    S.write_features(rows.where("year % 2 = 0"), path)
    S.commit(S.feature_rows(rows).where("year IN (1996, 1998, 2000)"), path)
    least = F.broadcast(rows.where("year = 1996").agg(F.min("entry_id").alias("least")))  # one row
    changed = rows.where("year = 1996").join(least).withColumn("value", F.when(F.col("entry_id") == F.col("least"), -1.0).otherwise(F.col("value"))).drop("least")
    S.write_features(changed, path)
    return S.resume(rows, path)


# --- features' evidence and signals -------------------------------------------------------------------------------------


@query("evidence", f"""
, h AS (SELECT *, {CONFIRMED_AT} AS c, {FETCHED_AT} AS fetched FROM hist)
SELECT t.entry_id, count(h.entry_id) AS events, count(*) FILTER (h.state = 'NORMAL_FINISH') AS normal, count(*) FILTER (h.state = 'DISQUALIFIED') AS disqualified, count(*) FILTER (h.state = 'FALL_DNF') AS fallen, count(*) FILTER (h.state = 'DID_NOT_START') AS did_not_start, count(*) FILTER (h.result_status = 'TIED') AS tied,
  min(h.start_at) AS first_at, max(h.start_at) AS last_at, max(h.fetched) AS max_fetched_at, count(*) FILTER (h.race_status = 'CONFIRMED') AS confirmation_known, count(*) FILTER (h.race_status = 'CORRECTED') AS corrected,
  count(*) FILTER (h.c <= t.cutoff) AS observed_by_cutoff, count(*) FILTER (h.c > t.cutoff) AS observed_later, count(*) FILTER (h.entry_id IS NOT NULL AND h.c IS NULL) AS observation_unknown FROM target t LEFT JOIN h ON h.player_id = t.player_id AND h.start_at < t.cutoff GROUP BY t.entry_id
""")
def _(spark, sf_dir):
    """What lies before each target's cutoff, and how much of it had been confirmed by then: an as-of on two clocks."""
    d = domain(spark, sf_dir)
    first = F.col("_clock") == 1
    is_ = lambda c, v: (first & (F.col(c) == v)).cast("int")
    sums = {"events": first.cast("int"), "normal": is_("state", "NORMAL_FINISH"), "disqualified": is_("state", "DISQUALIFIED"), "fallen": is_("state", "FALL_DNF"), "did_not_start": is_("state", "DID_NOT_START"), "tied": is_("result_status", "TIED"), "confirmation_known": is_("race_status", "CONFIRMED"), "corrected": is_("race_status", "CORRECTED"), "observation_unknown": (first & F.col("_c").isNull()).cast("int"), "observed_by_cutoff": (~first).cast("int")}
    e = eligible(d.entries)
    events = two_clocks(d.history.withColumns({"_c": F.expr(CONFIRMED_AT), "_fetched": F.expr(FETCHED_AT), "_at": F.col("start_at")}), F.col("start_at"), F.col("_c"))
    highs = {"last_at": F.when(first, F.col("_at")), "max_fetched_at": F.when(first, F.col("_fetched"))}
    out = asof_rows(e.select("entry_id", "player_id", "cutoff"), events, [Request("", sums, highs=highs, lows={"first_at": F.when(first, F.col("_at"))})])
    at = lambda n: F.coalesce(f"{n}_all", F.lit(0.0)).cast("long")
    later = (at("events") - at("observed_by_cutoff") - at("observation_unknown")).alias("observed_later")
    return out.select("entry_id", *(at(n).alias(n) for n in sums), later, *(F.col(c).cast("long").alias(c) for c in ("first_at", "last_at", "max_fetched_at")))


#: Statistic: query, signal, role. The signal is a published column or an expression of some.
SIGNALS = {
    "STAT-07": ("stat07_same_track", "delta_mean_residual_1825", "ENTRY_INCREMENTAL"), "STAT-08": ("stat08_same_hour", "delta_mean_residual_1825", "ENTRY_INCREMENTAL"), "STAT-10": ("stat10_recent_form", "residual_3_minus_10", "ENTRY_INCREMENTAL"), "STAT-11": ("stat11_abnormal_results", "abnormal_last_10", "ENTRY_INCREMENTAL"),
    "STAT-12": ("stat12_rest_gaps", "gap_percentile", "ENTRY_INCREMENTAL"), "STAT-23": ("stat23_same_meeting_day", "delta_mean_residual_all", "ENTRY_INCREMENTAL"), "STAT-24": ("stat24_volatility", "residual_sd_10", "ENTRY_INCREMENTAL"), "STAT-26": ("stat26_schedule_load", "started_30", "ENTRY_INCREMENTAL"),
    "STAT-31": ("stat31_stage_experience", "late_mean_residual", "ENTRY_INCREMENTAL"), "STAT-32": ("stat32_same_stage", "delta_mean_residual_1825", "ENTRY_INCREMENTAL"), "STAT-33": ("stat33_meeting_transition", "mean_next_residual", "DIAGNOSTIC_ONLY"), "STAT-39": ("stat39_position_bias", "delta_bike_mean_residual", "ENTRY_INCREMENTAL"),
    "STAT-42": ("stat42_pair_summary", "weighted_residual", "ENTRY_INCREMENTAL"),
}


def of_stat(spark, sf_dir, stat: str) -> DataFrame:
    """entry_id, status and signal of one statistic."""
    nn = stat[-2:]
    rows = (position_signal if stat == "STAT-39" else career_signals)(spark, sf_dir)
    return rows.select("entry_id", F.col(f"status_{nn}").alias("status"), F.col(f"signal_{nn}").alias("signal"))


def signals(spark, sf_dir) -> DataFrame:
    """entry_id, stat, role, status and signal of all entry-level statistics, a table for each of them."""
    out = None
    for stat, (*_, role) in SIGNALS.items():
        part = stored(spark, sf_dir, f"signals-{stat}", lambda stat=stat: of_stat(spark, sf_dir, stat)).select("entry_id", F.lit(stat).alias("stat"), F.lit(role).alias("role"), "status", "signal")
        out = part if out is None else out.unionByName(part)
    return out


def signal_lines(spark, sf_dir) -> DataFrame:
    """The rows of :func:`signals` with the entry's context, off the tables that hold them by entry, for who counts them."""
    line = lambda s: F.struct(F.lit(s).alias("stat"), F.lit(SIGNALS[s][2]).alias("role"), F.col(f"status_{s[-2:]}").alias("status"), F.col(f"signal_{s[-2:]}").alias("signal"))
    rows = career_signals(spark, sf_dir).select(*CONTEXT_COLUMNS, F.inline(F.array(*(line(s) for s in SIGNALS if s != "STAT-39"))))
    return rows.unionByName(position_signal(spark, sf_dir).select(*CONTEXT_COLUMNS, F.inline(F.array(line("STAT-39")))))


_SIGNALS_SQL = " UNION ALL ".join(f"SELECT entry_id, '{s}' AS stat, '{r}' AS role, status, CAST({c} AS DOUBLE) AS signal FROM ({ORACLE_SQL[n]})" for s, (n, c, r) in SIGNALS.items())


@query("signals_primary", _SIGNALS_SQL, cte=False)
def _(spark, sf_dir):
    return signals(spark, sf_dir)


@query("signals_run_summary", f"""
WITH s AS ({_SIGNALS_SQL}), g AS (SELECT stat, count(*) AS targets, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status IN ('PARTIAL', 'PARTIAL_HISTORY')) AS partial, count(*) FILTER (status = 'NO_HISTORY') AS no_history, count(*) FILTER (status = 'MISSING_INPUT') AS missing_input, count(*) FILTER (status = 'INVALID_INPUT') AS invalid_input, count(signal) AS signals FROM s GROUP BY stat)
SELECT *, round(valid / CAST(targets AS DOUBLE), 9) AS valid_rate, CASE WHEN invalid_input = 0 THEN 'SUCCEEDED' WHEN invalid_input < targets THEN 'PARTIALLY_SUCCEEDED' ELSE 'FAILED' END AS run_status FROM g
""", cte=False)
def _(spark, sf_dir):
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    g = signal_lines(spark, sf_dir).groupBy("stat").agg(F.count(F.lit(1)).alias("targets"), count("VALID").alias("valid"), count("PARTIAL", "PARTIAL_HISTORY").alias("partial"), count("NO_HISTORY").alias("no_history"), count("MISSING_INPUT").alias("missing_input"), count("INVALID_INPUT").alias("invalid_input"), F.count("signal").alias("signals"))
    status = F.when(F.col("invalid_input") == 0, "SUCCEEDED").when(F.col("invalid_input") < F.col("targets"), "PARTIALLY_SUCCEEDED").otherwise("FAILED")
    return g.withColumns({"valid_rate": P.r9(F.col("valid") / F.col("targets")), "run_status": status})


@query("signals_matched_set", f"""
WITH s AS ({_SIGNALS_SQL}), b AS ({ORACLE_SQL["bt_labels"].replace("SELECT entry_id,", "SELECT entry_id, race_id, score,")}), m AS (SELECT s.stat, b.* FROM s JOIN b USING (entry_id) WHERE s.status = 'VALID' AND s.signal IS NOT NULL AND b.score > 0 AND s.role = 'ENTRY_INCREMENTAL')
SELECT stat, count(*) AS entries, count(DISTINCT race_id) AS races, count(*) FILTER (is_win) AS wins, count(*) FILTER (is_top3) AS top3 FROM m GROUP BY stat
""", cte=False)
def _(spark, sf_dir):
    from tempolane.operators import evaluation as E

    labels = {n: F.coalesce(c, F.lit(False)).alias(n) for n, c in E.labels(F.col("result_status"), F.col("rank")).items()}
    matched = signal_lines(spark, sf_dir).where("status = 'VALID' AND signal IS NOT NULL AND role = 'ENTRY_INCREMENTAL' AND score > 0").select("stat", "race_id", *labels.values())
    own = matched.groupBy("stat").agg(F.count(F.lit(1)).alias("entries"), F.count_if("is_win").alias("wins"), F.count_if("is_top3").alias("top3"))
    # A race's statistics are bits of one number, so that a race is dealt once for all of them.
    masks = None
    for table in (career_signals(spark, sf_dir), position_signal(spark, sf_dir)):
        bits = [F.when((F.col(f"status_{s[-2:]}") == "VALID") & F.col(f"signal_{s[-2:]}").isNotNull(), 1 << k).otherwise(0) for k, s in enumerate(SIGNALS) if f"status_{s[-2:]}" in table.columns and SIGNALS[s][2] == "ENTRY_INCREMENTAL"]
        part = table.where("score > 0").select("race_id", sum(bits[1:], bits[0]).alias("mask"))
        masks = part if masks is None else masks.unionByName(part)
    races = masks.where("mask > 0").groupBy("race_id").agg(F.bit_or("mask").alias("mask")).agg(*(F.count_if(F.col("mask").bitwiseAND(1 << k) > 0).alias(f"_{k}") for k in range(len(SIGNALS))))
    races = races.select(F.inline(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(f"_{k}").alias("races")) for k, s in enumerate(SIGNALS)))))
    return own.join(F.broadcast(races), "stat").select("stat", "entries", "races", "wins", "top3")


# --- reports ------------------------------------------------------------------------------------------------------------


@query("report_latest_batch", """
, r AS (SELECT meeting_id AS run, track_id, count(*) AS entries, count(DISTINCT race_id) AS races, min(entrants) AS lo, max(entrants) AS hi, count(DISTINCT race_type) AS kinds, max(race_date) AS last FROM target GROUP BY ALL), c AS (SELECT * FROM r WHERE kinds = 4 AND lo < hi)
SELECT track_id, arg_max(run, run) AS run, CAST(arg_max(races, run) AS BIGINT) AS races, CAST(arg_max(entries, run) AS BIGINT) AS entries FROM c GROUP BY track_id
""")
def _(spark, sf_dir):
    r = targets(spark, sf_dir).groupBy(F.col("meeting_id").alias("run"), "track_id").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("race_id").alias("races"), F.min("entrants").alias("lo"), F.max("entrants").alias("hi"), F.countDistinct("race_type").alias("kinds"))
    return M.latest(r.where("kinds = 4 AND lo < hi"), ["track_id"], [F.desc("run")]).select("track_id", "run", "races", "entries")


@query("report_latest_run", """
, r AS (SELECT meeting_id AS run, track_id, count(DISTINCT race_id) AS races, bool_and(race_status IN ('CONFIRMED', 'CORRECTED')) AS complete FROM target GROUP BY ALL)
SELECT track_id, max(run) FILTER (complete) AS run, CAST(arg_max(races, run) FILTER (complete) AS BIGINT) AS races, count(*) FILTER (run > (SELECT max(x.run) FROM r x WHERE x.track_id = r.track_id AND x.complete)) AS later_incomplete FROM r GROUP BY track_id HAVING bool_or(complete)
""")
def _(spark, sf_dir):
    """Each track's latest run of which every race is settled, and how many incomplete ones came after it."""
    complete = F.bool_and(F.col("race_status").isin("CONFIRMED", "CORRECTED"))
    r = targets(spark, sf_dir).groupBy(F.col("meeting_id").alias("run"), "track_id").agg(F.countDistinct("race_id").alias("races"), complete.alias("complete"))
    last = M.latest(r.where("complete"), ["track_id"], [F.desc("run")]).select("track_id", "run", "races")
    after = r.select("track_id", F.col("run").alias("other")).join(last.select("track_id", "run"), "track_id").groupBy("track_id").agg(F.count_if(F.col("other") > F.col("run")).alias("later_incomplete"))
    return last.join(after, "track_id")


_BATCHES = """WHERE NOT (year = 1999 AND stat = 'STAT-12') AND NOT (year = 2000 AND stat = 'STAT-24' AND entry_id % 2 = 0)"""


@query("report_coherent_batch", f"""
WITH s AS ({_SIGNALS_SQL}), y AS (SELECT entry_id, year FROM ({ORACLE_SQL["bt_labels"].replace("SELECT entry_id,", "SELECT entry_id, year(race_date) AS year,")})),
k AS (SELECT year, stat, count(*) AS n FROM s JOIN y USING (entry_id) {_BATCHES} GROUP BY ALL),
b AS (SELECT year, count(*) AS stats, min(n) AS least, max(n) AS most FROM k GROUP BY year)
SELECT year, stats, least, most, stats = 13 AND least = most AS coherent, year = (SELECT max(year) FROM b WHERE stats = 13 AND least = most) AS selected FROM b
""", cte=False)
def _(spark, sf_dir):
    """Batches of all statistics by year: coherent if none is missing and all have as many rows; the latest of these is selected."""
    rows = signal_lines(spark, sf_dir).withColumn("year", F.year("race_date")).where(_BATCHES.removeprefix("WHERE "))
    b = rows.groupBy("year", "stat").agg(F.count(F.lit(1)).alias("n")).groupBy("year").agg(F.count(F.lit(1)).alias("stats"), F.min("n").alias("least"), F.max("n").alias("most"))
    b = b.withColumn("coherent", (F.col("stats") == len(SIGNALS)) & (F.col("least") == F.col("most")))
    best = F.broadcast(b.agg(F.max(F.when(F.col("coherent"), F.col("year"))).alias("best")))  # one row
    return b.join(best).select("year", "stats", "least", "most", "coherent", F.coalesce(F.col("year") == F.col("best"), F.lit(False)).alias("selected"))


@query("report_window_completeness", f"""
WITH f AS ({ORACLE_SQL["stat24_volatility"]}), w AS (UNPIVOT (SELECT entry_id, sample_3, sample_5, sample_10, sample_20, sample_30 FROM f) ON COLUMNS('sample_.*') INTO NAME win VALUE n)
SELECT CAST(substr(win, 8) AS INT) AS window, count(*) AS targets, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean, count(*) FILTER (n < CAST(substr(win, 8) AS INT)) AS incomplete FROM w GROUP BY ALL
""", cte=False)
def _(spark, sf_dir):
    f = QUERIES["stat24_volatility"](spark, sf_dir)
    w = f.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, (3, 5, 10, 20, 30))), F.array(*(F.col(f"sample_{n}") for n in (3, 5, 10, 20, 30))))).alias("window", "n"))
    return w.groupBy("window").agg(F.count(F.lit(1)).alias("targets"), F.min("n").alias("least"), F.max("n").alias("most"), P.r9(F.avg("n")).alias("mean"), F.count_if(F.col("n") < F.col("window")).alias("incomplete"))


@query("report_distributions", """
SELECT 'race_type' AS field, race_type AS value, count(*) AS n FROM target GROUP BY ALL UNION ALL SELECT 'result_status', result_status, count(*) FROM target GROUP BY ALL UNION ALL SELECT 'entrants', CAST(entrants AS VARCHAR), count(*) FROM target GROUP BY ALL
""")
def _(spark, sf_dir):
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("race_type", "result_status", "entrants"))))
    return targets(spark, sf_dir).select(each.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query("report_pair_distribution", f"""
SELECT least(direct_count, 10) AS meetings, count(*) AS pairs, CAST(sum(normal_count) AS BIGINT) AS normal FROM ({ORACLE_SQL["stat42_head_to_head"]}) GROUP BY ALL
""", cte=False)
def _(spark, sf_dir):
    pairs = P.head_to_head(domain(spark, sf_dir))
    return pairs.groupBy(F.least("direct_count", F.lit(10).cast("long")).alias("meetings")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("normal_count").alias("normal"))


@query("report_quantiles", f"""
WITH s AS ({_SIGNALS_SQL}) SELECT stat, {", ".join(f"round(quantile_cont(signal, {p}), 9) AS q{int(100 * p)}" for p in (0.25, 0.5, 0.75, 0.95))}, count(signal) AS n FROM s GROUP BY stat
""", cte=False)
def _(spark, sf_dir):
    from tempolane.operators import evaluation as E

    shares = (0.25, 0.5, 0.75, 0.95)
    lines = signal_lines(spark, sf_dir)
    # A value that occurs often is there once; narrowing down keeps no statistic's values in one task.
    counted = lines.where("signal IS NOT NULL").groupBy("stat", "signal").agg(F.count(F.lit(1)).alias("times"))
    found = E.quantiles(counted, ["stat"], "signal", shares, "times")
    found = found.groupBy("stat").agg(*(P.r9(F.max(F.when(F.col("share") == p, F.col("quantile")))).alias(f"q{int(100 * p)}") for p in shares))
    return lines.groupBy("stat").agg(F.count("signal").alias("n")).join(F.broadcast(found), "stat", "left").select("stat", *(f"q{int(100 * p)}" for p in shares), "n")


@query("report_subject_grain", """
SELECT year(race_date) AS year, count(*) AS rows, count(*) FILTER (player_id IS NULL) AS null_subjects, count(*) - count(DISTINCT entry_id) AS repeated, count(*) FILTER (rank IS NULL) AS missing_rank, round(count(score) / CAST(count(*) AS DOUBLE), 9) AS coverage, count(*) FILTER (score > 0) AS positive, count(*) FILTER (score = 0) AS zero, count(*) FILTER (score IS NULL) AS missing FROM target GROUP BY ALL
""")
def _(spark, sf_dir):
    e = targets(spark, sf_dir)
    return e.groupBy(F.year("race_date").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("player_id").isNull()).alias("null_subjects"), (F.count(F.lit(1)) - F.countDistinct("entry_id")).alias("repeated"), F.count_if(F.col("rank").isNull()).alias("missing_rank"),
        P.r9(F.count("score") / F.count(F.lit(1))).alias("coverage"), F.count_if(F.col("score") > 0).alias("positive"), F.count_if(F.col("score") == 0).alias("zero"), F.count_if(F.col("score").isNull()).alias("missing"),
    )


@query("report_year_against_all", """
, a AS (SELECT count(*) AS n, avg(CAST(rank = 1 AS INT)) AS w FROM target), y AS (SELECT year(race_date) AS year, count(*) AS n, avg(CAST(rank = 1 AS INT)) AS w FROM target GROUP BY ALL)
SELECT year, y.n AS entries, round(y.n / CAST(a.n AS DOUBLE), 9) AS share, round(y.w - a.w, 9) AS win_rate_difference FROM y, a
""")
def _(spark, sf_dir):
    e = targets(spark, sf_dir)
    agg = lambda n, w: [F.count(F.lit(1)).alias(n), F.avg((F.col("rank") == 1).cast("int")).alias(w)]
    whole = F.broadcast(e.agg(*agg("all_n", "all_w")))  # one row
    return e.groupBy(F.year("race_date").alias("year")).agg(*agg("entries", "w")).crossJoin(whole).select("year", "entries", P.r9(F.col("entries") / F.col("all_n")).alias("share"), P.r9(F.col("w") - F.col("all_w")).alias("win_rate_difference"))
