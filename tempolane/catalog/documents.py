"""Parse jobs over pages that Spark makes from the tables, so that SQL on the tables states what must come out.

Some pages are broken on purpose (by a rule on their id): they must come to quarantine as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempolane.operators import validation as V
from tempolane.registry import query
from tempolane.sources import documents as D
from tempolane.sources import pages as G
from tempolane.sources.domain import domain, eligible
from tempolane.storage import stored

_WORD = "CASE result_status WHEN 'DISQUALIFIED' THEN '失格' WHEN 'CRASHED' THEN '落車' WHEN 'DID_NOT_START' THEN '欠場' END"


def page(df: DataFrame, url: Column, body: Column, content_type: str = "text/html; charset=utf-8") -> DataFrame:
    """url, content_type and body of a page per row."""
    return df.select(url.alias("url"), F.lit(content_type).alias("content_type"), F.encode(body, "UTF-8").alias("body"))


def joined(order: str, cell: str, alias: str) -> Column:
    """The group's cells in order, as one text."""
    return F.expr(f"array_join(transform(array_sort(collect_list(struct({order} AS o, {cell} AS c))), x -> x.c), '')").alias(alias)


def race_pages(e: DataFrame, cell: str, head: str, tail: str, order: str = "bike") -> DataFrame:
    g = e.groupBy("race_id").agg(joined(order, cell, "rows"))
    return page(g, F.concat(F.lit("race/"), F.col("race_id").cast("string")), F.concat(F.lit(head), F.col("rows"), F.lit(tail)))


def result_pages(e: DataFrame) -> DataFrame:
    cell = f"concat('<tr><td>', CASE WHEN race_id % 17 = 0 AND bike = 1 THEN '?' ELSE coalesce(cast(rank AS string), {_WORD}) END, '</td><td></td><td>', bike, '</td><td>', coalesce(concat('P&amp;', player_id), 'unknown'), '</td></tr>')"
    return race_pages(e, cell, "<html><body><table><tbody id='pitbodyBs'><tr><th>rank</th></tr>", "<tr><td></td></tr></tbody></table></body></html>")


@query("doc_results", """
SELECT 'race/' || race_id AS url, rank, bike, coalesce('P&' || player_id, 'unknown') AS name, result_status AS status FROM target WHERE race_id % 17 <> 0
""")
def _(spark, sf_dir):
    return D.parse(result_pages(eligible(domain(spark, sf_dir).entries)), "results")[0]


@query("doc_results_quarantine", """
SELECT DISTINCT 'race/' || race_id AS url, 'PARSE' AS error_type FROM target WHERE race_id % 17 = 0
""")
def _(spark, sf_dir):
    return D.parse(result_pages(eligible(domain(spark, sf_dir).entries)), "results")[1].select("url", "error_type")


@query("doc_payouts", """
, r AS (SELECT DISTINCT race_id FROM target WHERE race_id % 19 <> 0)
SELECT 'race/' || race_id AS url, 'TRIFECTA' AS bet_type, '1-2-3' AS combination, race_id * 10 AS amount, race_id % 30 AS popularity, 1 AS sequence FROM r
UNION ALL SELECT 'race/' || race_id, 'QUINELLA_PLACE', '1-2', race_id, NULL, 1 FROM r UNION ALL SELECT 'race/' || race_id, 'QUINELLA_PLACE', '2-3', race_id + 1, NULL, 2 FROM r
""")
def _(spark, sf_dir):
    # Numbers of races are few bytes, but each is a page to parse: they are dealt to a fixed number of tasks.
    races = eligible(domain(spark, sf_dir).entries).select("race_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "race_id").distinct()
    rows = F.expr("""concat('<table><tbody id="pitbodyHarai"><tr><td>', CASE WHEN race_id % 19 = 0 THEN '単勝' ELSE '３連単' END, '</td><td>１ - ２ - ３</td><td>', format_number(race_id * 10, 0), '円</td><td>', race_id % 30, '</td></tr>',
      '<tr><td>ワイド</td><td>1-2</td><td>', race_id, '円</td><td></td></tr><tr><td>ワイド</td><td>2-3</td><td>', race_id + 1, '</td></tr></tbody></table>')""")
    return D.parse(page(races, F.concat(F.lit("race/"), F.col("race_id").cast("string")), rows), "payouts")[0]


def parsed(spark, sf_dir, kind: str, make) -> G.Parsed:
    """The pages of a kind, parsed once for an application."""
    found = stored(spark, sf_dir, f"pages-{kind}", lambda: G.parse_tables(make(spark, sf_dir), kind).found)
    return G.Parsed(found, G.PAGES[kind][1])


_PAGE_KIND = "CASE WHEN race_id % 10 = 0 THEN 'CANCELLED' WHEN race_id % 11 = 0 THEN 'UNDER_REVIEW' WHEN race_status = 'UNAVAILABLE' THEN 'UNAVAILABLE' WHEN race_id % 17 = 0 THEN 'BROKEN' ELSE 'RESULTS_AVAILABLE' END"


def result_page_bodies(spark, sf_dir) -> DataFrame:
    """Whole result pages: a word for the state, or results and, but for every fifth race, payouts."""
    e = eligible(domain(spark, sf_dir).entries).withColumn("kind", F.expr(_PAGE_KIND))
    cell = f"concat('<tr><td>', CASE WHEN kind = 'BROKEN' AND bike = 1 THEN '?' ELSE coalesce(cast(rank AS string), {_WORD}) END, '</td><td></td><td>', bike, '</td><td>P', coalesce(cast(player_id AS string), '-'), '</td></tr>')"
    g = e.groupBy("race_id", "kind").agg(joined("bike", cell, "rows"))
    body = F.expr("""concat('<html><h1>結果</h1>', CASE kind WHEN 'CANCELLED' THEN '<p>開催中止</p>' WHEN 'UNDER_REVIEW' THEN '<p>結果未確定</p>' WHEN 'UNAVAILABLE' THEN '<p>結果未掲載</p>' ELSE concat('<table><tbody id="pitbodyBs">', rows, '</tbody></table>',
      CASE WHEN race_id % 5 = 0 THEN '<p>払戻なし</p>' ELSE concat('<table><tbody id="pitbodyHarai"><tr><td>２車単</td><td>', race_id % 9, '-', race_id % 7, '</td><td>', race_id * 10, '円</td><td>', race_id % 30, '</td></tr></tbody></table>') END) END, '</html>')""")
    return page(g, F.concat(F.lit("race/"), F.col("race_id").cast("string")), body)


_RESULT_PAGES = f", pk AS (SELECT *, {_PAGE_KIND} AS kind FROM target)"


@query("doc_page_states", _RESULT_PAGES + """
SELECT DISTINCT 'race/' || race_id AS url, kind AS state, kind = 'RESULTS_AVAILABLE' AS results_shown, kind = 'RESULTS_AVAILABLE' AND race_id % 5 <> 0 AS payouts_shown, kind = 'RESULTS_AVAILABLE' AND race_id % 5 = 0 AS no_payouts FROM pk WHERE kind <> 'BROKEN'
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "result_page", result_page_bodies).table("page").drop("source_sha256")


@query("doc_page_hashes", """
SELECT sha256(url) = '' AS same, count(*) AS pages FROM (SELECT DISTINCT 'race/' || race_id AS url, {kind} AS kind FROM target) WHERE kind <> 'BROKEN' GROUP BY ALL
""".replace("{kind}", _PAGE_KIND).replace("sha256(url) = ''", "sha256(url) <> ''"))
def _(spark, sf_dir):
    """The hash that the parse gives for a page is that of its body."""
    hashed = D.raw_documents(result_page_bodies(spark, sf_dir)).select("url", "sha256")
    met = parsed(spark, sf_dir, "result_page", result_page_bodies).table("page").join(hashed, "url")
    return met.groupBy((F.col("sha256") == F.col("source_sha256")).alias("same")).agg(F.count(F.lit(1)).alias("pages"))


@query("doc_page_results", _RESULT_PAGES + """
SELECT 'race/' || race_id AS url, rank, bike, 'P' || coalesce(CAST(player_id AS VARCHAR), '-') AS name, result_status AS status FROM pk WHERE kind = 'RESULTS_AVAILABLE'
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "result_page", result_page_bodies).table("results")


@query("doc_page_payouts", _RESULT_PAGES + """
SELECT DISTINCT 'race/' || race_id AS url, 'EXACTA' AS bet_type, race_id % 9 || '-' || race_id % 7 AS combination, race_id * 10 AS amount, race_id % 30 AS popularity, 1 AS sequence FROM pk WHERE kind = 'RESULTS_AVAILABLE' AND race_id % 5 <> 0
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "result_page", result_page_bodies).table("payouts")


@query("audit_page_completeness", _RESULT_PAGES + """
, ex AS (SELECT race_id, count(*) AS n, race_id % 14 = 0 AS shifted FROM target WHERE NOT (race_id % 21 = 0 AND bike = 1) GROUP BY race_id), p AS (SELECT race_id, any_value(kind) AS kind, count(*) AS n FROM pk GROUP BY race_id)
SELECT 'race/' || race_id AS url, CASE WHEN kind <> 'RESULTS_AVAILABLE' THEN 'NO_RESULT_PAGE' WHEN coalesce(ex.n, 0) <> p.n THEN 'RESULT_COUNT_MISMATCH' WHEN shifted THEN 'BIKE_SET_MISMATCH' WHEN race_id % 13 = 0 AND race_id % 5 <> 0 THEN 'PARTIAL_PAYOUT' ELSE 'COMPLETE' END AS verdict FROM p LEFT JOIN ex USING (race_id) WHERE kind <> 'BROKEN'
""")
def _(spark, sf_dir):
    """Parsed result pages against the entries, of which some lack a bike or have others, and payouts of which some lack the amount."""
    g = parsed(spark, sf_dir, "result_page", result_page_bodies)
    url = F.concat(F.lit("race/"), F.col("race_id").cast("string")).alias("url")
    expected = eligible(domain(spark, sf_dir).entries).where("NOT (race_id % 21 = 0 AND bike = 1)").select(url, (F.col("bike") + F.when(F.col("race_id") % 14 == 0, 1).otherwise(0)).cast("int").alias("bike"))
    race = F.substring_index("url", "/", -1).cast("long")
    return V.page_completeness(g.table("page"), g.table("results"), g.table("payouts").withColumn("amount", F.when(race % 13 != 0, F.col("amount"))), expected)


@query("doc_schedule", """
SELECT 'schedule/' || meeting_id AS url, CAST(track_id AS VARCHAR) AS track, CAST(min(race_date) AS VARCHAR) AS starts_on, date_diff('day', min(race_date), max(race_date)) + 1 AS days, 'F' || (1 + track_id % 2) AS grade FROM target GROUP BY meeting_id, track_id
""")
def _(spark, sf_dir):
    m = eligible(domain(spark, sf_dir).entries).groupBy("meeting_id", "track_id").agg(F.min("race_date").alias("a"), F.max("race_date").alias("b"))
    body = F.expr("""concat('<input id="dispYearData" value="', year(a), '"><input id="dispDayData" value="', month(a), '"><table class="chiku_tbl"><tbody><tr><td class="td_keirinjo"><a href="?jocd=', track_id, '">t</a></td>',
      CASE WHEN day(a) > 1 THEN concat('<td class="td_day" colspan="', day(a) - 1, '"></td>') ELSE '' END, '<td class="td_day" colspan="', datediff(b, a) + 1, '"><a data-pprm-href="x"><img class="gradeIconSize" src="/ico_f', 1 + track_id % 2, '.png"></a></td></tr></tbody></table>')""")
    return D.parse(page(m, F.concat(F.lit("schedule/"), F.col("meeting_id").cast("string")), body), "schedule")[0]


_LISTED = """
, n AS (SELECT *, dense_rank() OVER (PARTITION BY track_id, race_date ORDER BY race_id) AS race_no, bool_or(player_id IS NULL OR actual NOT BETWEEN 5 AND 9) OVER (PARTITION BY track_id, race_date) AS bad, (track_id + CAST(strftime(race_date, '%j') AS INT)) % 13 AS k FROM target)
"""
_LISTED_URL = "'list/' || track_id || '/' || strftime(race_date, '%Y%m%d')"


def entry_list_pages(spark, sf_dir) -> DataFrame:
    """A track's day; some are cancelled, terminated or postponed (by track and day of the year)."""
    e = eligible(domain(spark, sf_dir).entries).withColumn("day", F.date_format("race_date", "yyyyMMdd")).withColumn("track", F.col("track_id").cast("string")).withColumn("k", (F.col("track_id") + F.dayofyear("race_date")) % 13)
    entry = F.struct(F.col("bike").alias("syaban"), F.col("player_id").cast("string").alias("senNo"), F.concat(F.lit("name  "), F.col("player_id").cast("string")).alias("senName"), F.lit("東京").alias("huken"), F.lit("－").alias("kyaku"))
    clock = F.date_format(F.timestamp_seconds("start_at"), "HH:mm").alias("stTime")
    race = e.groupBy("track", "day", "k", "race_id", "race_type", clock, (F.col("race_status") != "UNAVAILABLE").alias("done")).agg(F.array_sort(F.collect_list(entry)).alias("sInfo"))
    listed = race.groupBy("track", "day", "k").agg(F.array_sort(F.collect_list(F.struct("race_id", F.col("race_type").alias("syumoku"), "sInfo", "stTime", "done"))).alias("r"))
    numbered = F.transform("r", lambda x, i: F.struct((i + 1).alias("raceNo"), x["syumoku"].alias("syumoku"), x["stTime"].alias("stTime"), F.lit("").alias("denTime"), x["done"].cast("int").alias("resultFlg"), x["sInfo"].alias("sInfo")))
    asked = F.struct(F.col("track").alias("bkcd"), F.col("day").alias("kday")).alias("reqprm")
    held = F.to_json(F.struct(F.lit("0").alias("resultCd"), F.col("track").alias("keirinCd"), F.col("day").alias("kaisaihi"), F.lit("2020/01/01 07:01&nbsp;更新").alias("lastUpdateTime"), asked, numbered.alias("rInfo")))
    off = lambda words: F.to_json(F.struct(F.lit(0).alias("resultCd"), F.lit(0).alias("syusouDispFlag"), F.lit(words).alias("kaisaiMsg"), asked))
    root = F.when(F.col("k") == 1, off("中止となりました。")).when(F.col("k") == 2, off("打切となりました")).when(F.col("k") == 3, off("翌日に順延します。")).when(F.col("k") == 4, off("休みです。")).otherwise(held)
    return page(listed, F.concat_ws("/", F.lit("list"), "track", "day"), root, "application/json; charset=utf-8")


@query("doc_entry_list", _LISTED + f"""
SELECT {_LISTED_URL} AS url, race_no, bike, CAST(player_id AS VARCHAR) AS player, 'name ' || player_id AS name, '東京' AS prefecture, CAST(NULL AS VARCHAR) AS style FROM n WHERE NOT bad AND k NOT BETWEEN 1 AND 4
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "entry_list", entry_list_pages).table("entries")


@query("doc_entry_list_races", _LISTED + f"""
SELECT DISTINCT {_LISTED_URL} AS url, race_no, race_type, CASE WHEN race_type LIKE '%ガールズ%' OR race_type LIKE '%Ｌ級%' THEN 'GIRLS' WHEN race_type LIKE 'Ｓ級%' OR race_type LIKE 'Ａ級%' THEN 'MEN' ELSE 'UNKNOWN' END AS category, CAST(NULL AS VARCHAR) AS close_time, strftime(make_timestamp(start_at * 1000000), '%H:%M') AS start_time, race_status <> 'UNAVAILABLE' AS result_available, actual AS entrants
FROM n WHERE NOT bad AND k NOT BETWEEN 1 AND 4
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "entry_list", entry_list_pages).table("races")


@query("doc_entry_list_days", _LISTED + f"""
SELECT DISTINCT {_LISTED_URL} AS url, CASE WHEN k <> 3 THEN CAST(track_id AS VARCHAR) END AS track, CASE WHEN k <> 3 THEN CAST(race_date AS VARCHAR) END AS race_date, CASE k WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'TERMINATED' WHEN 3 THEN 'POSTPONED' ELSE 'HELD' END AS state,
  CASE k WHEN 1 THEN '中止となりました。' WHEN 2 THEN '打切となりました' WHEN 3 THEN '翌日に順延します。' END AS message, CASE WHEN k NOT IN (1, 2, 3) THEN '2020/01/01 07:01 更新' END AS updated FROM n WHERE k <> 4 AND (NOT bad OR k IN (1, 2, 3))
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "entry_list", entry_list_pages).table("day")


_MEETINGS = """
, d AS (SELECT DISTINCT meeting_id, track_id, race_date FROM target), n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY race_date) AS day_number, min(race_date) OVER (PARTITION BY meeting_id) AS first_day FROM d)
"""
_MEETING_STATE = "CASE WHEN meeting_id % 6 IN (1, 2) THEN 'CANCELLED' WHEN meeting_id % 6 = 3 THEN 'POSTPONED' ELSE 'HELD' END"


def day_metadata_pages(spark, sf_dir) -> DataFrame:
    """A meeting's page: held, cancelled with and without races, postponed, and (meeting_id % 6 = 4) cancelled without its evidence."""
    days = eligible(domain(spark, sf_dir).entries).groupBy("meeting_id", "track_id").agg(F.array_sort(F.collect_set("race_date")).alias("d"))
    k = F.col("meeting_id") % 6
    listed = F.transform("d", lambda x, i: F.struct(F.date_format(x, "MM/dd").alias("txtEventDate"), F.concat(F.lit("("), (i + 1).cast("string"), F.lit("日目)")).alias("txtDaily"), F.concat(F.lit("day-"), (i + 1).cast("string")).alias("encParaK")))
    races = F.array(*(F.struct(F.lit(f"race-{x}").alias("encParaR"), F.lit(True).alias("flgRaceEnd"), F.lit("1").alias("rcvKekka")) for x in (1, 2)))
    off = k.isin(1, 2, 3, 4)
    data = F.struct(F.date_format(F.get("d", F.lit(0)), "yyyyMMdd").alias("selKaisai"), F.col("track_id").cast("string").alias("selKjyoCd"), F.when(k == 1, 0).otherwise(2).alias("selRaceNo"), F.concat(F.lit("meeting "), F.col("meeting_id").cast("string")).alias("raceName"), F.lit("F1").alias("imgGradeAlt"), listed.alias("C0201kaisai"), F.when(k != 1, races).alias("C0201race"), off.alias("flgRaceCancel"), F.when(off, F.lit(0)).alias("flgSectionCancel"), F.when(off & (k != 4), F.lit(0)).alias("cntRace"), F.when(k == 3, "順延となりました。").when(off, "中止となりました。").alias("hhMessage"))
    root = F.to_json(F.struct(F.lit(0).alias("resultCd"), data.alias("C0201data")))
    # Half of the pages hold the same data in a script.
    body = F.when(k % 2 == 0, root).otherwise(F.concat(F.lit("<html><script>jsonData['PC0201'] = "), root, F.lit(";</script></html>")))
    return page(days, F.concat(F.lit("meeting/"), F.col("meeting_id").cast("string")), body)


@query("doc_day_metadata", _MEETINGS + """
SELECT 'meeting/' || meeting_id AS url, CAST(race_date AS VARCHAR) AS race_date, day_number, '(' || day_number || '日目)' AS label, 'day-' || day_number AS parameter, day_number = 1 AS selected FROM n WHERE meeting_id % 6 <> 4
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "day_metadata", day_metadata_pages).table("days")


@query("doc_day_context", _MEETINGS + f"""
SELECT 'meeting/' || meeting_id AS url, CAST(race_date AS VARCHAR) AS selected_date, CAST(track_id AS VARCHAR) AS track, CASE WHEN meeting_id % 6 = 1 THEN 0 ELSE 2 END AS race_no, 'meeting ' || meeting_id AS meeting, CAST(NULL AS VARCHAR) AS track_name, 'F1' AS meeting_grade, {_MEETING_STATE} AS state,
  CASE {_MEETING_STATE} WHEN 'CANCELLED' THEN '中止となりました。' WHEN 'POSTPONED' THEN '順延となりました。' END AS message, CASE WHEN meeting_id % 6 = 1 THEN 'missing' ELSE 'populated' END AS race_info FROM n WHERE day_number = 1 AND meeting_id % 6 <> 4
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "day_metadata", day_metadata_pages).table("context")


@query("doc_day_races", f"""
SELECT 'meeting/' || meeting_id AS url, r.race_no, 'race-' || r.race_no AS parameter, true AS ended, true AS result_available FROM (SELECT DISTINCT meeting_id FROM target), (VALUES (1), (2)) r(race_no) WHERE meeting_id % 6 <> 4 AND {_MEETING_STATE} <> 'CANCELLED'
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "day_metadata", day_metadata_pages).table("races")


def script_pages(g: DataFrame, **values: Column) -> DataFrame:
    """Pages whose script assigns each value to its key."""
    parts = [x for key, value in values.items() for x in (F.lit(f' jsonData["{key}"] = '), F.to_json(value), F.lit(";"))]
    body = F.concat(F.lit('<html><script>var a = "{";'), *parts, F.lit(" done();</script></html>"))
    return page(g, F.concat(F.lit("race/"), F.col("race_id").cast("string")), body)


def race_detail_pages(spark, sf_dir) -> DataFrame:
    """Entries in two lists, of which one lacks a bike where race_id % 13 = 0 and names another player where it is 1."""
    e = eligible(domain(spark, sf_dir).entries).where("player_id IS NOT NULL")
    own = F.col("player_id").cast("string")
    one = F.struct(F.col("bike").alias("carNum"), F.when((F.col("race_id") % 13 == 1) & (F.col("bike") == 1), "999999999").otherwise(own).alias("numPlayer"))
    two = F.struct(F.col("bike").cast("string").alias("syaban"), F.col("frame").cast("string").alias("wakuban"), own.alias("sensyuRegistNo"), F.concat(F.lit("選手　"), own).alias("sensyuName"), F.lit("Ａ級３班").alias("prevKyuhan"), F.lit("S級S班").alias("kyuhan"), F.when(F.col("score").isNull(), "－").otherwise(F.format_string("%.2f", "score")).alias("heikinTokuten"), (F.col("bike") * 2).cast("string").alias("nigeCnt"), F.lit("").alias("makuriCnt"), F.lit("12.5").alias("syouritu"))
    g = e.groupBy("race_id", "race_date", "track_id", "race_type", "start_at").agg(F.array_sort(F.collect_list(F.when((F.col("race_id") % 13 != 0) | (F.col("bike") > 1), one))).alias("one"), F.array_sort(F.collect_list(two)).alias("two"))
    clock = lambda c: F.date_format(F.timestamp_seconds(c), "HH:mm")
    detail = F.struct(F.col("race_type").alias("syumoku"), F.lit(2025).alias("kyori"), F.lit("5").alias("syukai"), clock("start_at").alias("aftStartTime"), F.col("one").alias("C0201sensyu"))
    context = F.struct(F.date_format("race_date", "yyyyMMdd").alias("selKaisai"), F.col("track_id").cast("string").alias("selKjyoCd"), (1 + F.col("race_id") % 12).alias("selRaceNo"), detail.alias("C0201racedtl"))
    return script_pages(g, PC0201=F.struct(context.alias("C0201data")), PJ0315=F.struct(F.col("two").alias("sensyuTypeInfo")))


_DETAILED = """
, q AS (SELECT race_id, bool_or(bike = 1) AS first FROM target WHERE player_id IS NOT NULL GROUP BY race_id), g AS (SELECT race_id FROM q WHERE NOT (first AND race_id % 13 IN (0, 1)))
"""


@query("doc_race_detail", _DETAILED + """
SELECT 'race/' || race_id AS url, bike, frame, CAST(player_id AS VARCHAR) AS player, 'A3' AS previous_grade, '選手 ' || player_id AS name, 'SS' AS grade, round(score, 2) AS score, bike * 2 AS escapes, CAST(NULL AS INT) AS sprints, 12.5 AS win_rate FROM target JOIN g USING (race_id) WHERE player_id IS NOT NULL
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "race_detail", race_detail_pages).table("entries").select("url", "bike", "frame", "player", "previous_grade", "name", "grade", "score", "escapes", "sprints", "win_rate")


@query("doc_race_context", _DETAILED + """
SELECT DISTINCT 'race/' || race_id AS url, CAST(race_date AS VARCHAR) AS race_date, CAST(track_id AS VARCHAR) AS track, 1 + race_id % 12 AS race_no, race_type, CAST(NULL AS VARCHAR) AS race_name, 2025 AS distance, 5 AS laps, strftime(make_timestamp(start_at * 1000000), '%H:%M') AS start_time, CAST(NULL AS VARCHAR) AS close_time FROM target JOIN g USING (race_id)
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "race_detail", race_detail_pages).table("context")


@query("audit_player_match", _DETAILED + """
SELECT race_id, CAST(count(*) AS BIGINT) AS bikes, count(*) FILTER (race_id % 33 = 0 AND bike = 3 OR race_id % 35 = 0 AND bike = 4) AS differing FROM target JOIN g USING (race_id) WHERE player_id IS NOT NULL GROUP BY race_id
""")
def _(spark, sf_dir):
    """Players of each bike in the parsed details against the stored entries, of which some have another player and some none."""
    doc = parsed(spark, sf_dir, "race_detail", race_detail_pages).table("entries").select(F.substring_index("url", "/", -1).cast("long").alias("race_id"), F.col("bike").cast("long").alias("bike"), "player")
    other = F.when((F.col("race_id") % 33 == 0) & (F.col("bike") == 3), -1).otherwise(F.col("player_id")).cast("string").alias("player")
    kept = eligible(domain(spark, sf_dir).entries).where("player_id IS NOT NULL AND NOT (race_id % 35 = 0 AND bike = 4)").join(doc.select("race_id").distinct(), "race_id", "left_semi").select("race_id", F.col("bike").cast("long").alias("bike"), other)
    return V.against_manifest(doc, kept, ["race_id", "bike"], ["player"]).groupBy("race_id").agg(F.count(F.lit(1)).alias("bikes"), F.count_if(F.col("differs") != "").alias("differing"))


_LIVE_KIND = "CASE WHEN race_id % 23 = 0 THEN 'RACE' WHEN race_id % 29 = 0 THEN 'SECTION' WHEN race_id % 7 = 1 THEN 'UNDER_REVIEW' WHEN race_id % 7 = 2 THEN 'PROVISIONAL' WHEN race_id % 31 = 0 THEN 'NOTHING' ELSE race_status END"


def live_pages(spark, sf_dir) -> DataFrame:
    """Live pages in every status: by flags, by words, by what was received; race_id % 19 = 0 has an unknown state, 1 no context."""
    e = eligible(domain(spark, sf_dir).entries).withColumn("kind", F.expr(_LIVE_KIND))
    word = F.when((F.col("race_id") % 19 == 0) & (F.col("bike") == 1), "？").otherwise(F.expr(_WORD))
    state = F.when(F.col("rank").isNull() | ((F.col("race_id") % 19 == 0) & (F.col("bike") == 1)), F.array(F.struct(word.alias("kojinState"), F.lit("").alias("tyakuNote")))).otherwise(F.array().cast("array<struct<kojinState:string,tyakuNote:string>>"))
    rank = F.when((F.col("race_id") % 19 == 0) & (F.col("bike") == 1), "").otherwise(F.coalesce(F.col("rank").cast("string"), F.lit("")))
    row = F.struct(F.col("bike").cast("string").alias("syaban"), rank.alias("tyaku"), F.coalesce(F.col("player_id").cast("string"), F.lit("000000")).alias("sensyuRegistNo"), F.lit("捲り").alias("kimarite"), state.alias("kojinStateItemSubData"))
    g = e.groupBy("race_id", "race_date", "track_id", "kind").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    k, own = F.col("kind"), F.col("race_id")
    done = k.isin("CONFIRMED", "CORRECTED", "PROVISIONAL", "NOTHING")
    race = F.struct(F.lit(1).alias("raceNo"), done.alias("flgRaceEnd"), F.when(done, "1").otherwise("0").alias("rcvKekka"), F.when(k == "NOTHING", "0").otherwise("1").alias("rcvRefund"))
    words = F.when(k == "CORRECTED", "結果 訂正 審議").when(k == "UNDER_REVIEW", "審議中").when(k == "PROVISIONAL", "暫定")
    context = F.struct(F.date_format("race_date", "yyyyMMdd").alias("selKaisai"), F.col("track_id").cast("string").alias("selKjyoCd"), F.lit(1).alias("selRaceNo"), (k == "RACE").alias("flgRaceCancel"), (k == "SECTION").cast("string").alias("x"), F.when(k == "SECTION", 1).otherwise(0).alias("flgSectionCancel"), F.array(race).alias("C0201race"), F.struct(words.alias("statusText")).alias("inner"))
    exacta = F.array(F.struct(F.lit("1-2").alias("kumiBan"), F.format_number(own * 10, 0).alias("haraiGaku"), F.lit("(1)").alias("ninki"), F.lit(1).alias("kumiDispFlg")), F.struct(F.lit("").alias("kumiBan"), F.lit("【未発売】").alias("haraiGaku"), F.lit("").alias("ninki"), F.lit(0).alias("kumiDispFlg")))
    wide = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda x: F.struct(F.concat(F.lit("1="), (x + 1).cast("string")).alias("kumiBan"), (own + x).cast("string").alias("haraiGaku"), F.lit("").alias("ninki")))
    shown, paid = ~k.isin("UNAVAILABLE", "RACE"), ~k.isin("UNAVAILABLE", "RACE", "PROVISIONAL")
    data = F.struct(F.lit(0).alias("resultCd"), F.lit("曇").alias("tenki"), F.lit("1.3").alias("husoku"), shown.alias("tyakujyunDispFlg"), paid.alias("haraiGakuDispFlg"), F.col("rows").alias("tyakujyunItemSubData"), F.struct(exacta.alias("ST2HaraiGakuDispItemSubData"), wide.alias("WHaraiGakuDispItemSubData")).alias("haraiGakuSubData"))
    outer = F.when(own % 19 != 1, context)
    return script_pages(g, PC0201=F.struct(outer.alias("C0201data")), PJ0326=data)


_LIVE = f"""
, lk AS (SELECT *, {_LIVE_KIND} AS kind FROM target), lv AS (SELECT *, kind IN ('CONFIRMED', 'CORRECTED', 'PROVISIONAL') AS wanted, kind NOT IN ('UNAVAILABLE', 'RACE') AS shown, kind NOT IN ('UNAVAILABLE', 'RACE', 'PROVISIONAL') AS paid FROM lk),
ls AS (SELECT * FROM lv WHERE race_id % 19 <> 1 AND NOT (wanted AND race_id IN (SELECT race_id FROM lv WHERE race_id % 19 = 0 AND bike = 1)))
"""


@query("doc_live_context", _LIVE + """
SELECT DISTINCT 'race/' || race_id AS url, CAST(race_date AS VARCHAR) AS race_date, CAST(track_id AS VARCHAR) AS track, 1 AS race_no, CAST(NULL AS VARCHAR) AS updated, '曇' AS weather, '1.3' AS wind,
  CASE kind WHEN 'RACE' THEN 'CANCELLED' WHEN 'SECTION' THEN 'CANCELLED' WHEN 'NOTHING' THEN NULL ELSE kind END AS status,
  CASE kind WHEN 'RACE' THEN 'flgRaceCancel is set' WHEN 'SECTION' THEN 'flgSectionCancel is set' WHEN 'CORRECTED' THEN 'marker 訂正' WHEN 'UNDER_REVIEW' THEN 'marker 審議' WHEN 'PROVISIONAL' THEN 'marker 暫定' WHEN 'CONFIRMED' THEN 'race ended, result and refund received and shown' WHEN 'UNAVAILABLE' THEN 'race not ended and no result received' ELSE 'no evidence' END AS evidence,
  CASE WHEN wanted THEN 'RESULTS_AVAILABLE' WHEN kind = 'UNDER_REVIEW' THEN kind WHEN kind IN ('RACE', 'SECTION') THEN 'CANCELLED' ELSE 'UNAVAILABLE' END AS page_state,
  shown AS results_shown, paid AS payouts_shown, shown AND NOT paid AS no_payouts, wanted AND shown AS results_complete, wanted AND (paid OR NOT shown) AS payouts_complete FROM ls
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "live_result", live_pages).table("context")


@query("doc_live_results", _LIVE + """
SELECT 'race/' || race_id AS url, bike, rank, result_status AS status, coalesce(CAST(player_id AS VARCHAR), '000000') AS player, '捲り' AS technique, CASE result_status WHEN 'DISQUALIFIED' THEN '失格' WHEN 'CRASHED' THEN '落車' WHEN 'DID_NOT_START' THEN '欠場' ELSE '' END AS states FROM ls WHERE wanted
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "live_result", live_pages).table("results").select("url", "bike", "rank", "status", "player", "technique", F.array_join("states", " ").alias("states"))


@query("doc_live_payouts", _LIVE + """
, lr AS (SELECT DISTINCT race_id FROM ls WHERE wanted AND paid)
SELECT 'race/' || race_id AS url, 'EXACTA' AS bet_type, '1-2' AS combination, race_id * 10 AS amount, 1 AS popularity, 1 AS sequence FROM lr
UNION ALL SELECT 'race/' || race_id, 'QUINELLA_PLACE', '1=' || x + 1, race_id + x, NULL, x FROM lr, (VALUES (1), (2)) v(x)
""")
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "live_result", live_pages).table("payouts")


@query("doc_quarantine", _LIVE + _DETAILED.replace(", q AS", ", q AS", 1) + f"""
, pk AS (SELECT race_id, {_PAGE_KIND} AS kind FROM target), n AS (SELECT *, bool_or(player_id IS NULL OR actual NOT BETWEEN 5 AND 9) OVER (PARTITION BY track_id, race_date) AS bad, (track_id + CAST(strftime(race_date, '%j') AS INT)) % 13 AS k FROM target)
SELECT 'live_result' AS kind, count(*) AS pages FROM (SELECT DISTINCT race_id FROM target) WHERE race_id NOT IN (SELECT race_id FROM ls)
UNION ALL SELECT 'race_detail', count(*) FROM q WHERE first AND race_id % 13 IN (0, 1)
UNION ALL SELECT 'day_metadata', count(DISTINCT meeting_id) FROM target WHERE meeting_id % 6 = 4
UNION ALL SELECT 'entry_list', count(DISTINCT (track_id, race_date)) FROM n WHERE k = 4 OR bad AND k NOT IN (1, 2, 3)
UNION ALL SELECT 'result_page', count(DISTINCT race_id) FROM pk WHERE kind = 'BROKEN'
""")
def _(spark, sf_dir):
    """Pages in quarantine by kind."""
    kinds = {"live_result": live_pages, "race_detail": race_detail_pages, "day_metadata": day_metadata_pages, "entry_list": entry_list_pages, "result_page": result_page_bodies}
    counts = [parsed(spark, sf_dir, k, make).quarantine().agg(F.count(F.lit(1)).alias("pages")).select(F.lit(k).alias("kind"), "pages") for k, make in kinds.items()]
    return reduce(DataFrame.unionByName, counts)


def suppliers(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet")


def player_list_pages(spark, sf_dir) -> DataFrame:
    """25 players a page; page 3 has a player whose number is not that of the link."""
    s = suppliers(spark, sf_dir).select("s_suppkey", "s_name", F.expr("s_suppkey div 25 + 1").alias("page"))
    last = F.broadcast(s.agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("total")))  # one row
    span = lambda k, v: f"'<span id=\"j:', s_suppkey, ':UNQ_orlabel_{k}\">', {v}, '</span>'"
    cell = f"""concat('<div><table class="btn25pv2 x"><tr><td><table><tr><td onclick="sensyuLink(''', s_suppkey, ''')">', {span(6, "'カナ'")}, '<p><a href="#">', {span(8, "s_name")}, '</a></p></td></tr></table></td><td>・', {span(9, "CASE WHEN page = 3 AND s_suppkey % 25 = 0 THEN 0 ELSE s_suppkey END")}, {span(10, "concat('A級', 1 + s_suppkey % 3, '班')")}, {span(12, "'宮城県'")}, {span(14, "20 + s_suppkey % 30")}, '歳', {span(15, "'－'")}, '</td></tr></table></div>')"""
    g = s.groupBy("page").agg(joined("s_suppkey", cell, "rows")).join(last)
    body = F.concat(F.lit("<html><title>選手検索結果</title><body><p>2026/07/17 02:36&nbsp;更新</p><p>"), F.col("total").cast("string"), F.lit("件見つかりました。ページ "), F.col("page").cast("string"), F.lit("/"), F.col("last").cast("string"), F.lit("</p>"), F.col("rows"), F.lit("</body></html>"))
    return page(g, F.concat(F.lit("players/"), F.col("page").cast("string")), body)


_PLAYER_PAGES = """
WITH s AS (SELECT *, s_suppkey // 25 + 1 AS page, max(s_suppkey // 25 + 1) OVER () AS last_page, count(*) OVER () AS total FROM supplier), g AS (SELECT * FROM s WHERE page <> 3 OR page NOT IN (SELECT page FROM s WHERE s_suppkey % 25 = 0))
"""


@query("doc_player_list", _PLAYER_PAGES + """
SELECT 'players/' || page AS url, CAST(s_suppkey AS VARCHAR) AS player, 'カナ' AS name_kana, s_name AS name, 'A' || (1 + s_suppkey % 3) AS grade, '宮城県' AS prefecture, 20 + s_suppkey % 30 AS age, CAST(NULL AS VARCHAR) AS home_bank, '/pc/racerprofile?snum=' || s_suppkey AS detail FROM g
""", cte=False)
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "player_list", player_list_pages).table("players").select("url", "player", "name_kana", "name", "grade", "prefecture", "age", "home_bank", "detail")


@query("doc_player_list_pages", _PLAYER_PAGES + """
SELECT DISTINCT 'players/' || page AS url, page, last_page, total, '2026-07-17 02:36' AS updated FROM g
""", cte=False)
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "player_list", player_list_pages).table("page")


def player_pages(spark, sf_dir) -> DataFrame:
    """Profile, grades and recent figures; every seventh has no recent figures, every eleventh no number."""
    cells = lambda *v: "concat('<tr>', " + ", ".join(f"'<td>', {x}, '</td>'" for x in v) + ", '</tr>')"
    number = "'<b id=\"playerNo\">', CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE cast(s_suppkey AS string) END, '</b>'"
    profile = "concat('<table><tr><th>a</th></tr>', " + cells("s_name", "'カナ'", "'東京'", "concat('19', 60 + s_suppkey % 40, '/02/03')", "'x'", "CASE WHEN s_suppkey % 2 = 0 THEN '男子' ELSE '女' END", number) + ", '<tr><th>b</th></tr>', " + cells("'71期'", "'Ｓ級１班'", "'2020/07/01'", "'－'", "'逃'", "concat(s_suppkey % 100, '.25点')") + ", '</table>')"
    grades = "concat('<div><p>級班の履歴情報</p><p>x</p><table><thead><tr><td>級班</td></tr></thead><tbody>', " + cells("'Ａ級３班'", "'2018/01/01'") + ", CASE WHEN s_suppkey % 2 = 1 THEN " + cells("'S1'", "'2020/07/01'") + " ELSE '<tr><td></td><td></td></tr>' END, '</tbody></table></div>')"
    stats = "CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE concat('<div><p>直近4ヶ月成績</p><table><tr><td>h</td></tr>', " + cells("0", "1", "2", "3", "4", "5", "concat(s_suppkey % 50, '回')", "'12.5％'", "'25.0'", "'－'", "'3'", "'4'", "'101.25'") + ", '</table></div>') END"
    body = F.expr(f"concat('<html><p>2025/07/01 02:34 更新</p>', {profile}, {grades}, {stats}, '</html>')")
    return page(suppliers(spark, sf_dir), F.concat(F.lit("player/"), F.col("s_suppkey").cast("string")), body)


@query("doc_player_details", """
SELECT 'player/' || s_suppkey AS url, CAST(s_suppkey AS VARCHAR) AS player, s_name AS name, 'カナ' AS name_kana, '東京' AS prefecture, '19' || (60 + s_suppkey % 40) || '-02-03' AS born_on, CASE WHEN s_suppkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender, '71期' AS period, 'S1' AS grade, '2020-07-01' AS grade_since, CAST(NULL AS VARCHAR) AS next_grade, '逃' AS style, s_suppkey % 100 + 0.25 AS score, '2025-07-01 02:34' AS updated FROM supplier WHERE s_suppkey % 11 <> 0
""", cte=False)
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "player_detail", player_pages).table("profile")


@query("doc_player_grades", """
SELECT 'player/' || s_suppkey AS url, 'A3' AS grade, '2018-01-01' AS since FROM supplier WHERE s_suppkey % 11 <> 0 UNION ALL SELECT 'player/' || s_suppkey, 'S1', '2020-07-01' FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 2 = 1
""", cte=False)
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "player_detail", player_pages).table("grades")


@query("doc_player_stats", """
SELECT 'player/' || s_suppkey AS url, 101.25 AS score, 12.5 AS win_rate, 25.0 AS quinella_rate, CAST(NULL AS DOUBLE) AS trio_rate, s_suppkey % 50 AS starts, 3 AS homes, 4 AS backs FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0
""", cte=False)
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "player_detail", player_pages).table("stats")


def retired_pages(spark, sf_dir) -> DataFrame:
    """A retired player's page by s_suppkey % 4: whole, two dates, no date, and a second time of update in another section."""
    said = "CASE s_suppkey % 4 WHEN 1 THEN '<p>本選手は、2020年03月09日に引退しました。</p><p>本選手は、2021年01月01日に引退しました。</p>' WHEN 2 THEN '' ELSE '<p>本選手は、2020年03月09日に引退しました。</p>' END"
    body = F.expr(f"""concat('<div><div class="midasi1_fsz">プロフィール</div><div><p class="fl-r">2025/07/01 02:34 更新</p></div><div><table><tbody><tr><td><table><tr><td>氏名</td><td>府県</td><td>年齢</td><td>期別</td><td>級班</td><td>登録番号</td></tr><tr><td>', s_name, '</td><td>合成県</td><td>', 30 + s_suppkey % 40, '歳</td><td>７１期</td><td>A級3班</td><td>', lpad(s_suppkey, 6, '0'), '</td></tr></table></td></tr></tbody></table></div>', {said},
      '<div><div class="midasi1_fsz">通算成績</div><p>', CASE WHEN s_suppkey % 4 = 3 THEN '2024/01/01 00:00' ELSE '2025/07/01 02:34' END, ' 更新</p></div></div>')""")
    return page(suppliers(spark, sf_dir), F.concat(F.lit("player/"), F.col("s_suppkey").cast("string")), body)


@query("doc_retired_players", """
SELECT 'player/' || s_suppkey AS url, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS player, s_name AS name, '合成県' AS prefecture, 30 + s_suppkey % 40 AS age, '71' AS period, 'A3' AS grade, '2020-03-09' AS retired_on, '2025-07-01 02:34' AS updated FROM supplier WHERE s_suppkey % 4 IN (0, 3)
""", cte=False)
def _(spark, sf_dir):
    return parsed(spark, sf_dir, "retired_player", retired_pages).table("profile")


@query("doc_raw_pages", """
SELECT page_id, url, sha256(html) AS sha256, octet_length(CAST(encode(html) AS BLOB)) AS bytes, length(html) AS chars FROM pages
""", cte=False)
def _(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = D.raw_documents(page(pages, F.col("page_id").cast("string"), F.col("html")))
    text = D.parse(raw, "text")[0].withColumnRenamed("url", "page")
    hashed = raw.join(text, F.col("url") == F.col("page")).select(F.col("page").cast("long").alias("page_id"), "sha256", "bytes", "chars")
    return hashed.join(pages.select("page_id", "url"), "page_id").select("page_id", "url", "sha256", "bytes", "chars")
