"""Queries that run as streams over the tables, to the end of what they hold. Registered with those of catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ORDERED, SLIDING, VIEWS, query
from .catalog_site import REPORT, SITED
from .functions.times import millis
from .operators import limiters
from .sources import keyed, shared
from .sources.tables import table
from .streaming import reports, stateful


def _events(spark, d) -> DataFrame:
    return stateful.source(spark, f"{d}/events.parquet")


def _page_views(spark, d) -> DataFrame:
    return _events(spark, d).select(F.col("event_type").alias("site"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("visitor"), "ts")


@query(f"WITH {SLIDING} SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(in_window AS BIGINT) AS in_window, CAST(in_day AS BIGINT) AS in_day, CASE WHEN in_day > 20 THEN 'daily_limit' WHEN in_window > 6 THEN 'minute_limit' ELSE 'ok' END AS verdict FROM y")
def streamed_sliding_limit(spark, d):
    return stateful.run(stateful.sliding_stream(_events(spark, d), across_days=True))[0]


@query(f"""WITH RECURSIVE {ORDERED}, f AS (SELECT user_id, event_id, ms, i, CASE WHEN fine THEN 0 ELSE 1 END AS bad, CAST(0 AS BIGINT) AS until, 'ok' AS verdict FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.ms, e.i, CASE WHEN e.ms < f.until THEN f.bad WHEN e.fine THEN 0 ELSE f.bad + 1 END, CASE WHEN e.ms < f.until THEN f.until WHEN NOT e.fine AND f.bad + 1 >= 2 THEN e.ms + 86400000 ELSE 0 END,
CASE WHEN e.ms < f.until THEN 'open' WHEN f.until > 0 THEN 'probe' ELSE 'ok' END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT CAST(user_id AS VARCHAR) AS k, event_id, ms, verdict FROM f""")
def streamed_circuit_breaker(spark, d):
    rows = _events(spark, d)
    asked = rows.select("user_id", "event_id", millis(rows).alias("ms"), (F.col("event_type") != "error").alias("ok"))
    return stateful.run(stateful.limited_stream(asked, limiters.breaker(2, 86_400_000)))[0]


@query("SELECT conv_id AS answer_id, sha256(string_agg(text, '' ORDER BY turn)) AS digest, false AS timed_out FROM conversations GROUP BY 1")
def streamed_token_answers(spark, d):
    """The turns of a conversation as the pieces of an answer; they come in three files, the last turns first."""
    turns = table(spark, d, "conversations")
    ends = turns.groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("end"), F.min("turn").alias("start"))
    pieces = turns.join(ends, turns.conv_id == ends.c).select(F.col("conv_id").alias("answer_id"), (F.col("turn") - F.col("start") + 1).alias("seq"), F.col("text").alias("piece"), (F.col("turn") == F.col("end")).alias("last"))
    path = shared.place(spark, "pieces")
    for i in (2, 1, 0):
        pieces.filter(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(path)
    whole = stateful.run(stateful.token_stream(stateful.source(spark, path, 1), 3_600_000))[0]
    return whole.select("answer_id", F.sha2("text", 256).alias("digest"), "timed_out")


LATE = 12 * 3_600_000


@query(f"""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events), n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS next FROM e)
SELECT CAST(user_id AS VARCHAR) AS k, event_id AS no, event_type AS text FROM n WHERE next IS NULL OR next > ms + {LATE}""")
def streamed_answers_in_time(spark, d):
    """Every event is a request that is answered half a day later; it is shown if its user has not asked anew."""
    rows = _events(spark, d)
    ms = millis(rows)
    both = F.array(F.struct(ms.alias("at"), F.lit(False).alias("is_answer")), F.struct((ms + LATE).alias("at"), F.lit(True).alias("is_answer")))
    turns = rows.select(F.col("user_id").alias("k"), F.col("event_id").alias("no"), F.col("event_type").alias("text"), F.explode(both).alias("t")).select("k", "no", "text", "t.*")
    return stateful.run(stateful.answers_in_time(turns))[0]


@query(f"WITH {VIEWS} SELECT day, site, CAST(count(*) AS BIGINT) AS pv, CAST(least(count(DISTINCT visitor), 5000) AS BIGINT) AS uv FROM v GROUP BY 1, 2")
def streamed_daily_visitors(spark, d):
    rows = stateful.run(stateful.visitor_stream(_page_views(spark, d)), timers=True)[0]
    return rows.groupBy("day", "site").agg(F.max("pv").alias("pv"), F.max("uv").alias("uv"))


@query("""WITH e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS instance, event_id, epoch_us(ts) // 1000 AS ms, (event_id % 4 + 1) * 43200000 AS takes, row_number() OVER (PARTITION BY user_id % 40 ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
r AS (WITH RECURSIVE f AS (SELECT DISTINCT instance, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS ms, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ends, CAST(0 AS BIGINT) AS running FROM e UNION ALL
SELECT instance, event_id, ms, i, CASE WHEN len(held) < 8 THEN list_append(held, ms + takes) ELSE held END, CAST(len(held) AS BIGINT) FROM (SELECT e.instance, e.event_id, e.ms, e.i, takes, list_filter(f.ends, lambda x: x > e.ms) AS held FROM f JOIN e ON e.instance = f.instance AND e.i = f.i + 1))
SELECT * FROM f) SELECT instance, event_id, ms, running, CASE WHEN running < 8 THEN 'ok' ELSE 'busy' END AS verdict FROM r WHERE i > 0""")
def running_requests(spark, d):
    """At most 8 requests of an instance run at a time; they take half a day to two."""
    rows = table(spark, d, "events")
    ms = millis(rows)
    return limiters.gauged(rows.select((F.col("user_id") % 40).alias("instance"), "event_id", ms.alias("ms"), (ms + (F.col("event_id") % 4 + 1) * 43_200_000).alias("until")))


@query("""WITH e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS instance, event_id, epoch_us(ts) // 1000 AS ms, value > 60 AS ok1, event_type = 'view' AS ok2, event_id % 7 = 0 AS ok3, row_number() OVER (PARTITION BY user_id % 40 ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
r AS (WITH RECURSIVE f AS (SELECT DISTINCT instance, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS ms, CAST(0 AS BIGINT) AS i, 0 AS b1, CAST(0 AS BIGINT) AS u1, 0 AS b2, CAST(0 AS BIGINT) AS u2, 0 AS b3, CAST(0 AS BIGINT) AS u3, false AS t1, false AS t2, false AS t3, false AS a1, false AS a2, false AS a3 FROM e UNION ALL
SELECT instance, event_id, ms, i, CASE WHEN NOT t1 THEN b1 WHEN ok1 THEN 0 ELSE b1 + 1 END, CASE WHEN NOT t1 THEN u1 WHEN NOT ok1 AND b1 + 1 >= 3 THEN ms + 43200000 ELSE 0 END,
CASE WHEN NOT t2 THEN b2 WHEN ok2 THEN 0 ELSE b2 + 1 END, CASE WHEN NOT t2 THEN u2 WHEN NOT ok2 AND b2 + 1 >= 3 THEN ms + 43200000 ELSE 0 END,
CASE WHEN NOT t3 THEN b3 WHEN ok3 THEN 0 ELSE b3 + 1 END, CASE WHEN NOT t3 THEN u3 WHEN NOT ok3 AND b3 + 1 >= 3 THEN ms + 43200000 ELSE 0 END, t1, t2, t3, t1 AND ok1, t2 AND ok2, t3 AND ok3 FROM
(SELECT *, NOT (t1 AND ok1) AND NOT (t2 AND ok2) AND ms >= u3 AS t3 FROM (SELECT *, NOT (t1 AND ok1) AND ms >= u2 AS t2 FROM (SELECT e.*, b1, u1, b2, u2, b3, u3, e.ms >= f.u1 AS t1 FROM f JOIN e ON e.instance = f.instance AND e.i = f.i + 1)))) SELECT * FROM f)
SELECT instance, event_id, ms, CASE WHEN a1 THEN 'first' WHEN a2 THEN 'second' WHEN a3 THEN 'third' END AS provider, concat_ws(',', CASE WHEN t1 THEN 'first' END, CASE WHEN t2 THEN 'second' END, CASE WHEN t3 THEN 'third' END) AS attempts,
CASE WHEN NOT (a1 OR a2 OR a3) AND greatest(u1, u2, u3) > ms THEN least(CASE WHEN u1 > ms THEN u1 END, CASE WHEN u2 > ms THEN u2 END, CASE WHEN u3 > ms THEN u3 END) ELSE -1 END AS retry_at FROM r WHERE i > 0""")
def provider_chain(spark, d):
    """Three providers in order, each with a breaker of three failures and half a day."""
    rows = table(spark, d, "events")
    fine = F.create_map(F.lit("first"), F.col("value") > 60, F.lit("second"), F.col("event_type") == "view", F.lit("third"), F.col("event_id") % 7 == 0)
    calls = rows.select((F.col("user_id") % 40).alias("instance"), "event_id", millis(rows).alias("ms"), fine.alias("ok"))
    return limiters.chained(calls, dict.fromkeys(("first", "second", "third"), limiters.breaker(3, 43_200_000))).withColumns({"attempts": F.array_join("attempts", ","), "retry_at": F.coalesce("retry_at", F.lit(-1))})


@query(f"WITH {REPORT} SELECT day, text FROM t WHERE day + INTERVAL 2 DAYS < (SELECT max(ts) + INTERVAL 8 HOURS FROM events)")
def daily_reports_sent(spark, d):
    """The reports of the days that are over by a day; the second run finds them sent."""
    path = shared.place(spark, "reports")
    for _ in range(2):
        reports.daily_run(_page_views(spark, d).withColumn("site", F.expr(SITED)), path)
    return reports.sent(spark, path).select("day", "text")


@query("""WITH k AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1), s AS (SELECT c.conv_id, c.turn, sha256(c.text) AS digest FROM conversations c JOIN k USING (conv_id, turn)), o AS (SELECT c.conv_id, c.turn, sha256(c.text) AS digest FROM conversations c WHERE turn = 1)
SELECT conv_id, turn, digest FROM s WHERE conv_id % 3 = 0 AND conv_id % 9 <> 0 UNION ALL SELECT conv_id, turn, digest FROM o WHERE conv_id % 3 <> 0""")
def sessions_changed_in_place(spark, d):
    """First turns of all sessions; then the last turns of a third take their place, and a ninth are deleted."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))
    made = keyed.KeyedTable.create(turns.filter("turn = 1"), shared.place(spark, "sessions"), "conv_id", 16)
    made.upsert(turns.filter("conv_id % 3 = 0"), "turn")
    made.delete(turns.filter("conv_id % 9 = 0").select("conv_id"))
    return made.read()
