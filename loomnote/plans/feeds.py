"""Queries of feeds, costs, backlogs, windows and versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tables
from ..tables import table
from .base import query


@query("cost_rollup_grouping_sets", "SELECT event_type AS consumer, user_id % 3 AS model, count(*) AS calls, round(sum(value), 4) AS cost, count(*) FILTER (WHERE value > 90) AS dear FROM events GROUP BY GROUPING SETS ((), (event_type), (event_type, user_id % 3))")
def cost_rollup_grouping_sets(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("consumer"), (F.col("user_id") % 3).alias("model"), "value")
    return calls.groupingSets([[], ["consumer"], ["consumer", "model"]], "consumer", "model").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.count_if(F.col("value") > 90).alias("dear"))


@query("daily_spend", "SELECT CAST(ts AS DATE) AS day, round(sum(value), 4) AS spend, count(*) AS calls FROM events WHERE event_type <> 'view' GROUP BY 1")
def daily_spend(spark, sf):
    return table(spark, sf, "events").where("event_type <> 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("spend"), F.count("*").alias("calls"))


@query("keyset_page", "SELECT event_id, ts, event_type FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 5000) ORDER BY ts DESC, event_id DESC LIMIT 50")
def keyset_page(spark, sf):
    cursor = (F.lit("2024-01-20").cast("timestamp"), 5000)
    return tables.keyset_page(table(spark, sf, "events").select("event_id", "ts", "event_type"), cursor, "ts", "event_id", 50)


@query("offset_page", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25 OFFSET 50")
def offset_page(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").offset(50).limit(25)


@query("activity_union", "SELECT source, kind, count(*) AS n FROM (SELECT 'event' AS source, event_type AS kind FROM events UNION ALL SELECT 'order', o_orderpriority FROM orders UNION ALL SELECT 'turn', role FROM conversations) GROUP BY 1, 2")
def activity_union(spark, sf):
    feed = lambda t, name, kind: table(spark, sf, t).select(F.lit(name).alias("source"), F.col(kind).alias("kind"))
    return feed("events", "event", "event_type").unionByName(feed("orders", "order", "o_orderpriority")).unionByName(feed("conversations", "turn", "role")).groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("timeline_velocity", """WITH b AS (SELECT unnest(range(0, 62)) AS i) SELECT TIMESTAMP '2024-01-01 05:00:00' + i * INTERVAL 12 HOUR AS bucket, count(event_id) AS n
FROM b LEFT JOIN events ON ts >= TIMESTAMP '2024-01-01 05:00:00' + i * INTERVAL 12 HOUR AND ts < TIMESTAMP '2024-01-01 05:00:00' + (i + 1) * INTERVAL 12 HOUR AND ts < TIMESTAMP '2024-02-01 05:00:00' GROUP BY i""")
def timeline_velocity(spark, sf):
    return tables.timeline(table(spark, sf, "events"), "2024-01-01 05:00:00", "2024-02-01 05:00:00", 12)


@query("lane_pivot", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def lane_pivot(spark, sf):
    lanes = ["view", "click", "purchase"]
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", lanes).agg(F.count(F.lit(1))).fillna(0, lanes)


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("sliding_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS start, count(*) AS n FROM events, range(0, 2) r(i) GROUP BY 1")
def sliding_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("session_counts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, i""")
def session_counts(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("gaps_islands", """WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2), c AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) > 60 THEN 1 ELSE 0 END AS cut FROM d),
i AS (SELECT *, sum(cut) OVER (PARTITION BY o_custkey ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM c) SELECT o_custkey, CAST(island AS BIGINT) AS island, min(day) AS first_day, max(day) AS last_day, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY 1, 2""")
def gaps_islands(spark, sf):
    return tables.islands(table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), "o_custkey", "day", 60)


@query("backlog_delta", """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta, coalesce(n > lag(n) OVER (ORDER BY day), false) AS growing FROM d""")
def backlog_delta(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("day"))
    return d.select("day", "n", (F.col("n") - before).alias("delta"), F.coalesce(F.col("n") > before, F.lit(False)).alias("growing"))


@query("mode_with_tiebreak", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def mode_with_tiebreak(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query("pending_backlog", """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars WHEN doc_id % 4 = 1 THEN n_chars // 2 WHEN doc_id % 4 = 2 THEN n_chars + 10 END AS bytes FROM documents)
SELECT source, count(*) FILTER (WHERE s.bytes IS NULL) AS unseen, count(*) FILTER (WHERE s.bytes = n_chars) AS drained, count(*) FILTER (WHERE s.bytes <> n_chars) AS pending, CAST(sum(CASE WHEN s.bytes IS NULL OR s.bytes > n_chars THEN n_chars ELSE n_chars - s.bytes END) AS BIGINT) AS pending_bytes FROM documents JOIN s USING (doc_id) GROUP BY source""")
def pending_backlog(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    state = docs.where("doc_id % 4 <> 3").select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars DIV 2 ELSE n_chars + 10 END").alias("bytes"))
    left = F.when(F.col("bytes").isNull() | (F.col("bytes") > F.col("n_chars")), F.col("n_chars")).otherwise(F.col("n_chars") - F.col("bytes"))
    return docs.join(state, "doc_id", "left").groupBy("source").agg(
        F.count_if(F.col("bytes").isNull()).alias("unseen"), F.count_if(F.col("bytes") == F.col("n_chars")).alias("drained"), F.count_if(F.col("bytes") != F.col("n_chars")).alias("pending"), F.sum(left).alias("pending_bytes"),
    )


@query("index_tombstones", """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'delete' WHEN doc_id % 10 = 1 THEN 'insert' WHEN doc_id % 10 = 2 THEN 'update' ELSE 'keep' END AS action, CASE WHEN doc_id % 10 = 1 THEN 1 WHEN doc_id % 10 = 2 THEN 4 ELSE 3 END AS generation FROM documents""")
def index_tombstones(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    state = docs.where("doc_id % 10 <> 1").withColumn("hash", F.when(F.col("doc_id") % 10 == 2, "old").otherwise(F.col("hash"))).withColumn("generation", F.lit(3))
    return tables.reconcile(state, docs.where("doc_id % 10 <> 0"), "doc_id")


@query("scd2_close", """SELECT c_custkey, day, status, lead(day) OVER w AS valid_to, lead(day) OVER w IS NULL AS current FROM (SELECT o_custkey AS c_custkey, CAST(o_orderdate AS DATE) AS day, max(o_orderstatus) AS status FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY c_custkey ORDER BY day)""")
def scd2_close(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_orderstatus").alias("status"))
    return tables.close_versions(rows, "c_custkey", "day")


@query("prune_raw", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 365 > 90")
def prune_raw(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 365 > 90").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("set_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("set_except", "SELECT l_orderkey, l_suppkey FROM lineitem EXCEPT ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1")
def set_except(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select("l_orderkey", "l_suppkey").exceptAll(line.where("l_linenumber = 1").select("l_orderkey", "l_suppkey"))


@query("cluster_cohesion", """WITH o AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS e FROM lineitem), n AS (SELECT id, count(*) AS n FROM o GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM o a JOIN o b ON a.e = b.e AND a.id < b.id AND a.id // 10 = b.id // 10 GROUP BY 1, 2),
g AS (SELECT id // 10 AS cluster, count(*) AS m FROM n GROUP BY 1) SELECT g.cluster, m AS members, round(coalesce(sum(p.c / CAST(x.n + y.n - p.c AS DOUBLE)), 0) / (m * (m - 1) / 2.0::DOUBLE), 3) AS cohesion FROM g LEFT JOIN p ON p.a // 10 = g.cluster LEFT JOIN n x ON x.id = p.a LEFT JOIN n y ON y.id = p.b WHERE m > 1 GROUP BY 1, 2""")
def cluster_cohesion(spark, sf):
    o = table(spark, sf, "lineitem").select(F.expr("l_orderkey DIV 10").alias("cluster"), F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("e")).distinct()
    sized = o.join(o.groupBy("id").agg(F.count("*").alias("n")), "id")
    a, b = sized.alias("a"), sized.alias("b")
    pair = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.e") == F.col("b.e")) & (F.col("a.id") < F.col("b.id")))
    shared = pair.groupBy(F.col("a.cluster").alias("cluster"), F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.col("a.n").alias("n"), F.col("b.n").alias("m")).agg(F.count("*").alias("c"))
    total = shared.groupBy("cluster").agg(F.sum(F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("s"))
    members = o.groupBy("cluster").agg(F.countDistinct("id").alias("members")).where("members > 1")
    return members.join(total, "cluster", "left").select("cluster", "members", F.round(F.coalesce("s", F.lit(0.0)) / (F.col("members") * (F.col("members") - 1) / 2), 3).alias("cohesion"))
