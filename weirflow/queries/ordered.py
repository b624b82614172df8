"""Queries of declared orders, of running values over the whole table, and of joins by nearness."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators import aggregates as A
from weirflow.operators import bands as B
from weirflow.operators import joins as J
from weirflow.operators import rows as R
from weirflow.operators.order import desc
from weirflow.queries.registry import Tables, query
from weirflow.shared import checkpoint_folder
from weirflow.streaming import stateful as SS

# Declared orders


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) <= 3""")
def order_top(t: Tables) -> DataFrame:
    return A.top(t.orders, 3, ["o_orderpriority desc", desc("o_totalprice"), "o_orderkey"], ["o_custkey"], "row_number").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY rank() OVER (ORDER BY l_shipdate DESC, l_extendedprice DESC) <= 20""")
def order_top_global(t: Tables) -> DataFrame:
    return A.top(t.lineitem, 20, ["l_shipdate desc", "l_extendedprice desc"]).select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_type, 'PROMO') DESC NULLS FIRST, p_name DESC, p_partkey) = 1""")
def order_first_row(t: Tables) -> DataFrame:
    return A.first_row(t.part, ["p_brand"], ["nullif(p_type, 'PROMO') desc nulls first", "p_name desc", "p_partkey"]).select("p_brand", "p_partkey", "p_name")


@query("""SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice < 1000, nullif(p_size, 7) NULLS FIRST, p_name DESC, p_partkey DESC) = 1""")
def order_first_row_reversed(t: Tables) -> DataFrame:
    return A.first_row(t.part, ["p_brand"], ["p_retailprice < 1000 desc", "nullif(p_size, 7) desc", "p_name", "p_partkey"], descending=True).select("p_brand", "p_partkey", "p_name")


@query("""SELECT c_custkey, o_orderkey AS newest, o_orderpriority AS priority FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""")
def order_lookup(t: Tables) -> DataFrame:
    return J.lookup(t.customer.select("c_custkey"), t.orders, [("c_custkey", "o_custkey")], {"newest": "o_orderkey", "priority": "o_orderpriority"}, "first", ["o_orderdate desc", "o_orderpriority desc", "o_orderkey desc"])


@query("""SELECT c_custkey, o_orderkey AS order_key FROM customer JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderdate, o_orderkey) <= 2) ON o_custkey = c_custkey""")
def order_top_per_row(t: Tables) -> DataFrame:
    return J.top_per_row(t.customer.select("c_custkey"), t.orders, [("c_custkey", "o_custkey")], ["o_orderstatus desc", "o_orderdate", "o_orderkey"], 2, {"order_key": "o_orderkey"})


@query("""SELECT o_orderkey, o_custkey, first_value(o_totalprice) OVER w AS price, (o_orderkey = first_value(o_orderkey) OVER w)::INTEGER AS new_lookup_row FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderdate DESC, o_orderkey)""")
def order_dynamic_lookup(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice as price")
    held = rows.limit(0).select("o_custkey", "price")
    return J.dynamic_lookup(rows, held, ["o_custkey"], ["o_orderpriority desc", "o_orderdate desc", "o_orderkey"], ["price"])[0].select("o_orderkey", "o_custkey", "price", "new_lookup_row")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) AS seq FROM orders")
def order_sequence(t: Tables) -> DataFrame:
    return A.sequence(t.orders, "seq", "o_orderpriority desc", ["o_totalprice desc", "o_orderkey"]).select("o_orderkey", "seq")


# Running values without a task that sees all rows

LINES = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
LINE_ORDER = LINES.split(", ")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, sum(cast(l_quantity AS DECIMAL(18,2))) OVER w AS total, count(nullif(l_linenumber, 1)) OVER w AS later_lines, max(l_extendedprice) OVER w AS dearest, min(l_extendedprice) OVER w AS cheapest,
row_number() OVER w AS position, lag(l_returnflag) OVER (ORDER BY {LINES}) AS flag_before, last_value(CASE WHEN l_quantity > 49 THEN l_partkey END IGNORE NULLS) OVER w AS last_large FROM lineitem WINDOW w AS (ORDER BY {LINES} ROWS UNBOUNDED PRECEDING)""")
def running_whole_table(t: Tables) -> DataFrame:
    out = R.running(t.lineitem, LINE_ORDER, total=("sum", "cast(l_quantity as decimal(18,2))"), later_lines=("count", "nullif(l_linenumber, 1)"), dearest=("max", "l_extendedprice"), cheapest=("min", "l_extendedprice"), position=("number", ""), flag_before=("previous", "l_returnflag"), last_large=("last", "case when l_quantity > 49 then l_partkey end"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "total", "later_lines", "dearest", "cheapest", "position", "flag_before", "last_large")


@query(f"""SELECT l_linestatus, l_orderkey, l_linenumber, l_partkey, l_extendedprice, sum(cast(l_quantity AS DECIMAL(18,2))) OVER w AS total, lag(l_suppkey) OVER (PARTITION BY l_linestatus ORDER BY l_shipdate DESC, {LINES}) AS supplier_before FROM lineitem WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_shipdate DESC, {LINES} ROWS UNBOUNDED PRECEDING)""")
def running_hot_keys(t: Tables) -> DataFrame:
    """Few keys with a large share of the rows each."""
    out = R.running(t.lineitem, ["l_shipdate desc", *LINE_ORDER], ["l_linestatus"], ranges=int(t.spark.conf.get("spark.sql.shuffle.partitions")), total=("sum", "cast(l_quantity as decimal(18,2))"), supplier_before=("previous", "l_suppkey"))
    return out.select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "total", "supplier_before")


@query("""SELECT p.event_id, v.event_id AS viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.ts >= v.ts""")
def join_as_of_whole_table(t: Tables) -> DataFrame:
    views = t.events.where("event_type = 'view'").selectExpr("ts as viewed_at", "event_id as viewed")
    return J.as_of(t.events.where("event_type = 'purchase'").select("event_id", "ts"), views, [], "ts", "viewed_at", ["viewed"], ["viewed"]).select("event_id", "viewed")


# Joins by nearness


@query("""SELECT p.event_id AS purchase_id, e.event_id AS error_id FROM events p JOIN events e ON p.event_type = 'purchase' AND e.event_type = 'error' AND e.ts BETWEEN p.ts - INTERVAL 90 SECONDS AND p.ts + INTERVAL 30 SECONDS""")
def join_band_of_times(t: Tables) -> DataFrame:
    """Errors around each purchase, whoever the user is."""
    p = t.events.where("event_type = 'purchase'").selectExpr("event_id as purchase_id", "ts as bought_at")
    e = t.events.where("event_type = 'error'").selectExpr("event_id as error_id", "ts as failed_at")
    return B.band_join(p, e, "bought_at", "failed_at", -90_000_000, 30_000_000).select("purchase_id", "error_id")


@query("""SELECT a.c_custkey AS customer, b.s_suppkey AS supplier FROM customer a JOIN supplier b ON b.s_acctbal BETWEEN a.c_acctbal - 2.5 AND a.c_acctbal + 2.5""")
def join_band_of_amounts(t: Tables) -> DataFrame:
    return B.band_join(t.customer.selectExpr("c_custkey as customer", "c_acctbal"), t.supplier.selectExpr("s_suppkey as supplier", "s_acctbal"), "c_acctbal", "s_acctbal", -2.5, 2.5).select("customer", "supplier")


@query("""WITH spans AS (SELECT o_custkey AS customer, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM orders GROUP BY 1), days AS (SELECT l_shipdate, count(*) AS n, sum(cast(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1)
SELECT customer, sum(n)::BIGINT AS n_lines, sum(q) AS quantity FROM spans JOIN days ON l_shipdate >= first_order AND l_shipdate < last_order GROUP BY 1""")
def join_within_spans(t: Tables) -> DataFrame:
    """Lines shipped between a customer's first and last order; days are added up before they meet the spans."""
    spans = t.orders.groupBy(F.col("o_custkey").alias("customer")).agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))
    days = t.lineitem.groupBy("l_shipdate").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    pairs = B.within(days, spans, "l_shipdate", "first_order", "last_order", "left", width=86_400_000_000)
    return pairs.groupBy("customer").agg(F.sum("n").alias("n_lines"), F.sum("q").alias("quantity"))


@query("""WITH s AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2, ts::DATE)
SELECT x.user_id AS errors_of, y.user_id AS signups_of, count(*) AS n_overlaps FROM s x JOIN s y ON x.event_type = 'error' AND y.event_type = 'signup' AND x.a <= y.b AND y.a <= x.b GROUP BY 1, 2""")
def join_overlapping_spans(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    side = lambda kind, p: s.where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{p}_of"), F.col("a").alias(f"{p}_a"), F.col("b").alias(f"{p}_b"))
    return B.overlap_counts(side("error", "errors"), side("signup", "signups"), "errors_of", "signups_of", ("errors_a", "errors_b"), ("signups_a", "signups_b"), "n_overlaps")


# Streams that remember earlier rows


def _through_a_stream(t: Tables, name: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table read as a stream to its end, and what the stream wrote."""
    table = getattr(t, name)
    folder = f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    stream = made(t.spark.readStream.schema(table.schema).parquet(f"{t.sf_dir}/{name}.parque[t]"))  # a pattern, as a stream's plain path must be a folder
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("""SELECT event_id, user_id, count(nullif(event_type, 'view')) OVER w AS n, max(value) OVER w AS most, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS bought, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS before
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING)""")
def stream_running_state(t: Tables) -> DataFrame:
    ports = {"n": ("count", "nullif(event_type, 'view')"), "most": ("max", "value"), "bought": ("last", "case when event_type = 'purchase' then event_id end"), "before": ("previous", "event_type")}
    made = lambda e: SS.running(e.select("event_id", "user_id", "ts", "event_type", "value"), ["ts desc", "event_id"], ["user_id"], **ports)
    return _through_a_stream(t, "events", made).select("event_id", "user_id", *ports)


@query("""SELECT event_id, user_id, CASE WHEN user_id % 5 = 0 THEN -user_id ELSE first_value(value) OVER w END AS value, (user_id % 5 <> 0 AND event_id = first_value(event_id) OVER w)::INTEGER AS new_lookup_row FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def stream_dynamic_lookup_state(t: Tables) -> DataFrame:
    """Users divisible by five are held from the start."""
    held = t.events.where("user_id % 5 = 0").selectExpr("user_id", "cast(-user_id as double) as value").distinct()
    made = lambda e: SS.dynamic_lookup(e.select("event_id", "user_id", "ts", "value"), held, ["user_id"], ["ts", "event_id"], ["value"])
    return _through_a_stream(t, "events", made).select("event_id", "user_id", "value", "new_lookup_row")
