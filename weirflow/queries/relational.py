"""Queries of the row, join, aggregate and window operators."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators import aggregates as A
from weirflow.operators import joins as J
from weirflow.operators import rows as R
from weirflow.queries.registry import Tables, query

REVENUE = "cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2)))"


@query("""SELECT l_returnflag, l_linestatus, sum(cast(l_quantity AS DECIMAL(18,2))) AS sum_qty, sum(cast(l_extendedprice AS DECIMAL(18,2))) AS sum_price,
sum(cast(l_extendedprice AS DECIMAL(18,2)) * (1 - cast(l_discount AS DECIMAL(18,2)))) AS revenue, count(*) AS n_rows
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q1_pricing_summary(t: Tables) -> DataFrame:
    rows = R.keep(t.lineitem, "l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return A.aggregate(rows, ["l_returnflag", "l_linestatus"], {"sum_qty": "sum(cast(l_quantity as decimal(18,2)))", "sum_price": "sum(cast(l_extendedprice as decimal(18,2)))", "revenue": f"sum({REVENUE})", "n_rows": "count(*)"})


@query("""SELECT c_mktsegment, count(*) AS n_orders, sum(cast(o_totalprice AS DECIMAL(18,2))) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' GROUP BY 1""")
def segment_revenue(t: Tables) -> DataFrame:
    done = R.keep(t.orders, "o_orderstatus = 'F'")
    return A.aggregate(J.join(done, t.customer, [("o_custkey", "c_custkey")]), ["c_mktsegment"], {"n_orders": "count(*)", "revenue": "sum(cast(o_totalprice as decimal(18,2)))"})


@query("""SELECT n_name, sum(cast(l_extendedprice AS DECIMAL(18,2)) * (1 - cast(l_discount AS DECIMAL(18,2)))) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def join_chain_revenue(t: Tables) -> DataFrame:
    # lines are summed by order before anything is joined, and orders by customer
    lines = A.aggregate(t.lineitem, ["l_orderkey"], {"revenue": f"sum({REVENUE})"})
    bought = A.aggregate(J.join(lines, t.orders.select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")]), ["o_custkey"], {"revenue": "sum(revenue)"})
    x = J.join(J.join(bought, t.customer.select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")]), t.nation.select("n_nationkey", "n_name"), [("c_nationkey", "n_nationkey")])
    return A.aggregate(x, ["n_name"], {"revenue": "sum(revenue)"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE nullif(o_orderstatus, 'O') <> 'F'")
def filter_three_valued(t: Tables) -> DataFrame:
    return R.keep(t.orders, "nullif(o_orderstatus, 'O') <> 'F'").select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber % 3) <> 0")
def filter_numeric_truth(t: Tables) -> DataFrame:
    return R.keep(t.lineitem, "l_linenumber % 3").select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, round(cast(l_extendedprice AS DECIMAL(18,2)) * (1 - cast(l_discount AS DECIMAL(18,2))) * (1 + cast(l_tax AS DECIMAL(18,2))), 2) AS charge,
CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'small' END AS size_class FROM lineitem""")
def expression_variable_ports(t: Tables) -> DataFrame:
    return R.with_variables(t.lineitem, {"v_net": REVENUE, "v_gross": "v_net * (1 + cast(l_tax as decimal(18,2)))", "v_class": "case when l_quantity > 25 then 'bulk' else 'small' end"}, {"l_orderkey": None, "l_linenumber": None, "charge": "round(v_gross, 2)", "size_class": "v_class"})


@query("SELECT *, o_totalprice > 100000 AS large FROM orders")
def expression_passthrough(t: Tables) -> DataFrame:
    return R.add_ports(t.orders, {"large": "o_totalprice > 100000"})


@query("""SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous_order, sum(cast(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS running_total, count(o_orderkey) OVER (w ROWS UNBOUNDED PRECEDING) AS running_count
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def stateful_variables(t: Tables) -> DataFrame:
    x = R.running(t.orders, ["o_orderdate", "o_orderkey"], ["o_custkey"], previous_order=("previous", "o_orderkey"), running_total=("sum", "cast(o_totalprice as decimal(18,2))"), running_count=("count", "o_orderkey"))
    return x.select("o_custkey", "o_orderkey", "previous_order", "running_total", "running_count")


@query("SELECT event_id, user_id, value FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-10')")
def incremental_watermark(t: Tables) -> DataFrame:
    held = t.events.filter("event_type = 'signup' and ts < timestamp_ntz'2024-01-10 00:00:00'")
    return R.newer_than(t.events, "ts", held).select("event_id", "user_id", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 50000")
def sql_with_parameters(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least", args={"status": "P", "least": 50000}, orders=t.orders)


def _few(t: Tables, name: str) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", F.lit(name).alias("tag"))


FEW = "(SELECT o_orderkey, o_custkey, 'x' AS tag FROM orders)"
PART = "(SELECT c_custkey, c_name, 'y' AS tag FROM customer WHERE c_mktsegment <> 'BUILDING')"

for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    @query(f"SELECT o_orderkey, o_custkey, o.tag AS tag, c_custkey, c_name, c.tag AS r_tag FROM {FEW} o {_sql} {PART} c ON o_custkey = c_custkey", name=f"join_{_how}")
    def _join(t: Tables, how: str = _how) -> DataFrame:
        return J.join(_few(t, "x"), t.customer.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", F.lit("y").alias("tag")), [("o_custkey", "c_custkey")], how)


@query(f"SELECT coalesce(o.k, c.k) AS k, o_orderkey, c_name FROM (SELECT o_orderkey, o_custkey AS k FROM {FEW}) o FULL JOIN (SELECT c_custkey AS k, c_name FROM {PART}) c ON o.k = c.k")
def join_using_full(t: Tables) -> DataFrame:
    return J.join(_few(t, "x").select("o_orderkey", F.col("o_custkey").alias("k")), t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), "c_name"), ["k"], "full").select("k", "o_orderkey", "c_name")


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def join_master_outer(t: Tables) -> DataFrame:
    return J.join(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), t.customer.filter("c_acctbal > 0").select("c_custkey", "c_name"), [("o_custkey", "c_custkey")], "Master Outer").select("o_orderkey", "o_totalprice", "c_name")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t: Tables) -> DataFrame:
    return J.join(t.nation.select("n_name"), t.region.select("r_name"), [])


@query("SELECT a.n_name AS n_name, b.n_name AS r_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    return J.join(n, n.withColumnRenamed("n_regionkey", "region2"), [("n_regionkey", "region2")], condition="n_nationkey < r_n_nationkey").select("n_name", "r_n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(t: Tables) -> DataFrame:
    return J.semi(t.customer, t.orders.filter("o_totalprice > 200000"), [("c_custkey", "o_custkey")]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t: Tables) -> DataFrame:
    return J.anti(t.customer, t.orders, [("c_custkey", "o_custkey")]).select("c_custkey", "c_name")


for _match, _dir in (("first", "ASC"), ("last", "DESC")):

    @query(f"""SELECT c_custkey, o_orderkey AS order_key, o_totalprice AS price FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {_dir}, o_orderkey {_dir}) AS rn FROM orders) o
    ON c_custkey = o_custkey AND rn = 1""", name=f"lookup_{_match}_match")
    def _lookup(t: Tables, match: str = _match) -> DataFrame:
        return J.lookup(t.customer.select("c_custkey"), t.orders, [("c_custkey", "o_custkey")], {"order_key": "o_orderkey", "price": "o_totalprice"}, match, ["o_orderdate", "o_orderkey"])


@query("SELECT c_custkey, o_orderkey AS order_key FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') o ON c_custkey = o_custkey")
def lookup_all(t: Tables) -> DataFrame:
    return J.lookup(t.customer.select("c_custkey"), t.orders, [("c_custkey", "o_custkey")], {"order_key": "o_orderkey"}, "all", source_filter="o_orderstatus = 'O'")


@query("""SELECT c_custkey, o_orderkey AS order_key, o_totalprice AS price FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY -o_totalprice, o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey AND rn <= 2""")
def cross_apply_top(t: Tables) -> DataFrame:
    return J.top_per_row(t.customer.select("c_custkey"), t.orders, [("c_custkey", "o_custkey")], ["-o_totalprice", "o_orderkey"], 2, {"order_key": "o_orderkey", "price": "o_totalprice"})


@query("""SELECT event_id, user_id, login_id FROM (SELECT event_id, user_id, ts, (event_type = 'purchase') AS p, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS login_id FROM events) WHERE p""")
def join_as_of(t: Tables) -> DataFrame:
    e = t.events
    return J.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("login_ts"), F.col("event_id").alias("login_id")), ["user_id"], "ts", "login_ts", ["login_id"]).select("event_id", "user_id", "login_id")


@query("""WITH RECURSIVE h AS (SELECT c_custkey, 1 AS level, c_custkey::VARCHAR AS path FROM customer WHERE c_custkey < 4 UNION ALL
SELECT c.c_custkey, h.level + 1, h.path || '/' || c.c_custkey FROM customer c JOIN h ON c.c_custkey // 4 = h.c_custkey WHERE c.c_custkey >= 4)
SELECT c_custkey, level, path FROM h WHERE c_custkey > 0""")
def hierarchy_levels(t: Tables) -> DataFrame:
    tree = t.customer.select("c_custkey", F.when(F.col("c_custkey") >= 4, F.floor(F.col("c_custkey") / 4)).alias("boss")).filter("c_custkey > 0")
    return J.hierarchy(tree, "c_custkey", "boss", "c_custkey < 4").select("c_custkey", "level", "path")


@query("""SELECT l_suppkey, count(*) AS n, sum(cast(l_quantity AS DECIMAL(18,2))) AS qty FROM lineitem GROUP BY 1 HAVING count(*) > 40""")
def agg_having(t: Tables) -> DataFrame:
    return A.aggregate(t.lineitem, ["l_suppkey"], {"n": "count(*)", "qty": "sum(cast(l_quantity as decimal(18,2)))"}, having="n > 40")


@query("SELECT count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, sum(cast(l_tax AS DECIMAL(18,4))) AS tax FROM lineitem")
def agg_global(t: Tables) -> DataFrame:
    return A.aggregate(t.lineitem, [], {"n": "count(*)", "first_ship": "min(l_shipdate)", "last_ship": "max(l_shipdate)", "tax": "sum(cast(l_tax as decimal(18,4)))"})


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg_distinct(t: Tables) -> DataFrame:
    return A.aggregate(t.lineitem, ["l_returnflag"], {"suppliers": "count(distinct l_suppkey)", "parts": "count(distinct l_partkey)"})


@query("SELECT year(o_orderdate)::BIGINT AS order_year, month(o_orderdate)::BIGINT AS order_month, count(*) AS n FROM orders GROUP BY ALL")
def agg_derived_keys(t: Tables) -> DataFrame:
    return A.aggregate(t.orders, {"order_year": "cast(year(o_orderdate) as bigint)", "order_month": "cast(month(o_orderdate) as bigint)"}, {"n": "count(*)"})


@query("SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_disc(l_quantity, 0.25) AS q25 FROM lineitem GROUP BY 1")
def agg_percentile_median(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.median("l_quantity").alias("med"), A.percentile("l_extendedprice", 90).alias("p90"), A.nearest_rank("l_quantity", 25).alias("q25"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_string_join(t: Tables) -> DataFrame:
    return J.join(t.nation, t.region, [("n_regionkey", "r_regionkey")]).groupBy("r_name").agg(A.string_join("n_name", ",").alias("nations"))


@query("""SELECT o_custkey, min(o_totalprice) AS low, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS high_done, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1""")
def agg_first_last(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(A.first_value("o_totalprice").alias("low"), A.last_value("o_totalprice", "o_orderstatus = 'F'").alias("high_done"), A.first_value("o_orderkey", order="struct(o_orderdate, o_orderkey)").alias("first_order"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS var FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)""")
def agg_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_samp("l_quantity"), 6).alias("var"))


@query("""SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def dedup_keep_first(t: Tables) -> DataFrame:
    return A.first_row(t.events.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT event_type, sum(cast(value AS DECIMAL(18,4))) AS used, max(cast(value AS DECIMAL(18,4))) AS greatest, arg_max(cast(value AS DECIMAL(18,4)), (ts, value)) AS last, count(DISTINCT coalesce(CASE WHEN user_id % 7 <> 0 THEN user_id END::VARCHAR, 'missing')) AS distinct_values FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def metering_sum_distinct_last(t: Tables) -> DataFrame:
    e = t.events.withColumn("who", F.expr("case when user_id % 7 <> 0 then user_id end")).withColumn("value", F.expr("cast(value as decimal(18,4))"))
    return A.metered(e, ["event_type"], "value", "ts", datetime.datetime(1970, 1, 1), datetime.datetime(2024, 1, 20), distinct="who")


@query("""SELECT coalesce(e.user_id, a.user_id) AS user_id, coalesce(e.n, 0) + coalesce(a.d, 0) AS used FROM (SELECT user_id, sum(event_id) AS n FROM events WHERE event_type <> 'purchase' GROUP BY 1) e
FULL JOIN (SELECT user_id, sum(-1 * event_id) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1) a ON e.user_id = a.user_id""")
def metering_adjustments(t: Tables) -> DataFrame:
    e = t.events.filter("event_type <> 'purchase'")
    a = t.events.filter("event_type = 'purchase'").select("user_id", "ts", (-F.col("event_id")).alias("delta"))
    return A.metered(e, ["user_id"], "event_id", "ts", datetime.datetime(1970, 1, 1), datetime.datetime(2100, 1, 1), adjustments=a).select("user_id", "used")


@query("""SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 7 ELSE n END AS n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)""")
def metering_finalised(t: Tables) -> DataFrame:
    fresh = A.aggregate(t.orders, ["o_orderstatus"], {"n": "count(*)"})
    frozen = t.orders.filter("o_orderstatus = 'F'").select("o_orderstatus", F.lit(7).cast("long").alias("n")).distinct()
    return A.finalised(fresh, frozen, ["o_orderstatus"], ["n"])


for _kind, _keep in (("rank", "rank"), ("dense_rank", "dense_rank"), ("row_number", "row_number")):
    _order = "l_quantity DESC" + (", l_orderkey, l_linenumber" if _kind == "row_number" else "")

    @query(f"SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, r AS position FROM (SELECT *, {_kind}() OVER (PARTITION BY l_suppkey ORDER BY {_order}) AS r FROM lineitem) WHERE r <= 3", name=f"rank_topn_{_kind}")
    def _rank(t: Tables, kind: str = _kind) -> DataFrame:
        order = ["-l_quantity"] + (["l_orderkey", "l_linenumber"] if kind == "row_number" else [])
        return A.top(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), 3, order, ["l_suppkey"], kind, "position")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_limit(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""SELECT o_custkey, o_orderkey, lag(o_totalprice, 1) OVER w AS before, lead(o_totalprice, 1) OVER w AS after, ntile(4) OVER w AS quarter, first_value(o_orderkey) OVER w AS first_key FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_lag_lead_ntile(t: Tables) -> DataFrame:
    x = A.neighbours(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"before": ("lag", "o_totalprice", 1), "after": ("lead", "o_totalprice", 1), "quarter": ("ntile", "", 4), "first_key": ("first_value", "o_orderkey", 0)})
    return x.select("o_custkey", "o_orderkey", "before", "after", "quarter", "first_key")


@query("""SELECT user_id, event_id, sum(cast(value AS DECIMAL(18,4))) OVER w AS total7, count(*) OVER w AS n7 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def window_rolling_7(t: Tables) -> DataFrame:
    e = t.events.withColumn("v", F.expr("cast(value as decimal(18,4))"))
    return A.moving(e, ["user_id"], ["ts", "event_id"], 7, {"total7": ("sum", "v"), "n7": ("count", "event_id")}).select("user_id", "event_id", "total7", "n7")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 1 AND count(*) OVER (PARTITION BY o_custkey) > 3")
def qualify_topn(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return A.qualify(o, {"r": "rank() over (partition by o_custkey order by o_totalprice desc)", "n": "count(*) over (partition by o_custkey)"}, "r = 1 and n > 3")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) * 5 + 1000 AS seq FROM orders")
def sequence_offset(t: Tables) -> DataFrame:
    return A.sequence(t.orders.select("o_orderkey", "o_orderdate"), "seq", "o_orderdate", ["o_orderkey"], start=1000, step=5).select("o_orderkey", "seq")


@query("SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1) % 10 + 1 AS seq FROM nation")
def sequence_cycle(t: Tables) -> DataFrame:
    return A.sequence(t.nation.select("n_nationkey"), "seq", "n_nationkey", cycle=10)


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_positional(t: Tables) -> DataFrame:
    return R.union_by_position([t.customer.select("c_custkey", "c_name", "c_acctbal"), t.supplier.select("s_suppkey", "s_name", "s_acctbal")], ["key", "name", "balance"])


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return R.union_by_position([t.customer.select("c_nationkey"), t.supplier.select("s_nationkey")], ["nationkey"], distinct=True)


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("key")).subtract(t.orders.select("o_custkey"))


@query("SELECT DISTINCT lower(o_orderpriority) AS priority, o_orderstatus FROM orders")
def sorter_distinct(t: Tables) -> DataFrame:
    return t.orders.select(F.lower("o_orderpriority").alias("priority"), "o_orderstatus").distinct()


GROUPS = {"BIG": "l_quantity > 40", "CHEAP": "l_extendedprice < 5000", "RETURNED": "nullif(l_returnflag, 'N') = 'R'"}


@query("""SELECT l_orderkey, l_linenumber, 'BIG' AS route_group FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT l_orderkey, l_linenumber, 'CHEAP' FROM lineitem WHERE l_extendedprice < 5000
UNION ALL SELECT l_orderkey, l_linenumber, 'RETURNED' FROM lineitem WHERE nullif(l_returnflag, 'N') = 'R'
UNION ALL SELECT l_orderkey, l_linenumber, 'DEFAULT' FROM lineitem WHERE NOT coalesce(l_quantity > 40, false) AND NOT coalesce(l_extendedprice < 5000, false) AND NOT coalesce(nullif(l_returnflag, 'N') = 'R', false)""")
def router_multi_match(t: Tables) -> DataFrame:
    return R.route(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"), GROUPS).select("l_orderkey", "l_linenumber", "route_group")


@query("""SELECT CASE WHEN l_quantity > 40 THEN 'BIG' WHEN l_extendedprice < 5000 THEN 'CHEAP' WHEN nullif(l_returnflag, 'N') = 'R' THEN 'RETURNED' ELSE 'DEFAULT' END AS route_group, count(*) AS n FROM lineitem GROUP BY 1""")
def router_first_match(t: Tables) -> DataFrame:
    return R.route(t.lineitem, GROUPS, mode="first").groupBy("route_group").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'DELETE' WHEN nullif(o_totalprice, 0) < 20000 THEN 'REJECT' WHEN o_orderkey % 2 = 0 THEN 'UPDATE' ELSE 'INSERT' END AS row_action, count(*) AS n FROM orders GROUP BY 1""")
def update_strategy(t: Tables) -> DataFrame:
    x = R.update_strategy(t.orders, [("o_orderstatus = 'P'", "DD_DELETE"), ("nullif(o_totalprice, 0) < 20000", 3), ("o_orderkey % 2 = 0", "DD_UPDATE")], "DD_INSERT")
    return x.groupBy("row_action").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, 1 AS gcid, 'price' AS kind, l_extendedprice AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, 'discount', l_discount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 3, 'tax', nullif(l_tax, 0.0) FROM lineitem""")
def normalizer_unpivot(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", F.expr("nullif(l_tax, 0.0D)").alias("t3"), F.lit("price").alias("k1"), F.lit("discount").alias("k2"), F.lit("tax").alias("k3"))
    return R.normalize(x, {"kind": ["k1", "k2", "k3"], "amount": ["l_extendedprice", "l_discount", "t3"]}, ["l_orderkey", "l_linenumber"])


@query("""SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS A_n, sum(cast(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'A') AS A_qty,
count(*) FILTER (WHERE l_returnflag = 'R') AS R_n, sum(cast(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS R_qty FROM lineitem GROUP BY 1""")
def pivot_returnflag(t: Tables) -> DataFrame:
    return R.denormalize(t.lineitem, ["l_linestatus"], "l_returnflag", ["A", "R"], {"n": "count(*)", "qty": "sum(cast(l_quantity as decimal(18,2)))"})


@query("SELECT l_returnflag, sum(n) AS n, max(top) AS top FROM (SELECT l_returnflag, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY 1) GROUP BY 1")
def agg_incremental(t: Tables) -> DataFrame:
    part = lambda c: A.aggregate(t.lineitem.filter(c), ["l_returnflag"], {"n": "count(*)", "top": "max(l_quantity)"})
    return A.accumulate(part("l_orderkey % 3 = 0"), part("l_orderkey % 3 <> 0"), ["l_returnflag"], {"n": "sum", "top": "max"})


@query("""SELECT event_type, count(*) AS n_runs, count(*) FILTER (WHERE NOT user_id % 9 <> 0) * 100.0 / count(*) AS failure_rate, round(avg(value), 6) AS mean_duration, median(value) AS median_duration, quantile_disc(value, 0.95) AS p95,
count(*) FILTER (WHERE NOT user_id % 9 <> 0) * 100.0 / count(*) <= 11 AND quantile_disc(value, 0.95) <= 40 AS met FROM events GROUP BY 1""")
def run_health(t: Tables) -> DataFrame:
    return A.health(t.events, ["event_type"], "user_id % 9 <> 0", "value", slow=40, failing=11).withColumn("mean_duration", F.round("mean_duration", 6))


@query("SELECT a.n_name AS n_name, b.n_name AS other, levenshtein(a.n_name, b.n_name)::INTEGER AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE levenshtein(a.n_name, b.n_name) <= 6")
def fuzzy_match(t: Tables) -> DataFrame:
    other = t.nation.selectExpr("n_nationkey as k2", "n_name as other", "n_regionkey as r2")
    return J.fuzzy_match(t.nation, other, ("n_regionkey", "r2"), "n_name", "other", 6).filter("n_nationkey < k2").select("n_name", "other", "distance")


@query("""WITH f AS (SELECT o_custkey, arg_min((o_orderkey, o_totalprice), (o_orderdate, o_orderkey)) AS r FROM orders GROUP BY 1), t AS (SELECT c_custkey, c_nationkey AS key, c_acctbal AS price FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT o_orderkey, o.o_custkey AS o_custkey, coalesce(t.price, f.r[2]) AS price, CASE WHEN t.c_custkey IS NULL AND f.r[1] = o_orderkey THEN 1 ELSE 0 END AS new_lookup_row FROM orders o JOIN f ON o.o_custkey = f.o_custkey LEFT JOIN t ON t.c_custkey = o.o_custkey""")
def lookup_dynamic(t: Tables) -> DataFrame:
    held = t.customer.filter("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey as o_custkey", "c_acctbal as price")
    rows = t.orders.selectExpr("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice as price")
    return J.dynamic_lookup(rows, held, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["price"])[0].select("o_orderkey", "o_custkey", "price", "new_lookup_row")


@query("""SELECT c_custkey AS o_custkey, c_acctbal AS price FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL
SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1""")
def lookup_dynamic_table(t: Tables) -> DataFrame:
    held = t.customer.filter("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey as o_custkey", "c_acctbal as price")
    return J.dynamic_lookup(t.orders.selectExpr("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice as price"), held, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["price"])[1]


@query("""WITH k AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS gk FROM orders) SELECT o_orderkey, gk, 1 AS gcid, o_orderstatus AS label FROM k UNION ALL SELECT o_orderkey, gk, 2, o_orderpriority FROM k""")
def normalizer_generated_key(t: Tables) -> DataFrame:
    return R.normalize_keyed(t.orders, {"label": ["o_orderstatus", "o_orderpriority"]}, ["o_orderkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT least(25, count(*)) AS n, true AS of_orders FROM orders")
def rownum_before_sort(t: Tables) -> DataFrame:
    some = R.first_rows(t.orders, 25, ["o_totalprice"])
    return some.join(t.orders.select(F.col("o_orderkey").alias("k")), F.col("o_orderkey") == F.col("k"), "left").agg(F.count("*").alias("n"), F.bool_and(F.col("k").isNotNull()).alias("of_orders"))


@query("""SELECT p_partkey, CASE WHEN fits THEN regexp_extract(p_brand, '^Brand#([1-3])([0-9])$', 1) END AS head, CASE WHEN fits THEN regexp_extract(p_brand, '^Brand#([1-3])([0-9])$', 2) END AS tail, NOT fits AS rejected
FROM (SELECT *, regexp_full_match(p_brand, 'Brand#[1-3][0-9]') AS fits FROM part)""")
def parser_fields(t: Tables) -> DataFrame:
    """Brands of one digit do not fit."""
    return R.parse_fields(t.part, "p_brand", "Brand#([1-3])([0-9])", ["head", "tail"], "rejected").select("p_partkey", "head", "tail", "rejected")


@query("SELECT p_partkey, p_brand AS brand, p_size AS size FROM part")
def xml_round_trip(t: Tables) -> DataFrame:
    x = R.render_xml(t.part, ["p_partkey", "p_brand", "p_size"], "part")
    return R.parse_xml(x.select("xml"), "xml", "p_partkey bigint, p_brand string, p_size int").select("parsed.p_partkey", F.col("parsed.p_brand").alias("brand"), F.col("parsed.p_size").alias("size"))


@query("""SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""")
def merge_survivors(t: Tables) -> DataFrame:
    return A.survivors(t.events, ["user_id"], {"value": ("latest", "struct(ts, event_id)"), "event_type": ("earliest", "struct(ts, event_id)")})


@query("""SELECT greatest(max(o_totalprice), 100.0) AS top, least(min(o_orderkey), 5) AS low, 7 + count(*) FILTER (WHERE o_orderstatus = 'F') - count(*) FILTER (WHERE o_orderstatus = 'P') AS n, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last FROM orders""")
def mapping_variables(t: Tables) -> DataFrame:
    act = "case o_orderstatus when 'F' then 'INSERT' when 'P' then 'DELETE' else 'UPDATE' end"
    return A.mapping_variables(t.orders, {"top": 100.0, "low": 5, "n": 7, "last": ""}, {"top": ("max", "o_totalprice"), "low": ("min", "o_orderkey"), "n": ("count", act), "last": ("set", "o_orderpriority")}, "struct(o_orderdate, o_orderkey)")


@query("SELECT a.n_name AS n_name, b.r_name AS r_name FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 4")
def join_non_equi(t: Tables) -> DataFrame:
    return J.join(t.nation, t.region, [], condition="n_nationkey > r_regionkey * 4").select("n_name", "r_name")


@query("""SELECT c_custkey, o_orderkey AS order_key FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey AND rn <= 1""")
def outer_apply_top(t: Tables) -> DataFrame:
    return J.top_per_row(t.customer.select("c_custkey"), t.orders, [("c_custkey", "o_custkey")], ["o_totalprice", "o_orderkey"], 1, {"order_key": "o_orderkey"}, outer=True)


@query("SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except_all(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderstatus").exceptAll(t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderstatus"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority ILIKE '%high%' AND regexp_matches(o_orderpriority, '^[0-9]-')")
def filter_predicates(t: Tables) -> DataFrame:
    return R.keep(t.orders, "o_orderstatus in ('F', 'P') and o_totalprice between 1000 and 200000 and o_orderpriority ilike '%high%' and o_orderpriority rlike '^[0-9]-'").select("o_orderkey")
