"""Queries of the load strategies, the reconciliation and the streaming semantics."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.graph import traverse as G
from weirflow.operators import joins as J
from weirflow.operators import loads as L
from weirflow.operators import rows as R
from weirflow.quality import classify as C
from weirflow.quality import reconcile as Q
from weirflow.queries.registry import Tables, query
from weirflow.sources import files
from weirflow.streaming import changes as S
from weirflow.streaming import windows as W

NOW = datetime.datetime(2024, 6, 1)
BASE = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT')"
DELTA = "(SELECT o_orderkey, o_custkey + 1 AS o_custkey, o_totalprice * 2 AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'DELETE' WHEN o_orderkey % 11 = 0 THEN 'REJECT' WHEN o_orderpriority = '1-URGENT' THEN 'INSERT' ELSE 'UPDATE' END AS row_action FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))"


def _base(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_custkey", "o_totalprice")


def _delta(t: Tables) -> DataFrame:
    d = t.orders.filter("o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW')").selectExpr("o_orderkey", "o_custkey + 1 as o_custkey", "o_totalprice * 2 as o_totalprice", "o_orderpriority")
    return R.update_strategy(d, [("o_orderkey % 7 = 0", "DELETE"), ("o_orderkey % 11 = 0", "REJECT"), ("o_orderpriority = '1-URGENT'", "INSERT")], "UPDATE").drop("o_orderpriority")


@query(f"""SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN s.row_action = 'UPDATE' OR t.o_orderkey IS NULL THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
CASE WHEN s.row_action = 'UPDATE' OR t.o_orderkey IS NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice FROM {BASE} t FULL JOIN {DELTA} s ON t.o_orderkey = s.o_orderkey
WHERE (t.o_orderkey IS NOT NULL AND coalesce(s.row_action, '') <> 'DELETE') OR (t.o_orderkey IS NULL AND s.row_action = 'INSERT')""")
def merge_iud(t: Tables) -> DataFrame:
    return L.merge(_base(t), _delta(t), ["o_orderkey"], action="row_action")


@query(f"""SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_custkey, s.o_custkey) AS o_custkey, CASE WHEN t.o_orderkey IS NULL OR s.o_totalprice > t.o_totalprice THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice
FROM {BASE} t FULL JOIN {DELTA} s ON t.o_orderkey = s.o_orderkey WHERE t.o_orderkey IS NULL OR s.o_orderkey IS NULL OR s.o_totalprice <= 400000""")
def merge_conditions(t: Tables) -> DataFrame:
    return L.merge(_base(t), _delta(t), ["o_orderkey"], delete="s.o_totalprice > 400000", update="s.o_totalprice > t.o_totalprice", columns=["o_totalprice"])


@query(f"SELECT * FROM {BASE} t WHERE NOT EXISTS (SELECT 1 FROM {DELTA} s WHERE s.o_custkey = t.o_custkey) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM {DELTA}")
def delete_insert(t: Tables) -> DataFrame:
    return L.delete_insert(_base(t), _delta(t), ["o_custkey"])


@query(f"SELECT * FROM {BASE} UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM {DELTA}")
def append(t: Tables) -> DataFrame:
    return L.append(_base(t), _delta(t))


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM {DELTA} WHERE row_action = 'REJECT'")
def rejects(t: Tables) -> DataFrame:
    return L.rejects(_delta(t))[1].select("o_orderkey", "o_custkey", "o_totalprice")


CUSTOMERS = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 <> 3 THEN c_mktsegment END AS segment FROM customer WHERE c_mktsegment <> 'MACHINERY')"
ARRIVING = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'CHANGED' ELSE c_mktsegment END AS segment FROM customer WHERE c_mktsegment <> 'FURNITURE')"


def _customers(t: Tables) -> DataFrame:
    return t.customer.filter("c_mktsegment <> 'MACHINERY'").selectExpr("c_custkey", "c_name", "case when c_custkey % 10 <> 3 then c_mktsegment end as segment")


def _arriving(t: Tables) -> DataFrame:
    return t.customer.filter("c_mktsegment <> 'FURNITURE'").selectExpr("c_custkey", "c_name", "case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then 'CHANGED' else c_mktsegment end as segment")


@query(f"""SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(t.c_name, s.c_name) AS c_name, CASE WHEN s.c_custkey IS NOT NULL THEN s.segment ELSE t.segment END AS segment FROM {CUSTOMERS} t FULL JOIN {ARRIVING} s ON t.c_custkey = s.c_custkey""")
def scd1(t: Tables) -> DataFrame:
    return L.scd1(_customers(t), _arriving(t), ["c_custkey"], ["segment"])


def _versions(t: Tables) -> DataFrame:
    return _customers(t).selectExpr("c_custkey", "c_name", "segment", "timestamp_ntz'2024-01-01 00:00:00' as valid_from", "cast(null as timestamp_ntz) as valid_to", "'Y' as flag")


@query(f"""WITH x AS (SELECT t.*, s.c_custkey AS k, s.segment AS new FROM {CUSTOMERS} t LEFT JOIN {ARRIVING} s ON t.c_custkey = s.c_custkey), y AS (SELECT *, k IS NOT NULL AND new IS DISTINCT FROM segment AS closes FROM x)
SELECT c_custkey, c_name, segment, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN closes THEN TIMESTAMP '2024-06-01' END AS valid_to, CASE WHEN closes THEN 'N' ELSE 'Y' END AS flag FROM y
UNION ALL SELECT c_custkey, c_name, new, TIMESTAMP '2024-06-01', NULL, 'Y' FROM y WHERE closes
UNION ALL SELECT c_custkey, c_name, segment, TIMESTAMP '2024-06-01', NULL, 'Y' FROM {ARRIVING} s WHERE c_custkey NOT IN (SELECT c_custkey FROM {CUSTOMERS})""")
def scd2_close_insert(t: Tables) -> DataFrame:
    return L.scd2(_versions(t), _arriving(t), ["c_custkey"], NOW, ["segment"], flag="flag", yes="Y", no="N")


@query("""WITH v AS (SELECT c_nationkey AS k, c_acctbal > 0 AS is_current, CASE WHEN c_acctbal < 5000 THEN TIMESTAMP '2023-06-01' END AS valid_to FROM customer)
SELECT 'current_uniqueness' AS check, (SELECT count(*) FROM (SELECT k FROM v WHERE is_current GROUP BY 1 HAVING count(*) > 1)) AS violations UNION ALL SELECT 'date_range', count(*) FILTER (WHERE valid_to < TIMESTAMP '2024-01-01') FROM v
UNION ALL SELECT 'flag_end_agreement', count(*) FILTER (WHERE is_current = (valid_to IS NOT NULL)) FROM v""")
def scd2_integrity(t: Tables) -> DataFrame:
    broken = t.customer.selectExpr("c_nationkey as k", "c_acctbal > 0 as is_current", "timestamp_ntz'2024-01-01 00:00:00' as valid_from", "case when c_acctbal < 5000 then timestamp_ntz'2023-06-01 00:00:00' end as valid_to")
    return L.scd2_checks(broken, ["k"])


@query("""WITH t AS (SELECT user_id, max(ts) AS updated_at, max(event_id) AS v FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1), s AS (SELECT user_id, max(ts) AS updated_at, max(event_id) AS v FROM events WHERE event_type <> 'click' GROUP BY 1)
SELECT t.user_id, t.updated_at, t.v, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN s.updated_at > t.updated_at THEN TIMESTAMP '2024-06-01' END AS valid_to, CASE WHEN s.updated_at > t.updated_at THEN false ELSE true END AS is_current FROM t LEFT JOIN s USING (user_id)
UNION ALL SELECT s.user_id, s.updated_at, s.v, TIMESTAMP '2024-06-01', NULL, true FROM s LEFT JOIN t USING (user_id) WHERE t.user_id IS NULL OR s.updated_at > t.updated_at""")
def scd2_by_timestamp(t: Tables) -> DataFrame:
    agg = lambda c: t.events.filter(c).groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.max("event_id").alias("v"))
    held = agg("event_type in ('click', 'view', 'signup')").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as valid_from", "cast(null as timestamp_ntz) as valid_to", "true as is_current")
    return L.scd2(held, agg("event_type <> 'click'"), ["user_id"], NOW, updated_at="updated_at")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 1000 THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE NOT coalesce(o_orderpriority = '5-LOW', false)")
def update_and_delete(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return L.delete_rows(L.update_rows(o, {"o_totalprice": "o_totalprice / 2"}, "o_orderstatus = 'P' and o_totalprice > 1000"), "o_orderpriority = '5-LOW'").select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM {DELTA} WHERE row_action IN ('INSERT', 'UPDATE')")
def merge_without_key(t: Tables) -> DataFrame:
    return L.merge(_base(t), _delta(t), [], action="row_action")


# Reconciliation


@query("SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS target_rows, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS violations")
def recon_row_counts(t: Tables) -> DataFrame:
    return Q.row_counts(t.orders, t.orders.filter("o_orderstatus <> 'P'"))


@query("SELECT count(*) AS violations FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def recon_key_uniqueness(t: Tables) -> DataFrame:
    return Q.key_duplicates(t.orders, ["o_custkey"])


@query("SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS o_orderkey_nulls, count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NULL) AS status_nulls FROM orders")
def recon_nulls(t: Tables) -> DataFrame:
    return Q.null_profile(t.orders.selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') as status"))


@query("SELECT count(*) AS duplicate_row_groups FROM (SELECT o_custkey, o_orderstatus FROM orders GROUP BY ALL HAVING count(*) > 1)")
def recon_duplicates(t: Tables) -> DataFrame:
    return Q.duplicate_rows(t.orders, ["o_custkey", "o_orderstatus"])


@query("SELECT count(*) AS row_count, sum(q) AS q_sum, count(q) AS q_count FROM (SELECT cast(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem)")
def recon_totals(t: Tables) -> DataFrame:
    return Q.totals(t.lineitem.selectExpr("cast(l_quantity as decimal(18,2)) as q"), ["q"])


@query("SELECT min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, min(o_orderdate) AS o_orderdate_min, max(o_orderdate) AS o_orderdate_max FROM orders")
def recon_minmax(t: Tables) -> DataFrame:
    return Q.ranges(t.orders, ["o_totalprice", "o_orderdate"])


@query("SELECT count(*) AS row_count, sum(('0x' || substr(md5(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR || '|' || coalesce(nullif(o_orderstatus, 'P'), '')), 1, 8))::BIGINT)::DECIMAL(38,0) AS md5_fingerprint FROM orders")
def recon_checksum(t: Tables) -> DataFrame:
    return Q.fingerprint(t.orders, ["o_orderkey", "o_custkey", F.expr("nullif(o_orderstatus, 'P')")])


TARGET = "(SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')"


@query(f"""SELECT 'source_only' AS side, (SELECT count(*) FROM (SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT * FROM {TARGET})) AS n_rows
UNION ALL SELECT 'target_only', (SELECT count(*) FROM (SELECT * FROM {TARGET} EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders))""")
def recon_except(t: Tables) -> DataFrame:
    target = t.orders.filter("o_orderstatus <> 'P'").selectExpr("case when o_orderpriority = '1-URGENT' then o_custkey + 1 else o_custkey end as o_custkey", "o_orderstatus")
    return Q.differences(t.orders, target, ["o_custkey", "o_orderstatus"])


@query("SELECT count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def recon_orphans(t: Tables) -> DataFrame:
    return Q.orphans(t.orders, t.customer.filter("c_acctbal > 0"), [("o_custkey", "c_custkey")])


@query("SELECT 'price' AS rule, count(*) FILTER (WHERE NOT o_totalprice < 300000) AS violations FROM orders UNION ALL SELECT 'status', count(*) FILTER (WHERE NOT nullif(o_orderstatus, 'P') = 'F') FROM orders")
def recon_rules(t: Tables) -> DataFrame:
    return Q.rules(t.orders, {"price": "o_totalprice < 300000", "status": "nullif(o_orderstatus, 'P') = 'F'"})


@query("""SELECT 'accepted' AS check, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, n AS violations, NULL AS measured FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
UNION ALL SELECT 'orphans', 'pass', 0, NULL UNION ALL SELECT 'totals', 'measured', NULL, '{"row_count":' || count(*) || ',"o_custkey_sum":' || sum(o_custkey) || ',"o_custkey_count":' || count(o_custkey) || '}' FROM orders""")
def recon_suite(t: Tables) -> DataFrame:
    return Q.run({"accepted": Q.accepted(t.orders, "o_orderstatus", ["F", "O"]), "orphans": Q.orphans(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")]), "totals": Q.totals(t.orders, ["o_custkey"])})


@query("""SELECT 'o_orderkey' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_nulls, max(length(o_orderkey::VARCHAR)) AS longest, max(length(o_orderkey::VARCHAR)) AS digits, false AS watermark FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(*) FILTER (WHERE o_orderstatus IS NULL), max(length(o_orderstatus)), 0, false FROM orders UNION ALL SELECT 'o_orderdate', count(*), count(*) FILTER (WHERE o_orderdate IS NULL), 19, 4, true FROM orders""")
def profile_columns(t: Tables) -> DataFrame:
    return files.profile(t.orders, ["o_orderkey", "o_orderstatus", "o_orderdate"]).select("column_name", "n_rows", "n_nulls", "longest", "digits", "watermark")


@query("SELECT o_orderstatus, count(*) AS n_rows, round(100 * count(*) / (SELECT count(*) FROM orders), 2) AS percent FROM orders GROUP BY 1")
def recon_router_distribution(t: Tables) -> DataFrame:
    return Q.distribution(t.orders, "o_orderstatus")


@query("SELECT count(*) FILTER (WHERE c_custkey IS NULL) AS unmatched, count(*) AS n_rows FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def recon_lookup_misses(t: Tables) -> DataFrame:
    return Q.lookup_misses(J.lookup(t.orders, t.customer.filter("c_acctbal > 0"), [("o_custkey", "c_custkey")], {"name": "c_name"}, "any"), "name")


@query("SELECT count(*) FILTER (WHERE s = 'F') AS passed, count(*) FILTER (WHERE s <> 'F') AS failed, count(*) FILTER (WHERE s IS NULL) AS unknown FROM (SELECT nullif(o_orderstatus, 'P') AS s FROM orders)")
def recon_filter_counts(t: Tables) -> DataFrame:
    return Q.filter_counts(t.orders, "nullif(o_orderstatus, 'P') = 'F'")


# Streaming semantics over tables


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end, event_type, count(*) AS n, sum(cast(value AS DECIMAL(18,4))) AS total FROM events GROUP BY ALL""")
def stream_tumbling(t: Tables) -> DataFrame:
    return W.windowed(t.events, "tumbling", "ts", ["event_type"], {"n": "count(*)", "total": "sum(cast(value as decimal(18,4)))"}, "5 minutes")


@query("""SELECT s AS window_start, s + INTERVAL '10 minutes' AS window_end, event_type, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL '5 minutes', ts), time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes']) AS s FROM events) GROUP BY ALL""")
def stream_hopping(t: Tables) -> DataFrame:
    return W.windowed(t.events, "hopping", "ts", ["event_type"], {"n": "count(*)"}, "10 minutes", "5 minutes")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT min(ts) AS window_start, max(ts) + INTERVAL '2 hours' AS window_end, user_id, count(*) AS n FROM b GROUP BY user_id, s""")
def stream_session(t: Tables) -> DataFrame:
    return W.windowed(t.events, "session", "ts", ["user_id"], {"n": "count(*)"}, gap="2 hours")


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'purchase'")
def stream_cdc_latest(t: Tables) -> DataFrame:
    return S.latest(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", ["purchase"])


@query("""SELECT user_id, event_id FROM (SELECT user_id, arg_max((event_id, event_type), (ts, event_id)) AS r FROM events GROUP BY 1), (SELECT 1), LATERAL (SELECT r[1] AS event_id) WHERE r[2] <> 'purchase'""")
def stream_cdc_apply(t: Tables) -> DataFrame:
    """Late rows come last: deletes that they would undo are remembered, so the state is that of the last change of each user."""
    e = t.events.select("user_id", "event_id", "ts", "event_type")
    state = e.limit(0).withColumn("gone", F.lit(False))
    for late in ("event_type in ('purchase', 'click')", "event_type not in ('purchase', 'click')"):
        state = S.apply_changes(state, e.filter(late), ["user_id"], ["ts", "event_id"], "event_type", ["purchase"], "gone")
    return S.current(state, "gone").select("user_id", "event_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    return W.deduplicated(t.events, ["user_id", "event_type"], "ts").select("user_id", "event_type")


@query("""SELECT l.user_id AS user_id, l.event_id AS login_id, p.event_id AS purchase_id FROM events l JOIN events p ON l.user_id = p.user_id AND p.ts >= l.ts AND p.ts <= l.ts + INTERVAL 12 HOURS WHERE l.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_interval_join(t: Tables) -> DataFrame:
    logins = t.events.filter("event_type = 'click'").selectExpr("user_id", "ts as login_ts", "event_id as login_id")
    buys = t.events.filter("event_type = 'purchase'").selectExpr("user_id", "ts as purchase_ts", "event_id as purchase_id")
    return W.interval_join(logins, buys, ["user_id"], "login_ts", "purchase_ts", "12 HOURS").select("user_id", "login_id", "purchase_id")


@query("SELECT event_id FROM events WHERE NOT coalesce(value > 10, false)")
def stream_dead_letters(t: Tables) -> DataFrame:
    return W.split_bad(t.events, "value > 10")[1].select("event_id")


# Classification and graphs


@query("""SELECT * FROM (VALUES ('CustomerEmail', 'pii.direct.email', 'HIGH', 'medium'), ('first_name', 'pii.direct.name', 'HIGH', 'high'), ('deviceFingerprint', 'pii.online.device_fingerprint', 'MEDIUM', 'high'), ('fingerprint', 'pii.special.biometric', 'HIGH', 'high'),
('KNA1_STRAS', 'pii.direct.address', 'MEDIUM', 'high'), ('home address line two', 'pii.direct.address', 'MEDIUM', 'medium')) v(column_name, category, severity, confidence)""")
def classify_fields(t: Tables) -> DataFrame:
    names = ["CustomerEmail", "first_name", "deviceFingerprint", "fingerprint", "KNA1_STRAS", "home address line two", "o_orderkey"]
    return C.classified(t.spark.createDataFrame([(n,) for n in names], "column_name string"))


def _secret_sql() -> str:
    """The six patterns in the other engine's words: the first value of each kind that is no reference, dummy or mask."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    dummy = "(?i)^(?:(?:" + "|".join(C.DUMMIES) + ")|your.*|[x*]{3,})$"
    stars = "length(v) - length(replace(v, '*', ''))"
    fine = f"NOT regexp_matches(trim(v), {quoted(dummy)}) AND NOT ({stars} >= 3 AND {stars} >= floor(length(v) / 2)) AND NOT regexp_matches(v, {quoted(C.REFERENCE)})"
    one = "SELECT doc_id, {} AS type, list_filter(regexp_extract_all(text, {}, 1), lambda v: {})[1] AS v FROM documents"
    return "SELECT doc_id, type, 'redacted (' || length(v) || ' chars)' AS evidence FROM (" + " UNION ALL ".join(one.format(quoted(k), quoted(p), fine) for k, p in C.SECRETS) + ") WHERE v IS NOT NULL"


@query(_secret_sql())
def scan_secrets(t: Tables) -> DataFrame:
    return C.secrets(t.documents, "doc_id", "text")


EDGES = "(SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region)"


def _edges(t: Tables) -> DataFrame:
    e = t.customer.selectExpr("concat('c', c_custkey) as source", "concat('n', c_nationkey) as target")
    return e.union(t.nation.selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)")).union(t.region.selectExpr("concat('r', r_regionkey)", "'world'")).distinct()


@query(f"""WITH RECURSIVE e AS {EDGES}, w AS (SELECT 'c' || c_custkey AS origin, 'c' || c_custkey AS node, 0 AS depth FROM customer UNION SELECT origin, target, depth + 1 FROM w JOIN e ON node = source) SELECT origin, node, min(depth) AS depth FROM w GROUP BY ALL""")
def lineage_blast_radius(t: Tables) -> DataFrame:
    return G.reach(_edges(t), t.customer.selectExpr("concat('c', c_custkey) as node"))


@query(f"""WITH RECURSIVE e AS (SELECT target AS source, source AS target FROM {EDGES}), w AS (SELECT 'r' || r_regionkey AS origin, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT origin, target, depth + 1 FROM w JOIN e ON node = source),
x AS (SELECT origin, count(DISTINCT node) - 1 AS affected, max(depth) AS deepest FROM w GROUP BY 1) SELECT *, CASE WHEN affected >= 10 THEN 'CRITICAL' WHEN affected >= 6 THEN 'HIGH' WHEN affected >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x""")
def lineage_impact(t: Tables) -> DataFrame:
    return G.impact(_edges(t).selectExpr("target as source", "source as target"), t.region.selectExpr("concat('r', r_regionkey) as node"))


@query(f"""WITH e AS {EDGES}, f AS (SELECT source, count(DISTINCT target) AS fan_out FROM e GROUP BY 1), a AS (SELECT e.source AS node, 1 AS depth FROM e WHERE target = 'world' UNION SELECT b.source, 2 FROM e a JOIN e b ON b.target = a.source WHERE a.target = 'world' UNION SELECT c.source, 3 FROM e a JOIN e b ON b.target = a.source JOIN e c ON c.target = b.source WHERE a.target = 'world')
SELECT 'world' AS origin, node, depth, fan_out, fan_out / depth AS score FROM a JOIN f ON source = node ORDER BY score DESC, depth, node LIMIT 15""")
def lineage_root_causes(t: Tables) -> DataFrame:
    return G.root_causes(_edges(t), t.spark.createDataFrame([("world",)], "node string"))


@query("SELECT 'n' || n_nationkey AS node, 'nation' AS kind FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def lineage_dead_ends(t: Tables) -> DataFrame:
    e = t.supplier.selectExpr("concat('n', s_nationkey) as source", "concat('s', s_suppkey) as target")
    nodes = t.nation.selectExpr("concat('n', n_nationkey) as node", "'nation' as kind").union(t.supplier.selectExpr("concat('s', s_suppkey)", "'dashboard'"))
    return G.dead_ends(nodes, e, ("dashboard",))


@query("SELECT n.n_name AS source_owner, r_name AS target_owner, count(*) AS n_edges FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def lineage_collapsed(t: Tables) -> DataFrame:
    e = t.customer.join(t.nation, F.expr("c_nationkey = n_nationkey")).selectExpr("concat('c', c_custkey) as source", "concat('r', n_regionkey) as target")
    owner = t.customer.join(t.nation, F.expr("c_nationkey = n_nationkey")).selectExpr("concat('c', c_custkey) as node", "n_name as owner").union(t.region.selectExpr("concat('r', r_regionkey)", "r_name"))
    return G.collapsed(e, owner)


@query("SELECT md5(lower(n_name)) AS fingerprint, 2::BIGINT AS n_items, n_nationkey || 'a,' || n_nationkey || 'b' AS names FROM nation")
def duplicate_logic(t: Tables) -> DataFrame:
    a = t.nation.selectExpr("concat(n_nationkey, 'a') as name", "concat(' ', n_name, '  ') as text").union(t.nation.selectExpr("concat(n_nationkey, 'b')", "upper(n_name)"))
    return G.repeated(a, "name", "text")


@query("SELECT 'n' || n_nationkey AS node, 'g' || n_regionkey AS grp FROM nation")
def association(t: Tables) -> DataFrame:
    e = t.nation.selectExpr("concat('n', n_nationkey) as source", "concat('g', n_regionkey) as target")
    return G.connected(e).filter("node like 'n%'").select("node", F.col("group").alias("grp"))
