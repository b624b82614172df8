"""Queries of mergeable state, exact percentiles, versioned tables, keys and references that are found from rows, texts within a distance, and cycles."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.graph import cycles as CY
from weirflow.graph import paths as PA
from weirflow.operators import edits as ED
from weirflow.operators import quantiles as Q
from weirflow.operators import sketches as K
from weirflow.operators import versions as V
from weirflow.quality import keys as D
from weirflow.queries.registry import Tables, query
from weirflow.shared import checkpoint_folder

# Sketches and percentiles


@query("""SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS n_props, TRUE AS users_within, TRUE AS props_within, TRUE AS half_within, TRUE AS p95_within FROM events GROUP BY 1""")
def sketch_state_over_loads(t: Tables) -> DataFrame:
    """Six loads sketched one by one and merged, beside the exact figures: whether each estimate lies within three percent, or one percent of the rows."""
    measures = {"e_users": ("distinct", "user_id"), "e_props": ("distinct", "props"), "values": ("quantiles", "value")}
    loads = [K.sketched(t.events.where(F.pmod("event_id", F.lit(6)) == n), ["event_type"], measures) for n in range(6)]
    state = loads[0]
    for fresh in loads[1:]:
        state = K.merged([state, fresh], ["event_type"], measures)
    guess = K.estimates(state, ["event_type"], measures)
    both = t.events.join(guess.select("event_type", "values"), "event_type")
    share = lambda k, p: (F.count_if(F.col("value") < F.col("values")[k]) / F.count("value") <= p + 0.01) & (F.count_if(F.col("value") <= F.col("values")[k]) / F.count("value") >= p - 0.01)
    exact = both.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("n_props"))
    ranks = both.groupBy("event_type").agg(share(0, 0.5).alias("half_within"), share(1, 0.95).alias("p95_within"))
    near = lambda e, x: F.abs(F.col(e) - F.col(x)) <= F.greatest(F.col(x) * 0.03, F.lit(1))
    out = exact.join(guess, "event_type").join(ranks, "event_type")
    return out.select("event_type", "users", "n_props", near("e_users", "users").alias("users_within"), near("e_props", "n_props").alias("props_within"), "half_within", "p95_within")


@query("""SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS half, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.999) AS p999 FROM lineitem GROUP BY 1""")
def percentile_hot_groups(t: Tables) -> DataFrame:
    """Three groups hold all rows; none is gathered (from 10,000 rows on here, a million by default)."""
    return Q.exact_percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"half": 0.5, "p95": 0.95, "p999": 0.999}, large=10_000)


@query("""SELECT quantile_disc(cast(o_totalprice AS DECIMAL(12,2)), 0.25) AS p25, quantile_disc(cast(o_totalprice AS DECIMAL(12,2)), 0.75) AS p75 FROM orders""")
def percentile_whole_table(t: Tables) -> DataFrame:
    return Q.exact_percentiles(t.orders, [], "cast(o_totalprice as decimal(12,2))", {"p25": 0.25, "p75": 0.75}, nearest=True, large=1_000)


# Versioned tables


def _versioned(t: Tables) -> str:
    path = f"{checkpoint_folder(t.spark)}/versioned-{uuid.uuid4().hex}"
    V.create(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path, ["o_orderkey"])
    return path


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 101 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE NOT (o_orderkey % 101 = 0 AND o_orderstatus = 'F')
UNION ALL SELECT -o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 211 = 1""")
def versioned_merge(t: Tables) -> DataFrame:
    """Updates, deletes and inserts of about a hundredth of the rows."""
    path = _versioned(t)
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    changed = o.where("o_orderkey % 101 = 0").select("o_orderkey", "o_custkey", (-F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus", F.when(F.col("o_orderstatus") == "F", "DELETE").otherwise("UPDATE").alias("row_action"))
    new = o.where("o_orderkey % 211 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", "o_totalprice", "o_orderstatus", F.lit("INSERT").alias("row_action"))
    for source in (changed, new):
        V.merge_into(path, source, action="row_action")
    return V.read(t.spark, path)


@query("""SELECT version, n_rows, total FROM (SELECT 1 AS version, count(*) AS n_rows, sum(cast(o_totalprice AS DECIMAL(18,2))) AS total FROM orders UNION ALL SELECT 2, count(*), sum(CASE WHEN o_custkey = 7 THEN 1 ELSE cast(o_totalprice AS DECIMAL(18,2)) END) FROM orders)""")
def versioned_read_back(t: Tables) -> DataFrame:
    """Each version as it was, the second after one that came twice."""
    path = _versioned(t)
    source = t.orders.where("o_custkey = 7").select("o_orderkey", "o_custkey", F.lit(1.0).alias("o_totalprice"), "o_orderstatus")
    for _ in range(2):
        V.merge_into(path, source, "orders", 1)
    seen = [V.read(t.spark, path, n).agg(F.lit(n).alias("version"), F.count("*").alias("n_rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total")) for n in V.versions(t.spark, path)]
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out


# Keys and references

#: Tables and columns whose keys and references are looked for, as the tables have them.
SCHEMAS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}
#: Columns that can refer to others: whole numbers and texts.
REFERRING = {t: [c for c in cs.split() if not c.endswith(("acctbal", "retailprice", "totalprice", "orderdate", "quantity", "extendedprice", "discount", "tax", "shipdate"))] for t, cs in SCHEMAS.items()}
TEXTS = {"r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus"}


def _unique(table: str, columns: tuple[str, ...]) -> str:
    return f"(SELECT count(*) > 0 AND count(*) = count(DISTINCT ({', '.join(columns)},)) AND count(*) = {' AND count(*) = '.join(f'count({c})' for c in columns)} FROM {table})".replace(",,", ",") if len(columns) > 1 else f"(SELECT count(*) > 0 AND count(*) = count(DISTINCT {columns[0]}) AND count(*) = count({columns[0]}) FROM {table})"


def _keys_sql() -> str:
    parts = []
    for table, names in SCHEMAS.items():
        cs = names.split()
        ones = f"one_{table} AS (SELECT {', '.join(f'{_unique(table, (c,))} AS {c}' for c in cs)})"
        parts.append((ones, [f"SELECT '{table}' AS table_name, '{c}' AS key_columns FROM one_{table} WHERE {c}" for c in cs] + [f"SELECT '{table}', '{a},{b}' FROM one_{table} WHERE NOT {a} AND NOT {b} AND (SELECT count(*) = count(DISTINCT ({a}, {b})) FROM {table})" for a, b in combinations(cs, 2)]))
    return "WITH " + ", ".join(o for o, _ in parts) + " " + " UNION ALL ".join(s for _, each in parts for s in each)


@query(_keys_sql())
def discovered_keys(t: Tables) -> DataFrame:
    """Minimal keys of one or two columns of seven tables."""
    found = [(name, ",".join(k)) for name in SCHEMAS for k in D.keys(getattr(t, name), 2)]
    return t.spark.createDataFrame(found, "table_name string, key_columns string")


def _references_sql() -> str:
    parts = []
    for table, cs in REFERRING.items():
        for c in cs:
            for other, ds in REFERRING.items():
                parts += [f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{other}' AS key_table, '{d}' AS key_column WHERE {_unique(other, (d,))} AND (SELECT count({c}) > 0 FROM {table}) AND NOT EXISTS (SELECT {c} FROM {table} WHERE {c} IS NOT NULL EXCEPT SELECT {d} FROM {other})" for d in ds if other != table and (c in TEXTS) == (d in TEXTS)]
    return " UNION ALL ".join(parts)


@query(_references_sql())
def discovered_references(t: Tables) -> DataFrame:
    """Columns whose values all are values of a key column of another table."""
    tables = {name: getattr(t, name) for name in SCHEMAS}
    found = D.references(tables, [(name, c) for name, cs in REFERRING.items() for c in cs])
    return t.spark.createDataFrame(found, "table_name string, column_name string, key_table string, key_column string")


# Texts within a distance, and cycles


@query("SELECT a.c_custkey AS customer, b.c_custkey AS other, 1 AS distance FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND levenshtein(a.c_name, b.c_name) = 1")
def edits_customers(t: Tables) -> DataFrame:
    """Names of one beginning that differ in a character."""
    a = t.customer.selectExpr("c_custkey as customer", "c_name as name")
    b = t.customer.selectExpr("c_custkey as other", "c_name as other_name")
    return ED.similar_rows(a, b, "name", "other_name", 1, least=1).where("customer < other").select("customer", "other", "distance")


@query("SELECT a.p_name AS left_text, b.p_name AS right_text, levenshtein(a.p_name, b.p_name)::INTEGER AS distance FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON levenshtein(a.p_name, b.p_name) <= 3")
def edits_parts(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_name").alias("text"))
    return ED.similar_texts(p, p, 3)


HOPS = "(SELECT s_suppkey AS source, o_custkey % (SELECT count(*) FROM supplier) AS target FROM supplier JOIN orders ON o_orderkey = s_suppkey)"
SCC = f"""WITH RECURSIVE e AS {HOPS}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e), r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.target FROM r JOIN e ON r.b = e.source),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)"""


def _hops(t: Tables) -> DataFrame:
    """Each supplier leads to one that the order of its number names."""
    n = t.supplier.count()
    return t.supplier.join(t.orders, F.col("o_orderkey") == F.col("s_suppkey")).selectExpr("s_suppkey as source", f"o_custkey % {n} as target")


@query(f"{SCC} SELECT node, component FROM c")
def graph_strong_components(t: Tables) -> DataFrame:
    return CY.components(_hops(t))


@query(f"{SCC} SELECT c.component, count(DISTINCT node) AS n_nodes, (SELECT count(*) FROM e JOIN c p ON e.source = p.node JOIN c q ON e.target = q.node WHERE p.component = c.component AND q.component = c.component) AS n_edges FROM c GROUP BY 1 HAVING n_edges > 0")
def graph_cycles(t: Tables) -> DataFrame:
    return CY.cycles(_hops(t))


STEPS = """(SELECT 's' || s_suppkey AS source, 'n' || s_nationkey AS target, CASE WHEN s_acctbal < 0 THEN 'coarse' ELSE 'passthrough' END AS kind FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'expression' FROM nation UNION ALL SELECT 'n' || n_nationkey, 'world', 'coarse' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world', 'passthrough' FROM region)"""


@query(f"""WITH RECURSIVE e AS {STEPS}, w AS (SELECT source AS origin, target AS node, 1 AS steps, source || '>' || target AS path, CASE kind WHEN 'passthrough' THEN 0 WHEN 'expression' THEN 1 ELSE 2 END AS k, CASE kind WHEN 'passthrough' THEN 1e0 WHEN 'expression' THEN 9e-1 ELSE 5e-1 END AS c FROM e WHERE source LIKE 's%'
UNION ALL SELECT origin, target, steps + 1, path || '>' || target, greatest(k, CASE kind WHEN 'passthrough' THEN 0 WHEN 'expression' THEN 1 ELSE 2 END), c * CASE kind WHEN 'passthrough' THEN 1e0 WHEN 'expression' THEN 9e-1 ELSE 5e-1 END FROM w JOIN e ON node = source)
SELECT origin, node, steps::INTEGER AS steps, path, ['passthrough', 'expression', 'coarse'][k + 1] AS kind, round(c::DOUBLE, 6) AS confidence FROM w""")
def lineage_ways(t: Tables) -> DataFrame:
    """From each supplier to the world: by its nation, or by the nation's region."""
    e = t.supplier.selectExpr("concat('s', s_suppkey) as source", "concat('n', s_nationkey) as target", "if(s_acctbal < 0, 'coarse', 'passthrough') as kind")
    n = t.nation.selectExpr("concat('n', n_nationkey) as source", "explode(map(concat('r', n_regionkey), 'expression', 'world', 'coarse')) as (target, kind)")
    r = t.region.selectExpr("concat('r', r_regionkey) as source", "'world' as target", "'passthrough' as kind")
    return PA.ways(e.unionByName(n).unionByName(r), t.supplier.selectExpr("concat('s', s_suppkey) as node"))
