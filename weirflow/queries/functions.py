"""Queries of the function library, one for each family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions import scalar as f
from weirflow.queries.registry import Tables, query


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_type || ' ') AS trimmed, length(p_name) AS n, substr(p_name, 2, 3) AS sub, instr(p_name, 'a')::INTEGER AS at, replace(p_name, 'a', 'A') AS rep, lpad(p_partkey::VARCHAR, 8, '0') AS padded,
split_part(p_type, ' ', 1) AS part1, reverse(p_brand) AS rev, p_name || coalesce(nullif(p_brand, 'Brand#11'), '') AS joined, translate(p_brand, '#B', '') AS no_hash, regexp_replace(p_name, '(?i)[ae]', '*', 'g') AS masked FROM part""")
def fn_string(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"), F.length("p_name").alias("n"), F.substring("p_name", 2, 3).alias("sub"), F.instr("p_name", "a").alias("at"), F.replace("p_name", F.lit("a"), F.lit("A")).alias("rep"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("part1"), F.reverse("p_brand").alias("rev"), f.concat_empty("p_name", F.expr("nullif(p_brand, 'Brand#11')")).alias("joined"), f.replace_chars("p_brand", "#B").alias("no_hash"), f.replace_text("p_name", ["a", "e"], "*", False).alias("masked"))


@query("""SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'none' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS decoded, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS decoded_plain, coalesce(nullif(o_custkey % 5, 0), 0) AS zero, nullif(o_custkey % 5, 0) AS no_zero,
CASE WHEN nullif(o_custkey % 5, 0) IS NULL THEN NULL ELSE greatest(nullif(o_custkey % 5, 0), 2) END AS strict, CASE o_custkey % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS chosen, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS indexed FROM orders""")
def fn_conditional(t: Tables) -> DataFrame:
    n = F.expr("nullif(o_custkey % 5, 0)")
    return t.orders.select("o_orderkey", f.decode(F.expr("nullif(o_orderstatus, 'P')"), None, "none", "F", "done", default="open").alias("decoded"), f.decode(F.expr("nullif(o_orderstatus, 'P')"), None, "none", "F", "done", default="open", null_safe=False).alias("decoded_plain"), F.zeroifnull(n).alias("zero"), n.alias("no_zero"), f.greatest_strict(n, F.lit(2)).alias("strict"), f.choose(F.expr("o_custkey % 4"), "a", "b").alias("chosen"), f.index_of("o_orderstatus", "O", "F").alias("indexed"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, last_day(o_orderdate) AS eom, date_trunc('month', o_orderdate)::TIMESTAMP AS month, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, o_orderdate + INTERVAL 5 DAY AS plus5, o_orderdate + INTERVAL 36 HOUR AS plus36,
CASE WHEN o_orderdate::DATE = last_day(o_orderdate) THEN last_day(o_orderdate::DATE + INTERVAL 1 MONTH) ELSE (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE END AS next_month, strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS parsed, CASE WHEN o_orderdate < TIMESTAMP '1995-06-17' THEN -1 WHEN o_orderdate > TIMESTAMP '1995-06-17' THEN 1 ELSE 0 END AS cmp FROM orders""")
def fn_date(t: Tables) -> DataFrame:
    d = "o_orderdate"
    return t.orders.select("o_orderkey", f.to_text(d, "YYYY-MM-DD").alias("day"), F.last_day(d).alias("eom"), f.truncate_date(d, "MM").cast("timestamp_ntz").alias("month"), f.date_part(d, "YYYY").cast("int").alias("y"), f.date_part(d, "Q").cast("int").alias("q"), f.add_to_date(d, "DD", 5).alias("plus5"), f.add_to_date(d, "HH", 36).alias("plus36"), f.add_months(d, 1).alias("next_month"), f.to_date_time(f.to_text(d, "DD/MM/YYYY"), "DD/MM/YYYY").cast("timestamp_ntz").alias("parsed"), f.date_compare(d, F.expr("timestamp_ntz'1995-06-17 00:00:00'")).alias("cmp"))


DAYS = ("year", "quarter", "month", "week", "day", "hour")


@query("SELECT o_orderkey, " + ", ".join(f"date_diff('{u}', o_orderdate, TIMESTAMP '1998-12-31 22:30:00') AS {u}s" for u in DAYS if u != "week") + ", date_diff('day', date_trunc('week', o_orderdate), TIMESTAMP '1998-12-28') // 7 AS weeks FROM orders")
def datediff_boundary(t: Tables) -> DataFrame:
    end = F.expr("timestamp_ntz'1998-12-31 22:30:00'")
    return t.orders.select("o_orderkey", *[f.boundaries(u, "o_orderdate", end).alias(f"{u}s") for u in DAYS])


@query("SELECT o_orderkey, " + ", ".join(f"date_sub('{u}', o_orderdate, TIMESTAMP '1998-12-31 22:30:00') AS {u}s" for u in ("year", "month", "day", "hour")) + " FROM orders")
def datediff_elapsed(t: Tables) -> DataFrame:
    end = F.expr("timestamp_ntz'1998-12-31 22:30:00'")
    return t.orders.select("o_orderkey", *[f.date_diff(end, "o_orderdate", u).alias(f"{u}s") for u in ("year", "month", "day", "hour")])


@query("""SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::BIGINT AS whole, round(cast(l_extendedprice AS DECIMAL(18,2)), 1) AS r1, abs(l_linenumber - 4) AS a, l_linenumber % 3 AS m, ceil(l_discount * 10)::BIGINT AS c, floor(l_discount * 10)::BIGINT AS fl, sign(l_linenumber - 3)::INTEGER AS s,
round(pow(l_linenumber, 2), 3) AS p, round(sqrt(l_quantity), 6) AS sq, round(ln(l_quantity), 6) AS lnq, 0.29::DECIMAL(5,2) AS cents, 12345678901234567.89::DECIMAL(20,2) AS big, 9007199254740993 AS wide, trunc(l_extendedprice * 100 + 0.001) / 100.0 AS two, -3::BIGINT AS below, try_cast(CASE WHEN l_linenumber = 1 THEN 'x' ELSE l_linenumber::VARCHAR || '.75' END AS DECIMAL(38,6)) AS dec, CASE WHEN l_linenumber <> 1 THEN l_linenumber END AS cut FROM lineitem""")
def fn_math(t: Tables) -> DataFrame:
    text = F.expr("case when l_linenumber = 1 then 'x' else concat(l_linenumber, '.75') end")
    return t.lineitem.select("l_orderkey", "l_linenumber", f.truncate("l_extendedprice").cast("long").alias("whole"), F.round(F.expr("cast(l_extendedprice as decimal(18,2))"), 1).alias("r1"), F.expr("abs(l_linenumber - 4)").alias("a"), F.expr("l_linenumber % 3").alias("m"), F.expr("ceil(l_discount * 10)").alias("c"), F.expr("floor(l_discount * 10)").alias("fl"), F.expr("cast(sign(l_linenumber - 3) as int)").alias("s"), F.round(F.pow("l_linenumber", F.lit(2)), 3).alias("p"), F.round(F.sqrt("l_quantity"), 6).alias("sq"), F.round(F.ln("l_quantity"), 6).alias("lnq"), f.truncate(F.lit(0.29), 2).cast("decimal(5,2)").alias("cents"), f.truncate(F.expr("12345678901234567.891BD"), 2).cast("decimal(20,2)").alias("big"), f.to_integer(F.lit("9007199254740993"), kind="bigint").alias("wide"), f.truncate("l_extendedprice", 2).cast("double").alias("two"), f.truncate(F.lit(-3.7)).alias("below"), f.to_decimal(text).alias("dec"), f.to_integer(text).alias("cut"))


@query("SELECT o_orderkey, md5(o_orderstatus) AS m, sha256(o_orderpriority) AS s, upper(md5(o_orderpriority)) AS h, regexp_replace(left(o_orderpriority, length(o_orderpriority) - 2), '[A-Za-z0-9]', 'X', 'g') || right(o_orderpriority, 2) AS x, base64(encode(o_orderpriority)) AS b64, decode(from_base64(base64(encode(o_orderpriority)))) AS back FROM orders")
def fn_hash(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.md5("o_orderstatus").alias("m"), F.sha2("o_orderpriority", 256).alias("s"), f.standard_hash("o_orderpriority", "MD5").alias("h"), f.mask("o_orderpriority", 2).alias("x"), F.base64(F.encode("o_orderpriority", "UTF-8")).alias("b64"), F.decode(F.unbase64(F.base64(F.encode("o_orderpriority", "UTF-8"))), "UTF-8").alias("back"))


@query("""SELECT event_id, CASE WHEN regexp_matches(event_type, '^p') THEN 1 ELSE 0 END AS p, regexp_extract(event_type, '([a-z])([a-z]*)', 2) AS rest, coalesce(nullif(instr(event_type, 'i'), 0), 0)::INTEGER AS at FROM events""")
def fn_regex(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.regexp_like("event_type", F.lit("^p")), 1).otherwise(0).alias("p"), F.regexp_extract("event_type", "([a-z])([a-z]*)", 2).alias("rest"), f.pattern_index("%i%", "event_type").alias("at"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k')::BIGINT % 2 AS odd, json_extract_string(props, '$.none') AS missing, json_valid(props) AS ok FROM events")
def fn_json(t: Tables) -> DataFrame:
    x = t.events.withColumn("j", f.json_values("props", {"k": "$.k", "missing": "$.none"}))
    return x.select("event_id", "j.k", (f.json_value("props", "$.k").cast("bigint") % 2).alias("odd"), "j.missing", F.expr("try_parse_json(props)").isNotNull().alias("ok"))


@query("SELECT l_orderkey, count(*) AS n, list_sort(list(l_linenumber)) AS numbers, list_sort(list(l_linenumber))[1] AS first FROM lineitem GROUP BY 1")
def fn_array(t: Tables) -> DataFrame:
    x = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("numbers"))
    return x.select("l_orderkey", F.size("numbers").cast("long").alias("n"), "numbers", f.array_element("numbers", 1).alias("first"))


@query("SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings")
def fn_flatten_rows(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "x", (F.col("i") + 1).cast("long").alias("i"))


@query("SELECT o_orderkey, sha256('=' || o_custkey || chr(31) || CASE WHEN o_orderstatus = 'P' THEN '~' ELSE '=' || o_orderstatus END) AS key FROM orders")
def fn_hash_key(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", f.hash_key("o_custkey", F.expr("nullif(o_orderstatus, 'P')")).alias("key"))
