"""Cases that the tables do not hold."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions import scalar as f
from weirflow.functions import types as types
from weirflow.functions import vectorised as v
from weirflow.graph import traverse as G
from weirflow.operators import aggregates as A
from weirflow.operators import joins as J
from weirflow.operators import loads as L
from weirflow.operators import rows as R
from weirflow.quality import classify as C
from weirflow.quality import reconcile as Q
from weirflow.sources import files
from weirflow.streaming import changes as S
from weirflow.streaming import evolution as E
from weirflow.streaming import windows as W


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_null_goes_to_the_default_route(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, x int")
    got = sorted((r["id"], r["route_group"]) for r in R.route(df, {"A": "x > 1", "B": "x > 10"}).collect())
    assert got == [(1, "A"), (2, "DEFAULT"), (3, "A"), (3, "B")]
    assert [r["id"] for r in R.split(df, {"A": "x > 1"})["DEFAULT"].collect()] == [2]
    assert R.route(df, {"A": "x > 1"}, default=None).count() == 2


def test_update_strategy_falls_through_null(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    got = R.update_strategy(df, [("x <> y", "DD_UPDATE")], "DD_INSERT").collect()
    assert [r["row_action"] for r in got] == ["INSERT", "UPDATE"]
    with pytest.raises(ValueError):
        R.update_strategy(df, [("true", "DD_NONE")])


def test_orders_must_be_declared(spark):
    df = spark.range(3)
    for call in (lambda: R.running(df, [], x=("sum", "id")), lambda: A.first_row(df, ["id"], []), lambda: J.lookup(df, df, [("id", "id")], {"y": "id"})):
        with pytest.raises(ValueError):
            call()


def test_union_check(spark):
    a, b = spark.createDataFrame([], "x int, y date, z int"), spark.createDataFrame([], "x bigint, y timestamp, z string")
    assert [k for _, k in R.union_check([a, b])] == ["implicit", "implicit", "incompatible"]


def test_lookup_with_null_keys_and_no_match(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "k int")
    t = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "n", 1)], "k int, v string, o int")
    assert sorted(((r["k"] or 0), r["v"]) for r in J.lookup(df, t, [("k", "k")], {"v": "v"}, "first", ["o"]).collect()) == [(0, None), (1, "a"), (9, None)]


def test_hierarchy_ends_in_cycles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "id int, boss int")
    got = J.hierarchy(df, "id", "boss", "boss is null or id = 4")
    assert sorted((r["id"], r["level"], r["path"]) for r in got.collect()) == [(1, 1, "1"), (2, 2, "1/2"), (3, 3, "1/2/3"), (4, 1, "4"), (5, 2, "4/5")]


def test_long_chains_are_walked_to_their_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "source int, target int")
    start = spark.createDataFrame([(0,)], "node int")
    assert {(r["node"], r["depth"]) for r in G.reach(chain, start).collect()} == {(i, i) for i in range(61)}
    assert {r["node"] for r in G.reach(chain, start, 3).collect()} == {0, 1, 2, 3}
    down = J.hierarchy(chain, "target", "source", "source = 0").collect()
    assert {(r["target"], r["level"]) for r in down} == {(i, i) for i in range(1, 61)}


def test_sequence_over_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i // 3) for i in range(300)], "id int, o int")
    got = sorted(r["s"] for r in A.sequence(df, "s", "o", ["id"], parts=11).collect())
    assert got == list(range(1, 301))


def test_merge_refuses_a_row_matched_twice(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    s = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(Exception, match="several source rows"):
        L.merge(t, s, ["k"]).collect()
    assert rows(L.merge(t, s.limit(0), ["k"])) == [(1, "a")]
    assert rows(L.merge(t.limit(0), s.filter("v = 'b'"), ["k"])) == [(1, "b")]


def test_scd2_is_done_once(spark):
    now = datetime.datetime(2024, 6, 1)
    t = spark.createDataFrame([(1, 10, "a", datetime.datetime(2024, 1, 1), None, True), (2, 11, None, datetime.datetime(2024, 1, 1), None, True)], "sk bigint, k int, v string, valid_from timestamp, valid_to timestamp, is_current boolean")
    s = spark.createDataFrame([(10, "b"), (11, None), (12, "c")], "k int, v string")
    first = L.scd2(t, s, ["k"], now, ["v"], surrogate="sk")
    assert sorted((r["sk"], r["k"], r["v"], r["is_current"]) for r in first.filter("k <> 11").collect()) == [(1, 10, "a", False), (3, 10, "b", True), (4, 12, "c", True)]
    again = L.scd2(first, s, ["k"], now + datetime.timedelta(1), ["v"], surrogate="sk")
    assert again.count() == first.count() == 4
    assert {r["violations"] for r in L.scd2_checks(again, ["k"]).collect()} == {0}


def test_save_replaces_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    L.save(spark.range(3), path)
    L.save(spark.read.parquet(path).filter("id > 0"), path)
    L.save(spark.range(10, 11), path, "append")
    assert rows(spark.read.parquet(path)) == [(1,), (2,), (10,)]


def test_dates(spark):
    d = lambda x: F.to_date(F.lit(x))
    ts = lambda x: F.to_timestamp(F.lit(x))
    assert str(one(spark, f.add_months(d("2024-02-29"), 1))) == "2024-03-31"
    assert one(spark, f.boundaries("YEAR", ts("2023-12-31"), ts("2024-01-01"))) == 1
    assert one(spark, f.elapsed("YEAR", ts("2023-12-31"), ts("2024-01-01"))) == 0
    assert f.mask_to_pattern('YYYY-MM-DD"T"HH24:MI:SS') == "yyyy-MM-dd'T'HH:mm:ss"
    assert one(spark, f.to_date_time(F.lit("31/12/2023 23:59"), "DD/MM/YYYY HH24:MI")) == datetime.datetime(2023, 12, 31, 23, 59)
    assert one(spark, f.to_date_time(F.lit("nothing"), "DD/MM/YYYY")) is None
    assert one(spark, f.set_date_part(ts("2024-01-31 10:00:00"), "MM", 2)) is None
    assert one(spark, f.set_date_part(ts("2024-01-31 10:00:00"), "MM", 3)) == datetime.datetime(2024, 3, 31, 10)
    assert one(spark, f.date_compare(F.lit(None).cast("date"), d("2024-01-01"))) is None
    with pytest.raises(ValueError):
        f.unit("fortnight")


def test_strings_and_numbers(spark):
    assert one(spark, f.pattern_index("%[0-9]%", F.lit("ab7c"))) == 3
    assert one(spark, f.pattern_index("b%", F.lit("ab"))) == 0
    assert one(spark, f.instr_from(F.lit("banana"), "an", 1, 2)) == 4
    assert one(spark, f.replace_chars(F.lit("AbaB"), "a", "*", False)) == "*b*B"
    assert one(spark, f.replace_text(F.lit("a.b$"), [".", "$"], "$1")) == "a$1b$1"
    assert one(spark, f.truncate(F.lit(-3.567), 1)) == -3.5
    assert one(spark, f.to_integer(F.lit("1.5"))) == 1
    assert one(spark, f.to_integer(F.lit("1.5"), truncating=False)) == 2
    assert one(spark, f.to_integer(F.lit("x"))) is None
    assert one(spark, f.is_number(F.lit(" -1e5 "))) is True
    assert one(spark, f.is_spaces(F.lit(""))) is False
    assert one(spark, f.concat_empty(F.lit("a"), F.lit(None).cast("string"))) == "a"
    assert one(spark, f.greatest_strict(F.lit(1), F.lit(None).cast("int"))) is None
    assert one(spark, f.decode(F.lit(None).cast("string"), None, 1, default=2)) == 1
    assert one(spark, f.mask(F.lit("Ab-1234"), 2)) == "XX-XX34"
    assert one(spark, f.choose(F.lit(9), "a")) is None
    assert one(spark, v.decompress(v.compress(F.lit("xyz")))) == "xyz"
    assert one(spark, v.metaphone(F.lit("Phone"))) == "FN"
    assert one(spark, v.metaphone(F.lit("Knight"))) == "NT"
    assert one(spark, f.json_values(F.lit('{"a": 1, "b": "x"}'), {"p": "$.a", "q": "$.b"})).asDict() == {"p": "1", "q": "x"}


def test_names_that_are_the_same_exist_in_spark(spark):
    known = {r[0] for r in spark.sql("SHOW FUNCTIONS").collect()}
    assert {n for n in f.SAME.values() if n not in known and n not in ("try_cast",)} == set()


def test_types():
    assert types.spark_type(types.canonical("NUMBER(10,2)")) == "decimal(10,2)"
    assert types.spark_type(types.canonical("NUMBER")) == "decimal(38,6)"
    assert types.spark_type(types.canonical("DATE", "oracle")) == "timestamp_ntz"
    assert types.spark_type(types.canonical("whatever")) == "string"
    got = dict(types.check_fit(T.StructType([T.StructField("a", T.DecimalType(20, 6)), T.StructField("b", T.LongType())]), {"a": types.canonical("DECIMAL(10,2)"), "b": types.canonical("INT"), "c": types.canonical("INT")}))
    assert got == {"a": "precision_loss", "b": "precision_loss", "c": "unknown_column"}


def test_files(spark, tmp_path):
    p = tmp_path / "orders.txt"
    p.write_text("﻿order id,amount,order_dt,active,note\n1,2.5,2024-01-01,true,x\n\n2,3,2024-01-02,false\n", encoding="utf-8")
    df = files.read_delimited(spark, str(p))
    assert df.columns == ["ORDER_ID", "AMOUNT", "ORDER_DT", "ACTIVE", "NOTE"]
    assert dict(df.dtypes)["ORDER_ID"] == "bigint" and dict(df.dtypes)["ORDER_DT"] == "date" and dict(df.dtypes)["ACTIVE"] == "boolean"
    assert df.count() == 2
    j = tmp_path / "r.json"
    j.write_text('{"data": [{"b": 1, "a": {"x": 2}}, {"b": null}]}')
    assert rows(files.read_json_records(spark, str(j)).select("B").filter("B is not null")) == [(1,)]
    assert files.clean_names(["a b", "a-b", "9x", "!"]) == ["A_B", "A_B_2", "C_9X", "COL"]


def test_streams_equal_tables(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    data = [(i, base + datetime.timedelta(minutes=i), i % 3, float(i)) for i in range(60)] + [(99, base + datetime.timedelta(days=2), 0, 0.0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(data, "id int, ts timestamp, k int, v double").repartition(1).write.parquet(src)
    stream = spark.readStream.schema("id int, ts timestamp, k int, v double").parquet(src)
    for kind, args in (("tumbling", {"size": "10 minutes"}), ("hopping", {"size": "10 minutes", "slide": "5 minutes"}), ("session", {"gap": "5 minutes"})):
        q = W.windowed(stream, kind, "ts", ["k"], {"n": "count(*)", "s": "sum(v)"}, **args).writeStream.format("memory").queryName(kind).outputMode("append").option("checkpointLocation", str(tmp_path / kind)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = W.windowed(spark.read.parquet(src), kind, "ts", ["k"], {"n": "count(*)", "s": "sum(v)"}, **args).filter("window_end < timestamp'2024-01-02'")
        assert rows(spark.table(kind).filter("window_end < timestamp'2024-01-02'")) == rows(want)
    with pytest.raises(ValueError):
        W.window_column("wavy", "ts")


def test_change_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "c", "a"), (1, 3, "u", "b"), (1, 2, "u", "x"), (2, 1, "c", "q"), (2, 2, "d", None), (3, 1, "c", "z")], "k int, seq int, op string, v string").write.parquet(src)
    stream = spark.readStream.schema("k int, seq int, op string, v string").parquet(src)
    S.keep_target(stream, out, str(tmp_path / "cp"), ["k"], ["seq"], "op").awaitTermination(120)
    kept = spark.read.parquet(out)
    assert rows(S.current(kept).select("k", "seq", "v")) == [(1, 3, "b"), (3, 1, "z")]
    stale = spark.createDataFrame([(2, 1, "u", "again"), (9, 4, "d", None), (9, 3, "u", "late")], "k int, seq int, op string, v string")
    after = S.apply_changes(kept, stale, ["k"], ["seq"], "op", tombstone="_deleted")
    assert rows(S.current(after).select("k", "seq", "v")) == [(1, 3, "b"), (3, 1, "z")] and after.count() == 4
    late = spark.createDataFrame([(1, 2, "u", "old"), (3, 5, "d", None)], "k int, seq int, op string, v string")
    assert rows(S.apply_changes(S.current(kept), late, ["k"], ["seq"], "op").select("k", "v")) == [(1, "b")]


def test_schema_evolution():
    nested = lambda *f: T.StructType([T.StructField(n, t, z) for n, t, z in f])
    old = nested(("a", T.IntegerType(), True), ("b", T.DoubleType(), True), ("c", T.StringType(), True), ("s", nested(("x", T.LongType(), True), ("y", T.DateType(), False)), True))
    new = nested(("a", T.LongType(), True), ("b", T.StringType(), True), ("d", T.StringType(), False), ("s", nested(("x", T.LongType(), False), ("y", T.DateType(), True)), True))
    got = [(d.field, d.kind) for d in E.differences(old, new)]
    assert got == [("a", "widened"), ("b", "retyped"), ("c", "removed"), ("d", "added, required"), ("s.x", "required"), ("s.y", "optional")]
    assert [d.field for d in E.breaking(E.differences(old, new))] == ["b", "c", "s.x"]
    assert [d.field for d in E.breaking(E.differences(old, new), "forward")] == ["b", "s.x"]
    assert E.breaking(E.differences(old, new), "NONE") == [d for d in E.differences(old, new) if d.kind in ("retyped", "required")]
    assert E.differences(old, old) == []
    with pytest.raises(ValueError):
        E.breaking([], "SIDEWAYS")


def test_rows_that_were_wrong(spark, tmp_path):
    """Quoted line breaks, null keys of a merge, and text that is no XML."""
    p = tmp_path / "q.csv"
    p.write_text('id,note\n1,"two\nlines, ""quoted"""\n2,plain\n', encoding="utf-8")
    assert rows(files.read_delimited(spark, str(p))) == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    (tmp_path / "r.csv").write_text('id,note\n1,"a ""b"" c"\n', encoding="utf-8")
    assert rows(files.read_delimited(spark, str(tmp_path / "r.csv"))) == [(1, 'a "b" c')]
    t = spark.createDataFrame([(1, "a"), (None, "t")], "k int, v string")
    s = spark.createDataFrame([(1, "b"), (None, "x"), (None, "y")], "k int, v string")
    assert sorted(map(repr, rows_of(L.merge(t, s, ["k"])))) == sorted(map(repr, [(1, "b"), (None, "t"), (None, "x"), (None, "y")]))
    texts = spark.createDataFrame([("<r><a>1</a></r>",), ("hello",), ("<r><a>",), ("",), (None,)], "x string")
    got = {r["x"]: r["parsed"] for r in R.parse_xml(texts, "x", "a int").collect()}
    assert got["<r><a>1</a></r>"]["a"] == 1 and [got[k] for k in ("hello", "<r><a>", "", None)] == [None] * 4


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_secrets_and_graph(spark):
    df = spark.createDataFrame([(1, "db password: \"kite-93-Harbour\" rest"), (2, "pwd=${DB_PWD}"), (3, "password: changeme"), (4, "jdbc://u:s3cretpw@h/db"), (5, None)], "id int, t string")
    assert rows(C.secrets(df, "id", "t").select("id", "type")) == [(1, "password"), (4, "connection_string_password")]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = rows(G.reach(e, spark.createDataFrame([("a",)], "node string")).select("node", "depth"))
    assert got == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_saves_are_put_back(spark, tmp_path):
    path = str(tmp_path / "t")
    L.save(spark.range(3), path)
    os.rename(path, path + ".old-x")  # a save that died between its renames
    assert L.recover(spark, path) and spark.read.parquet(path).count() == 3 and not L.recover(spark, path)
    L.save(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    L.save(spark.range(1), path, "append")
    assert spark.read.parquet(path).count() == 3
    L.save(spark.range(2).toDF("x"), str(tmp_path / "csv"), format="csv")
    assert spark.read.csv(str(tmp_path / "csv")).count() == 2


def test_statements_and_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType(), False, {"comment": "it's the key"}), T.StructField("a b", T.DecimalType(9, 2))])
    sql = types.create_table("made", schema, comment="rows")
    assert sql == "CREATE TABLE `made` (`id` BIGINT NOT NULL COMMENT 'it\\'s the key', `a b` DECIMAL(9,2)) USING parquet COMMENT 'rows'"
    done = L.with_statements(spark, lambda: spark.sql("INSERT INTO made VALUES (1, 2.5)"), ["DROP TABLE IF EXISTS made", sql], ["CREATE OR REPLACE TEMPORARY VIEW seen AS SELECT * FROM made"])
    assert done is not None and spark.table("seen").count() == 1
    spark.sql("DROP TABLE made")
    with pytest.warns(UserWarning, match="without keys"):
        assert rows(L.merge(spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(7, "b")], "k int, v string"), [])) == [(7, "b")]


def test_numbers_that_were_wrong(spark):
    one = spark.range(1)
    got = one.select(f.truncate(F.expr("-0.29BD"), 2).cast("string").alias("a"), f.truncate(F.expr("1234.5D"), -2).cast("string").alias("b"), f.to_integer(F.lit("-9.99")).alias("c"), f.truncate(F.expr("cast(null as double)")).alias("d")).first()
    assert got["a"] == "-0.29" and float(got["b"]) == 1200 and got["c"] == -9 and got["d"] is None
    many = spark.createDataFrame([(float(i),) for i in range(1, 201)], "v double")
    assert many.agg(A.nearest_rank("v", 1).alias("p")).first()["p"] == 2.0
    with pytest.raises(Exception, match="stop here"):
        one.select(f.error("stop here")).collect()
    assert W.window_column("session", "ts", "10 minutes", gap="5 minutes") is not None


def test_sequences_of_shared_values(spark):
    df = spark.createDataFrame([(None if i % 3 else 1, i) for i in range(300)], "o int, id int")
    got = {r["id"]: r["s"] for r in A.sequence(df, "s", "o", ["id"], start=10, step=2, parts=7).collect()}
    want = sorted(range(300), key=lambda i: (0 if i % 3 else 1, i))
    assert got == {i: 10 + 2 * k for k, i in enumerate(want)}
    assert A.sequence(df.limit(0), "s", "o", ["id"]).count() == 0


def test_records_of_one_key(spark):
    df = spark.createDataFrame([(1, "aa", "x", 1), (1, None, "y", 2), (1, "b", "y", 3), (2, None, None, 1)], "k int, a string, b string, t int")
    got = A.survivors(df, ["k"], {"a": ("longest", "a"), "b": ("most_frequent", "b"), "t": ("latest", "t")})
    assert rows(got) == [(1, "aa", "y", 3), (2, None, None, 1)]
    v = A.mapping_variables(df.limit(0), {"m": 3, "c": 1}, {"m": ("max", "t"), "c": ("count", "a")}).first()
    assert (v["m"], v["c"]) == (3, 1)


def test_names_and_dummies(spark):
    names = {"CustomerEmail": "customer_email", "KNA1_STRAS": "kna1_stras", "XMLParser": "xml_parser", "first name": "first_name", "HTTPServerID2": "http_server_id2", "__x__": "x", "": ""}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", C.normal_name(F.col("n")).alias("m")).collect()
    assert {r["n"]: r["m"] for r in got} == names
    values = {"your-key-here": True, "****": True, "XXXX": True, "Changeme": True, "${DB}": True, "k9!secret": False, "a*b": False, "yes": False}
    got = spark.createDataFrame([(k,) for k in values], "v string").select("v", C.outside(F.col("v")).alias("o")).collect()
    assert {r["v"]: r["o"] for r in got} == values


def test_other_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rs><r><id>1</id><n>x</n></r><r><id>2</id></r></rs>")
    assert rows(files.read_xml(spark, str(tmp_path / "a.xml"), "r").select("id", "n")) == [(1, "x"), (2, None)]
    spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01")], "id int, d string").write.parquet(str(tmp_path / "t.parquet"))
    entry = {"name": "t", "columns": {"id": "NUMBER(10)", "d": "DATE"}, "incremental_column": "d"}
    first = files.read_manifest_table(spark, entry, str(tmp_path))
    assert first.count() == 2 and first.schema["d"].dataType == T.DateType()
    assert files.read_manifest_table(spark, entry, str(tmp_path), first.filter("id = 1")).count() == 1
    assert Q.schema_differences(first, first.withColumnRenamed("id", "key")) == [("id", "missing"), ("key", "unexpected")]
