"""Databases through the driver that Spark brings along, and workbooks."""

import datetime
import uuid
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weirflow.sources import databases as D
from weirflow.sources import workbooks as X


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def db(spark):
    db = D.Database.at(spark, "derby", f"t{uuid.uuid4().hex};create=true")
    db.run(
        "CREATE TABLE DEPT (ID INT NOT NULL PRIMARY KEY, NAME VARCHAR(20) NOT NULL UNIQUE)",
        "CREATE TABLE EMP (ID BIGINT NOT NULL PRIMARY KEY, DEPT INT REFERENCES DEPT(ID), PAY DECIMAL(9,2), SINCE DATE)",
        "CREATE TABLE PLAIN (V VARCHAR(5))",
        "INSERT INTO DEPT VALUES (1, 'a'), (2, 'b')",
    )
    return db


EMP = [(i, 1 + i % 2, Decimal(i) / 4 if i % 5 else None, datetime.date(2020, 1, 1) + datetime.timedelta(i)) for i in range(-50, 450)]


def test_load_read_and_catalogue(spark, db):
    df = spark.createDataFrame(EMP, "id bigint, dept int, pay decimal(9,2), since date").repartition(5)
    assert D.load_table(df, db, "EMP") == 500
    got = D.read_table(db, "EMP", parts=4)
    assert got.rdd.getNumPartitions() == 4 and rows(got) == rows(df)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 130
    assert D.read_table(db, "EMP", "SINCE", 3).rdd.getNumPartitions() == 3
    assert rows(D.read_table(db, "EMP", "DEPT", 2)) == rows(df)
    plan = got.where("dept = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(DEPT,1)" in plan
    about = D.declared(db, "EMP")
    assert [(c[0], c[1], c[4]) for c in about.columns] == [("ID", "BIGINT", False), ("DEPT", "INTEGER", True), ("PAY", "DECIMAL", True), ("SINCE", "DATE", True)]
    assert about.key == ["ID"] and about.references == [("DEPT", "DEPT", "ID")] and D.declared(db, "DEPT").unique == [["ID"], ["NAME"]]
    assert rows(D.sizes(db, ["EMP", "DEPT"])) == [("DEPT", 2), ("EMP", 500)]


def test_a_load_is_whole_or_nothing(spark, db, monkeypatch):
    bad = spark.createDataFrame([(9000, 1), (9001, 77)], "id bigint, dept int")  # no such department
    before = D.sizes(db, ["EMP"]).first()[1]
    with pytest.raises(Exception, match="(?i)constraint|foreign"):
        D.load_table(bad, db, "EMP")
    assert D.sizes(db, ["EMP"]).first()[1] == before
    with pytest.raises(ValueError, match="no column"):
        D.load_table(bad.withColumn("x", F.lit(1)), db, "EMP")
    assert D.load_table(spark.createDataFrame([("p",), (None,)], "v string"), db, "PLAIN") == 2
    assert D.load_table(spark.createDataFrame([("q",)], "v string"), db, "PLAIN", replace=True) == 1
    assert rows(D.read_table(db, "PLAIN")) == [("q",)]
    with pytest.raises(ValueError, match="no number"):
        D.read_table(db, "PLAIN", "V")
    monkeypatch.setattr(D.Observation, "get", {"n": 5})
    with pytest.raises(D.Miscounted):
        D.load_table(spark.createDataFrame([("r",)], "v string"), db, "PLAIN")
    assert rows(D.read_table(db, "PLAIN")) == [("q",)]


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheet, shared=(), other_first=False):
    with zipfile.ZipFile(path, "w") as z:
        names = [("Data", "rId2"), ("More", "rId1")]
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="{r}"/>' for k, (n, r) in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData><row r="1"><c t="inlineStr"><is><t>wrong</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>when</t></is></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="s"><v>1</v></c></row>'
    shared = ("<t>order id</t>", "<r><t>no</t></r><r><t>te</t></r><rPh><t>x</t></rPh>", "<t>two\nlines</t>")
    workbook(tmp_path / "in" / "a.xlsx", head + '<row r="3"><c r="A3"><v>7</v></c><c r="B3" s="1"><v>45292</v></c><c r="D3" t="s"><v>2</v></c></row><row r="4"/><row r="5"><c r="A5"><v>8</v></c><c r="C5" t="b"><v>1</v></c><c r="D5" t="e"><v>#N/A</v></c><c r="F5"><v>1</v></c></row>', shared)
    workbook(tmp_path / "in" / "b.xlsx", head + '<row r="9"><c r="A9" s="3"><v>9</v></c><c r="B9" s="1"><v>45293</v></c></row>', shared)
    df = X.read_workbook(spark, str(tmp_path / "in"))
    assert df.dtypes == [("ORDER_ID", "bigint"), ("WHEN", "date"), ("NOTE", "boolean"), ("NOTE_2", "string")]
    day = datetime.date(2024, 1, 1)
    assert rows(df) == [(7, day, None, "two\nlines"), (8, None, True, None), (9, day + datetime.timedelta(1), None, None)]
    workbook(tmp_path / "t.xlsx", head + '<row r="3"><c r="B3" s="2"><v>45292.75</v></c></row>', shared)
    assert X.read_workbook(spark, str(tmp_path / "t.xlsx"), infer=False).first()["WHEN"] == "2024-01-01 18:00:00"
    workbook(tmp_path / "empty.xlsx", "")
    assert X.read_workbook(spark, str(tmp_path / "empty.xlsx")).count() == 0
    workbook(tmp_path / "in" / "c.xlsx", '<row r="1"><c t="inlineStr"><is><t>other</t></is></c></row>')
    with pytest.raises(ValueError, match="headers"):
        X.read_workbook(spark, str(tmp_path / "in"))
