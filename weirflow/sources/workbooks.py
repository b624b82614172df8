"""XLSX workbooks: Spark reads the files from whatever store, each file is unpacked and its first sheet streamed in one task.

Cells come as texts: shared and inline strings, numbers as written, booleans as true and false, dates and times (told by the cell's number format) in ISO form, errors as null. Types are then found over all rows as for delimited
files. A file is held in memory once, packed, and its shared strings unpacked; rows are not.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.sources.files import clean_names, infer_types, typed

#: Number formats of the standard that are dates or times (fixed values); others are if their code has a letter of one outside quotes and brackets.
DATES = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
BATCH = 2000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
        if _local(e.tag) == "si":
            out.append(_joined(e))
            e.clear()
    return out


def _joined(e: ElementTree.Element) -> str:
    """The text of a string, without its phonetic runs."""
    return "".join(t.text or "" for run in ([e] + [r for r in e if _local(r.tag) == "r"]) for t in run if _local(t.tag) == "t")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    codes = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter() if _local(f.tag) == "numFmt"}
    cells = next((x for x in root if _local(x.tag) == "cellXfs"), ())
    ids = [int(x.get("numFmtId", 0)) for x in cells]
    return {k for k, i in enumerate(ids) if (re.search("[ymdhs]", codes[i], re.IGNORECASE) if i in codes else i in DATES)}


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part of the sheet that the workbook names first."""
    root = ElementTree.parse(book.open("xl/workbook.xml")).getroot()
    sheet = next(e for e in root.iter() if _local(e.tag) == "sheet")
    link = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot():
        if r.get("Id") == link:
            return r.get("Target").lstrip("/") if r.get("Target").startswith("/") else "xl/" + r.get("Target")
    raise ValueError("the workbook does not say where its first sheet is")


def _old_calendar(book: zipfile.ZipFile) -> bool:
    return any(e.get("date1904") in ("1", "true") for e in ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter() if _local(e.tag) == "workbookPr")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(packed: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """Number and cells of each row of a workbook's first sheet; rows without a cell are left out."""
    book = zipfile.ZipFile(io.BytesIO(packed))
    texts, dates = _texts(book), _date_styles(book)
    start = datetime.datetime(1904, 1, 1) if _old_calendar(book) else datetime.datetime(1899, 12, 30)

    def value(c: ElementTree.Element) -> str | None:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return next((_joined(x) for x in c if _local(x.tag) == "is"), None)
        v = next((x.text for x in c if _local(x.tag) == "v"), None)
        if v is None or kind == "e":
            return None
        if kind == "s":
            return texts[int(v)]
        if kind == "b":
            return "true" if v == "1" else "false"
        if kind == "n" and int(c.get("s", 0)) in dates:
            t = start + datetime.timedelta(seconds=round(float(v) * 86400))
            return t.date().isoformat() if t.time() == datetime.time() else t.isoformat(sep=" ")
        return v

    n = 0
    for _, e in ElementTree.iterparse(book.open(_first_sheet(book))):
        if _local(e.tag) == "row":
            n = int(e.get("r", n + 1))
            cells: list[str | None] = []
            for c in e:
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = value(c)
            if any(x not in (None, "") for x in cells):
                yield n, cells
            e.clear()


def read_workbook(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """The first sheet of a workbook, or of all in a folder (whose headers must be the same): the first row names the columns; short rows are filled with null, cells beyond the header are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["path", "n", "cells"])

        for batch in batches:
            for name, packed in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                for n, cells in sheet_rows(packed):
                    rows.append((name, n, cells))
                    if len(rows) == BATCH:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    rows = files.mapInArrow(run, "path string, n long, cells array<string>")
    heads = rows.groupBy("path").agg(F.min_by("cells", "n").alias("head"), F.min("n").alias("at"))
    kinds = [list(r["head"]) for r in heads.select("head").distinct().collect()]
    if not kinds:
        return spark.createDataFrame([], "COL string").limit(0)
    if len(kinds) > 1:
        raise ValueError(f"the workbooks have different headers: {kinds[:3]}")
    names = clean_names([h or "" for h in kinds[0]])
    df = rows.join(heads.select("path", "at"), "path").where("n > at").select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)])
    return typed(df, infer_types(df)) if infer else df
