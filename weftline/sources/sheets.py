"""Workbooks (.xlsx) as rows of cells, by zip and XML alone; headers found by their aliases; demand lists.

Files are read by tasks through Spark's `binaryFile` source, so any store that Spark reads will do; a workbook, packed, is one row of that source and
must fit a task; its rows come out a few thousand at a time. Tables are written by tasks too, a workbook or more each.
"""

from __future__ import annotations

import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from weftline.functions.normalize import text
from weftline.shared import store

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Headers under which demand lists have their columns.
ALIASES = {
    "code": ["code", "الكود", "كود الصنف"],
    "name": ["name", "اسم الصنف"],
    "qty": ["qty", "الكمية", "الكمية المطلوبة", "كمية", "كمية الطلب"],
}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet as text, row by row; formulas by their cached values."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (len(n), n))
        for _, row in ElementTree.iterparse(io.BytesIO(z.read(sheet))):
            if row.tag != f"{_M}row":
                continue
            cells: list[str | None] = []
            for c in row.iter(f"{_M}c"):
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                elif (v := c.find(f"{_M}v")) is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
            yield cells
            row.clear()


_PACK = "http://schemas.openxmlformats.org/package/2006"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_MAIN}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_MAIN}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_M[1:-1]}" xmlns:r="{_REL}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="r1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _cell(v) -> str:
    if isinstance(v, int | float) and not isinstance(v, bool):
        return f"<c><v>{v}</v></c>"
    return "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def pack_rows(out: BinaryIO, rows: Iterable[Sequence]) -> None:
    """One sheet of inline strings and numbers, packed into out as rows come."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in _PARTS.items():
            z.writestr(name, _XML + body)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'{_XML}<worksheet xmlns="{_M[1:-1]}"><sheetData>'.encode())
            for row in rows:
                sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")


def workbook(rows: Iterable[Sequence]) -> bytes:
    out = io.BytesIO()
    pack_rows(out, rows)
    return out.getvalue()


#: Rows that the format's sheets hold: what a workbook can have.
MOST_ROWS = 1_048_576


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Workbooks(DataSource):
    """`df.write.format("workbooks").mode("append").save(folder)`: workbooks of a header row and at most `mostRows` rows in all, by tasks."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, schema.names)


class WorkbookWriter(DataSourceWriter):
    """Tasks write under names of their own attempt, hidden; the files of the attempts that Spark takes are moved to theirs in the end."""

    def __init__(self, options: dict, names: list[str]):
        self.folder, self.most = options["path"], min(MOST_ROWS, int(options.get("mostrows", MOST_ROWS)))
        self.head = [*json.loads(options.get("above", "[]")), names]

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = store(self.folder)
        fs.create_dir(root, recursive=True)
        task, files = TaskContext.get(), []
        rows = iter(iterator)
        while (first := next(rows, None)) is not None:
            files.append(f"part-{task.partitionId():06d}-{len(files):04d}-{task.taskAttemptId():x}.xlsx")
            with fs.open_output_stream(f"{root}/_{files[-1]}") as out:
                pack_rows(out, itertools.chain(self.head, [first], itertools.islice(rows, self.most - len(self.head) - 1)))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store(self.folder)
        for f in (f for m in messages if m for f in m.files):
            fs.move(f"{root}/_{f}", f"{root}/{f}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = store(self.folder)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/_{f}")


def write_workbooks(df: DataFrame, folder: str, above: list[list] | None = None, order: list[Column] | None = None, most_rows: int = MOST_ROWS) -> None:
    """df as workbooks in folder, each with a header row and `above` before it. In an order, names of files rise with it."""
    d = df if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.sparkSession.dataSource.register(Workbooks)
    d.write.format("workbooks").option("above", json.dumps(above or [])).option("mostRows", most_rows).mode("append").save(folder)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 0), cells (text) of every workbook under path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                rows = enumerate(workbook_rows(content))
                while part := list(itertools.islice(rows, 4096)):
                    yield pd.DataFrame({"path": p, "row": [i for i, _ in part], "cells": [c for _, c in part]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, row long, cells array<string>")


def header_rows(cells: DataFrame, wanted: dict[str, list[str]] = ALIASES, identity: tuple = ("code", "name")) -> DataFrame:
    """path, row, and the place of each wanted column in the header: the first of 20 rows that has all of them, else the first with the identity."""
    names = F.transform("cells", lambda c: F.regexp_replace(F.trim(text(c)), r"\s+", " "))
    d = cells.filter("row < 20").withColumn("_h", names)
    place = {k: F.try_element_at(F.filter(F.transform(F.array(*map(F.lit, v)), lambda a: F.array_position("_h", a)), lambda p: p > 0), F.lit(1)) for k, v in wanted.items()}
    d = d.withColumns({f"at_{k}": p for k, p in place.items()})
    every = F.lit(True)
    for k in wanted:
        every = every & F.col(f"at_{k}").isNotNull()
    some = F.lit(True)
    for k in identity:
        some = some & F.col(f"at_{k}").isNotNull()
    kind = F.when(every, 0).when(some, 1)
    at = F.struct(*(F.col(f"at_{k}").alias(k) for k in wanted))
    d = d.filter(kind.isNotNull()).groupBy("path").agg(F.min(F.struct(kind.alias("kind"), F.col("row"), at.alias("at"))).alias("h"))
    return d.select("path", F.col("h.row").alias("row"), F.col("h.at").alias("at"))


def whole_number(c: Column) -> Column:
    """Rounded half to even; blank or no number is 0."""
    return F.coalesce(F.rint(F.regexp_replace(F.trim(text(c)), ",", "").try_cast("double")).cast("int"), F.lit(0))


def demand_rows(df: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """code, name, qty and the other columns, without rows that are blank or ask for less than `least`."""
    q = whole_number(F.col("qty"))
    d = df.withColumns({"code": F.regexp_replace(F.trim(text(F.col("code"))), r"\.0$", ""), "name": F.trim(text(F.col("name"))), "qty": q if most is None else F.least(q, F.lit(most))})
    return d.filter(((F.col("code") != "") | (F.col("name") != "")) & (F.col("qty") >= least))


def read_demand(spark: SparkSession, path: str, match_only: bool = False, least: int = 1, most: int | None = None) -> DataFrame:
    """path, row, code, name, qty of demand workbooks; without quantities each row asks for one."""
    cells = read_cells(spark, path)
    wanted = {k: ALIASES[k] for k in (("code", "name") if match_only else ("code", "name", "qty"))}
    heads = header_rows(cells, wanted).withColumnRenamed("row", "head")
    d = cells.join(heads, "path").filter("row > head")
    cell = lambda k: F.get("cells", F.col(f"at.{k}").cast("int") - 1)
    d = d.select("path", "row", cell("code").alias("code"), cell("name").alias("name"), (F.lit("1") if match_only else cell("qty")).alias("qty"))
    return demand_rows(d, least, most)
