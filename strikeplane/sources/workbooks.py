"""Logs from workbooks and wells from arrays: files that Spark lists and deals out, each opened by the task that has it.

A sheet holds at most 1,048,576 rows and an array file one site's wells, so a file fits a task; many files are many tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import find_columns, normals_to_log, number


def column_index(place: str) -> int:
    """The column, from 0, of a cell's place: A1 is 0, AB7 is 27."""
    at = 0
    for letter in re.match(r"[A-Za-z]+", place).group().upper():  # type: ignore[union-attr]
        at = at * 26 + ord(letter) - 64
    return at - 1


def _texts(element: ElementTree.Element) -> str:
    """The text of a shared or inline string, its runs joined; readings in rPh are no part of it."""
    parts = [c for c in element if not c.tag.endswith("}rPh")]
    return "".join(t.text or "" for c in parts for t in c.iter() if t.tag.endswith("}t"))


def first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the sheet which the workbook lists first; without such a list, the one of the lowest number."""
    names = book.namelist()
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        listed = (s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet"))
        first = next(listed, None)
        if first is not None:
            link = next((v for k, v in first.attrib.items() if k.endswith("}id")), None)
            for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
                if r.attrib.get("Id") == link:
                    target = r.attrib["Target"]
                    part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                    if part in names:
                        return part
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    if not sheets:
        raise ValueError("a workbook without a sheet")
    return sheets[0]


def sheet_rows(content: bytes) -> list[tuple[int, list[str | None]]]:
    """The rows of a workbook's first sheet: their number there, from 1, and their cells as texts up to the last. Rows without cells count, but are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if s.tag.endswith("}si")]
        out: list[tuple[int, list[str | None]]] = []
        at_row = 0
        with book.open(first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if not row.tag.endswith("}row"):
                    continue
                at_row = int(row.attrib.get("r", at_row + 1))
                line: list[str | None] = []
                for cell in (c for c in row if c.tag.endswith("}c")):
                    at = column_index(cell.attrib["r"]) if "r" in cell.attrib else len(line)
                    value = next((v.text for v in cell if v.tag.endswith("}v")), None)
                    if cell.attrib.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.attrib.get("t") == "inlineStr":
                        value = "".join(_texts(i) for i in cell if i.tag.endswith("}is"))
                    line += [None] * (at + 1 - len(line))
                    line[at] = value
                if line:
                    out.append((at_row, line))
                row.clear()
        return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(well, row_id, depth, dip, dip_dir) of the first sheet of one XLSX or a folder of them; what is no number is null.

    The first row that has cells is the header, and files may differ in theirs. A file without a depth, dip or
    dip direction column fails. Without a well column a file's name is the well's. row_id is the row's place in
    its sheet, 0 for the row below the header; rows without cells count.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def opened(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for place, content in zip(pdf["path"], pdf["content"]):
                rows = sheet_rows(content)
                top, header = (rows[0][0], [c or "" for c in rows[0][1]]) if rows else (0, [])
                columns = find_columns(header)
                if missing := {"depth", "dip", "dip_dir"} - set(columns):
                    raise ValueError(f"no column for {', '.join(sorted(missing))} in {place}")
                at = {want: header.index(name) for want, name in columns.items()}
                of = lambda line, want: line[at[want]] if want in at and at[want] < len(line) else None  # noqa: E731,B023
                stem = PurePosixPath(place).stem
                body = [((of(line, "well") or "").strip() or stem, i - top - 1, *(of(line, c) for c in ("depth", "dip", "dip_dir"))) for i, line in rows[1:]]
                yield pd.DataFrame(body, columns=["well", "row_id", "depth", "dip", "dip_dir"])

    raw = files.mapInPandas(opened, "well string, row_id long, depth string, dip string, dip_dir string")
    return raw.select("well", "row_id", *(number(F.col(c)).alias(c) for c in ("depth", "dip", "dip_dir")))


def read_array_wells(spark: SparkSession, path: str, key: str = "wells") -> DataFrame:
    """(well, row_id, depth, nx, ny, nz, dip, dip_dir) of NPZ files with an array of normals, wells x rows x 3 or rows x 3.

    The array is `key`, or a file's first. A well is named by its file and place; normals become unit vectors, and
    rows of zeros are padding. Files that hold objects instead of numbers fail.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def opened(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for place, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    normals = np.asarray(data[key if key in data else data.files[0]], dtype=float)
                normals = normals[None] if normals.ndim == 2 else normals
                length = np.linalg.norm(normals, axis=-1, keepdims=True)
                unit = np.where(length > 1e-12, normals / np.maximum(length, 1e-12), 0.0)
                stem = PurePosixPath(place).stem
                yield pd.DataFrame({"well": [f"{stem}_{i:02d}" for i in range(len(unit))], "normals": [w.tolist() for w in unit]})

    return normals_to_log(files.mapInPandas(opened, "well string, normals array<array<double>>"))
