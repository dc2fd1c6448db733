"""Workbooks (Office Open XML spreadsheets) as raw sheet grids, and reports as workbooks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = "workbook string, sheet string, sheet_no int, row_idx int, cells array<string>, error string"
#: Sheets that hold no tables.
SKIPPED = ("TOC", "Index")
#: Fixed values of the file format.
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _name(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _number(text: str) -> str:
    try:
        v = float(text)
    except ValueError:
        return text
    return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ET.iterparse(f):
            if e.tag == f"{NS}si":
                out.append("".join(t.text or "" for p in e for t in ([p] if p.tag == f"{NS}t" else p.findall(f"{NS}t") if p.tag == f"{NS}r" else [])))
                e.clear()
    return out


def _value(c: ET.Element, shared: list[str]) -> str | None:
    kind, v = c.get("t", "n"), c.find(f"{NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{NS}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    return {"b": lambda t: "True" if t == "1" else "False", "n": _number}.get(kind, str)(v.text)


def sheets(data: bytes) -> Iterator[tuple[str, Iterator[tuple[int, list[str | None]]]]]:
    """Name and rows (number from 0, cells) of every sheet in workbook order; rows are parsed one at a time, blank rows are left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = _strings(z)
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}

    def rows(path: str) -> Iterator[tuple[int, list[str | None]]]:
        at = -1
        with z.open(path) as f:
            for _, e in ET.iterparse(f):
                if e.tag != f"{NS}row":
                    continue
                at = int(e.get("r")) - 1 if e.get("r") else at + 1
                cells: list[str | None] = []
                for c in e.findall(f"{NS}c"):
                    i = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (i + 1 - len(cells))
                    cells[i] = _value(c, shared)
                e.clear()
                if any(x not in (None, "") for x in cells):
                    yield at, cells

    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet"):
        target = targets[s.get(f"{REL}id")]
        yield s.get("name"), rows(target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target))


def _grids(batches: Iterator[pd.DataFrame], size: int = 4096) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in GRID.split(", ")]
    for batch in batches:
        for workbook, data in zip(batch["workbook"], batch["content"], strict=True):
            held: list[tuple] = []
            try:
                for k, (sheet, rows) in enumerate(sheets(data)):
                    for at, cells in rows:
                        held.append((workbook, sheet, k, at, cells, None))
                        if len(held) >= size:
                            yield pd.DataFrame(held, columns=names)
                            held = []
            except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError) as e:
                held.append((workbook, None, None, None, None, f"{type(e).__name__}: {e}"))
            if held:
                yield pd.DataFrame(held, columns=names).astype({"sheet_no": "Int32", "row_idx": "Int32"})


def scan(spark: SparkSession, path: str, glob: str = "*_tables.xlsx") -> DataFrame:
    """Raw grid rows of all workbooks under ``path``; one that can't be read gives a row with ``error`` alone.

    ``workbook`` is the file's name without ``_tables.xlsx``. Files are dealt to
    tasks, and a task holds one batch of files, not their rows.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "(_tables)?\\.xlsx$", "")
    return found.select(name.alias("workbook"), "content").mapInPandas(_grids, GRID)


def tables_only(grid: DataFrame) -> DataFrame:
    return grid.where(F.col("error").isNull() & ~F.col("sheet").isin(*SKIPPED))


def export_status(grid: DataFrame) -> DataFrame:
    """Per workbook: sheets read, rows, and SUCCESS, PARTIAL_SUCCESS (an error after rows) or FAILED."""
    g = grid.groupBy("workbook").agg(F.countDistinct("sheet").alias("sheets"), F.count("row_idx").alias("rows"), F.max("error").alias("error"))
    status = F.when(F.col("error").isNull(), "SUCCESS").when(F.col("rows") > 0, "PARTIAL_SUCCESS").otherwise("FAILED")
    return g.withColumn("status", status)


def index(grid: DataFrame) -> DataFrame:
    """Rows of the Index sheets as maps from the heading to the cell, by workbook and row."""
    rows = grid.where("sheet = 'Index'")
    head = rows.groupBy("workbook").agg(F.min_by("cells", "row_idx").alias("_head"), F.min("row_idx").alias("_first"))
    pairs = F.filter(F.arrays_zip(F.col("_head").alias("k"), F.col("cells").alias("v")), lambda p: p["k"].isNotNull())
    entry = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
    return rows.join(head, "workbook").where("row_idx > _first").select("workbook", "row_idx", entry.alias("entry"))


def workbook_bytes(tables: Mapping[str, Sequence[Sequence]]) -> bytes:
    """A workbook of report size with one sheet per entry; numbers stay numbers, None is an empty cell. More rows than a sheet holds are an error."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, doc = NS[1:-1], REL[1:-1]
    n = len(tables)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}worksheet+xml"/>' for i in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{doc}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
        names = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(tables, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{doc}"><sheets>{names}</sheets></workbook>')
        for i, rows in enumerate(tables.values(), 1):
            if len(rows) > MOST_ROWS:
                raise ValueError(f"a sheet holds {MOST_ROWS} rows, not {len(rows)}")
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                for r, row in enumerate(rows, 1):
                    cells = "".join(_written(f"{_name(c)}{r}", v) for c, v in enumerate(row) if v is not None)
                    f.write(f'<row r="{r}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _written(ref: str, v) -> str:
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
