"""Readers of documents that need a library: a table of back ends, asked in order of preference.

A back end turns a file's bytes into tables: (page from 1, title, rows of
cells). None ships here; a site registers those whose libraries it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Table = tuple[int, str, list[list[str]]]
Backend = Callable[[bytes], Iterator[Table]]
TABLES = "source_doc string, backend string, table_no int, page_no int, title string, rows array<array<string>>, error string"

_KNOWN: dict[str, tuple[int, Backend]] = {}


def register(name: str, backend: Backend, preference: int = 100) -> None:
    """Add a back end; the smallest preference is asked first. A name that is known is replaced."""
    _KNOWN[name] = (preference, backend)


def unregister(name: str) -> None:
    _KNOWN.pop(name, None)


def names() -> list[str]:
    return [n for n, _ in sorted(_KNOWN.items(), key=lambda kv: (kv[1][0], kv[0]))]


def scan(spark: SparkSession, path: str, glob: str = "*.pdf", use: Sequence[str] | None = None) -> DataFrame:
    """Tables of all files under ``path``, one row each.

    The back ends ``use`` (all by preference, if not given) are tried until one
    doesn't fail; a file that none reads gives one row with every ``error``, one
    without tables gives none. An unknown or missing back end is an error here,
    before any task runs.
    """
    chosen = list(use or names())
    if not chosen or set(chosen) - set(_KNOWN):
        raise ValueError(f"no such back end: {sorted(set(chosen) - set(_KNOWN)) or 'none is registered'}")
    readers = [(n, _KNOWN[n][1]) for n in chosen]
    columns = [c.split()[0] for c in TABLES.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch["source_doc"], batch["content"], strict=True):
                errors: list[str] = []
                for name, backend in readers:
                    try:
                        found = [(doc, name, k, page, title, rows, None) for k, (page, title, rows) in enumerate(backend(data), 1)]
                    except Exception as e:  # noqa: BLE001 - a back end may fail in any way, and the next one is asked
                        errors.append(f"{name}: {type(e).__name__}: {e}")
                        continue
                    if found:
                        yield pd.DataFrame(found, columns=columns)
                    break
                else:
                    yield pd.DataFrame([(doc, None, None, None, None, None, "; ".join(errors))], columns=columns).astype({"table_no": "Int32", "page_no": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_doc"), "content").mapInPandas(read, TABLES)


def quality(tables: DataFrame) -> DataFrame:
    """Per document and back end: tables, rows, and the share of cells that are filled."""
    cells = F.flatten("rows")
    filled = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return tables.where("error IS NULL").groupBy("source_doc", "backend").agg(
        F.count("*").alias("tables"), F.sum(F.size("rows")).alias("rows"), F.try_divide(F.sum(filled), F.sum(F.size(cells))).alias("filled")
    )
