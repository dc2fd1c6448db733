"""A sink of tables as CSV files with a commit: what a job wrote is there as a whole or not at all."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Name of the source in ``df.write.format``.
NAME = "filing_tables"


@dataclass
class Part(WriterCommitMessage):
    """A task's file, and its rows by table."""

    file: str | None
    rows: dict


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _text(value) -> str:
    return "" if value is None else str(value)


class Writer(DataSourceWriter):
    """Tasks write under ``_started``; the commit moves their files beside each other and then writes ``_index.csv``, without which there is no table."""

    def __init__(self, path: str, table: str, columns: list[str]):
        self.path, self.table, self.columns, self.job = path.rstrip("/"), table, columns, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        store, root = _store(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.job}.csv"
        counts: dict[str, int] = {}
        out = text = None
        try:
            for row in rows:
                if out is None:
                    store.create_dir(f"{root}/_started/{self.job}", recursive=True)
                    out = store.open_output_stream(f"{root}/_started/{self.job}/{name}")
                    text = io.TextIOWrapper(out, "utf-8", newline="", write_through=False)
                    lines = csv.writer(text, lineterminator="\n")
                    lines.writerow(self.columns)
                lines.writerow([_text(row[c]) for c in self.columns])
                of = _text(row[self.table])
                counts[of] = counts.get(of, 0) + 1
        finally:
            if text is not None:
                text.close()
        return Part(name if out is not None else None, counts)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        lines = [["table", "file", "rows"]]
        for m in messages:
            if m is not None and m.file is not None:
                store.move(f"{root}/_started/{self.job}/{m.file}", f"{root}/{m.file}")
                lines += [[t, m.file, n] for t, n in sorted(m.rows.items())]
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows(lines)
        with store.open_output_stream(f"{root}/_index-{self.job}.csv") as out:
            out.write(text.getvalue().encode())
        self._clear(store, root)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        for folder in (f"{root}/_started/{self.job}", f"{root}/_started"):
            info = store.get_file_info(folder)
            if info.type == fs.FileType.Directory and (folder.endswith(self.job) or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class TableSink(DataSource):
    """``df.write.format(NAME).option("path", folder).option("table", column)``: appends a job's rows."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("tables are appended; a new folder takes a new set")
        return Writer(self.options["path"], self.options["table"], schema.fieldNames())


def write_tables(df: DataFrame, path: str, table: str = "Table_ID") -> None:
    """All rows of ``df`` as CSV files in ``path``, one for each task, and an index of tables, files and rows. All columns are texts; null is empty.

    A task that fails and is run again leaves no second file, as only the files
    that the commit was told of are moved; a job that fails leaves none
    but, from a task that outlives it, one under ``_started`` that no reader reads. A table with
    a third of all rows stands in as many files as it has tasks.
    """
    df.sparkSession.dataSource.register(TableSink)
    df.write.format(NAME).option("path", path).option("table", table).mode("append").save()


def read_tables(spark, path: str) -> DataFrame:
    """The rows that committed jobs wrote: of the files that an index names, and no others."""
    from pyarrow import fs

    store, root = _store(path)
    files: list[str] = []
    for info in store.get_file_info(fs.FileSelector(root)):
        if info.base_name.startswith("_index-"):
            with store.open_input_stream(info.path) as f:
                files += [r["file"] for r in csv.DictReader(io.StringIO(f.read().decode()))]
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv([f"{path}/{f}" for f in sorted(set(files))])
