"""A data source that writes the results of a run as JSON and text together, or not at all.

Each task writes a JSON and a text file of its own below ``folder/runs/<run>/<attempt>``; only the commit names those that count, in a
manifest that it puts in place last. A failed task or job leaves no manifest and its files are removed; files of attempts
that were lost are in no manifest. A run that has a manifest is not written again: a replay removes its own files.

    spark.dataSource.register(RunSink)
    df.write.format("run_results").option("folder", uri).option("run", "2024-01-01").mode("append").save()
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from piiguard.shared import open_folder


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, by kind, and how many rows they hold."""

    files: dict[str, str]
    rows: int


def _line(row: Row) -> str:
    return "; ".join(f"{k}={v}" for k, v in row.asDict().items())


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, run: str):
        #: Each write has a folder of its own, so that giving it up touches no other's files.
        self.folder, self.run, self.attempt = folder, run, uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        files, base = open_folder(self.folder)
        return files, f"{base}/runs/{self.run}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, place = self._place()
        files.create_dir(f"{place}/{self.attempt}", recursive=True)
        stem, rows = f"{self.attempt}/{uuid.uuid4().hex}", 0
        names = {"json": f"{stem}.json", "text": f"{stem}.txt"}
        with files.open_output_stream(f"{place}/{names['json']}", compression=None) as as_json, files.open_output_stream(f"{place}/{names['text']}", compression=None) as as_text:
            for row in iterator:
                as_json.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode())
                as_text.write((_line(row) + "\n").encode())
                rows += 1
        return Written(names, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, place = self._place()
        done = [m for m in messages if m is not None]
        if files.get_file_info(f"{place}/manifest.json").is_file:
            self._give_up(files, place)
            return
        files.create_dir(f"{place}/{self.attempt}", recursive=True)
        told = {kind: [m.files[kind] for m in done] for kind in ("json", "text")} | {"rows": sum(m.rows for m in done)}
        draft = f"{place}/{self.attempt}/manifest.draft"
        with files.open_output_stream(draft, compression=None) as out:
            out.write(json.dumps(told).encode())
        files.move(draft, f"{place}/manifest.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._give_up(*self._place())

    def _give_up(self, files: fs.FileSystem, place: str) -> None:
        if files.get_file_info(f"{place}/{self.attempt}").type == fs.FileType.Directory:
            files.delete_dir(f"{place}/{self.attempt}")


class RunSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_results"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite or not {"folder", "run"} <= set(self.options):
            raise ValueError("run_results appends a run: give folder and run")
        return _Writer(self.options["folder"], self.options["run"])


def write_run(df: DataFrame, folder: str, run: str) -> None:
    df.sparkSession.dataSource.register(RunSink)
    df.write.format("run_results").option("folder", folder).option("run", run).mode("append").save()


def read_run(spark: SparkSession, folder: str, run: str, schema) -> tuple[DataFrame, DataFrame]:
    """The rows of a run that was committed, as a table of ``schema`` and as lines of text."""
    files, base = open_folder(folder)
    with files.open_input_stream(f"{base}/runs/{run}/manifest.json", compression=None) as source:
        told = json.loads(source.read())
    paths = lambda kind: [f"{folder}/runs/{run}/{n}" for n in told[kind]]
    return spark.read.schema(schema).json(paths("json")), spark.read.text(paths("text"))
