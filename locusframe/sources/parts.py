"""Files of a format of their own, written by tasks into a trial folder and moved to their place once all tasks have ended well."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def open_at(path: str):
    """(file system, path in it) of a path or address."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class PartsWriter(DataSourceArrowWriter):
    """write() of a format puts files into the folder of trial() and names those that shall stay."""

    def __init__(self, path: str):
        self.path, self.trial_name = path.rstrip("/"), f"_trial-{uuid.uuid4().hex}"

    def trial(self):
        """(file system, trial folder, a name that no other attempt takes)."""
        from pyspark import TaskContext

        fs, base = open_at(self.path)
        task = TaskContext.get()
        folder = f"{base}/{self.trial_name}"
        fs.create_dir(folder)
        return fs, folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}"

    def place(self, name: str) -> str:
        """Where a file of the trial folder goes."""
        return name

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The files of tasks that ended well move to their place; what lost tasks left goes."""
        fs, base = open_at(self.path)
        for m in messages:
            for name in m.names if m is not None else ():
                place = f"{base}/{self.place(name)}"
                fs.create_dir(place.rpartition("/")[0])
                fs.move(f"{base}/{self.trial_name}/{name}", place)
        self.abort(messages)
        with fs.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        import pyarrow.fs

        fs, base = open_at(self.path)
        if fs.get_file_info(f"{base}/{self.trial_name}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.trial_name}")


class _NamedWriter(PartsWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder, attempt = self.trial()
        lines = ((name, value) for b in iterator for name, value in zip(b.column("name").to_pylist(), b.column("value").to_pylist(), strict=True))
        names = []
        for name, group in groupby(lines, key=lambda x: x[0]):
            names.append(f"{attempt}/{name}")
            fs.create_dir(f"{folder}/{names[-1]}".rpartition("/")[0])
            with fs.open_output_stream(f"{folder}/{names[-1]}") as out:  # compressed as the name's ending says
                for _, value in group:
                    out.write(f"{value}\n".encode())
        return Written(names)

    def place(self, name: str) -> str:
        return name.partition("/")[2]


class NamedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_text"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _NamedWriter(self.options["path"])


def named_texts(lines: DataFrame, path: str) -> None:
    """lines (name, at, value) as text files of these names in a folder, each in order of `at`; a name that ends in .gz is compressed, one with slashes lies in a folder below.

    A file is one task's work, as it is one stream. Rows that are too many for that get names in several folders.
    """
    spark = lines.sparkSession
    spark.dataSource.register(NamedSource)
    rows = lines.where("name is not null and value is not null").repartition("name").sortWithinPartitions("name", "at").select("name", "value")
    rows.write.format("named_text").mode("append").save(path)
