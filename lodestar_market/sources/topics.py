"""Topics: messages with JSON bodies in folders, written and read by streams.

A log is a folder with one subfolder for each batch of its writer
(``batch=7/topic=alerts/part-...``); a batch counts once Spark's mark of success
is there.  The offset of a reader is the number of the last batch that it has
read, so a stream that starts again goes on after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MESSAGE = "topic string, batch long, file string, line long, value string"
_BATCH = re.compile(r"batch=(\d+)$")
_TOPIC = re.compile(r"topic=([^/]+)$")
#: Lines of a record batch.
LINES = 10_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _File(InputPartition):
    def __init__(self, topic: str, batch: int, path: str):
        self.topic, self.batch, self.path = topic, batch, path


class _Log:
    def __init__(self, options: dict):
        self.path, self.topics = options["path"], [t.strip() for t in options.get("topics", "").split(",") if t.strip()]

    def batches(self) -> dict[int, str]:
        """Folders of batches before the first that isn't whole."""
        store, root = _store(self.path)
        found = {int(m[1]): i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if (m := _BATCH.search(i.path))}
        whole = {}
        for number in sorted(found):
            if store.get_file_info(f"{found[number]}/_SUCCESS").type != fs.FileType.File:
                break
            whole[number] = found[number]
        return whole

    def files(self, after: int, until: int) -> list[_File]:
        store, _ = _store(self.path)
        out = []
        for number, folder in self.batches().items():
            if after < number <= until:
                for topic in store.get_file_info(fs.FileSelector(folder)):
                    name = _TOPIC.search(topic.path)
                    if name and (not self.topics or name[1] in self.topics):
                        out += [_File(name[1], number, f.path) for f in store.get_file_info(fs.FileSelector(topic.path)) if f.base_name.startswith("part-")]
        return sorted(out, key=lambda f: (f.batch, f.topic, f.path))

    def rows(self, part: _File) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        name = part.path.rsplit("/", 1)[1]

        def batch(lines: list[str], first: int) -> pa.RecordBatch:
            n = len(lines)
            columns = [pa.array([part.topic] * n), pa.array([part.batch] * n, pa.int64()), pa.array([name] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines)]
            return pa.RecordBatch.from_arrays(columns, names=["topic", "batch", "file", "line", "value"])

        held, first = [], 0
        with store.open_input_stream(part.path) as raw:
            rest = b""
            while block := raw.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                held += [line.decode() for line in lines]
                if len(held) >= LINES:
                    yield batch(held, first)
                    first, held = first + len(held), []
            if rest:
                held.append(rest.decode())
        if held:
            yield batch(held, first)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, log: _Log):
        self.log = log

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(self.log.batches(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return self.log.files(start["batch"], end["batch"])

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return self.log.rows(partition)


class _Reader(DataSourceReader):
    def __init__(self, log: _Log):
        self.log = log

    def partitions(self) -> list[_File]:
        return self.log.files(-1, max(self.log.batches(), default=-1))

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        return self.log.rows(partition) if partition else iter(())


class TopicSource(DataSource):
    """``format("topics")`` with ``path`` and, unless all are wanted, ``topics`` joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "topics"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema) -> _Reader:
        return _Reader(_Log(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(_Log(self.options))


def read_topics(spark: SparkSession, path: str, *topics: str, stream: bool = True) -> DataFrame:
    """topic, batch, file, line and value of the messages of some topics, or of all."""
    spark.dataSource.register(TopicSource)
    return (spark.readStream if stream else spark.read).format("topics").option("path", path).option("topics", ",".join(topics)).load()


def write_batch(messages: DataFrame, number: int, path: str) -> None:
    """Write topic and value as batch ``number`` of a log; where that batch is whole nothing changes."""
    store, root = _store(path)
    if store.get_file_info(f"{root}/batch={number}/_SUCCESS").type == fs.FileType.File:
        return
    # A body on several lines would be several messages: JSON may do without its line feeds.
    value = F.regexp_replace("value", "[\\r\\n]+", " ")
    messages.select("topic", value.alias("value")).where("topic is not null and value is not null").write.mode("overwrite").partitionBy("topic").text(f"{path}/batch={number}")


def publish(messages: DataFrame, path: str, state: str) -> None:
    """Run a stream of topic and value into a log, as far as there is something; a batch that is run again is there once."""
    query = messages.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path))
    query.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
