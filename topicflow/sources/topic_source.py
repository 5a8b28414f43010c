"""S11 as a data source: ``spark.read.format("topic_files").load(folder)``.

Each ``<anything>_<dataset>_topk<K>.txt`` file is one partition.  The reader
numbers the lines (topics) and words itself, so no window is needed, and takes
filters on ``dataset`` and ``num_topics``: files not asked for are not opened.
Filters are pushed when ``spark.sql.python.filterPushdown.enabled`` is true;
otherwise Spark applies them to the rows, with the same result.

Options: ``max_words`` (15), the words kept of a topic.  Folders may lie on any
file system ``pyarrow.fs`` opens.  Defined results: an empty line is a topic
without words and gives no row, but keeps its number; files of another name
are no topic files; a folder without files gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "dataset string, num_topics string, file string, topic int, rank int, term string"
NAME = re.compile(r"_(?P<dataset>[^_]+)_(?:topk)?(?P<k>[^_]+)\.txt$")
# Names of datasets in files that are other names elsewhere.
ALIASES = {"answer": "yahoo_answer", "20newgroups": "20NewsGroup"}


@dataclass
class TopicFile(InputPartition):
    path: str
    dataset: str
    num_topics: str


def _open_fs(path: str):
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class TopicFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.max_words = options["path"], int(options.get("max_words", 15))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities and lists of values on the two columns a file's name holds; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in ("dataset", "num_topics"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[TopicFile]:
        from pyarrow import fs
        store, folder = _open_fs(self.folder)
        found = []
        for info in store.get_file_info(fs.FileSelector(folder)):
            m = NAME.search(info.base_name) if info.type == fs.FileType.File else None
            if m is None:
                continue
            has = {"dataset": ALIASES.get(m["dataset"], m["dataset"]), "num_topics": m["k"]}
            if all(has[c] in values for c, values in self.wanted.items()):
                found.append(TopicFile(info.path, **has))
        return sorted(found, key=lambda p: p.path)

    def read(self, partition: TopicFile | None) -> Iterator[tuple]:
        if partition is None:                       # a folder without files
            return
        store, _ = _open_fs(self.folder)
        name = partition.path.rsplit("/", 1)[-1]
        with store.open_input_stream(partition.path) as f:
            text = f.read().decode("utf-8", "replace")
        lines = text.split("\n")
        for topic, line in enumerate(lines):
            words = line.strip(" \r").split(" ")
            for rank, term in enumerate(words[:self.max_words] if words != [""] else []):
                yield partition.dataset, partition.num_topics, name, topic, rank, term


class TopicFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TopicFileReader:
        return TopicFileReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known and let filters reach it."""
    spark.dataSource.register(TopicFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
