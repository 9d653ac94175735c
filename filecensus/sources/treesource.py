"""``spark.read.format("filetree")``: a directory tree as a data source.

Options: ``path`` (the root, or ``load(path)``), ``follow_symlinks`` (false), ``partitions`` (how many input
partitions to aim at, 64) and ``share_bytes``.  Every entry below the root is a row, what could not be
listed is a row with ``error``.  Scans with walking rules use ``filetree.list_tree``, which deals every level anew.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filecensus.sources.filetree import BATCH_ROWS, SHARE_BYTES, folder_entries

COLUMNS = "path string, filename string, is_directory boolean, is_symlink boolean, is_file boolean, error string"


@dataclass
class TreePart(InputPartition):
    """A share of a folder's names; ``deep`` goes on into the folders among them."""

    folder: str
    share: int
    shares: int
    above: list[str]
    deep: bool


class FileTreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(self.options)


class FileTreeReader(DataSourceReader):
    def __init__(self, options):
        if "path" not in options:
            raise ValueError("a file tree needs a path")
        self.root = options["path"].rstrip("/") or "/"
        self.follow = str(options.get("follow_symlinks", "false")).lower() == "true"
        self.wanted = int(options.get("partitions", 64))
        self.share_bytes = int(options.get("share_bytes", SHARE_BYTES))

    def _entries(self, folder: str, share: int, shares: int, above: list[str]) -> Iterator[tuple]:
        return folder_entries(folder, share, shares, above, self.follow, self.share_bytes)

    def _goes_down(self, row: tuple) -> bool:
        _, _, is_directory, is_symlink, _, error, _, _, leads_back = row
        return error is None and is_directory and not leads_back and (self.follow or not is_symlink)

    def partitions(self) -> list[TreePart]:
        """The tree's top is opened until there are enough folders to deal; a folder of very many names is dealt in shares.

        Only folders of few names are opened here, and no more of them than partitions are wanted.
        """
        open_ = deque([(self.root, 1, [])])
        parts: list[TreePart] = []
        while open_ and len(parts) + len(open_) < self.wanted:
            folder, shares, above = open_.popleft()
            if shares > 1:
                parts += [TreePart(folder, k, shares, above, True) for k in range(shares)]
                continue
            parts.append(TreePart(folder, 0, 1, above, False))
            open_.extend((row[0], row[6], row[7]) for row in self._entries(folder, 0, 1, above) if self._goes_down(row))
        return parts + [TreePart(folder, k, shares, above, True) for folder, shares, above in open_ for k in range(shares)]

    def read(self, partition: TreePart) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        todo = [(partition.folder, partition.share, partition.shares, partition.above)]
        while todo:
            for row in self._entries(*todo.pop()):
                rows.append(row[:6])
                if partition.deep and self._goes_down(row):
                    todo.append((row[0], 0, 1, row[7]))
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FileTreeSource)
