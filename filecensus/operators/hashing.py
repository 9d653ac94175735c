"""SHA-256 of texts, files and folders.

A folder's hash is the SHA-256 of its files' sorted ``relative path:hash`` lines.  Lines are
dealt by folder and sorted inside their partition, which Spark spills to disk as needed, and
each folder's lines run through one hash object as they come.  So a task holds one batch of
lines whatever the size of a folder, and all folders are hashed side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def folder_hashes(files: DataFrame, keys: list[str], rel: str = "rel", digest: str = "hash") -> DataFrame:
    """``keys`` plus ``folder_hash``; files without a hash are left out.

    A folder whose files all lack a hash gets the hash of the empty text.  Null keys are a
    folder of their own.  SHA-256 needs a folder's bytes in order, so one huge folder is one
    sequential stream; it shares its task with few others and is never gathered.
    """
    line = F.when(F.col(digest).isNotNull(), F.concat_ws(":", F.col(rel), F.col(digest)))
    lines = files.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], line.alias("line"))
    names = lines.columns[:-1]
    schema = ", ".join(f"{n} {lines.schema[n].dataType.simpleString()}" for n in names)
    hashed = (
        lines.repartition(*names)
        .sortWithinPartitions(*names, "line")
        .mapInArrow(_streamed(len(names)), f"{schema}, folder_hash string")
    )
    return hashed.toDF(*keys, "folder_hash")


def _streamed(n_keys: int):
    """Hash the runs of equal keys of one sorted partition, a run over any number of batches."""

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        """Rows whose keys differ from the row before."""
        changed = np.zeros(batch.num_rows, dtype=bool)
        for i in range(n_keys):
            codes = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            changed[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(changed)

    def closed(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*done))
        arrays = [pa.array(columns[i], schema.field(i).type) for i in range(n_keys)]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(columns[-1], pa.string())], names=[*schema.names[:n_keys], "folder_hash"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = schema = None
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            schema, done = batch.schema, []
            cuts = [0, *changes(batch).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                own = tuple(batch.column(i)[start].as_py() for i in range(n_keys))
                if state is None or own != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state, begun = own, hashlib.sha256(), False
                lines = batch.column(n_keys).slice(start, end - start).drop_null().to_pylist()
                if lines:
                    state.update(("\n" * begun + "\n".join(lines)).encode())
                    begun = True
            if done:
                yield closed(done, schema)
        if state is not None:
            yield closed([(*key, state.hexdigest())], schema)

    return run


def bytes_hash(chunks: Iterator[bytes]) -> str:
    """SHA-256 of a file read in chunks."""
    digest = hashlib.sha256()
    for chunk in chunks:
        digest.update(chunk)
    return digest.hexdigest()
