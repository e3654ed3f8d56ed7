"""SHA-256 of texts that lie in pieces over many rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def pieces_sha256(pieces: DataFrame, key: Sequence[str], order: str, body: str, between: str = "") -> DataFrame:
    """key and sha256 (lowercase hex) of each key's pieces in order, with ``between`` them; null pieces count for nothing.

    Spark sorts the pieces; a task reads them one after another and holds the state of one
    key, so nothing grows with the text of a key. Null keys are a key.
    """
    key = list(key)
    rows = pieces.select(*key, order, body).repartition(*key).sortWithinPartitions(*key, order)
    schema = T.StructType([*(rows.schema[k] for k in key), T.StructField("sha256", T.StringType())])
    arrow = pa.schema([*((k, pa.string() if isinstance(rows.schema[k].dataType, T.StringType) else pa.int64()) for k in key), ("sha256", pa.string())])
    joint = between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state = None
        begun = False
        for b in batches:
            done: list[tuple] = []
            names = list(zip(*(b.column(k).to_pylist() for k in key), strict=True))
            for name, text in zip(names, b.column(body), strict=True):
                if name != own or state is None:
                    if state is not None:
                        done.append((*own, state.hexdigest()))
                    own, state, begun = name, hashlib.sha256(), False
                if text.is_valid:
                    if begun:
                        state.update(joint)
                    state.update(text.as_buffer())
                    begun = True
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, d, strict=True)) for d in done], arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*own, state.hexdigest()), strict=True))], arrow)

    return rows.mapInArrow(run, schema)
