"""What the vector operators share: usable rows as a packed table, equal vectors joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def packed(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dim, v): vectors as little-endian doubles; null, empty and zero ones and those with null or non-finite components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, vs = [], [], []
            for ident, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if ident is None or not v.is_valid or v.values is None or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(x).all() and x.any():
                    ids.append(ident)
                    dims.append(len(x))
                    vs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vs, pa.binary())], names=["id", "dim", "v"])

    return df.select(F.col(id_col).cast("long"), vec_col).mapInArrow(run, "id bigint, dim int, v binary")


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return written(packed(df, id_col, vec_col))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of packed vectors of one length."""
    vs = column.to_pylist()
    return np.frombuffer(b"".join(vs), dtype="<f8").reshape(len(vs), -1) if vs else np.zeros((0, 0))
