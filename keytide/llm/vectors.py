"""Tables of vectors, as the operators on embeddings need them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import in_batches, whole_ids


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, not zero, every component there and finite."""
    x = F.transform(vec, lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~odd & F.exists(x, lambda c: c != 0), F.lit(False))


def packed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, dim int, v binary) of the usable rows: components as little-endian doubles. Ids must be whole numbers."""
    whole_ids(df, id_col)

    @in_batches
    def run(batch):
        vec = batch.column(1)
        flat, ends = vec.flatten().to_numpy(zero_copy_only=False).astype("<f8"), vec.offsets.to_numpy()
        ends = ends - ends[0]
        return {"id": batch.column(0), "dim": pa.array(np.diff(ends).astype(np.int32)), "v": pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())}

    rows = df.where(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, dim int, v binary")
