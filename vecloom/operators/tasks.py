"""Functions of the caller's own over all vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.knn import matrix


def per_vector(items: DataFrame, task: Callable[[np.ndarray], np.ndarray], id_col: str = "id", vector_col: str = "vector", rows: int = 2000) -> DataFrame:
    """(id, value): ``task`` maps a matrix, whose rows are vectors of one length, to a number for each. Null vectors have a null value,
    empty ones go to the task as a matrix without columns."""
    source = items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                lengths = np.asarray(batch["vector"].value_lengths().fill_null(-1))
                value = np.zeros(len(lengths))
                for n in np.unique(lengths[lengths >= 0]):
                    own = np.flatnonzero(lengths == n)
                    value[own] = task(matrix(batch["vector"].take(pa.array(own))).reshape(len(own), -1))
                yield pa.record_batch({"id": batch["id"], "value": pa.array(value, mask=lengths < 0)})

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, value double")
