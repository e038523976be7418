"""Buckets of rows compared all against all, in blocks of bounded size.

A bucket larger than `block` is dealt into blocks by a hash of the row's id;
every pair of its blocks is a group of its own, so a hot bucket spreads over
tasks and no group holds more than about twice `block` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import trimmed


def dealt(rows: DataFrame, keys: list[str], row_id: str, block: int) -> DataFrame:
    """Rows of buckets with two rows or more, with bi <= bj (the group's blocks) and own (the row's block)."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    n = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(row_id), F.lit(7)), n).cast("int")
    spread = rows.join(sizes.hint("merge"), keys).withColumn("n", n).withColumn("own", own)
    return (
        spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("bi", F.least("own", "other"))
        .withColumn("bj", F.greatest("own", "other"))
        .drop("size", "n", "other")
    )


def column_values(column: pa.Array) -> np.ndarray:
    """A numpy array; a list column whose lists are of one length becomes two-dimensional."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return column.to_numpy(zero_copy_only=False)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of two rows or more, from batches sorted by keys (integers without nulls)."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        whole = new if held is None else pa.concat_tables([held, new])
        k = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in keys])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        starts = np.concatenate([[0], cuts])
        whole = whole.combine_chunks()
        for i in np.flatnonzero(np.diff(starts) > 1):
            yield whole.slice(starts[i], starts[i + 1] - starts[i])
        held = whole.slice(starts[-1])
    if held is not None and held.num_rows > 1:
        yield held.combine_chunks()


def each_group(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """work() on every group of two rows or more; what it returns are columns of the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict[str, np.ndarray]] = []
        held = 0
        for group in groups(batches, keys):
            made = work(group)
            if made is not None:
                found.append(made)
                held += len(made[arrow.names[0]])
            if held >= 50_000:
                yield _batch(found, arrow)
                found, held = [], 0
        if found:
            yield _batch(found, arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), schema)


def _batch(found: list[dict[str, np.ndarray]], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[f.name] for x in found]), f.type) for f in arrow], schema=arrow)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest member that links a[i]-b[i] reach."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label
