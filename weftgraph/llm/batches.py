"""Arrow-batch helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, if it comes straight from a scan with fewer.

    A table of few row groups would otherwise keep most cores idle through Python's share of the work. Large scans have
    more partitions than cores and are never shuffled; the rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def map_arrow(df: DataFrame, fn: Callable[[list[list]], list], schema: str) -> DataFrame:
    """``fn`` over column lists of slices of Arrow batches; it returns column lists (or arrays) of the result.

    Slices hold at most 512 rows, so that what a function builds beside its texts stays small whatever the batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                cols = fn([c.to_pylist() for c in b.columns])
                if cols is None:
                    continue
                names = names or [f"c{i}" for i in range(len(cols))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names=fields)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    types = [to_arrow_type(f.dataType) for f in parsed.fields]
    fields = [f.name for f in parsed.fields]
    return df.mapInArrow(run, schema)
