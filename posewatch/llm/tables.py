"""Settings and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A batch that goes to Python holds few rows, because one text may be megabytes long.
ARROW_ROWS = "256"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, with Arrow batches bounded for whole texts."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def map_rows(
    df: DataFrame, columns: list[str], schema: str, work: Callable[[list[list]], list[list]]
) -> DataFrame:
    """Apply `work` to the given columns of every Arrow batch.

    `work` gets one Python list per column and returns one list per output column;
    the lists need not have the length of the input.
    """
    spark = df.sparkSession
    bounded(spark)
    names = spark.createDataFrame([], schema).schema.names
    types = arrow_schema(spark, schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = work([batch.column(i).to_pylist() for i in range(len(columns))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, types.field(n).type) for n, x in zip(names, out, strict=True)],
                schema=types,
            )

    return df.select(*columns).mapInArrow(batches, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)
