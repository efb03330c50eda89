"""Histograms of a trajectory that is still being written.

Bin counts and sums only ever grow, so the aggregation of the batch operators runs
unchanged on a stream, with one state row per bin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..operators.histogram import address_rows
from ..session import shared_folder


def stream_bin_sum(stream: DataFrame, spec: GridSpec, coords: list[Column], values: dict[str, Column]) -> DataFrame:
    """Running ``addr`` and sums of a streaming DataFrame."""
    rows = address_rows(stream, spec, coords, *[c.alias(n) for n, c in values.items()])
    return rows.groupBy("addr").agg(*[F.sum(n).alias(n) for n in values])


def run_to_end(sums: DataFrame) -> DataFrame:
    """Process everything available now and return the sums.

    Each micro-batch writes the complete result to a folder of its own; a repeated batch
    overwrites its folder, so the last one is right whatever was restarted.
    """
    spark = sums.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        last.append(number)

    query = (
        sums.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], sums.schema)
    return spark.read.schema(sums.schema).parquet(f"{base}/out/{max(last)}")
