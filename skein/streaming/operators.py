"""Stream forms: incremental scan, bounded state of each author, seen ids, running counters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import workdir


def scan(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table as a file stream. Single files are picked from their folder by name."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path.removeprefix("file://")):
        return s.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return s.parquet(path)


def scan_json(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """JSON lines as they arrive; a broken line keeps its text in ``_corrupt`` and the stream goes on."""
    return spark.readStream.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_trigger).json(path)


def capped_state(stream: DataFrame, author: str, key: str, most: int, seed: int) -> DataFrame:
    """Update rows (author, ids): the ``most`` documents of smallest hash seen so far. Keeping the smallest is the same
    in any order and when rows come again, so the state equals the batch sample. State of an author: at most ``most``
    pairs."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    keyed = stream.where(F.col(author).isNotNull()).select(F.col(author).cast("string").alias("author"), F.col(key).cast("string").alias("id"), F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("u"))

    def step(key_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = set(zip(*state.get)) if state.exists else set()
        for p in pdfs:
            held |= set(zip(p.u, p.id))
            held = set(sorted(held)[:most])
        best = sorted(held)
        state.update(([u for u, _ in best], [i for _, i in best]))
        yield pd.DataFrame({"author": [key_[0]], "ids": [[i for _, i in best]]})

    return keyed.groupBy("author").applyInPandasWithState(step, "author string, ids array<string>", "u array<string>, id array<string>", "update", GroupStateTimeout.NoTimeout)


def seen_once(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each id; ids are remembered in the checkpoint, so a restart goes on where it stopped."""
    return stream.dropDuplicates([key])


def counters(stream: DataFrame, *by: str) -> DataFrame:
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def run(stream: DataFrame, mode: str, checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Run until all that is there is processed and give back what was written, with its batch number. Appends survive
    a restart with the same ``checkpoint`` and ``target``; a batch that is run again replaces its own files."""
    spark = stream.sparkSession
    home = f"{workdir(spark)}/skein/stream-{uuid.uuid4().hex}"
    checkpoint, target = checkpoint or f"{home}/checkpoint", target or f"{home}/rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", target).parquet(target)


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """The last update of each key."""
    r = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("batch")))
    return rows.withColumn("__r", r).where("__r = 1").drop("__r", "batch")
