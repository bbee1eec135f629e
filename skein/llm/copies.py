"""Problem 4: records that differ only by formatting, by an incremental ledger of canonical keys.

The ledger is a table in buckets by key: key, number of copies, smallest doc_id. A batch is aggregated first (partial
sums before the shuffle), then full-outer-joined with those buckets that it touches; only these are written anew, and a
state file that names the current folder of each bucket is replaced last. So an update that fails leaves the ledger as
it was, a repeated one is recognised by its batch name, and a ledger can be opened again by its path. The number of
buckets follows the number of keys. A key that a third of all records share is one row of the aggregate, and its members
meet the ledger row by a broadcast of the few hot rows, so no task holds the group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import HOT_PARTS, split_join
from ..session import ship, stash, workdir
from . import textkit as T
from .store import read_state, remove, write_state

#: Keys that a bucket is made for; at twice as many on average, the ledger is laid out anew.
BUCKET_KEYS = 500_000
_COLUMNS = "key binary, n_copies bigint, first_doc_id string"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.string()), ("key", pa.binary())])
    for b in batches:
        texts = b.column(1).to_pylist()
        keys: list[bytes | None] = []
        for lo, hi in T.slices(texts):
            keys += T.keys(texts[lo:hi])[1]
        made = pa.array(keys, pa.binary())
        keep = made.is_valid()
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), made.filter(keep)], schema=schema)


def canonical_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key) of each document with a letter, mark or digit in its text; the key identifies the normal form.
    Null, empty and blank texts have no normal form and no row. Other columns of ``docs`` are ignored."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("string"), "text").where("text is not null").mapInArrow(_keys, "doc_id string, key binary")


class Ledger:
    """Persisted counts of canonical keys; ``update`` adds a batch. Opening a path that holds a ledger continues it."""

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.bucket_keys = spark, bucket_keys
        self.path = path or f"{workdir(spark)}/skein/ledger-{uuid.uuid4().hex}"
        self.state = read_state(spark, f"{self.path}/ledger.json") or {"round": 0, "buckets": 0, "where": {}, "rows": {}, "batches": []}

    def _bucket(self, buckets: int) -> F.Column:
        return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def _folders(self, buckets: list[str]) -> DataFrame:
        folders = [f"{self.path}/round-{self.state['where'][b]}/bucket={b}" for b in buckets]
        return self.spark.read.schema(_COLUMNS).parquet(*folders) if folders else self.spark.createDataFrame([], _COLUMNS)

    def read(self) -> DataFrame:
        """(key, n_copies, first_doc_id) of all keys so far."""
        return self._folders(list(self.state["where"]))

    def update(self, keys: DataFrame, batch: str | None = None) -> Ledger:
        """Add a batch of (doc_id, key). A batch must hold each document once; an empty one changes nothing. A batch
        whose name the ledger has seen is left out, so a job can be run again. Driver memory: a number a bucket."""
        if batch is not None and batch in self.state["batches"]:
            return self
        new = stash(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_doc_id")), "ledger-batch")
        old = self.state
        held = sum(old["rows"].values())
        n = new.count()
        buckets = old["buckets"] or max(16, -(-n // self.bucket_keys))
        grown = held + n > 2 * buckets * self.bucket_keys
        if grown:
            buckets = -(-(held + n) // self.bucket_keys)
        touched = [str(r[0]) for r in new.select(self._bucket(buckets)).distinct().collect()]  # at most ``buckets`` numbers
        before = list(old["where"]) if grown else [b for b in touched if b in old["where"]]
        if before:
            was = self._folders(before).toDF("key", "o_n", "o_first")
            new = was.join(new, "key", "full").select("key", (F.coalesce("o_n", F.lit(0)) + F.coalesce("n_copies", F.lit(0))).alias("n_copies"), F.least("o_first", "first_doc_id").alias("first_doc_id"))
        number = old["round"] + 1
        folder = f"{self.path}/round-{number}"
        if touched:
            new.withColumn("bucket", self._bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(f"{_COLUMNS}, bucket int").parquet(folder).groupBy("bucket").count().collect() if touched else []
        rows = ({} if grown else old["rows"]) | {str(r[0]): r[1] for r in written}
        where = ({} if grown else old["where"]) | {str(r[0]): number for r in written}
        self.state = {"round": number, "buckets": buckets, "where": where, "rows": rows, "batches": old["batches"] + ([batch] if batch is not None else [])}
        write_state(self.spark, f"{self.path}/ledger.json", self.state)
        for b in before:
            remove(self.spark, f"{self.path}/round-{old['where'][b]}/bucket={b}")
        return self


def tally(docs: DataFrame, batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """Run ``docs`` through a new ledger in so many batches; returns the ledger and the documents' keys."""
    keys = stash(canonical_keys(docs), "keys")
    book = Ledger(docs.sparkSession)
    for i in range(batches):
        book.update(keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i), f"batch {i} of {batches}")
    return Ledger(docs.sparkSession, book.path).read(), keys


def collapsed(docs: DataFrame) -> DataFrame:
    """One row for each normal form: the smallest doc_id and the number of copies, itself included."""
    book, _ = tally(docs)
    return book.select("first_doc_id", "n_copies")


def copies(docs: DataFrame) -> DataFrame:
    """(first_doc_id, doc_id): each further member of a set of equal normal forms with the smallest."""
    book, keys = tally(docs)
    repeated = book.where("n_copies > 1").select("key", "n_copies", "first_doc_id")
    total = keys.count()
    hot = repeated.where(F.col("n_copies") > max(total // HOT_PARTS, 10_000)).select("key")
    return split_join(keys.select("doc_id", "key"), repeated.select("key", "first_doc_id"), "key", hot).where("doc_id <> first_doc_id").select("first_doc_id", "doc_id")
