r"""Line deduplication with levelled sorted runs of line hashes.

The corpus arrives in batches.  A *run* holds (key, documents) for some batches as a table in the shared
folder, bucketed by key into a fixed number of files, each sorted by key, so two runs meet in a
merge join with neither exchange nor sort.  A new batch merge-anti-joins the settled runs (keys that
have already reached the threshold need no more counting) and adds what is left as a run
of its own; two runs of one level are compacted into one of the next, and keys that reach
the threshold on the way move to the settled side.

Keys are 128-bit hashes (two longs) of the stripped, lower-cased line.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rasterloom.shared import remove, settle, shared_dir

SPACE = b" \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
KEY_TYPE = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def line_key(line: bytes) -> bytes | None:
    """16 bytes for a line; None for one without a code point left."""
    bare = line.strip(SPACE).lower()
    return xxhash.xxh3_128_digest(bare) if bare else None


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x.encode() for x in column.to_pylist()]


#: Lets a scan say that its buckets are sorted, which each is where it is one file.
SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside know the order of runs."""
    was = spark.conf.get(SORTED_SCAN)
    spark.conf.set(SORTED_SCAN, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_SCAN, was)


class LineRuns:
    """Levelled runs; ``add`` takes a batch of (h1, h2, n), ``common`` gives the keys with n >= least.

    ``close`` drops the runs' tables and files.  No batches, or empty ones, give no keys.
    """

    def __init__(self, spark: SparkSession, least: int, partitions: int):
        self.spark, self.least, self.partitions = spark, least, partitions
        self.levels: list[DataFrame | None] = []
        self.settled: list[DataFrame | None] = []
        self.tables: list[tuple[str, str]] = []

    def _run(self, df: DataFrame) -> DataFrame:
        """``df``, hash partitioned by key, as a sorted bucketed table."""
        at = shared_dir(self.spark, "run")
        name = "line_run_" + at.rpartition("-")[2]
        self.tables.append((name, at))
        with sorted_scans(self.spark):
            df.sortWithinPartitions(*KEY).write.format("parquet").bucketBy(self.partitions, *KEY).sortBy(*KEY).option("path", at).saveAsTable(name)
        return self.spark.table(name)

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.withColumnRenamed("n", "a"), b.withColumnRenamed("n", "b")
        return a.hint("merge").join(b, KEY, "full").select(*KEY, (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))

    def add(self, batch: DataFrame) -> None:
        run = batch.repartition(self.partitions, *KEY).groupBy(*KEY).agg(F.sum("n").alias("n"))
        for known in self.settled:
            if known is not None:
                run = run.join(known.hint("merge"), KEY, "left_anti")
        self._push(self.levels, 0, self._run(run))

    def _push(self, levels: list[DataFrame | None], at: int, run: DataFrame) -> None:
        while True:
            if at == len(levels):
                levels.append(None)
            if levels[at] is None:
                levels[at] = run
                return
            merged = self._run(self._merge(levels[at], run))
            levels[at] = None
            if levels is self.levels:
                self._push(self.settled, 0, self._run(merged.where(F.col("n") >= self.least)))
                merged = merged.where(F.col("n") < self.least)
            run, at = merged, at + 1

    def common(self) -> DataFrame:
        """The keys found in at least ``least`` documents, checkpointed."""
        rest = None
        for run in (x for x in self.levels if x is not None):
            rest = run if rest is None else self._merge(rest, run)
        out = self.spark.createDataFrame([], "h1 long, h2 long") if rest is None else rest.where(F.col("n") >= self.least).select(*KEY)
        for run in (x for x in self.settled if x is not None):
            out = out.unionByName(run.select(*KEY))
        with sorted_scans(self.spark):
            return settle(out)

    def close(self) -> None:
        for name, at in self.tables:
            self.spark.sql(f"drop table if exists {name}")
            remove(self.spark, at)
        self.tables.clear()


def line_counts(docs: DataFrame, text_col: str, batches: int) -> DataFrame:
    """(batch, h1, h2, n): in how many documents of a part of the input each key stands, counted in part before any shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(seen), KEY_TYPE)
            out = pa.RecordBatch.from_arrays([pa.array(keys["h1"]), pa.array(keys["h2"]), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], names=[*KEY, "n"])
            seen.clear()
            return out

        for part in parts:
            for text in _texts(part.column("text")):
                seen.update({k for line in text.split(b"\n") if (k := line_key(line))})
                if len(seen) > 200_000:
                    yield flush()
        if seen:
            yield flush()

    narrow = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h1 long, h2 long, n long")
    return narrow.groupBy(F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"), *KEY).agg(F.sum("n").alias("n"))


def common_lines(docs: DataFrame, least: int = 10, text_col: str = "text", batches: int = 4) -> DataFrame:
    """Keys (h1, h2) of the lines found in at least ``least`` documents, by way of ``batches`` batches."""
    spark = docs.sparkSession
    counts = settle(line_counts(docs, text_col, batches))
    runs = LineRuns(spark, least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        for k in range(batches):
            runs.add(counts.where(F.col("batch") == k).drop("batch"))
        return runs.common()
    finally:
        runs.close()


def _drop_lines(text: bytes, common: frozenset[bytes]) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [x for x in lines if line_key(x) not in common]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def line_dedup(docs: DataFrame, least: int = 10, text_col: str = "text", batches: int = 4, most_broadcast: int = 1_000_000, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    r"""``docs`` without the lines whose key stands in at least ``least`` documents, plus two count columns.

    Each row counts as a document, ids aren't read: repeated rows and null ids are fine.  A null
    or empty text is one empty line, which stays, as do lines of white space; a text is read whole, however
    long, and a line any number of times in it counts once.  A table without rows gives none.  Other columns pass
    through; a count column whose name is taken replaces the taken one (choose names by ``counts``).
    Up to ``most_broadcast`` common keys (16 bytes each) are broadcast after their number is
    checked; beyond that, lines are joined with the keys and documents put together again.
    """
    spark = docs.sparkSession
    common = common_lines(docs, least, text_col, batches)
    if common.count() > most_broadcast:
        return _by_join(docs, common, text_col, counts)
    keys = common.toArrow()
    packed = np.empty(keys.num_rows, KEY_TYPE)
    for name in KEY:
        packed[name] = keys.column(name).to_numpy()
    shared = spark.sparkContext.broadcast(packed.tobytes())
    base = docs.drop(*counts)
    place = base.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        hot = frozenset(raw[i : i + 16] for i in range(0, len(raw), 16))
        for part in parts:
            done = [_drop_lines(x, hot) for x in _texts(part.column(place))]
            columns = part.columns
            columns[place] = pa.array([x[0].decode() for x in done], part.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=[*part.schema.names, *counts])

    return base.mapInArrow(run, StructType([*base.schema.fields, *(StructField(name, LongType()) for name in counts)]))


def _key_udf():
    @F.pandas_udf("h1 long, h2 long")
    def key(lines):
        import pandas as pd

        found = [line_key(x.encode()) for x in lines]
        both = np.frombuffer(b"".join(x or bytes(16) for x in found), KEY_TYPE)
        none = np.array([x is None for x in found], bool)
        return pd.DataFrame({n: pd.Series(both[n], dtype="Int64").mask(none) for n in KEY})

    return key


def _by_join(docs: DataFrame, common: DataFrame, text_col: str, counts: tuple[str, str]) -> DataFrame:
    """The same by a left join of exploded lines; groups are the lines of one document, so bounded by it."""
    base = docs.drop(*counts)
    names = base.columns
    whole = settle(base.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("row", F.monotonically_increasing_id()))
    text = f"c{names.index(text_col)}"
    lines = whole.select("row", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line"))
    keyed = lines.withColumn("key", _key_udf()("line")).select("row", "line_no", "line", "key.h1", "key.h2")
    found = keyed.join(common.withColumn("hot", F.lit(True)), KEY, "left")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("hot").isNull(), F.struct("line_no", "line")))), lambda x: x["line"])
    again = found.groupBy("row").agg(F.concat_ws("\n", kept).alias("kept"), F.count(F.lit(1)).alias("n_lines"), F.count("hot").alias("n_dropped"))
    joined = whole.join(again, "row")
    return joined.select(*(F.col("kept" if f"c{i}" == text else f"c{i}").alias(n) for i, n in enumerate(names)), F.col("n_lines").alias(counts[0]), F.col("n_dropped").alias(counts[1]))
