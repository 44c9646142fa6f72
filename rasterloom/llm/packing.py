"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Documents are tokenized and cut; what gets packed is only ever counted.  The plan is
best-fit decreasing over at most ``length`` distinct piece lengths: how many sequences of
which contents.  Pieces then take the planned slots by their rank within their length, a
rank made of a count per (task, length) and a position inside the task, so no task ever
holds all pieces of one length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm import textbytes as tb
from rasterloom.shared import shared_dir
from rasterloom.llm.tokens import tokenizer

END = 2
_PIECES = "piece int, start long, length int, ids_crc32 long, ids binary, task long, nth long"


def plan(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (piece length, first rank, end rank, first sequence, offset).

    Ranks of a length are dealt in order; slot k's rank r goes to sequence ``first sequence + r - first rank``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> (first sequence, how many) that have it
    slots, sequences = [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]

        def put(first: int, bins: int, space: int, each: int) -> None:
            nonlocal rank, left
            for k in range(each):
                slots.append((size, rank, rank + bins, first, length - space + k * size))
                rank, left = rank + bins, left - bins
            if space - each * size:
                room.setdefault(space - each * size, []).append((first, bins))

        def fill(first: int, bins: int, space: int) -> int:
            """Put pieces into equal sequences, each as full as it gets; how many sequences were used."""
            each = space // size
            if full := min(bins, left // each):
                put(first, full, space, each)
            if full < bins and left:
                put(first + full, 1, space, left)  # fewer than ``each`` are left
                full += 1
            return full

        for space in sorted(s for s in room if s >= size):
            while left and room.get(space):
                first, bins = room[space].pop()
                if (used := fill(first, bins, space)) < bins:
                    room[space].append((first + used, bins - used))
            if not left:
                break
        if left:
            sequences += fill(sequences, -(-left // (length // size)), length)
    return slots


def tokenized(docs: DataFrame, path: str, length: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Pieces of at most ``length`` ids; a longer document's first piece takes the remainder."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        task = TaskContext.get().partitionId()
        met = np.zeros(length + 1, np.int64)
        for part, values, offsets in tb.slices(batches):
            ids, first = encode(values, offsets)
            whole = np.insert(ids, first[1:], END).astype("<u4")
            first = first + np.arange(len(first))
            sizes = np.diff(first)
            n = -(-sizes // length)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            short = sizes - (n - 1) * length
            start = np.where(piece == 0, 0, short[doc] + (piece - 1) * length)
            size = np.where(piece == 0, short[doc], length)
            order = np.argsort(size, kind="stable")
            nth = np.empty(len(size), np.int64)
            ordered = size[order]
            nth[order] = np.arange(len(size)) - np.searchsorted(ordered, ordered) + met[ordered]
            met += np.bincount(size, minlength=length + 1)
            data, begin = whole.tobytes(), (first[doc] + start) * 4
            cuts = [data[a:b] for a, b in zip(begin, begin + size * 4, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array([zlib.crc32(x) for x in cuts], pa.int64()), pa.array(cuts if with_ids else [None] * len(cuts), pa.binary()), pa.array(np.full(len(doc), task), pa.int64()), pa.array(nth)],
                names=["id", *(x.split()[0] for x in _PIECES.split(", "))],
            )

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, {_PIECES}")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, [ids], sequence_id, offset.

    A null text counts as empty; an empty one is the end token alone.  Rows are packed each for
    itself, so repeated rows and null ids give as many pieces; other columns aren't read.  A full
    piece is a sequence by itself.  The pieces are written to the shared folder once, so that
    counts and slots come from the same ranks even if executors are lost.
    """
    spark = docs.sparkSession
    at = shared_dir(spark)
    tokenized(docs, tokenizer_path, length, id_col, text_col, with_ids).write.parquet(at)
    pieces = spark.read.parquet(at)
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    # at most ``length`` rows reach the driver
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(plan(counts, length), np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    # a few slots per length: the plan's size depends on ``length`` alone
    shared = spark.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, low, _, first, offset = shared.value.T
        begin = np.searchsorted(sizes, np.arange(length + 2))
        for part in batches:
            size, rank = part.column("length").to_numpy().astype(np.int64), part.column("rank").to_numpy()
            slot = np.empty(len(size), np.int64)
            for s in np.unique(size):
                mine = size == s
                slot[mine] = begin[s] + np.searchsorted(low[begin[s] : begin[s + 1]], rank[mine], "right") - 1
            columns = [c for name, c in zip(part.schema.names, part.columns, strict=True) if name != "rank"]
            names = [name for name in part.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[slot] + rank - low[slot]), pa.array(offset[slot])], names=[*names, "sequence_id", "offset"])

    columns = ["id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(bases, ["length", "task"]).select(*columns, (F.col("base") + F.col("nth")).alias("rank"))
    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' if with_ids else ''}sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
