r"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ten consecutive words of a benchmark item (all words of a shorter
one).  For each pattern length a shift table says, for every block of two words, how far the
search may jump because no pattern has that block nearer to its end; where the jump is zero,
the bucket of patterns with that suffix (five words) is compared with the text word by word, and at
last byte by byte.  Many stretches of text are searched side by side in numpy, each at its own
position.  Documents are never shuffled.

Tables are arrays: a pattern is a place in the benchmark's words, not a copy of them.  They are built once,
on the driver, and broadcast ready for use.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import textbytes as tb
from rasterloom.llm.suffix_order import _edges, _ranges

WINDOW = 10
#: Bytes of benchmark text searched for at once (tables of about ten times as much); more is taken in as many blocks.
BLOCK_BYTES = 8 << 20
#: Words of the suffix by which patterns are put into buckets.
SUFFIX = 5
#: Window ends that one stretch covers.
STRETCH = 256
#: Least and most bits of a shift table's index; in between, it has about four cells per block of words.
_LEAST_BITS, _MOST_BITS = 12, 25
#: Words compared byte by byte at once.
_AT_ONCE = 1 << 18


def words_of(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = tb.spans(tb.ALNUM_ANY_CASE[values], offsets)
    return starts, ends, first, tb.span_hash(tb.prefix_hash(values, tb.LOWER_CODES), starts, ends)


def _block(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return tb.mix(before * np.uint64(0x9E3779B97F4A7C15) + last)


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether words (not empty) of two arrays of bytes are equal, byte by byte, A-Z lower-cased."""
    size = (end - start).astype(np.int64)
    same = size == other_end - other_start
    like = np.flatnonzero(same)
    for at in range(0, len(like), _AT_ONCE):
        k = like[at : at + _AT_ONCE]
        differs = tb.LOWER[data[_ranges(start[k], size[k])]] != tb.LOWER[other[_ranges(other_start[k], size[k])]]
        same[k] = np.add.reduceat(differs, np.cumsum(size[k]) - size[k]) == 0
    return same


class WuManber:
    """The tables for patterns of ``m`` words each: ``at`` are their first places in ``words``, the benchmark's word hashes."""

    def __init__(self, words: np.ndarray, at: np.ndarray, m: int):
        self.m, self.b = m, min(2, m)
        ends = lambda j: _block(words[at + j - 1] if self.b == 2 else words[at + j], words[at + j])
        suffix = self._suffix(words, at + m - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.words, self.at, self.suffix = words, at[self.order], suffix[self.order]
        self.bits = int(np.clip(np.ceil(np.log2(max(1, 4 * len(at) * m))), _LEAST_BITS, _MOST_BITS))
        self.shift = np.full(1 << self.bits, m - self.b + 1, np.uint8)
        for j in range(self.b - 1, m):  # the nearer to the end, the smaller the shift: later ones win
            self.shift[self._cell(ends(j))] = m - 1 - j

    def _suffix(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.zeros(len(last), np.uint64)
        for back in range(min(SUFFIX, self.m)):
            out = tb.mix(out + words[last - back])
        return out

    def _cell(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of the window's last word, pattern) of equal word hashes."""
        low, high = first[:-1] + self.m - 1, first[1:]
        n = np.maximum(0, -(-(high - low) // STRETCH))
        at = np.repeat(low, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        stop = np.minimum(np.repeat(high, n), at + STRETCH)
        where, which = [], []
        while len(at):
            blocks = _block(words[at - 1] if self.b == 2 else words[at], words[at])
            jump = self.shift[self._cell(blocks)].astype(np.int64)
            if len(zero := np.flatnonzero(jump == 0)):
                a, b = self._compare(words, at[zero])
                where.append(a)
                which.append(b)
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(where), np.concatenate(which)

    def _compare(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blocks = self._suffix(words, at)
        low, high = np.searchsorted(self.suffix, blocks), np.searchsorted(self.suffix, blocks, "right")
        n = high - low
        where = np.repeat(at, n)
        which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for back in range(self.m):  # only those still alike go on
            same = words[where - back] == self.words[self.at[which] + self.m - 1 - back]
            where, which = where[same], which[same]
        return where, which


class Patterns:
    """All windows of a block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.names = [x[0] for x in items]
        batch = pa.RecordBatch.from_arrays([pa.array([x[1] for x in items], pa.string())], names=["text"])
        values, _ = tb.strings(batch.column(0))
        parts, bytes_before, words_before = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.uint64))], 0, 0
        for _, some, offsets in tb.slices([batch]):  # temporaries of a slice, not of the block
            starts, ends, first, words = words_of(some, offsets)
            parts.append(((starts + bytes_before).astype(np.int32), (ends + bytes_before).astype(np.int32), first[1:] + words_before, words))
            bytes_before, words_before = bytes_before + len(some), words_before + len(words)
        starts, ends, first, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.values, self.starts, self.ends = values.copy(), starts, ends
        n = np.diff(first)
        size = np.minimum(n, WINDOW)
        # words that are equal have one number
        _, one, number = np.unique(words, return_index=True, return_inverse=True)
        clash = np.flatnonzero(~same_words(values, starts, ends, values, starts[one[number]], ends[one[number]]))
        apart: dict[bytes, int] = {}
        for k in clash.tolist():
            number[k] = len(one) + apart.setdefault(tb.LOWER[values[starts[k] : ends[k]]].tobytes(), len(apart))
        self.tables, self.owners = [], []
        for m in np.unique(size[size > 0]).tolist():
            mine = np.flatnonzero(size == m)
            windows = n[mine] - m + 1
            at, item = _ranges(first[mine], windows), np.repeat(mine, windows)
            code = np.zeros(len(at), np.uint64)
            for j in range(m):
                code = tb.mix(code * np.uint64(0x9E3779B97F4A7C15) + number[at + j].astype(np.uint64))
            by = np.lexsort((item, code))
            at, item, code = at[by], item[by], code[by]
            # equal windows are one pattern; those of one code that differ all the same stay apart
            new = np.append(True, code[1:] != code[:-1])
            for j in range(m):
                new[1:] |= number[at[1:] + j] != number[at[:-1] + j]
            edges = np.append(np.flatnonzero(new), len(at))
            table = WuManber(words, at[edges[:-1]].astype(np.int32), m)
            self.tables.append(table)
            # owners in the table's order, as rows of one array
            count = np.diff(edges)[table.order]
            self.owners.append((np.append(0, np.cumsum(count)), item[_ranges(edges[:-1][table.order], count)].astype(np.int32)))

    def search(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: np.ndarray, hit: np.ndarray, items: dict[int, set[str]]) -> None:
        """Mark the hit words, and add to each document's item ids."""
        for table, (edges, owner) in zip(self.tables, self.owners, strict=True):
            last, which = table.search(words, first)
            for back in range(table.m):
                other = table.at[which] + table.m - 1 - back
                same = same_words(values, starts[last - back], ends[last - back], self.values, self.starts[other], self.ends[other])
                last, which = last[same], which[same]
            if not len(last):
                continue
            steps = np.bincount(last - table.m + 1, minlength=len(hit) + 1) - np.bincount(last + 1, minlength=len(hit) + 1)
            hit |= np.cumsum(steps)[: len(hit)] > 0
            doc = np.searchsorted(first, last, "right") - 1
            pairs = np.unique(doc.astype(np.int64) << 32 | which)
            doc, which = pairs >> 32, pairs & 0xFFFFFFFF
            n = edges[which + 1] - edges[which]
            named = np.unique(np.repeat(doc, n) << 32 | owner[_ranges(edges[which], n)])
            for k, i in zip((named >> 32).tolist(), (named & 0xFFFFFFFF).tolist(), strict=True):
                if self.names[i] is not None:
                    items[k].add(self.names[i])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list:
    """Broadcast tables, each for (item id, text) rows of about ``block_bytes`` at most unless one text is longer."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    if n == 1:
        parts = [rows]
    else:
        parts = [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]
    return [spark.sparkContext.broadcast(Patterns([tuple(r) for r in p.distinct().collect()])) for p in parts]


def search_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: id, n_words, n_hit, items (sorted ids), spans (hit stretches of words, end exclusive), contaminated.

    Null and empty texts have no words and no hits; items without words have no window.  An item whose
    id is null hits words but isn't named; equal ids are named once.  Repeated rows and null ids are
    searched each for itself, whole however long; other columns aren't read, so names can't clash; without documents
    there are no rows, without items no hits.  A benchmark of more than ``block_bytes`` is searched
    for block by block, so neither driver nor task holds tables for all of it: the rows are the same, the
    search is done once for each block.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = _searcher(_blocks(benchmark, item_col, item_text_col, block_bytes))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first, hit, items in run(batches, "text"):
            begin, end, at = tb.spans(hit, first)
            docs = range(len(first) - 1)
            base = np.repeat(first[:-1], np.diff(at))
            spans = [{"start": a, "stop": b} for a, b in zip((begin - base).tolist(), (end - base).tolist(), strict=True)]
            n_hit = tb.sums_by_row(hit, first)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(first)), pa.array(n_hit), pa.array([sorted(items[k]) if k in items else [] for k in docs], pa.list_(pa.string())), pa.array([spans[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()}))), pa.array(n_hit > 0)],
                names=["id", "n_words", "n_hit", "items", "spans", "contaminated"],
            )

    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>, contaminated boolean"
    return narrow.mapInArrow(describe, schema).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns, whatever their names.

    Null, empty and wordless texts stay, repeated rows stay or go together; a benchmark without
    words takes nothing; ids aren't read.
    """
    run = _searcher(_blocks(benchmark, item_col, item_text_col, block_bytes))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first, hit, _ in run(batches, text_col):
            yield part.filter(pa.array(tb.sums_by_row(hit, first) == 0))

    return docs.mapInArrow(clean, docs.schema)


def _searcher(blocks: list):
    def run(batches: Iterator[pa.RecordBatch], column: str):
        for part, values, offsets in tb.slices(batches, column, tb.SLICE_BYTES * (1 if len(blocks) == 1 else 8)):
            starts, ends, first, words = words_of(values, offsets)
            hit, items = np.zeros(len(words), bool), defaultdict(set)
            for block in blocks:
                block.value.search(values, starts, ends, first, words, hit, items)
                if len(blocks) > 1:
                    vars(block).pop("_value", None)  # one block's tables at a time
            yield part, first, hit, items

    return run
