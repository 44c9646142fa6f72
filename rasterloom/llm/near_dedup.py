r"""Near-duplicate documents by one-permutation MinHash.

One hash of each five-word shingle names its bin and its value there; the least value of each
bin is the signature.  Empty bins borrow by optimal densification: each bin has its own random
order of donors, the same for all documents, and takes the first that isn't empty.  Bands of
bins are hashed into buckets.

Documents with the same shingle set form a class and take part once.  In a bucket every class is
paired with the smallest one only (a star), so candidates grow with the members, not their
square; pairs are confirmed on the full sets of whole texts.  A link between two points of a
star that its centre doesn't confirm could still be missing, so buckets that hold more than one
component afterwards are looked at again: two members of different components are compared unless
their distances to the centre, which are known by then, rule a link out (1 - Jaccard is a metric).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import textbytes as tb
from rasterloom.operators.stars import components
from rasterloom.shared import settle

SHINGLE = 5
BANDS, ROWS = 32, 7
BINS = BANDS * ROWS
EMPTY = np.uint32(0xFFFFFFFF)
_DONORS = np.stack([np.random.default_rng(1000 + k).permutation(BINS) for k in range(BINS)])


def shingles(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a slice's texts: their hashes, and the row of each."""
    starts, ends, first = tb.spans(tb.NOT_SPACE[values], offsets)
    words = tb.span_hash(tb.prefix_hash(values, tb.LOWER_CODES), starts, ends)
    row, n = tb.row_of(first), np.diff(first)
    ok = tb.in_one_row(first, SHINGLE, len(words))
    grams = tb.ngram_hash(words, SHINGLE)
    hashes, rows = [grams[ok]], [row[: len(grams)][ok]]
    for k in range(1, SHINGLE):  # texts of fewer words: the whole sequence
        short = np.flatnonzero(n == k)
        whole = np.zeros(len(short), np.uint64)
        for j in range(k):
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + words[first[short] + j]
        hashes.append(tb.mix(whole + np.uint64(k)))
        rows.append(short)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    keys = h ^ tb.mix(r.astype(np.uint64) + np.uint64(1))
    again = tb.repeated(keys)
    if again.any():
        at = np.flatnonzero(again)
        _, one = np.unique(keys[at], return_index=True)
        again[at[one]] = False
        h, r = h[~again], r[~again]
    return h, r


def signatures(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """BANDS bucket keys for each of n rows; rows without shingles get zeros."""
    cell = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    low = np.full(n * BINS, EMPTY, np.uint32)
    np.minimum.at(low, row * BINS + cell, (tb.mix(h) & np.uint64(0x7FFFFFFF)).astype(np.uint32))
    low = low.reshape(n, BINS)
    full = low.copy()
    r, c = np.nonzero((low == EMPTY) & (low != EMPTY).any(axis=1)[:, None])
    for k in range(BINS):
        if not len(r):
            break
        took = low[r, _DONORS[c, k]]
        full[r, c] = took
        left = took == EMPTY
        r, c = r[left], c[left]
    keys = np.zeros((n, BANDS), np.uint64)
    keys += np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cells = full.reshape(n, BANDS, ROWS)
    for k in range(ROWS):
        keys = tb.mix(keys + cells[:, :, k])
    return keys


def sketch(docs: DataFrame) -> DataFrame:
    """(id, n, s1, s2, bands) of (id, text) rows: the set's size, a 128-bit hash of it, its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in tb.slices(batches):
            h, row = shingles(values, offsets)
            n = part.num_rows
            size = np.bincount(row, minlength=n)
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.zeros(n, np.uint64)
                np.add.at(total, row, tb.mix(h + np.uint64(salt)))
                sums.append(pa.array(total.view(np.int64), mask=size == 0))
            keys = signatures(h, row, n).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size, pa.int64()), *sums, bands], names=["id", "n", "s1", "s2", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, s1 long, s2 long, bands array<long>")


def overlaps(pairs: DataFrame) -> DataFrame:
    """(a, b, inter, n_union) of (a, b, a_text, b_text) rows: sizes over the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in tb.slices(batches, "a_text", tb.SLICE_BYTES // 2):
            n = part.num_rows
            keys, sizes = [], []
            for v, o in ((values, offsets), tb.strings(part.column("b_text"))):
                h, row = shingles(v, o)
                sizes.append(np.bincount(row, minlength=n))
                keys.append((h ^ tb.mix(row.astype(np.uint64) + np.uint64(1)), row))
            (ka, _), (kb, row) = keys
            ka = np.sort(ka)
            at = np.searchsorted(ka, kb)
            at[at == len(ka)] = 0
            same = ka[at] == kb if len(ka) else np.zeros(len(kb), bool)
            inter = np.bincount(row[same], minlength=n)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(inter, pa.int64()), pa.array(sizes[0] + sizes[1] - inter, pa.int64())], names=["a", "b", "inter", "n_union"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {kind}, b {kind}, inter long, n_union long")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their sets' intersection and union; a hot ``a`` is split by the adaptive join."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    with_both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
    return overlaps(with_both.select("a", "b", "a_text", "b_text"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of five-word
    shingles (A-Z lower-cased, split at white space; a shorter text is one shingle).  Null and
    empty texts have no shingles and are linked with nothing: each is its own component.  Rows
    with a null id take no part: component_id is null and they are kept.  Rows that share an id
    are judged each by its own text, but are one node to others: a link to any of their texts
    is a link to the id.  Other columns aren't read.  ``kept`` says that the row's id
    is its component's.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = settle(sketch(rows))
    part = sig.where(F.col("id").isNotNull() & (F.col("n") > 0))
    least = part.groupBy("s1", "s2").agg(F.min(F.struct("id", "n", "bands")).alias("x"))
    classes = settle(least.select("s1", "s2", "x.*"))
    keyed = classes.select(F.explode("bands").alias("key"), "id", "n")
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1).select("key", "hub")
    members = settle(keyed.join(hubs, "key"))
    stars = settle(members.where(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    involved = stars.select(F.col("a").alias("id")).unionAll(stars.select(F.col("b").alias("id"))).distinct()
    texts = settle(rows.join(involved, "id").dropDuplicates(["id", "text"]))
    found = settle(_confirm(stars, texts))
    linked = 100 * F.col("inter") >= percent * F.col("n_union")
    edges = found.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = settle(components(edges))

    more = _between_components(members, found, labels, percent)
    more_found = settle(_confirm(more, texts))
    extra = more_found.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not extra.isEmpty():
        labels = settle(components(edges.unionAll(extra)))

    named = classes.select("s1", "s2", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component_id"))
    out = sig.select("id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _between_components(members: DataFrame, found: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), not yet compared, of one bucket's members in different components whose distances to its centre allow a link."""
    labelled = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(F.col("x") != F.col("y")).select("key")
    inside = labelled.join(mixed, "key", "left_semi").where(F.col("id") != F.col("hub"))
    distance = found.select(F.col("a").alias("hub"), F.col("b").alias("id"), (1 - F.col("inter") / F.col("n_union")).alias("d"))
    ringed = inside.join(distance, ["hub", "id"])
    most = (100 - percent) / 100 + 1e-9
    ringed = settle(ringed.withColumn("ring", F.floor(F.col("d") / most)))
    left = ringed.select("key", "ring", F.col("id").alias("a"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("component").alias("ca"))
    right = ringed.select("key", F.explode(F.array(F.col("ring"), F.col("ring") + 1)).alias("ring"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("component").alias("cb"))
    near = left.join(right, ["key", "ring"]).where((F.col("ca") != F.col("cb")) & (F.abs(F.col("da") - F.col("db")) <= most))
    near = near.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
