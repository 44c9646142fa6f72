"""Quality classifier with supervised subword embeddings.

A document's features are hashed words, hashed character n-grams and hashed marks of how often a
word trigram has already stood in the document.  Every bucket has a learned vector; a document
is the average of its features' vectors, and a softmax layer on top gives the class.  Vectors and
layer are trained together by stochastic gradient descent in numpy on a bounded sample of
labelled rows.  Since the layer is linear, scoring needs one number per bucket only: the
difference of the two classes' logits, broadcast as a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import textbytes as tb
from rasterloom.llm.folds import fold, sampled_labels
from rasterloom.shared import settle

BITS, DIMENSIONS = 15, 8
GRAMS = (3, 4)
#: Labelled rows to learn from, those with the smallest hash of their id.
MOST_LABELLED = 6000
#: Bytes of bags that reach the driver; of more, rows with the smallest hashes up to that are learnt from.
MOST_BYTES = 192 << 20
EPOCHS, RATE, BATCH = 8, 1.0, 16
#: Levels of repetition told apart, each twice as often as the one before.
_MARKS = 8


def features(values: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Feature kinds as (buckets, each row's first) and the number of all features of each row."""
    mask = np.uint64((1 << BITS) - 1)
    starts, ends, first = tb.spans(tb.NOT_SPACE[values], offsets)
    words = tb.span_hash(tb.prefix_hash(values), starts, ends)
    kinds = [((words & mask).astype(np.int64), first)]
    padded = np.concatenate([values, np.zeros(max(GRAMS), np.uint8)]).astype(np.uint64)
    code = np.zeros(len(values), np.uint64)
    for k in range(max(GRAMS)):
        code = code << np.uint64(8) | padded[k : k + len(values)]
        if k + 1 in GRAMS:
            n = k + 1
            ok = tb.in_one_row(offsets, n, len(values))
            grams = (tb.mix(code[: len(ok)] + np.uint64(n << 40)) & mask).astype(np.int64)[ok]
            kinds.append((grams, np.concatenate([[0], np.cumsum(ok)])[np.minimum(offsets, len(ok))]))
    # how often each trigram has stood before, as a power of two
    row = tb.row_of(first)
    ok = tb.in_one_row(first, 3, len(words))
    grams = tb.ngram_hash(words, 3) ^ tb.mix(row[: len(ok)].astype(np.uint64) + np.uint64(1))
    rank = np.zeros(len(grams), np.int64)
    again = np.flatnonzero(tb.repeated(grams))
    order = again[np.argsort(grams[again], kind="stable")]
    ordered = grams[order]
    rank[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered)
    level = np.minimum(np.log2(rank + 1).astype(np.int64), _MARKS - 1)
    marks = (tb.mix(level.astype(np.uint64) + np.uint64(77)) & mask).astype(np.int64)[ok]
    kinds.append((marks, np.concatenate([[0], np.cumsum(ok)])[np.minimum(first, len(ok))]))
    return kinds, sum(np.diff(bounds) for _, bounds in kinds)


def bags(values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct buckets with their shares of its features."""
    kinds, totals = features(values, offsets)
    for k in range(len(offsets) - 1):
        ids, n = np.unique(np.concatenate([b[f[k] : f[k + 1]] for b, f in kinds]), return_counts=True)
        yield ids, (n / max(1, totals[k])).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logit differences per bucket and their bias, from bags and 0/1 labels, by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen = np.zeros((1 << BITS, 1), np.float32)  # squared gradients, for a step of its own per bucket
    seen_layer = np.zeros((), np.float32)
    n = len(rows)
    if not n:
        return np.zeros(1 << BITS, np.float32), 0.0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            some = order[at : at + BATCH]
            ids = np.concatenate([rows[i][0] for i in some])
            share = np.concatenate([rows[i][1] for i in some])
            who = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            mean = np.zeros((len(some), DIMENSIONS), np.float32)
            np.add.at(mean, who, vectors[ids] * share[:, None])
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            down = p @ layer.T
            unique, back = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(unique), DIMENSIONS), np.float32)
            np.add.at(grad, back, down[who] * share[:, None])
            seen[unique] += (grad**2).mean(axis=1, keepdims=True)
            vectors[unique] -= RATE * grad / np.sqrt(seen[unique] + 1e-8)
            g = mean.T @ p
            seen_layer += float((g**2).mean())
            layer -= RATE * 0.2 * g / np.sqrt(seen_layer + 1e-8)
            bias -= RATE * 0.2 * p.sum(axis=0)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score(values: np.ndarray, offsets: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    kinds, totals = features(values, offsets)
    logit = np.zeros(len(offsets) - 1)
    for buckets, first in kinds:
        run = np.concatenate([[0.0], np.cumsum(table[buckets], dtype=np.float64)])
        logit += run[first[1:]] - run[first[:-1]]
    return 1 / (1 + np.exp(-np.clip(logit / np.maximum(totals, 1) + bias, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> tuple[np.ndarray, float]:
    """The table and bias learnt from at most ``most`` labelled documents outside the held-out fold.

    What reaches the driver is bounded by ``most`` rows and ``most_bytes`` bytes of bags (one bag at
    least).  Documents come in the order of their id's hash, those that share an id in the order of
    their bag's, so a fit can be repeated.  Null ids and labels aren't learnt from; a null or empty text is
    an empty bag.  Without any labelled document the model is neutral.
    """
    sample = sampled_labels(labels, label_col, most, id_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in tb.slices(batches):
            found = list(bags(values, offsets))
            yield pa.RecordBatch.from_arrays([part.column("place"), part.column("y"), pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))], names=["place", "y", "buckets", "shares"])

    found = settle(texts.select(F.xxhash64("id").alias("place"), "text", "y").mapInArrow(run, "place long, y int, buckets array<int>, shares array<float>").withColumn("code", F.xxhash64("buckets", "shares")))
    sizes = found.select("place", "code", (F.size("buckets") * 8 + 32).alias("bytes")).orderBy("place", "code").limit(most).toArrow()
    fits = int(np.searchsorted(np.cumsum(sizes.column("bytes").to_numpy()), most_bytes, "right"))
    if not sizes.num_rows:
        return train([], np.zeros(0, np.int64))
    last = sizes.slice(max(fits, 1) - 1, 1).to_pylist()[0]
    chosen = found.where((F.col("place") < last["place"]) | ((F.col("place") == last["place"]) & (F.col("code") <= last["code"])))
    # equal rows at the border all pass the filter; the number decides
    got = chosen.select("y", "buckets", "shares", "place", "code").orderBy("place", "code").limit(max(fits, 1)).toArrow()
    # the bags stay where they came, as views of the table's columns
    rows = [(b.values.to_numpy(), s.values.to_numpy()) for b, s in zip(got.column("buckets"), got.column("shares"), strict=True)]
    return train(rows, got.column("y").to_numpy().astype(np.int64))


def quality_scores(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score (0 to 1, higher: quality likelier), predicted, for every row of ``docs``.

    A null or empty text has no features and gets the score of the bias.  Rows are scored each for
    itself, whole however long; repeated rows and null ids too, equal texts get equal scores.  Other
    columns aren't read, so names can't clash; a table without rows gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold(F.col(id_col)) == 0).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for part, values, offsets in tb.slices(batches):
            s = score(values, offsets, table, bias)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
