"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of two words.  A word's probability after the one
before it is its count there less an absolute discount; the mass so freed goes to in how many
different contexts the class uses the word, again less a discount; and what that frees goes to
backoff counts that both classes share, so a rare expression has the same probability in both.

A toxic document is mostly ordinary text: its model is the ordinary class's with a small share of
the toxic one's.  A document's evidence is the difference of the two log-likelihoods of its whole
text, divided by its number of words.  A logistic curve, fitted on a fold that the counts don't
use, turns the evidence (its logarithm, as it spans orders of magnitude) into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import textbytes as tb
from rasterloom.llm.folds import fold, known_labels
from rasterloom.shared import settle, shared_dir

#: What is taken off the count of a pair of words, and off a word's number of contexts.
PAIR_DISCOUNT, CONTEXT_DISCOUNT = 20.0, 1.0
#: The share of a toxic document's words that come from the toxic class's model.
SHARE = 0.001
#: Labels that are broadcast (more are joined by a shuffle), and labelled documents that the curve is fitted on.
MOST_BROADCAST, MOST_FITTED = 1_000_000, 20_000
#: Entries of the models that are broadcast (16 bytes each); beyond, texts meet them in joins.
MOST_ENTRIES = 4_000_000
#: Words whose pairs a task counts before it sends them.
COUNTED_TOGETHER = 1 << 21
FIT_FOLD = 1
WORD, CONTEXT, PAIR = 0, 1, 2


def words_of(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of a slice's words, of the words before them (0 at a text's start), and each text's first word."""
    starts, ends, first = tb.spans(tb.ALNUM_ANY_CASE[values], offsets)
    words = tb.span_hash(tb.prefix_hash(values, tb.LOWER_CODES), starts, ends)
    before = np.zeros(len(words), np.uint64)
    before[1:] = words[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = 0
    return words, before, first


def pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return tb.mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


def class_counts(docs: DataFrame, pair_discount: float = PAIR_DISCOUNT) -> DataFrame:
    """Counts of both classes over (text, y) rows: kind, h, w, toxic, other, cut_toxic, cut_other.

    WORD rows (w): in how many contexts a class uses the word.  CONTEXT rows (h): how often a word stands
    in it, and how much of that the discount cuts off.  PAIR rows (h, w): how often, where
    that is more than the discount in either class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            before, words, y = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            _, at, back = np.unique(pair_key(before, words), return_index=True, return_inverse=True)
            toxic = np.bincount(back, y, minlength=len(at)).astype(np.int64)
            n = np.bincount(back, minlength=len(at))
            return pa.RecordBatch.from_arrays([pa.array(before[at].view(np.int64)), pa.array(words[at].view(np.int64)), pa.array(toxic), pa.array(n - toxic)], names=["h", "w", "toxic", "other"])

        for part, values, offsets in tb.slices(batches):
            words, before, first = words_of(values, offsets)
            held.append((before, words, part.column("y").to_numpy()[tb.row_of(first)] == 1))
            if sum(len(x[0]) for x in held) >= COUNTED_TOGETHER:
                yield flush()
        if any(len(x[0]) for x in held):
            yield flush()

    pairs = docs.select("text", "y").mapInArrow(run, "h long, w long, toxic long, other long").groupBy("h", "w").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    none, t, o = F.lit(None).cast("long"), F.col("toxic").cast("double"), F.col("other").cast("double")
    cut = lambda x: F.least(x, F.lit(float(pair_discount)))
    one = lambda kind, h, w, *n: F.struct(F.lit(kind).alias("kind"), h.alias("h"), w.alias("w"), *(x.cast("double").alias(a) for x, a in zip(n, ("toxic", "other", "cut_toxic", "cut_other"), strict=True)))
    zero = F.lit(0.0)
    told = [one(WORD, none, F.col("w"), t > 0, o > 0, zero, zero), one(CONTEXT, F.col("h"), none, t, o, cut(t), cut(o))]
    often = (t > pair_discount) | (o > pair_discount)
    rows = pairs.select(F.explode(F.when(often, F.array(*told, one(PAIR, F.col("h"), F.col("w"), t, o, zero, zero))).otherwise(F.array(*told))).alias("x")).select("x.*")
    return rows.groupBy("kind", "h", "w").agg(*(F.sum(c).alias(c) for c in ("toxic", "other", "cut_toxic", "cut_other")))


def log_ratios(counts: DataFrame, context_discount: float = CONTEXT_DISCOUNT, pair_discount: float = PAIR_DISCOUNT) -> tuple[DataFrame, float]:
    """(kind, h, w, value) of all that tells the classes apart, and the log ratio of every other word.

    The log ratio of the classes' probabilities of a word is its PAIR value, or else the sum of
    its WORD value (the neutral one without) and its context's CONTEXT value (0 without).
    """
    d = float(context_discount)
    words, contexts, pairs = (counts.where(F.col("kind") == k) for k in (WORD, CONTEXT, PAIR))
    least = lambda c: F.least(F.col(c), F.lit(d))
    total = words.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in (F.col("toxic"), F.col("other"), least("toxic"), least("other")))).first()
    sizes = {"toxic": max(total[0], 1.0), "other": max(total[1], 1.0)}
    # a class without words has the shared probabilities
    freed = {"toxic": total[2] / total[0] if total[0] else 1.0, "other": total[3] / total[1] if total[1] else 1.0}
    everything = max(total[0] + total[1], 1.0)

    def unigram(c: str) -> Column:
        return F.greatest(F.col(c) - d, F.lit(0.0)) / sizes[c] + freed[c] * (F.col("toxic") + F.col("other")) / everything

    left = lambda c: F.when(F.col(c) > 0, F.col(f"cut_{c}") / F.col(c)).otherwise(1.0)
    none = F.lit(None).cast("long")
    word_rows = words.where((F.col("toxic") > d) | (F.col("other") > d)).select("kind", none.alias("h"), "w", F.log(unigram("toxic") / unigram("other")).alias("value"))
    context_rows = contexts.where((F.col("cut_toxic") < F.col("toxic")) | (F.col("cut_other") < F.col("other"))).select("kind", "h", none.alias("w"), F.log(left("toxic") / left("other")).alias("value"))
    by_word = words.select("w", unigram("toxic").alias("k_toxic"), unigram("other").alias("k_other"))
    by_context = contexts.select("h", *(F.col(c).alias(f"n_{c}") for c in ("toxic", "other")), *(left(c).alias(f"left_{c}") for c in ("toxic", "other")))
    full = pairs.join(by_word, "w").join(by_context, "h")
    p = lambda c: F.greatest(F.col(c) - pair_discount, F.lit(0.0)) / F.greatest(f"n_{c}", F.lit(1.0)) + F.col(f"left_{c}") * F.col(f"k_{c}")
    pair_rows = full.select("kind", "h", "w", F.log(p("toxic") / p("other")).alias("value"))
    return word_rows.unionAll(context_rows).unionAll(pair_rows), float(np.log(max(freed["toxic"], 1e-9) / max(freed["other"], 1e-9)))


def packed(entries: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and values of the entries, by kind."""
    kind = entries.column("kind").to_numpy()
    h, w = (entries.column(c).fill_null(0).to_numpy().view(np.uint64) for c in "hw")
    value, out = entries.column("value").to_numpy(), []
    for k, keys in ((WORD, w), (CONTEXT, h), (PAIR, pair_key(h, w))):
        mine = np.flatnonzero(kind == k)
        mine = mine[np.argsort(keys[mine])]
        out.append((keys[mine], value[mine]))
    return out


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, out: np.ndarray) -> np.ndarray:
    known, values = table
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = known[at] == keys
        out[found] = values[at[found]]
    return out


class Model:
    """The log ratios, broadcast or (too many for that) as a DataFrame, and the curve."""

    def __init__(self, neutral: float, shared: Broadcast | None, entries: DataFrame | None, share: float = SHARE, slope: float = 1.0, shift: float = 0.0):
        self.neutral, self.shared, self.entries, self.share, self.slope, self.shift = neutral, shared, entries, share, slope, shift

    def evidence_of(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's difference of log-likelihoods a word; 0 without words."""
        words, before, first = words_of(values, offsets)
        by_word, by_context, by_pair = self.shared.value
        ratio = _look_up(by_word, words, np.full(len(words), self.neutral)) + _look_up(by_context, before, np.zeros(len(words)))
        ratio = _look_up(by_pair, pair_key(before, words), ratio)
        sums = np.concatenate([[0.0], np.cumsum(np.log1p(self.share * np.expm1(ratio)))])
        return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        scale = np.log(np.maximum(evidence + 1.02 * self.share, 1e-12))
        return 1 / (1 + np.exp(-np.clip(self.slope * scale + self.shift, -50, 50)))


def _by_join(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (text and others) with their ``evidence``, by joins of their words with the models' entries.

    Pairs of words are counted per row before they are shuffled; a hot word's rows are split by the adaptive join.
    """
    at = shared_dir(rows.sparkSession)
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(at)
    kept = rows.sparkSession.read.parquet(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in tb.slices(batches):
            words, before, first = words_of(values, offsets)
            row = part.column("row").to_numpy()[tb.row_of(first)]
            _, one, n = np.unique(tb.mix(row.astype(np.uint64)) ^ pair_key(before, words), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(row[one]), pa.array(before[one].view(np.int64)), pa.array(words[one].view(np.int64)), pa.array(n.astype(np.int64))], names=["row", "h", "w", "n"])

    some = kept.select("row", "text").mapInArrow(run, "row long, h long, w long, n long")
    kind = lambda k, *on: model.entries.where(F.col("kind") == k).select(*on, F.col("value").alias(f"v{k}"))
    met = some.join(kind(WORD, "w"), "w", "left").join(kind(CONTEXT, "h"), "h", "left").join(kind(PAIR, "h", "w"), ["h", "w"], "left")
    ratio = F.coalesce(f"v{PAIR}", F.coalesce(f"v{WORD}", F.lit(model.neutral)) + F.coalesce(f"v{CONTEXT}", F.lit(0.0)))
    sums = met.groupBy("row").agg((F.sum(F.col("n") * F.log1p(model.share * F.expm1(ratio))) / F.sum("n")).alias("evidence"))
    return kept.join(sums, "row", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0.0))).drop("row")


def evidence(rows: DataFrame, model: Model, keep: str) -> DataFrame:
    """The columns ``keep`` (a schema) of (text, ...) rows, and ``evidence``."""
    names = [x.split()[0] for x in keep.split(", ")]
    if model.shared is None:
        return _by_join(rows, model).select(*names, "evidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in tb.slices(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(model.evidence_of(values, offsets))], names=[*names, "evidence"])

    return rows.select(*names, "text").mapInArrow(run, f"{keep}, evidence double")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method with a small penalty; neutral without both classes."""
    if not len(x) or y.min() == y.max():
        return 1.0, -float(x.max()) - 1 if len(x) and not y.max() else 0.0
    mean, scale = x.mean(), x.std() + 1e-9
    a = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.02, 1e-6])
        step = np.linalg.solve(hessian, a.T @ (p - y) + np.array([0.02, 1e-6]) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", broadcast: int = MOST_BROADCAST, most_entries: int = MOST_ENTRIES, share: float = SHARE) -> Model:
    """The models' counts from all labelled documents outside folds 0 and FIT_FOLD; the curve from FIT_FOLD, up to MOST_FITTED.

    Up to ``broadcast`` labels (16 bytes each) are broadcast, so texts aren't shuffled; beyond, the texts of
    the counted folds are.  Up to ``most_entries`` entries of the models are collected and broadcast;
    beyond, texts are joined with them, which gives the same scores.
    """
    spark = docs.sparkSession
    sample = settle(known_labels(labels, label_col, id_col))
    counted = sample.where(F.col("fold") != FIT_FOLD)
    counted = F.broadcast(counted) if counted.count() <= broadcast else counted.hint("shuffle_hash")
    inside = docs.where(~fold(F.col(id_col)).isin(0, FIT_FOLD))
    known = inside.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(counted, "id")
    at = shared_dir(spark)
    class_counts(known).write.parquet(at)
    entries, neutral = log_ratios(spark.read.parquet(at))
    entries = settle(entries)
    shared = spark.sparkContext.broadcast(packed(entries.toArrow())) if entries.count() <= most_entries else None
    model = Model(neutral, shared, None if shared else entries, share)
    chosen = sample.where(F.col("fold") == FIT_FOLD).orderBy(F.xxhash64("id"), "id").limit(MOST_FITTED).select("id", "y")
    fitted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")
    got = evidence(fitted, model, "y int").toArrow().sort_by([("evidence", "ascending"), ("y", "ascending")])
    x = np.log(np.maximum(got.column("evidence").to_numpy() + 1.02 * share, 1e-12))
    model.slope, model.shift = logistic(x, got.column("y").to_numpy())
    return model


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score (0 to 1, higher: toxic likelier), predicted, for every row of ``docs``.

    A null or empty text has no words and gets the score of no evidence.  Rows are scored each for itself,
    whole, however long; repeated rows and null ids too, equal texts get equal scores; a table
    without rows gives none.  Other columns aren't read, so their names can't clash.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold(F.col(id_col)) == 0).alias("held_out"))
    found = evidence(narrow, model, f"id {narrow.schema['id'].dataType.simpleString()}, held_out boolean")
    # the curve in DataFrame functions; the same as Model.score
    scale = F.log(F.greatest(F.col("evidence") + 1.02 * model.share, F.lit(1e-12)))
    score = 1 / (1 + F.exp(-F.greatest(F.least(model.slope * scale + model.shift, F.lit(50.0)), F.lit(-50.0))))
    return found.select(F.col("id").alias(id_col), "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
