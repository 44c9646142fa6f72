r"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the n-grams that occur again in the same
document; what counts is the share of the document's characters inside such n-grams
and inside repeated lines.  One narrow pass: no shuffle, memory bounded by a slice of
text, the result of a row depends on that row alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import textbytes as tb

#: Most of a document's characters, in percent, that may stand in n-grams occurring twice or more.
MOST_REPEATED = {5: 35, 8: 28, 10: 25}
#: The same for lines equal to an earlier line, as lines and as characters.
MOST_DUP_LINES, MOST_DUP_LINE_CHARS = 40, 40
#: Symbols a hundred words may have.
MOST_SYMBOLS = 25

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + "".join(f"dup_chars_{n} long, " for n in MOST_REPEATED) + "dup_line_chars long, n_full_lines long, base_failed boolean, kept boolean"


def measure(values: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of the rules for each text of a slice."""
    starts, ends, first = tb.spans(tb.NOT_SPACE[values], offsets)
    sums = tb.prefix_hash(values)
    words = tb.span_hash(sums, starts, ends)
    row, total = tb.row_of(first), len(starts)
    n_words = np.diff(first)
    letters = np.concatenate([[0], np.cumsum((values & 0xC0) != 0x80)])
    chars = letters[ends] - letters[starts]
    out = {"n_words": n_words, "word_chars": tb.sums_by_row(chars, first), "n_symbols": tb.sums_by_row(SYMBOLS[values], offsets)}
    salt = tb.mix(row.astype(np.uint64) + np.uint64(1))

    begin, end, lines = tb.line_spans(values, offsets)
    filled = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    line_row = tb.row_of(lines)
    keys = tb.span_hash(sums, begin, end) ^ tb.mix(line_row.astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(filled)
    _, earliest = np.unique(keys[at], return_index=True)
    dup = np.zeros(len(keys), bool)
    dup[at] = True
    dup[at[earliest]] = False
    out["n_dup_lines"] = tb.sums_by_row(dup, lines)
    out["dup_line_chars"] = tb.sums_by_row(np.where(dup, letters[end] - letters[begin], 0), lines)
    out["n_full_lines"] = tb.sums_by_row(filled, lines)

    for n in (3, *MOST_REPEATED):
        grams = tb.ngram_hash(words, n) ^ salt[: max(0, total - n + 1)]
        ok = tb.in_one_row(first, n, total)
        marks = np.zeros(len(grams), bool)
        marks[ok] = tb.repeated(grams[ok])
        hit = tb.cover(marks, n, total) if marks.any() else np.zeros(total, bool)
        if n == 3:
            out["n_repeat_words"] = tb.sums_by_row(hit, first)
        else:
            out[f"dup_chars_{n}"] = tb.sums_by_row(np.where(hit, chars, 0), first)
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    bad = out["base_failed"].copy()
    for n, most in MOST_REPEATED.items():
        bad |= 100 * out[f"dup_chars_{n}"] > most * out["word_chars"]
    bad |= 100 * out["n_dup_lines"] > MOST_DUP_LINES * out["n_full_lines"]
    bad |= 100 * out["dup_line_chars"] > MOST_DUP_LINE_CHARS * np.maximum(out["word_chars"], 1)
    bad |= 100 * out["n_symbols"] > MOST_SYMBOLS * n_words
    return out | {"kept": ~bad}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures and verdict of every document: ``id_col`` and FIELDS, one row per input row.

    A null or empty text has no words, fails the base rules and isn't kept.  Repeated rows and
    null ids are each judged alone; other columns aren't read and so can't clash.  A very long
    text makes a slice by itself.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in tb.slices(batches):
            found = measure(values, offsets)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[n]) for n in names)], names=["id", *names])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in tb.slices(batches, text_col):
            yield part.filter(pa.array(measure(values, offsets)["kept"]))

    return docs.mapInArrow(run, docs.schema)
