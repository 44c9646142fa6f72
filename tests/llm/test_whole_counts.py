"""What the training-data operators gather from all of their input."""

import random

import pytest

from rasterloom.llm import toxicity
from test_other_operators import labelled
from test_text_operators import frame


def test_counts_take_all_labels_beyond_the_broadcast(spark):
    rows, labels = labelled(spark, random.Random(4), 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()
    a, b = toxicity.fit(docs, known), toxicity.fit(docs, known, broadcast=10)
    assert len(a.shared.value[0][0])
    assert [x.tolist() for t in a.shared.value for x in t] == [x.tolist() for t in b.shared.value for x in t]
    assert (a.neutral, a.slope, a.shift) == (b.neutral, b.slope, b.shift)


def test_near_stage_keeps_one_row_of_repeated_and_null_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d = "a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"
    rows = [(5, a), (5, a), (5, b), (7, b), (None, a), (None, c), (None, c), (None, c.upper()), (9, d), (2, None), (2, None), (None, "")]
    docs = frame(spark, [t for _, t in rows], [k for k, _ in rows])
    got = pipeline.STAGES[2][1](spark, docs, "")
    assert got.columns == docs.columns
    left = sorted(((r["doc_id"], (r["text"] or "").lower(), r["text"] is None) for r in got.collect()), key=str)
    assert left == sorted([(5, a, False), (5, b, False), (None, c, False), (9, d, False), (2, "", True), (2, "", True), (None, "", False)], key=str)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls everywhere, repeated rows and ids, clashing columns, and no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(900)]
    good = [" ".join(rng.sample(words, 80)) for _ in range(6)]
    long = "\n".join(" ".join(rng.sample(words, 60)) for _ in range(400))
    rows = [(1, good[0]), (1, good[0]), (1, good[1]), (2, good[2]), (None, good[3]), (None, good[3]), (3, None), (4, ""), (None, None), (5, good[2].upper()), (6, long), (7, good[4])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, y int, n_lines long, kept boolean, length int"
    benchmark = spark.createDataFrame([("q", good[4]), (None, None)], "item_id string, text string")
    for name, some in (("full", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in some], schema).write.parquet(f"{at}/documents.parquet")
        benchmark.write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at)
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        left = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        packed = pipeline.run(spark, at).collect()
        if not some:
            assert left == packed == []
            continue
        assert left == sorted([(1, good[0]), (1, good[1]), (2, good[2]), (None, good[3]), (6, long)], key=str)
        assert sorted({r["doc_id"] for r in packed}, key=str) == [1, 2, 6, None]
        from tokenizers import Tokenizer

        total = sum(len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for _, t in left)
        assert sum(r["length"] for r in packed) == total
