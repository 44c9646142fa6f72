"""Span hashes against the polynomial itself, and texts that a hash modulo 2**64 takes for equal."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import near_dedup, quality_rules, textbytes as tb
from rasterloom.llm.packing import best_fit_pack
from rasterloom.llm.tokens import PieceTokenizer
from test_text_operators import frame, reference

PRIME = (1 << 61) - 1


def twins(a="a", b="b", n=10):
    """The Thue-Morse text of 2**n letters and its opposite."""
    bits = [0]
    for _ in range(n):
        bits += [1 - x for x in bits]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("long", [64, 1 << 22])
def test_span_hash_is_the_polynomial(monkeypatch, long):
    monkeypatch.setattr(tb, "_LONG", long)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 256, 3000, dtype=np.uint8)
    starts = rng.integers(0, 2700, 200)
    ends = starts + rng.integers(0, 300, 200)
    for a, b, h in zip(starts.tolist(), ends.tolist(), tb.span_hash(tb.prefix_hash(values), starts, ends), strict=True):
        x = sum((int(values[a + i]) + 1) * pow(tb._ROOT, i, PRIME) for i in range(b - a)) % PRIME
        assert tb.mix(np.array([(x + (b - a) * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0] == h


def test_twins_differ():
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in twins())
    old = tb.window_hash(tb.window_sums(np.concatenate([a, b])), np.array([0, 1024]), np.array([1024, 1024]), np.array([0, 1024]))
    assert old[0] == old[1]
    new = tb.span_hash(tb.prefix_hash(np.concatenate([a, b])), np.array([0, 1024]), np.array([1024, 2048]))
    assert new[0] != new[1]


def test_twins_are_no_near_duplicates(spark):
    got = near_dedup.near_duplicates(frame(spark, [*twins(), twins()[0].upper()])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1, 2: 0}


def test_twins_are_no_repeated_lines(spark):
    a, b = twins()
    r = quality_rules.quality_rules(frame(spark, [f"{a}\n{b}", f"{a}\n{b}\n{a}"])).orderBy("doc_id").collect()
    assert [x["n_dup_lines"] for x in r] == [0, 1]


def test_twins_have_their_own_tokens(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = [*twins(), "hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a <|endoftext|", "x <|endoftext|>\n\ny  z", "plain words here"]
    mine, got = PieceTokenizer(path), []
    for _, values, offsets in tb.slices([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]):
        ids, first = mine(values, offsets)
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    want = [reference(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert got == want and 50256 in want[2] and len(want[2]) == 4
    packed = best_fit_pack(frame(spark, texts), path, 1024).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packed} == {k: [*x, 2] for k, x in enumerate(want)}


def test_random_words_hash_apart():
    rng = random.Random(4)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 18))) for _ in range(20_000)})
    values, offsets = tb.strings(pa.array(words))
    assert len(np.unique(tb.span_hash(tb.prefix_hash(values), offsets[:-1], offsets[1:]))) == len(words)
