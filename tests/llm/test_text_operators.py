"""Quality rules, line dedup, decontamination, near-duplicates and packing against brute force and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from rasterloom.llm.tokens import PieceTokenizer
from rasterloom.llm import textbytes as tb
import pyarrow as pa

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, n_lines int, id int, rank int"


def frame(spark, texts, ids=None):
    """Documents with columns whose names operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 5, 6, 7) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


ODD = [None, "", " ", "\n", "\n\n a \n", "one", "a b c", "é\tü\x0b日本 x", "Same Same Same", "x" * 5000]


def odd_texts():
    rng = random.Random(3)
    return [*ODD, *ODD, prose(rng, 300) + "\n" + prose(rng, 40), " ".join(f"v{k}" for k in range(200_000))]


# ---- quality rules


def rules(text):
    """The base figures, told plainly."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_quality_rules(spark):
    rng = random.Random(1)
    texts = odd_texts() + [prose(rng, 80), "the same words again " * 40, "line of words here\n" * 30 + prose(rng, 60), "#*$ | " * 60, prose(rng, 60, 5)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == rules(t), t
        assert not (r["kept"] and r["base_failed"])
    assert got[len(odd_texts())]["kept"] and not got[len(texts) - 2]["kept"]
    kept = quality_rules.keep_good(frame(spark, texts))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


# ---- line dedup


def drop(texts, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if not key(x) or n[key(x)] < least]
        out.append(("\n".join(left), len(lines), len(lines) - len(left)))
    return out


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_line_dedup(spark, most):
    rng = random.Random(5)
    pool = [f"Line {k}" for k in range(40)] + ["  LINE 3\t", "", "   ", "ünï"]
    texts = odd_texts() + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    ids = [None, None, 7, 7, *range(4, len(texts))]
    docs = frame(spark, texts, ids).repartition(7)
    out = line_dedup.line_dedup(docs, least=10, batches=5, most_broadcast=most)
    assert out.columns == ["doc_id", "text", "kept", "id", "rank", "n_lines", "n_dropped"]
    got = sorted((r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    assert got == sorted(drop(texts, 10)) and sum(x[2] for x in got) > 100
    assert line_dedup.line_dedup(frame(spark, []), batches=2).count() == 0


def test_runs_settle_over_batches(spark):
    runs = line_dedup.LineRuns(spark, least=3, partitions=2)
    assert runs.common().count() == 0
    for _ in range(7):
        runs.add(spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "h1 long, h2 long, n long"))
    runs.add(spark.createDataFrame([(3, 3, 2)], "h1 long, h2 long, n long"))
    assert sorted(tuple(r) for r in runs.common().collect()) == [(1, 1), (2, 2)]
    assert any(x is not None for x in runs.settled)
    full = [x for x in runs.levels + runs.settled if x is not None]
    with line_dedup.sorted_scans(spark):
        plan = runs._merge(full[0], full[-1])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.close()
    assert not spark.catalog.listTables()


# ---- decontamination


def windows(items):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: words.findall((t or "").translate(AZ))
    out = {}
    for i, t in items:
        w = cut(t)
        m = min(10, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            out.setdefault(tuple(w[a : a + m]), set()).add(i)
    return out, cut


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_decontamination(spark, block):
    rng = random.Random(8)
    items = [("a", prose(rng, 25)), ("b", "Four Words, only: here"), ("c", prose(rng, 10)), (None, prose(rng, 12)), ("d", None), ("e", "... !!"), ("f", "single"), ("b", prose(rng, 11)), ("a", "x y z " * 6)]
    copy = lambda t, a, b: " ".join((t or "").split()[a:b])
    texts = odd_texts() + [prose(rng, 30) + " " + copy(items[0][1], 3, 16).upper() + "; " + prose(rng, 5), "so FOUR words only HERE now", copy(items[0][1], 0, 9), items[3][1] + "!" + items[2][1], "x y z " * 30, "a single one", prose(rng, 700) + " " + items[2][1]]
    found, cut = windows(items)
    lengths = {len(k) for k in found}
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.search_benchmark(frame(spark, texts), bench, block_bytes=block).collect()}
    for k, t in enumerate(texts):
        w, hit, names = cut(t), set(), set()
        for m in lengths:
            for a in range(len(w) - m + 1):
                if (p := tuple(w[a : a + m])) in found:
                    hit |= set(range(a, a + m))
                    names |= found[p] - {None}
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(names), bool(hit)), t
        assert {j for s in r["spans"] for j in range(s["start"], s["stop"])} == hit
    clean = decontaminate.drop_contaminated(frame(spark, texts), bench, block_bytes=block)
    assert {r["doc_id"] for r in clean.collect()} == {k for k, r in got.items() if not r["contaminated"]}
    assert decontaminate.search_benchmark(frame(spark, texts), bench.limit(0)).where("contaminated").isEmpty()


# ---- near-duplicates


def groups(texts, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(AZ))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(k)) for k, s in enumerate(sets)]


def test_near_duplicates(spark):
    rng = random.Random(11)
    base = [prose(rng, n, 10_000).split() for n in (30, 80, 200, 7, 60)]
    texts = list(ODD)
    for words in base:
        texts.append(" ".join(words))
        for _ in range(14):  # chains of copies, each changed a little more
            w = list(words)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            texts.append("  ".join(w).upper())
        chain = list(words)
        for k in range(0, len(chain), max(2, len(chain) // 12)):
            chain[k] = f"c{k}"
            texts.append(" ".join(chain))
    rng.shuffle(texts)
    want = groups(texts, 85)
    out = near_dedup.near_duplicates(frame(spark, texts).repartition(5), 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()}
    assert [got[k] for k in range(len(texts))] == [(n, c, c == k) for k, (n, c) in enumerate(want)]
    assert len({c for _, c in want}) < len(texts) - 40


def test_near_duplicates_of_odd_rows(spark):
    texts = ["a b c d e f", "A b c  d e f", None, "", "q", "q", "a b c d e f"]
    out = near_dedup.near_duplicates(frame(spark, texts, [5, None, 3, 2, 9, 9, 4]), 85)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out.collect()), key=str)
    assert got == sorted([(5, 4, False), (None, None, True), (3, 3, True), (2, 2, True), (9, 9, True), (9, 9, True), (4, 4, True)], key=str)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_links_that_the_stars_miss_are_found(spark, monkeypatch):
    """With one band of one bin nearly all share buckets, and only the second look joins what hubs don't."""
    monkeypatch.setattr(near_dedup, "BANDS", 1)
    monkeypatch.setattr(near_dedup, "ROWS", 1)
    monkeypatch.setattr(near_dedup, "BINS", 1)
    monkeypatch.setattr(near_dedup, "_DONORS", np.zeros((1, 1), np.int64))
    common = [f"s{k}" for k in range(60)]
    texts = []
    for g in range(6):
        tail = [f"g{g}x{k}" for k in range(40)]
        texts += [" ".join(common + tail), " ".join([*common, *tail[:-1], f"e{g}"])]
    h, row = near_dedup.shingles(*tb.strings(pa.array(texts)))
    assert len(row) and near_dedup.signatures(h, row, len(texts)).shape == (len(texts), 1)
    want = groups(texts, 85)
    # the sketch runs in workers, which don't see the patches: look at the candidates directly
    from pyspark.sql import types as T

    members = spark.createDataFrame([(0, k, 96, 0) for k in range(len(texts))], "key long, id long, n long, hub long")
    found_rows = []
    sets = [set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for t in texts]
    for k in range(1, len(texts)):
        found_rows.append((0, k, len(sets[0] & sets[k]), len(sets[0] | sets[k])))
    found = spark.createDataFrame(found_rows, "a long, b long, inter long, n_union long")
    labels = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    pairs = {(r["a"], r["b"]) for r in near_dedup._between_components(members, found, labels, 85).collect()}
    need = {(a, b) for a in range(2, len(texts)) for b in range(a + 1, len(texts)) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert need and need <= pairs and want[2][1] == 2 and T is not None


# ---- tokens and packing


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def reference(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_pieces_give_the_tokenizers_ids(vocabulary):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "é", "\u0085", " ", "it's", "'s", "12", "!", "<|endoftext|>", "日", "ß", "\r\n", "\x1c", "×", "É", ".", " the", "İ", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(20_000)] + ["", "x" * 4000]
    for most in (1_000_000, 3_000):
        mine, got = PieceTokenizer(vocabulary, most), []
        for part, values, offsets in tb.slices([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], most=20_000):
            ids, first = mine(values, offsets)
            got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        assert got == [e.ids for e in reference(vocabulary).encode_batch(texts, add_special_tokens=False)]


def best_fit(counts, length):
    left = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [k for k in range(len(left)) if left[k] >= size]
            if fits:
                left[min(fits, key=left.__getitem__)] -= size
            else:
                left.append(length - size)
    return len(left)


def test_the_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(150):
        length = rng.choice([4, 9, 30])
        counts = {rng.randint(1, length): rng.randint(1, 12) for _ in range(rng.randint(1, 9))}
        taken, where = Counter(), {}
        for size, low, high, first, offset in packing.plan(counts, length):
            taken[size] += high - low
            for r in range(low, high):
                where.setdefault(first + r - low, []).append((offset, size))
        assert taken == Counter(counts) and len(where) == best_fit(counts, length)
        for row in where.values():
            assert [o for o, _ in sorted(row)] == np.cumsum([0, *(s for _, s in sorted(row))])[:-1].tolist() and sum(s for _, s in row) <= length


def check_packing(rows, texts, vocabulary, length):
    ids = [e.ids + [2] for e in reference(vocabulary).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    by, where = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, mine in by.items():
        mine.sort(key=lambda r: r["piece"])
        at = 0
        for n, r in enumerate(mine):
            assert r["piece"] == n and r["start"] == at and (n == 0 or r["length"] == length) and r["length"] <= length
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[k][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[k])
    for row in where.values():
        at = 0
        for o, n in sorted(row):
            assert o == at
            at += n
        assert at <= length
    assert set(by) == set(range(len(texts)))
    sizes = Counter(r["length"] for r in rows)
    assert len(where) == best_fit(sizes, length)


def test_packing(spark, vocabulary):
    rng = random.Random(6)
    texts = odd_texts() + [prose(rng, rng.randrange(1, 120)) for _ in range(150)]
    rows = packing.best_fit_pack(frame(spark, texts).repartition(6), vocabulary, 256).collect()
    check_packing(rows, texts, vocabulary, 256)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.best_fit_pack(frame(spark, []), vocabulary, 64).count() == 0
    twice = packing.best_fit_pack(frame(spark, ["a b", "a b", None], [1, 1, None]), vocabulary, 64, with_ids=False).collect()
    assert len(twice) == 3 and len({r["sequence_id"] for r in twice}) == 1 and "ids" not in twice[0].asDict()


# ---- the pipeline


def test_pipeline_against_brute_force(spark, vocabulary, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    boiler = "All rights reserved by nobody at all"
    bench = prose(rng, 30, 5000)
    texts = [prose(rng, 120, 8000) + "\n" + boiler for _ in range(25)]
    texts += [texts[3], texts[3].replace("w1", "w1", 1), texts[4] + " end", "too short", None, "", prose(rng, 90, 8000) + " " + " ".join(bench.split()[4:15]), "again and again " * 50]
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    left = [(k, t) for k, t in enumerate(texts) if not rules(t)[-1]]
    left = [(k, d[0]) for (k, _), d in zip(left, drop([t for _, t in left], 10), strict=True)]
    assert boiler not in left[0][1]
    keep = groups([t for _, t in left], 85)
    left = [x for n, (x, (_, c)) in enumerate(zip(left, keep, strict=True)) if c == n]
    found, cut = windows([(1, bench)])
    clean = lambda t: not any(tuple(cut(t)[a : a + 10]) in found for a in range(len(cut(t))))
    left = [(k, t) for k, t in left if clean(t)]
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {k for k, _ in left}
    names = {k: n for n, (k, _) in enumerate(left)}
    check_packing([r.asDict() | {"doc_id": names[r["doc_id"]]} for r in got], [t for _, t in left], vocabulary, 1024)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    second = pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    assert second.schema.names == docs.schema.names and second.dtypes == docs.dtypes
    assert second.where(F.length("text") != F.col("n_chars")).where("text is not null").isEmpty() and hashlib is not None
