"""WARC, URLs, substring removal, the two models, and the registered queries against their SQL."""

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest

from helpers import duck, rows
from rasterloom.llm import folds, quality_model, queries, substring_dedup, toxicity, url_filter, warc
from rasterloom.llm.suffix_order import suffix_arrays
from rasterloom.shared import shared_dir
from test_text_operators import ODD, frame, prose

SF = "/root/testdata/sf0.001"


# ---- WARC


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>ü" + "x" * 200, "a" * 50
    pages = [(1, "http://a.b/c?d", big), (2, None, big), (3, "http://x\r\ny/", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big), (9, "http://z/", "é" * 50), (10, "q", "é" * 50), (11, "q", "y" * 3_000_000), (12, "q", "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op3_warc(spark, str(tmp_path)).collect()}
    again = {2: 1, 3: 1, 10: 9}
    for k, url, html in pages:
        data = (html or "").encode()
        path = "/" + (url or "").partition("://")[2].partition("/")[2]
        assert got[k] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if k in again else "response", again.get(k), path, 1, 1), k


def test_equal_payloads_are_found_with_and_without_a_broadcast(spark):
    pages = spark.createDataFrame([(k, "u", "z" * (50 + k % 90), "d", 1) for k in range(300)] + [(None, None, None, "d", 1)] * 2, "page_id long, url string, html string, digest string, first int")
    a, b = ({tuple(r) for r in warc.captures_of(pages, most_broadcast=n).collect()} for n in (10_000, 0))
    assert a == b and sum(r[4] is not None for r in a) == 80
    assert warc.captures_of(pages.limit(0)).count() == 0


def test_no_pages_and_missing_requests(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x" * 200), (2, "http://a.b/d", "x" * 200)], "page_id long, url string, html string")
    assert warc.round_trip(spark, pages.limit(0), shared_dir(spark)).count() == 0
    warc.write_archives(warc.captures_of(pages), f"file://{tmp_path}/w").write.parquet(f"{tmp_path}/index")
    records = warc.read_records(spark.read.parquet(f"{tmp_path}/index"), with_blocks=False)
    whole = queries.digests_of(warc.transactions(records))
    assert {(r["page_id"], r["requested"], r["n_requests"]) for r in whole.collect()} == {(1, "/c", 1), (2, "/d", 1)}
    assert whole._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("SortMergeJoin") == 2
    short = queries.digests_of(warc.transactions(records.where("type <> 'request' or record_id not like '%:2:%'")))
    assert {(r["page_id"], r["requested"], r["n_requests"]) for r in short.collect()} == {(1, "/c", 1), (2, None, 0)}


def test_transactions_nest_whole_records(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    captures = spark.createDataFrame([("1", "http://a/", b"\x00\xff\r\n" * 40, "d1", None), ("2", "http://b/x", b"", "d2", None)], "name string, url string, payload binary, digest string, refers_to string")
    index = warc.write_archives(captures.coalesce(1), folder).collect()
    assert sum(r["captures"] for r in index) == 2
    paths = spark.createDataFrame([(r["path"],) for r in index], "path string")
    records = warc.read_records(paths)
    assert records.groupBy("type").count().count() == 4  # with warcinfo
    extra = records.where("type = 'request' and record_id like '%:1:%'")
    stray = records.where("type = 'metadata'").limit(1).selectExpr("'urn:stray' record_id", *[c if c != "concurrent_to" else "'urn:none' concurrent_to" for c in records.columns[1:]])
    found = {r["record_id"]: r for r in warc.transactions(records.unionByName(extra).unionByName(stray)).collect()}
    one = found["urn:capture:1:response"]
    assert len(found) == 2 and one["response"]["block"].endswith(b"\x00\xff\r\n" * 40) and one["response"]["payload_length"] == 160
    assert one["n_requests"] == 2 and one["n_metadata"] == 1 and b"payload-bytes: 160" in one["metadata"]["block"]
    assert warc.transactions(records.where("type = 'response'")).where("request is null and n_requests = 0").count() == 2
    assert warc.read_records(paths.limit(0)).count() == 0
    for broken in (b"no record", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"):
        with pytest.raises(ValueError):
            warc.parse(broken)


# ---- URLs


def judge(url, rules):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [4 << 20, 0])
def test_url_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", limit)
    rng = random.Random(1)
    rules = [*queries.URL_RULES, ("block", "", "/x"), ("block", "a.b.c", ""), ("allow", "A.org", "/é")]
    hosts = ["org", "example.org", "EXAMPLE.Org", "x.example.org", "notexample.org", "a.b.com", "com", "z.a.b.c", "a.org", "A.org", "ünï.org", "example.org:80", ".org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/a#/de/", "/de/", "?/es/", "#/", "/é", "/x\n/y"]
    urls = [f"{s}{h}{p}" for h in hosts for p in paths for s in ("http://", "h://q://" if rng.random() < 0.1 else "ftp://")] + [None, "", "no scheme", "://", "mailto:x", "http:///es/"]
    urls += urls[:50]
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, verdict int")
    out = url_filter.url_filter(pages, url_filter.rules_frame(spark, rules))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    usable = [r for r in rules if r[1]]
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        assert got[k] == judge(u, usable), u
    assert url_filter.url_filter(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
    none = url_filter.url_filter(pages, url_filter.rules_frame(spark, rules).limit(0), default="block")
    assert none.where("verdict = 'block' and rule is null").count() == len(urls)


def test_url_filter_with_many_shapes(spark):
    """Rules of 300 path lengths, hot urls and very long ones."""
    rules = [("block" if k % 2 else "allow", f"h{k % 9}.com", "/" + "a" * (k // 3)) for k in range(900)] + [("block", None, "/"), ("block", "com", None)]
    urls = [f"http://{'x.' * (k % 4)}h{k % 12}.com/{'a' * (k % 350)}{'b' * (k % 2)}" for k in range(500)] + ["http://h1.com/aaa"] * 300 + ["http://h2.com/" + "a" * 100_000] + [None] * 300
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.url_filter(pages, url_filter.rules_frame(spark, rules)).collect()
    usable = [r for r in rules if r[1] and r[2] is not None]
    assert len(got) == len(urls)
    for r in got:
        best = judge(r["url"], usable)
        assert (r["host"], r["path"], r["rule"] and len(r["rule"])) == (best[0], best[1], best[2] and len(best[2]))


# ---- substrings


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(250):
        strings = []
        for _ in range(rng.randint(1, 6)):
            s = [rng.randint(1, rng.choice([1, 2, 3, 20])) + 1 for _ in range(rng.randint(0, 25))]
            s = s[:5] * (len(s) // 5) if rng.random() < 0.4 else s
            strings.append([1 if rng.random() < 0.1 else c for c in s] + [0])
        first = np.cumsum([0, *map(len, strings)])
        want = [p + first[k] for k, s in enumerate(strings) for p in sorted(range(len(s)), key=lambda i, s=s: s[i:])]
        assert suffix_arrays(np.array([c for s in strings for c in s]), first).tolist() == want


def remove(texts):
    """What is left of each text (in order of ids), and its spans."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        windows = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = np.zeros(len(b), bool)
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = True
        seen |= set(windows)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def copied(rng):
    """Texts that share passages of many lengths, at their starts, ends and middles."""
    base = [prose(rng, 40, 3000) for _ in range(8)]
    texts = [*ODD, "ab" * 60, "ab" * 25, "x" * 49, "x" * 50]
    for _ in range(150):
        p = rng.choice(base)
        a, n = rng.randrange(len(p)), rng.randrange(30, 140)
        part = p[a : a + n]
        texts.append(rng.choice(["", prose(rng, 3), prose(rng, 30)]) + part + rng.choice(["", prose(rng, 3), prose(rng, 20) + part]))
    return texts


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_removal(spark, seed):
    rng = random.Random(seed)
    texts = copied(rng)
    rng.shuffle(texts)
    out = substring_dedup.substring_dedup(frame(spark, texts).repartition(5))
    got = {r["doc_id"]: r for r in out.collect()}
    want = remove(texts)
    assert [tuple(got[k])[1:5] for k in range(len(texts))] == want and sum(w[1] for w in want) > 1000
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.values())


def test_substring_removal_of_odd_rows(spark):
    t = "The same sixty bytes of text stand in several documents, all of them."
    out = substring_dedup.substring_dedup(frame(spark, [t, t, t, t, t], [5, 5, None, 9, None]), with_kept=False)
    got = sorted(((r["doc_id"], r["n_removed"]) for r in out.collect()), key=str)
    assert got == sorted([(5, 0), (5, 0), (None, 0), (None, 0), (9, len(t))], key=str)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_crowded_anchors():
    """Contexts of one anchor, sorted at once or in parts, lose the same bytes."""
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcd") for _ in range(84))
    found = set()
    while len(found) < 60:
        x = bytearray(base)
        for _ in range(rng.randint(1, 2)):
            x[rng.choice([k for k in range(84) if not 34 <= k < 50])] = rng.choice(b"abcd")
        a, b = rng.choice([0, 0, rng.randint(0, 34)]), rng.choice([84, 84, rng.randint(50, 84)])
        found.add((bytes(x[a:b]), 34 - a))
    contexts = sorted(found)
    size, left = np.array([len(c) for c, _ in contexts]), np.array([n for _, n in contexts])
    least = np.array([rng.randint(0, 1000) for _ in contexts])
    data = np.frombuffer(b"".join(c for c, _ in contexts), np.uint8)
    want = []
    for k, (c, n) in enumerate(contexts):
        gone = np.zeros(len(c), bool)
        for s in range(len(c) - 49):
            if s <= n and s + 50 >= n + 16 and any(least[j] < least[k] and c[s : s + 50] in d for j, (d, _) in enumerate(contexts)):
                gone[s : s + 50] = True
        want.append(gone.tolist())
    for many in (1000, 5):
        substring_dedup.MANY, kept = many, substring_dedup.MANY
        try:
            spans = substring_dedup.lost_spans(substring_dedup.Contexts(data, np.cumsum(size) - size, size, left, np.zeros(60, np.uint64), least))
        finally:
            substring_dedup.MANY = kept
        got = [np.zeros(n, bool) for n in size]
        for k, a, b in zip(*spans, strict=True):
            got[k][a:b] = True
        assert [g.tolist() for g in got] == want


# ---- the models


def labelled(spark, rng, n):
    bad = ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for k in range(n):
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        words = prose(rng, rng.randrange(20, 200), 300).split()
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        text = " ".join(words) if good else " ".join(w + "!!" for w in words).upper()
        rows.append((k, text))
        labels.append((k, good, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    rows, labels = labelled(spark, rng, 700)
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "vile nasty rotten"), (1, "a row again")]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, score string, predicted double").cache()
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").cache()
    return docs, known, {k: (g, t) for k, g, t in labels}


def accuracy(scored, truth, which):
    seen = [(r["predicted"], truth[r["doc_id"]][which]) for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert len(seen) > 80
    return np.mean([p == y for p, y in seen])


def test_toxicity(spark, corpus):
    docs, known, truth = corpus
    model = toxicity.fit(docs, known)
    scored = toxicity.toxicity_scores(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert accuracy(scored, truth, 1) > 0.95
    empty = {r["doc_id"]: r["predicted"] for r in scored}
    assert empty[1000] == empty[1001] == 0
    nothing = toxicity.fit(docs, known.limit(0))
    assert {r["predicted"] for r in toxicity.toxicity_scores(docs, nothing).collect()} <= {0, 1}
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_joins_with_the_models_give_the_same_scores(spark, corpus):
    docs, known, _ = corpus
    one, many = toxicity.fit(docs, known), toxicity.fit(docs, known, most_entries=0)
    assert one.shared and many.shared is None
    scores = [sorted((str(r["doc_id"]), round(r["score"], 6)) for r in toxicity.toxicity_scores(docs, m).collect()) for m in (one, many)]
    assert scores[0] == scores[1]


def test_kneser_ney_probabilities(spark):
    """Every word's log ratio against dictionaries of counts."""
    rng = random.Random(6)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))), k % 3 == 0) for k in range(40)]
    docs = spark.createDataFrame([(t, int(y)) for t, y in rows] + [(None, 1)], "text string, y int").repartition(3)
    d1, d2 = 2.0, 3.0
    entries, neutral = toxicity.log_ratios(toxicity.class_counts(docs, d2), d1, d2)
    model = toxicity.Model(neutral, spark.sparkContext.broadcast(toxicity.packed(entries.toArrow())), None, share=0.25)
    pairs = {True: {}, False: {}}
    for text, y in rows:
        words = text.split()
        for h, w in zip([None, *words], words, strict=False):
            pairs[y][h, w] = pairs[y].get((h, w), 0) + 1
    contexts = {y: {w: sum(1 for k in c if k[1] == w) for w in {k[1] for k in c}} for y, c in pairs.items()}
    total = {y: sum(c.values()) for y, c in contexts.items()}

    def unigram(y, w):
        n = contexts[y].get(w, 0)
        shared = sum(contexts[z].get(w, 0) for z in (True, False)) / sum(total.values())
        freed = sum(min(x, d1) for x in contexts[y].values()) / total[y]
        return max(n - d1, 0) / total[y] + freed * shared

    def p(y, h, w):
        here = {k: n for k, n in pairs[y].items() if k[0] == h}
        size = sum(here.values())
        if not size:
            return unigram(y, w)
        return max(here.get((h, w), 0) - d2, 0) / size + sum(min(n, d2) for n in here.values()) / size * unigram(y, w)

    for text, _ in rows:
        words = text.split()
        want = [math.log(0.75 + 0.25 * p(True, h, w) / p(False, h, w)) for h, w in zip([None, *words], words, strict=False)]
        data = np.frombuffer(text.encode(), np.uint8)
        got = model.evidence_of(data, np.array([0, len(data)]))[0]
        assert abs(got - (sum(want) / len(want) if want else 0)) < 1e-9


def test_a_toxic_word_weighs_less_in_a_longer_text(spark, corpus):
    docs, known, _ = corpus
    model = toxicity.fit(docs, known)
    rng = random.Random(3)
    good = " ".join(prose(rng, 30, 300) for _ in range(1500))
    texts = [f"vile {good[:n]}" for n in (40, 400, 4_000, 200_000)] + [good]
    x = [model.evidence_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts]
    assert x[0] > 3 * x[1] and x[1] > 3 * x[2] and x[2] > x[3] > x[4]
    scored = toxicity.toxicity_scores(frame(spark, [*texts, texts[0]]), model).orderBy("doc_id").collect()
    assert [r["score"] for r in scored] == sorted((r["score"] for r in scored[:5]), reverse=True) + [scored[0]["score"]]


def test_bags_are_bounded_in_bytes(spark, corpus):
    docs, known, _ = corpus
    table, bias = quality_model.fit(docs, known, most_bytes=20_000)
    again = quality_model.fit(docs.repartition(7), known, most_bytes=20_000)
    assert np.array_equal(table, again[0]) and bias == again[1]
    assert not np.array_equal(table, quality_model.fit(docs, known)[0])
    assert quality_model.fit(docs, known, most_bytes=1)[0].any()


def test_quality(spark, corpus):
    docs, known, truth = corpus
    scored = quality_model.quality_scores(docs, quality_model.fit(docs, known)).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert accuracy(scored, truth, 0) > 0.95
    nothing = quality_model.fit(docs, known.limit(0))
    assert {round(r["score"], 6) for r in quality_model.quality_scores(docs, nothing).collect()} == {0.5}


def test_held_out_labels_are_never_learnt(spark, corpus):
    docs, known, _ = corpus
    sample = folds.sampled_labels(known, "toxic", 10_000).collect()
    import zlib

    assert sample and all(zlib.crc32(str(r["id"]).encode()) % 5 == r["fold"] != 0 for r in sample)
    assert folds.sampled_labels(known, "toxic", 10).count() == 10
    flipped = known.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = toxicity.fit(docs, known), toxicity.fit(docs, flipped)
    assert (a.slope, a.shift, a.neutral) == (b.slope, b.shift, b.neutral)


# ---- the registered queries


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck(SF).sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_substring_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_suffix_array_dedup(spark, SF).collect()}
    assert [got[r["doc_id"]] for r in docs] == remove([r["text"] for r in docs])


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_packing_query_equals_brute_force(spark):
    from test_text_operators import check_packing

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    place = {r["doc_id"]: k for k, r in enumerate(docs)}
    found = queries.op7_best_fit_packing(spark, SF).collect()
    check_packing([r.asDict() | {"doc_id": place[r["doc_id"]]} for r in found], [r["text"] for r in docs], queries.tokenizer_path(), 1024)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_model_queries_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, which, least in ((queries.op1_toxicity, 1, 0.95), (queries.op2_quality_model, 0, 0.97)):
        scored = query(spark, sf).collect()
        assert len(scored) == spark.read.parquet(f"{sf}/documents.parquet").count()
        assert accuracy(scored, truth, which) > least


def test_all_ten_are_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert shared_dir(spark).startswith("file://")
