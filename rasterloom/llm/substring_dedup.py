r"""Removal of repeated substrings with suffix arrays.

Each byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller id is
removed.  A suffix array over a whole corpus can't be spread over tasks, so the corpus is first cut
into parts between which no match is lost: every window of LENGTH bytes has an *anchor*, the
16-byte string in it with the least hash, and equal windows have equal anchors at equal places.
Anchors found in one document only are left out; around the others a *context* is cut that holds all
windows of the anchor.  The contexts of one anchor are a part: their suffix array (see
``suffix_order``) puts equal windows side by side, and the smallest id among them decides.

Equal contexts are one from the start, so thousands of copies cost what one does; anchors
with very many different contexts are parted further by the bytes next to the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import textbytes as tb
from rasterloom.llm.suffix_order import _edges, _ranges, suffix_arrays

LENGTH = 50
ANCHOR = 16
SIDE = LENGTH - ANCHOR
#: Bytes of text whose anchors are sent together, and whose anchors are found at once.
SEND, FIND = 8 << 20, 1 << 20
#: Bytes of text per bucket of anchors.
BUCKET_BYTES = 4 << 20
#: Contexts of an anchor beyond which they are parted further, and the width of such a part.
MANY, STEP = 96, 4
#: Width of the ranges by which contexts are told that share no window with any other.
WIDE = 7
SUMS_AT_ONCE = 1 << 20
#: Bytes of contexts that are sorted side by side.
SORT_BYTES = 1 << 19


def anchors(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, rows and hashes of the anchors of a slice's texts, in order."""
    n = len(values)
    ok = tb.in_one_row(offsets, LENGTH, n)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # 16 bytes at every place as two words
    words = np.lib.stride_tricks.as_strided(values.view(), (n - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    h = tb.mix(words[: n - ANCHOR + 1] * np.uint64(0xA0761D6478BD642F) ^ tb.mix(words[8:]))
    # the least of SIDE + 1 neighbours by doubling; the place breaks ties, so the leftmost wins
    low, width = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while width * 2 <= SIDE + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SIDE + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:])[: len(ok)]
    places = (low[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    places = places[np.append(True, places[1:] != places[:-1])]  # they never go back
    return places, np.searchsorted(offsets, places, "right") - 1, h[places]


def anchors_of(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of a long slice, some rows at a time, for arrays that fit the processor's caches."""
    found, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + FIND, "right")) - 1)
        place, row, h = anchors(values[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        found.append((place + offsets[at], row + at, h))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    return _zstd()[0].compress(np.ascontiguousarray(x).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(b), kind)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    """The 32 bits of an anchor's hash that are kept beside its bucket; a clash only lets more through."""
    return (tb.mix(h) >> np.uint64(32)).astype(np.uint32)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = _edges(bucket[order])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _anchor_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ids, docs, hashes): the anchors of a stretch of documents by bucket, each once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in tb.slices(batches, most=SEND):
            _, row, h = anchors_of(values, offsets)
            ids = part.column("id").to_numpy()
            out = []
            for bucket, some in _by_bucket(_bucket(h, buckets)):
                pairs = np.unique(row[some].astype(np.uint64) << np.uint64(32) | _short(h[some]).astype(np.uint64))
                docs, local = np.unique((pairs >> np.uint64(32)).astype(np.int64), return_inverse=True)
                out.append((bucket, _pack(np.diff(ids[docs], prepend=0)), _pack(local.astype(np.uint32)), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "ids", "docs", "hashes"])

    return rows.mapInArrow(run, "bucket long, ids binary, docs binary, hashes binary")


def _shared(sent: DataFrame) -> DataFrame:
    """(id, hash) of anchors found in two documents or more, bucket by bucket."""

    def run(table: pa.Table) -> pa.Table:
        ids, hashes = [], []
        for i, d, h in zip(*(table.column(c).to_pylist() for c in ("ids", "docs", "hashes")), strict=True):
            ids.append(np.cumsum(_unpack(i, np.int64))[_unpack(d, np.uint32)])
            hashes.append(np.frombuffer(h, np.uint32))
        ids, hashes = np.concatenate(ids), np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        ids, hashes = ids[order], hashes[order]
        cuts = _edges(hashes)
        low, high = np.minimum.reduceat(ids, cuts[:-1]), np.maximum.reduceat(ids, cuts[:-1])
        keep = np.repeat(low != high, np.diff(cuts))
        return pa.table({"id": pa.array(ids[keep]), "hash": pa.array(hashes[keep].view(np.int32))})

    return sent.groupBy("bucket").applyInArrow(run, "id long, hash int")


def _context_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ids, entries, bytes): the contexts of shared anchors by bucket, equal ones of a stretch once.

    ``texts``: id, text, hashes (the document's shared anchors).
    """
    kind = np.dtype([("context", "<u4"), ("doc", "<u4"), ("place", "<i8")])
    shape = np.dtype([("hash", "<u8"), ("left", "u1"), ("size", "u1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in tb.slices(batches, most=SEND):
            place, row, h = anchors_of(values, offsets)
            lists = part.column("hashes")
            wanted = np.asarray(lists.flatten()).view(np.uint32)
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            keys = np.sort(owner.astype(np.uint64) << np.uint64(32) | wanted)
            mine = row.astype(np.uint64) << np.uint64(32) | _short(h)
            at = np.searchsorted(keys, mine)
            at[at == len(keys)] = 0
            chosen = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
            place, row, h = place[chosen], row[chosen], h[chosen]
            begin, end = np.maximum(place - SIDE, offsets[row]), np.minimum(place + ANCHOR + SIDE, offsets[row + 1])
            content = Contexts(values, begin, end - begin, place - begin, h, h).hashes(np.arange(len(h)), np.zeros(len(h), np.int64), end - begin) ^ tb.mix(h + (place - begin).astype(np.uint64))
            ids = part.column("id").to_numpy()
            out = []
            for bucket, some in _by_bucket(_bucket(h, buckets)):
                _, one, which = np.unique(content[some], return_index=True, return_inverse=True)
                first = some[one]
                docs, local = np.unique(row[some], return_inverse=True)
                entries = np.empty(len(some), kind)
                entries["context"], entries["doc"], entries["place"] = which, local, place[some] - offsets[row[some]]
                heads = np.empty(len(first), shape)
                heads["hash"], heads["left"], heads["size"] = h[first], place[first] - begin[first], end[first] - begin[first]
                data = values[_ranges(begin[first], end[first] - begin[first])]
                out.append((bucket, _pack(np.diff(ids[docs], prepend=0)), b"".join(_framed(x) for x in (entries["context"], entries["doc"], entries["place"])), b"".join(_framed(x) for x in (heads["hash"], heads["left"], heads["size"])), _pack(data)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "ids", "entries", "heads", "bytes"])

    return texts.mapInArrow(run, "bucket long, ids binary, entries binary, heads binary, bytes binary")


def _framed(x: np.ndarray) -> bytes:
    data = _pack(x)
    return len(data).to_bytes(4, "little") + data


def _frames(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


class Contexts:
    """Distinct contexts of a bucket: bytes in a row, each one's begin, size, bytes left of the anchor, anchor and first document."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, anchor: np.ndarray, least: np.ndarray):
        self.data, self.begin, self.size, self.left, self.anchor, self.least = data, begin, size, left, anchor, least
        # running sums start anew every so many bytes, between contexts, so the tables of powers stay small
        by = np.argsort(begin, kind="stable")
        block = np.empty(len(begin), np.int64)
        block[by] = begin[by] // SUMS_AT_ONCE
        first = _edges(block[by])
        self.sums, self.origin, self.base = np.empty(len(data) + len(first), np.uint64), np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
        at = 0
        for x, y in zip(first[:-1], first[1:], strict=True):
            low, high = begin[by[x]], (begin[by[x:y]] + size[by[x:y]]).max()
            if at + high - low + 1 > len(self.sums):
                self.sums = np.append(self.sums, np.empty(at + high - low + 1, np.uint64))
            self.sums[at : at + high - low + 1] = tb.window_sums(data[low:high])
            self.origin[by[x:y]], self.base[by[x:y]] = low, at
            at += high - low + 1

    def hashes(self, which: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the bytes start..stop of contexts."""
        local = self.begin[which] - self.origin[which] + start
        return tb.window_hash(self.sums, self.base[which] + local, stop - start, local)

    def pieces(self, which: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(contexts, key, start, stop) for windows with low..high bytes left of the anchor, for ranges of ``step``.

        Two contexts can share such a window only if their keys are equal: the bytes that all those
        windows have.  start..stop are the bytes that some of the windows have.
        """
        for low in range(0, SIDE + 1, step):
            high = min(low + step - 1, SIDE)
            left, right = self.left[which], self.size[which] - self.left[which] - ANCHOR
            ok = np.flatnonzero((left >= low) & (right >= SIDE - high))
            some, left, right = which[ok], left[ok], right[ok]
            key = self.hashes(some, left - low, left + ANCHOR + SIDE - high) ^ tb.mix(self.anchor[some])
            yield some, key, left - np.minimum(left, high), left + ANCHOR + np.minimum(right, SIDE - low)


def window_owners(data: np.ndarray, begin: np.ndarray, size: np.ndarray, cuts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every window of every context, contexts in a row, the smallest ``least`` of its group's contexts that have it.

    Group k is the contexts cuts[k] to cuts[k + 1]; one suffix array per group, many side by side.
    """
    n, groups = len(begin), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    # each context is followed by a mark, each group by a smaller one
    place = np.cumsum(size + 1) - (size + 1) + groups
    lanes = np.append(place[cuts[:-1]], place[-1] + size[-1] + 2)
    text = np.zeros(lanes[-1], np.int64)
    text[_ranges(place, size)] = data[_ranges(begin, size)].astype(np.int64) + 2
    text[place + size] = 1
    order = suffix_arrays(text, lanes)
    windows = np.maximum(size - LENGTH + 1, 0)
    where = _ranges(place, windows)
    context = np.full(len(text), -1, np.int64)
    context[where] = np.repeat(np.arange(n), windows)
    # suffixes that begin with a whole window, in order; neighbours with equal windows form a run
    s = order[context[order] >= 0]
    if not len(s):
        return np.zeros(0, np.int64)
    code = tb.window_hash(tb.window_sums(text.astype(np.uint8)), s, np.full(len(s), LENGTH), s)
    runs = _edges(groups[context[s]], code)
    found = np.empty(len(text), np.int64)
    found[s] = np.repeat(np.minimum.reduceat(least[context[s]], runs[:-1]), np.diff(runs))
    return found[where]


def _covered(context: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (context, start, stop) of bytes covered by the windows that start at ``at``, in order within each context."""
    if not len(at):
        return context, at, at
    new = np.append(True, (context[1:] != context[:-1]) | (np.diff(at) > LENGTH))
    first = np.flatnonzero(new)
    return context[first], at[first], at[np.append(first[1:] - 1, len(at) - 1)] + LENGTH


def _repeated_keys(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(tb.repeated(key))


def lost_spans(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, stop): what each distinct context's first document loses; contexts are sorted by anchor."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # contexts that can share a window with another one
    able = np.zeros(len(c.begin), bool)
    several = _repeated_keys(c.anchor)
    for some, key, _, _ in c.pieces(several, WIDE):
        able[some[_repeated_keys(key)]] = True
    able = np.flatnonzero(able)
    if not len(able):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    cuts = _edges(c.anchor[able])
    crowded = np.repeat(np.diff(cuts) > MANY, np.diff(cuts))

    def solve(some: np.ndarray, start: np.ndarray, stop: np.ndarray, groups: np.ndarray, least: np.ndarray, parents: np.ndarray, child: np.ndarray, shift: np.ndarray) -> None:
        """Contexts start..stop of ``some`` in groups (sorted); ``parents``, sorted by ``child``, take what their child's windows say, from byte ``shift`` on."""
        cuts = _edges(groups)
        sizes = np.add.reduceat(stop - start, cuts[:-1]) if len(some) else np.zeros(0, np.int64)
        by = np.argsort(sizes, kind="stable")  # groups of like size side by side
        block = (np.cumsum(sizes[by]) - sizes[by]) // SORT_BYTES
        edge = np.searchsorted(child, np.arange(len(some) + 1))
        for x, y in zip((e := _edges(block))[:-1], e[1:], strict=True):
            chosen = by[x:y]
            n = np.diff(cuts)[chosen]
            k = _ranges(cuts[chosen], n)
            owners = window_owners(c.data, c.begin[some[k]] + start[k], stop[k] - start[k], np.append(0, np.cumsum(n)), least[k])
            windows = np.maximum(stop[k] - start[k] - LENGTH + 1, 0)
            base = np.cumsum(windows) - windows
            many = np.diff(edge)[k]
            taken, mine = _ranges(edge[k], many), np.repeat(np.arange(len(k)), many)
            who = parents[taken]
            flat = _ranges(base[mine], windows[mine])
            owner = np.repeat(np.arange(len(who)), windows[mine])
            gone = np.flatnonzero(owners[flat] < c.least[who[owner]])
            at = flat[gone] - base[mine[owner[gone]]] + shift[taken[owner[gone]]]
            one, a, b = _covered(owner[gone], at)
            found.append((who[one], a, b))

    plain = able[~crowded]
    if len(plain):
        solve(plain, np.zeros(len(plain), np.int64), c.size[plain], c.anchor[plain], c.least[plain], plain, np.arange(len(plain)), np.zeros(len(plain), np.int64))
    if crowded.any():
        for some, key, start, stop in c.pieces(able[crowded], STEP):
            kept = _repeated_keys(key)
            some, key, start, stop = some[kept], key[kept], start[kept], stop[kept]
            content = c.hashes(some, start, stop)
            by = np.lexsort((content, key))
            some, key, start, stop, content = some[by], key[by], start[by], stop[by], content[by]
            same = _edges(key, content)
            one = same[:-1]
            if len(some):
                solve(some[one], start[one], stop[one], key[one], np.minimum.reduceat(c.least[some], one), some, np.repeat(np.arange(len(one)), np.diff(same)), start)
    if not found:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    who, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(who, kind="stable")
    return who[by], a[by], b[by]


def _marks(sent: DataFrame) -> DataFrame:
    """(id, start, stop): spans of bytes to be removed, bucket by bucket; they overlap."""

    def run(table: pa.Table) -> pa.Table:
        ids, places, owners, hashes, lefts, sizes, data = [], [], [], [], [], [], []
        n = 0
        for i, e, hd, b in zip(*(table.column(c).to_pylist() for c in ("ids", "entries", "heads", "bytes")), strict=True):
            which, doc, place = (_unpack(x, k) for x, k in zip(_frames(e), ("<u4", "<u4", "<i8"), strict=True))
            h, left, size = (_unpack(x, k) for x, k in zip(_frames(hd), ("<u8", "u1", "u1"), strict=True))
            ids.append(np.cumsum(_unpack(i, np.int64))[doc])
            places.append(place)
            owners.append(which.astype(np.int64) + n)
            hashes.append(h)
            lefts.append(left)
            sizes.append(size)
            data.append(_unpack(b, np.uint8))
            n += len(h)
        ids, places, owners = np.concatenate(ids), np.concatenate(places), np.concatenate(owners)
        hashes, lefts, sizes, data = np.concatenate(hashes), np.concatenate(lefts).astype(np.int64), np.concatenate(sizes).astype(np.int64), np.concatenate(data)
        begin = np.cumsum(sizes) - sizes
        every = Contexts(data, begin, sizes, lefts, hashes, np.zeros(0, np.int64))
        code = every.hashes(np.arange(n), np.zeros(n, np.int64), sizes) ^ tb.mix(hashes + lefts.astype(np.uint64))
        by = np.lexsort((code, hashes))
        cuts = _edges(hashes[by], code[by])
        one = by[cuts[:-1]]
        distinct = np.empty(n, np.int64)
        distinct[by] = np.repeat(np.arange(len(one)), np.diff(cuts))
        owners = distinct[owners]
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, owners, ids)
        who, lost_from, lost_to = lost_spans(Contexts(data, begin[one], sizes[one], lefts[one], hashes[one], least))
        # later documents with the same context lose all of it, the first what its windows' owners say
        start, size = places - lefts[one][owners], sizes[one][owners]
        later = (ids != least[owners]) & (size >= LENGTH)
        edge = np.searchsorted(who, np.arange(len(one) + 1))
        count = np.diff(edge)
        own = np.flatnonzero((ids == least[owners]) & (count[owners] > 0))
        pick, rep = _ranges(edge[owners[own]], count[owners[own]]), np.repeat(own, count[owners[own]])
        out_id, out_start, out_stop = [ids[later], ids[rep]], [start[later], start[rep] + lost_from[pick]], [(start + size)[later], start[rep] + lost_to[pick]]
        return pa.table({"id": pa.array(np.concatenate(out_id)), "start": pa.array(np.concatenate(out_start)), "stop": pa.array(np.concatenate(out_stop))})

    return sent.groupBy("bucket").applyInArrow(run, "id long, start long, stop long")


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans; those that overlap or touch are one."""
    if not len(start):
        return start, stop
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(stop[by])
    new = np.append(True, start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:] - 1, len(start) - 1)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (the bytes left) if wanted.

    Ids are whole numbers.  Matches don't cross documents, overlaps count, and all is judged on the
    input.  Null and empty texts have no bytes; texts of fewer than LENGTH bytes lose nothing.  Rows with a
    null id neither lose bytes nor take any from others.  Rows that share an id are one document:
    they take nothing from each other, and a span found in one of them goes from all.
    Other columns aren't read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = base.where(F.col("id").isNotNull())
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, -(-total // BUCKET_BYTES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle of the texts serves both for cutting contexts and for removing bytes, so both read the same plan
    placed = named.repartition(parts, "id")
    lists = _shared(_anchor_rows(named, buckets)).groupBy("id").agg(F.collect_list("hash").alias("hashes"))
    marks = _marks(_context_rows(placed.join(lists, "id"), buckets))
    spans = marks.groupBy("id").agg(F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop"))
    none = F.lit(None).cast("array<bigint>")
    nameless = base.where(F.col("id").isNull()).select("id", "text", none.alias("start"), none.alias("stop"))
    joined = placed.join(spans, "id", "left").select("id", "text", "start", "stop").unionAll(nameless)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in tb.slices(batches):
            rows = []
            for k in range(part.num_rows):
                text = values[offsets[k] : offsets[k + 1]]
                start, stop = part.column("start")[k].values, part.column("stop")[k].values
                if start is None:
                    rows.append((len(text), 0, 0, text.tobytes()))
                    continue
                a, b = merged(start.to_numpy(), stop.to_numpy())
                b = np.minimum(b, len(text))
                steps = np.zeros(len(text) + 1, np.int64)
                steps[a] += 1
                steps[b] -= 1
                keep = np.cumsum(steps[:-1]) == 0
                rows.append((len(text), int((b - a).sum()), len(a), text[keep].tobytes()))
            size, gone, n, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept if with_kept else [None] * len(kept), pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = joined.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return (out if with_kept else out.drop("kept")).withColumnRenamed("id", id_col)
