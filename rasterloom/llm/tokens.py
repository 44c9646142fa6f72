"""Token ids of whole texts, each distinct piece of text encoded once per worker.

A byte-level BPE vocabulary never merges across the borders of the tokenizer's own splitting,
and some of those are plain to see in the bytes: after a visible character before white space,
after a letter before another ASCII character, after a lone line break before a visible one.  Texts
are cut there in numpy, the pieces hashed, and only pieces that this worker hasn't met are given
to the tokenizer; a text's ids are its pieces' ids in a row.  A text that holds one of the tokenizer's
added tokens (such as an end mark) is one piece, as the tokenizer looks for those first.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np
from rasterloom.llm import textbytes as tb

VISIBLE, LETTER, MARK, BLANK = (np.zeros(256, bool) for _ in range(4))
VISIBLE[0x21:0x7F] = True
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
MARK[0x21:0x7F] = True
MARK &= ~LETTER
BLANK[[9, 10, 13, 32]] = True
#: The second byte of a letter whose first is 0xC3 (the two others are signs).
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False


#: How byte-level vocabularies write a space.
SPACE_MARK = "\u0120"
PLAIN = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


class PieceTokenizer:
    """Ids for slices of text from the tokenizer file at ``path``; remembers about ``most`` pieces and 8 * ``most`` ids."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens whose strings stand for themselves in a text; a text with one is never cut.
        self.whole = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = self._ids(texts)
        count = np.fromiter(map(len, found), np.int32, len(found))
        begin = (len(self.ids) + np.cumsum(count, dtype=np.int64) - count).astype(np.int32)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each piece; words of letters after a space are given to the tokenizer many at a time."""
        plain = [k for k, x in enumerate(texts) if PLAIN(x)]
        out: list[list[int]] = [[]] * len(texts)
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]
            got = self.tokenizer.encode("".join(texts[k] for k in some), add_special_tokens=False)
            ids, opens = got.ids, [i for i, x in enumerate(got.tokens) if x[0] == SPACE_MARK]
            opens.append(len(ids))
            for k, a, b in zip(some, opens[:-1], opens[1:], strict=True):
                out[k] = ids[a:b]
        others = sorted(set(range(len(texts))).difference(plain))
        for k, e in zip(others, self.tokenizer.encode_batch_fast([texts[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def __call__(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's texts in a row, and each text's first (one more than texts)."""
        n = len(values)
        cut = np.zeros(n, bool)
        if n:
            before, now = values[:-1], values[1:]
            letter = LETTER[before]
            letter[1:] |= LATIN[before[1:]] & (before[:-1] == 0xC3)
            seen = letter | VISIBLE[before]
            cut[1:] = BLANK[now] & seen | letter & MARK[now]
            cut[2:] |= (before[1:] == 10) & seen[:-1] & VISIBLE[now[1:]]
            data = values.tobytes()
            for mark in self.whole:
                at = data.find(mark)
                while at >= 0:
                    row = int(np.searchsorted(offsets, at, "right")) - 1
                    cut[offsets[row] : offsets[row + 1]] = False
                    at = data.find(mark, max(at + 1, int(offsets[row + 1])))
            cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        hashes = tb.span_hash(tb.prefix_hash(values), starts, ends) if n else np.zeros(0, np.uint64)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            at = np.searchsorted(self.keys, keys)
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            if len(self.keys) + int(new.sum()) > self.most or len(self.ids) > 8 * self.most:
                self._forget()  # what is remembered makes room for this slice
                new[:] = True
            self._learn(keys[new], [data[a:b].decode() for a, b in zip(starts[where[new]], ends[where[new]], strict=True)])
        at = np.searchsorted(self.keys, keys)[back]
        count = self.count[at].astype(np.int64)
        first = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(first[-1]) + np.repeat(self.begin[at] - first[:-1], count)] if len(at) else np.zeros(0, np.uint32)
        return ids, first[np.searchsorted(starts, offsets)]


@cache
def tokenizer(path: str) -> PieceTokenizer:
    """This worker's tokenizer, which later tasks find with what it has learnt."""
    return PieceTokenizer(path)
