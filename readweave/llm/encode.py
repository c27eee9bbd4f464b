"""Token ids by the tokenizers library; each worker caches the ids of the pieces of text that it met first.

Texts are cut only at gaps which the pre-tokenizer never joins across: plain spaces and line feeds, and between a run of
Latin letters and the plain punctuation after it. So the ids of a text are the ids of its pieces in order. Pieces are
found, hashed and looked up as arrays; a text with other white space or with runs of it goes to the library whole where
the vocabulary keeps white space, and so does any text that holds the literal of a special token.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from readweave.llm import text as T

#: Punctuation that the pre-tokenizers always part from letters before it (no apostrophe: contractions)
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?*#%$&|")] = True
#: ASCII letters, lead bytes of U+00C0..U+024F, continuation bytes
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
_LINES = np.zeros(256, bool)
_LINES[[10, 32]] = True
_OTHER = np.zeros(256, bool)
_OTHER[[9, 11, 12, 13, *range(28, 32)]] = True
_WIDE_SPACE = re.compile("[\x85\xa0 ᠎ -​    　﻿]")
_SPACED = np.uint64(0xA24BAED4963EE407)
#: Bounds of a worker's cache; pieces beyond are encoded each time they come up
_MOST_PIECES, _MOST_IDS = 400_000, 4_000_000
_LIBRARY_BATCH = 8192
#: Pieces that go to the library as one text, where the vocabulary has an id for line feeds, which no word holds
_JOINED = 256


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # tasks are the parallelism; threads of the library would take other tasks' cores, and memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        # in lower case, as some vocabularies fold texts before they look for them
        self.literals = [t.content.encode().lower() for t in self.library.get_added_tokens_decoder().values() if t.content]
        shown = [self.library.encode(x, add_special_tokens=False).ids for x in ("a b", "a  \n b")]
        self.drops_space = shown[0] == shown[1]
        self.line_feed = self.library.encode("\n", add_special_tokens=False).ids
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has."""
        if len(self.line_feed) == 1 and not self.drops_space:
            got, sizes = [], []
            for at in range(0, len(pieces), _JOINED):
                some = pieces[at : at + _JOINED]
                ids = np.array(self.library.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                feeds = np.flatnonzero(ids == self.line_feed[0])
                if len(feeds) != len(some) - 1:  # a piece is a line feed itself
                    ids, n = self._encode_each(some)
                else:
                    n = np.diff(feeds, prepend=-1, append=len(ids)) - 1
                    ids = np.delete(ids, feeds)
                got.append(ids)
                sizes.append(n)
            return np.concatenate(got), np.concatenate(sizes)
        return self._encode_each(pieces)

    def _encode_each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got: list[int] = []
        sizes: list[int] = []
        for at in range(0, len(pieces), _LIBRARY_BATCH):
            for e in self.library.encode_batch_fast(pieces[at : at + _LIBRARY_BATCH], add_special_tokens=False):
                ids = e.ids
                got += ids
                sizes.append(len(ids))
        return np.array(got, np.uint32), np.array(sizes, np.int64)

    def _odd(self, docs: T.Docs) -> np.ndarray:
        """Documents that go to the library whole, if white space is kept."""
        data = docs.data
        n = len(data)
        bad = _OTHER[data]
        gap = _LINES[data]
        head = np.zeros(n + 1, bool)
        head[docs.offsets] = True
        bad |= gap & head[1:]  # at the end
        bad |= (data == 32) & head[:-1]
        bad[1:] |= gap[1:] & gap[:-1]
        counts = np.concatenate([[0], np.cumsum(bad)])[docs.offsets]
        odd = np.diff(counts) > 0
        if (data >= 0xC2).any():
            lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xEF))
            has = np.diff(np.concatenate([[0], np.cumsum(lead)])[docs.offsets]) > 0
            for i in np.flatnonzero(has & ~odd):
                odd[i] = bool(_WIDE_SPACE.search(docs.text(i)))
        return odd

    def _special(self, docs: T.Docs) -> np.ndarray:
        """Documents that may hold the literal of an added token, which the library looks for before it cuts texts."""
        out = np.zeros(len(docs), bool)
        data = docs.data.tobytes().lower()
        for literal in self.literals:
            at = data.find(literal)
            while at >= 0:
                i = int(np.searchsorted(docs.offsets, at, "right")) - 1
                out[i] = True
                # on in the same document there is nothing to learn
                at = data.find(literal, max(at + 1, int(docs.offsets[i + 1]) - len(literal) + 1))
        return out

    def slice(self, docs: T.Docs) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, and each document's range of them."""
        keep = not self.drops_space
        words = T.words_of(docs, _LINES if keep else T.SPACE)
        start, end = words.start, words.end
        n = len(start)
        total = np.concatenate([[0], np.cumsum(_TAIL[docs.data])])
        # the last byte of a word that is no tail: by the last position of such a byte
        last = np.where(_TAIL[docs.data], -1, np.arange(len(docs.data)))
        last = np.maximum.accumulate(last) if len(last) else last
        core_end = np.maximum(last[end - 1] + 1, start) if n else end
        odd_byte = ~_LETTER[docs.data]
        two = np.flatnonzero(docs.data[:-1] == 0xC3) if len(docs.data) else np.zeros(0, np.int64)
        sign = np.isin(docs.data[two + 1], (0x97, 0xB7)) if len(two) else np.zeros(0, bool)
        odd_byte[two[sign]] = True
        odds = np.concatenate([[0], np.cumsum(odd_byte)])
        split = (core_end > start) & (core_end < end) & (odds[core_end] == odds[start])
        assert not n or (total[end] - total[core_end] == end - core_end).all()
        spaced = np.zeros(n, bool)
        line = np.zeros(n, bool)
        if keep and n:
            inner = start > 0
            before = docs.data[np.maximum(start - 1, 0)]
            at_head = np.zeros(len(docs.data) + 1, bool)
            at_head[docs.offsets] = True
            inner &= ~at_head[start]
            spaced = inner & (before == 32)
            line = inner & (before == 10)
        # pieces in order: [line feed] word-or-core [tail]
        count = 1 + line + split
        pos = np.cumsum(count) - count
        m = int(count.sum())
        a, b = np.zeros(m, np.int64), np.zeros(m, np.int64)
        lead = np.zeros(m, bool)
        main = pos + line
        a[main], b[main], lead[main] = start, np.where(split, core_end, end), spaced
        a[pos[line]], b[pos[line]] = start[line] - 1, start[line]
        tail = main[split] + 1
        a[tail], b[tail] = core_end[split], end[split]
        keys = T.hashes(docs, T.Words(a, b, np.zeros(1, np.int64)))
        keys[lead] ^= _SPACED
        one, at, where = np.unique(keys, return_index=True, return_inverse=True)
        i = np.searchsorted(self.keys, one)
        known = i < len(self.keys)
        known[known] = self.keys[i[known]] == one[known]
        start, size, ids = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), self.ids
        start[known], size[known] = self.start[i[known]], self.size[i[known]]
        if not known.all():
            raw, new = docs.data.tobytes(), at[~known]
            got, n = self._encode([(" " if s else "") + raw[x:y].decode("utf-8", "replace") for x, y, s in zip(a[new].tolist(), b[new].tolist(), lead[new].tolist())])
            ids = np.concatenate([ids, got])
            start[~known], size[~known] = len(ids) - len(got) + np.cumsum(n) - n, n
            if len(self.keys) + len(n) <= _MOST_PIECES and len(ids) <= _MOST_IDS:
                places = i[~known]
                self.keys = np.insert(self.keys, places, one[~known])
                self.start = np.insert(self.start, places, start[~known])
                self.size = np.insert(self.size, places, n)
                self.ids = ids
        start, size = start[where], size[where]
        ends = np.cumsum(size)
        out = ids[np.repeat(start - ends + size, size) + np.arange(int(size.sum()))]
        edge = np.concatenate([[0], ends])[np.concatenate([pos, [m]])[words.first]]
        odd = self._special(docs)
        if keep:
            odd |= self._odd(docs)
        if odd.any():
            parts = [self.whole(docs.text(d)) if odd[d] else out[edge[d] : edge[d + 1]] for d in range(len(docs))]
            out = np.concatenate(parts)
            edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, edge.astype(np.int64)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each vocabulary in a worker process, with its cache."""
    return Encoder(path)
