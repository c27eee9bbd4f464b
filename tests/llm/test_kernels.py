import zlib

import corpus
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from readweave.llm import encode, text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    some = [t or "" for t in corpus.texts()] + ["a  b\n\nc  ", " x", "it's 12 A.B, c!?\n d", "a\tb", "é...  \n\n  ü's", "don't.,' x", "a× b÷. Ça.\nÜ,b", "\nb", "a…. b—, «x».", "日本語。 テスト, 印刷!", "é. áb,", "''s. 's. 're,", "<|endoftext|> x<|endoftext|>"]
    e = encode.Encoder(public_tokenizers.path(name))
    for _ in range(2):  # empty cache, then full
        for _, to, part in text.slices(text.docs_of(pa.array(some)), 3000):
            ids, edge = e.slice(part)
            for i in range(len(part)):
                assert np.array_equal(ids[edge[i] : edge[i + 1]], e.whole(some[to - len(part) + i])), some[to - len(part) + i]


def test_words_and_shingles():
    some = [*corpus.texts(), "x"]
    docs = text.docs_of(pa.array(some))
    w = text.words_of(docs)
    for i, t in enumerate(some):
        got = [docs.data[a:b].tobytes().decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
        assert got == corpus.words(t)
    g, first = text.distinct(*text.shingle_hashes(docs))
    assert [b - a for a, b in zip(first, first[1:])] == [len(corpus.shingles(t)) for t in some]
    sets = [frozenset(g[a:b].tolist()) for a, b in zip(first, first[1:])]
    for i in range(0, len(some), 3):
        for j in range(0, len(some), 4):
            assert len(sets[i] & sets[j]) == len(corpus.shingles(some[i]) & corpus.shingles(some[j]))


def test_slices_cover_all_documents():
    docs = text.docs_of(pa.array(["a" * 50, "", "b" * 500, None, "c"]))
    got = [(a, b) for a, b, _ in text.slices(docs, 60)]
    assert got[0][0] == 0 and got[-1][1] == 5 and all(x[1] == y[0] for x, y in zip(got, got[1:]))
    assert zlib.crc32(b"".join(p.data.tobytes() for _, _, p in text.slices(docs, 60))) == zlib.crc32(docs.data.tobytes())
