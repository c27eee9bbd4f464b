"""Operators on documents against plain versions, over the awkward corpus."""

import collections
import hashlib
import itertools
import math
import zlib

import corpus
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from readweave.llm import contamination, idfile, katz, licenses, neardup, packing, quality, substrings
from readweave.llm import text as T
from readweave.llm.tables import clear, new_path, stash


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark).repartition(3).cache()


def test_contamination(spark, docs):
    some = corpus.texts()
    items = [(0, " ".join(corpus.words(some[3])[5:45])), (1, "a b c"), (2, None), (3, ""), (4, some[10]), (5, "no such words in any of the texts here at all"), (6, some[10]), (None, some[12])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared_shingles"]) for r in contamination.contaminated(docs, bench, block_bytes=400).collect()}
    want = {}
    for (i, a), (d, b) in itertools.product(items, enumerate(some)):
        x, y = corpus.shingles(a), corpus.shingles(b)
        if x and 100 * len(x & y) >= 80 * len(x):
            want[d, i] = (len(x), len(x & y))
    assert got == want and want
    assert {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(docs, bench).collect()} == set(want)
    kept = contamination.drop_contaminated(docs, bench, block_bytes=400)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one scan for several blocks
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(some))) - {d for d, _ in want}
    assert contamination.contaminated(docs, bench.limit(0)).count() == 0 and contamination.contaminated(corpus.empty(spark), bench).count() == 0


@pytest.mark.parametrize("more", [0, 1, 2, 7])
def test_contamination_by_items_of_one_shingle(spark, more):
    item, filler = "one two three four five", [f"w{i}" for i in range(more)]
    some = [" ".join(filler[:i] + item.split() + filler[i:]) for i in range(more + 1)] + ["two three four five six", " ".join(filler)]
    docs = corpus.frame(spark, [*some, "x " * 4 + "y " * 9])
    bench = spark.createDataFrame([(0, item), (1, "y y y y y y y")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["item_shingles"], r["shared_shingles"]) for r in contamination.contaminated(docs, bench).collect()}
    assert got == {(i, 0, 1, 1) for i in range(more + 1)} | {(len(some), 1, 1, 1)}
    assert {r["doc_id"] for r in contamination.drop_contaminated(docs, bench).collect()} == {more + 1, more + 2}


def quality_counts(t):
    t = t or ""
    w = corpus.words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if corpus.words(line):
            dup += line in seen
            seen.add(line)
    n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def test_quality(spark, docs):
    some = [*corpus.texts(), "line one of this text is here\n" * 3 + "### $$$ a | b\nline one of this text is here"]
    df = corpus.frame(spark, some)
    got = rows(quality.quality_rules(df, quality.PRIOR))
    for i, t in enumerate(some):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == quality_counts(t)
        assert not (r["kept"] and r["base_failed"])
    kept = quality.keep_quality(df, quality.PRIOR)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.quality_rules(corpus.empty(spark), quality.PRIOR).count() == 0


def slow_verdict(t, crf, least=0.5):
    """content share and kept of one text, character by character and with every way through the lines weighed."""
    t = t or ""
    w = corpus.words(t)
    times = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    xs, sizes, seen, at = [], [], set(), 0
    for line in t.split("\n"):
        own = corpus.words(line)
        if not own:
            continue
        raw, k = line.encode(), len(own)
        count = lambda some: sum(c in some for c in raw)  # noqa: E731, B023
        letters = sum(chr(c).isascii() and chr(c).isalpha() or c >= 0xC0 for c in raw)
        xs.append([1, min(10 * count(b"#*$%&|<>") / len(raw), 3), min(10 * count(b"!") / len(raw), 3), 2 * count(bytes(range(65, 91))) / max(letters, 1), math.log1p(k) / 3,
                   own[-1][-1] in ".?;:", line in seen, sum(j in covered for j in range(at, at + k)) / k, min(5 * count(b"0123456789") / len(raw), 3), len(raw) / k / 10])
        sizes.append(k)
        seen.add(line)
        at += k
    best, ways = [0.0, 0.0], [[], []]
    for n, x in enumerate(xs):
        emit = [sum(a * b for a, b in zip(x, crf.emit[:, y])) for y in (0, 1)]
        if n:
            of = [max((1, 0), key=lambda p, y=y: best[p] + crf.move[p, y]) for y in (0, 1)]
            best, ways = [best[of[y]] + crf.move[of[y], y] + emit[y] for y in (0, 1)], [ways[of[y]] + [y] for y in (0, 1)]
        else:
            best, ways = emit, [[0], [1]]
    label = ways[1] if best[1] >= best[0] else ways[0]
    share = sum(k for k, y in zip(sizes, label) if y) / max(sum(sizes), 1)
    return share, not quality_counts(t)[-1] and share >= least


def test_verdicts_of_a_fitted_field(spark):
    """Fitted weights, content shares and verdicts of a hundred texts against the slow way."""
    r = np.random.default_rng(9)
    good, bad = [f"word{i}" for i in range(200)], ["BUY!!", "$$$", "a|b", "###", "99%", "CALL"]
    line = lambda some, n: " ".join(r.choice(some, n)) + "."
    some, y = [], []
    for i in range(100):
        y.append(i % 2)
        some.append("\n".join(line(good if r.random() < (0.85 if i % 2 else 0.25) else bad, r.integers(1, 12)) for _ in range(r.integers(1, 14))))
    docs = corpus.frame(spark, some)
    crf = quality.fit_quality(docs, spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, quality int"))
    got = rows(quality.quality_rules(docs, crf))
    for i, t in enumerate(some):
        share, kept = slow_verdict(t, crf)
        assert got[i]["content_share"] == pytest.approx(share) and got[i]["kept"] == kept
    assert 20 < sum(r["kept"] for r in got.values()) < 80
    assert {r["doc_id"] for r in quality.keep_quality(docs, crf).collect()} == {i for i, r in got.items() if r["kept"]}


def test_viterbi_against_all_sequences():
    r = np.random.default_rng(4)
    crf = quality.Crf(r.normal(size=(quality.FEATURES, 2)), r.normal(size=(2, 2)))
    sizes = [0, 1, 5, 8, 0, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = r.normal(size=(first[-1], quality.FEATURES))
    got = crf.viterbi(x, first)
    for a, b in zip(first, first[1:]):
        s = x[a:b] @ crf.emit
        if b > a:
            value = lambda y: sum(s[i, y[i]] for i in range(len(y))) + sum(crf.move[y[i], y[i + 1]] for i in range(len(y) - 1))
            best = max(itertools.product((0, 1), repeat=b - a), key=value)
            assert value(got[a:b].tolist()) == pytest.approx(value(best))


def test_crf_learns(spark):
    good = ["The quick words of this line are plain.\nAnd so are these of the next one."] * 20
    bad = ["BUY!! NOW!! $$$ CHEAP!!\nplain start | a | b | c |"] * 20
    crf = quality.fit_crf(good + bad, np.array([1] * 20 + [0] * 20))
    got = rows(quality.quality_rules(corpus.frame(spark, [good[0] + " It has enough words to pass.", bad[0] + " CALL!! US!! TODAY!! $$$"]), crf))
    assert got[0]["kept"] and not got[1]["kept"] and not got[1]["base_failed"]
    assert quality.fit_crf([], np.zeros(0)) is quality.PRIOR and quality.fit_crf(good, np.ones(20)) is quality.PRIOR


def test_crf_learns_from_the_ends_of_long_texts(spark):
    plain = "\n".join(f"The quick words of line {i} are plain." for i in range(90))
    texts, y = [plain, plain + "\nBUY!! NOW!! $$$ CHEAP!!" * 40] * 10, np.array([1, 0] * 10)
    all_lines, fewer = quality.fit_crf(texts, y), quality.fit_crf(texts, y, lines=600)
    shout = quality.measure(T.docs_of(pa.array(["BUY!! NOW!! $$$ CHEAP!!"])))[1].features
    for crf in (all_lines, fewer):
        assert (shout @ crf.emit)[0, 0] > (shout @ crf.emit)[0, 1] + 1
    n = np.array([5, 0, 90, 130])
    assert [quality.line_limit(n, most) for most in (1000, 225, 105, 2)] == [130, 130, 50, 1]
    docs = corpus.frame(spark, texts)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    assert np.allclose(quality.fit_quality(docs, labels, lines=600).emit, fewer.emit)
    assert quality.fit_quality(docs, labels, chars=10) is quality.PRIOR


def brute_katz(some, order, least):
    toks = {i: ["<s>"] * (order - 1) + corpus.words(t, True) + [None] for i, t in enumerate(some)}
    count = [collections.Counter() for _ in range(order + 1)]
    history = [collections.Counter() for _ in range(order + 1)]
    for i, w in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for j in range(order - 1, len(w)):
                for m in range(1, order + 1):
                    count[m][tuple(w[j - m + 1 : j + 1])] += 1
                    history[m][tuple(w[j - m + 1 : j])] += 1
    total, types = sum(count[1].values()), len(count[1])
    d = [None] + [katz.good_turing(collections.Counter(count[m].values()), least=least[m - 1]) for m in range(1, order + 1)]
    dis = lambda m, c: c * (d[m][c] if c < len(d[m]) else 1)
    left = 1 - sum(dis(1, c) for c in count[1].values()) / total
    seen = collections.defaultdict(list)
    for m in range(2, order + 1):
        for g, c in count[m].items():
            if c >= least[m - 1]:
                seen[g[:-1]].append((g[-1], c))
    memo = {}

    def p(h, w):
        c = count[len(h) + 1][*h, w]
        if not h:
            return dis(1, c) / total if c else left
        return dis(len(h) + 1, c) / history[len(h) + 1][h] if c >= least[len(h)] else weight(h) * p(h[1:], w)

    def weight(h):
        if h not in memo:
            memo[h] = 1.0
            if h in seen:
                low = 1 - sum(p(h[1:], w) for w, _ in seen[h])
                a = (1 - sum(dis(len(h) + 1, c) for _, c in seen[h]) / history[len(h) + 1][h]) / low if low else math.inf
                memo[h] = a if 0 < a < math.inf else 1e-9
        return memo[h]

    for h in [h for h in seen if len(h) == order - 1][:20]:
        if weight(h) > 1e-8:
            assert sum(p(h, w) for (w,) in count[1]) + p(h, "never seen") == pytest.approx(1, abs=1e-6)
    out = {}
    for i, w in toks.items():
        own = w[order - 1 :]
        out[i] = (sum(math.log10(p(tuple(w[j - order + 1 : j]), w[j])) for j in range(order - 1, len(w))), sum(math.log10((count[1][x,] + 0.5) / (total + 0.5 * (types + 1))) for x in own), total, len(own), sum(count[1][x,] > 0 for x in own))
    return out


@pytest.mark.parametrize("order,least", [(2, (1, 2)), (3, (1, 1, 2))])
def test_katz(docs, order, least):
    some = corpus.texts()
    got, want = rows(katz.katz_scores(docs, order=order, least=least)), brute_katz(some, order, least)
    assert len(got) == len(some)
    for i, (score, base, total, n, known) in want.items():
        r = got[i]
        assert (r["train_tokens"], r["n_tokens"], r["n_known"], r["held_out"]) == (total, n, known, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, rel=1e-6, abs=1e-6)


def test_katz_query_counts_all_trigrams(docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = rows(katz.op3_katz_scores(docs.sparkSession, str(tmp_path))), brute_katz(corpus.texts(), 3, (1, 1, 1))
    assert {i: r["score"] for i, r in got.items()} == {i: pytest.approx(x[0], rel=1e-6, abs=1e-6) for i, x in want.items()}


def test_katz_of_little(spark):
    assert katz.katz_scores(corpus.empty(spark)).count() == 0
    got = katz.katz_scores(spark.createDataFrame([(None, None), (5, "a"), (5, "a")], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(math.isfinite(r["score"]) for r in got)


def test_good_turing():
    d = katz.good_turing({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5})
    assert d[0] == 0 and all(0 < x < 1 for x in d[1:])
    # what the discounts free is what unseen n-grams get by Turing's estimate: the number of single ones
    assert sum((1 - d[r]) * r * n for r, n in {1: 100, 2: 40, 3: 20, 4: 12, 5: 8}.items()) == pytest.approx(100)
    assert all(0 < x < 1 for x in katz.good_turing({3: 1})[1:])


def test_substrings(spark, docs):
    some = corpus.texts()
    seen, want = set(), {}
    for i, t in enumerate(some):
        w, gone = corpus.words(t), set()
        for j in range(len(w) - 19):
            g = tuple(w[j : j + 20])
            gone.update(range(j, j + 20) if g in seen else ())
            seen.add(g)
        want[i] = [x for j, x in enumerate(w) if j not in gone]
    got = rows(substrings.remove_repeats(docs, digest=True))
    for i, kept in want.items():
        n = len(corpus.words(some[i]))
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    assert any(r["n_removed"] for r in got.values())
    cut = substrings.remove_repeats(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert corpus.words(r["text"]) == want[r["doc_id"]]
        assert r["text"] == some[r["doc_id"]] or got[r["doc_id"]]["n_removed"]
    assert substrings.remove_repeats(corpus.empty(spark), digest=True).count() == 0


def test_substrings_of_repeated_ids(spark):
    line = " ".join(f"w{i}" for i in range(25))
    got = substrings.remove_repeats(spark.createDataFrame([(None, line), (1, line), (1, line), (2, line)], "doc_id long, text string"), digest=True).collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 25), (99, 25)]


@pytest.mark.parametrize("chunk_bytes", [1, 300, 1200, 8_000_000])
def test_substrings_by_chunks_of_any_size(spark, monkeypatch, chunk_bytes):
    """Repeated rows, windows that start again within a document, and long copies: the same whatever the chunks are."""
    monkeypatch.setattr(substrings, "SPANS", 2)
    r = np.random.default_rng(1)
    some = [" ".join(f"w{x}" for x in r.integers(0, 500, 80)) for _ in range(6)]
    rows_ = [(1, some[0]), (2, some[1]), (3, some[2] + " " + some[1]), (4, some[3]), (5, some[0]), (5, some[0]), (6, some[4] + " x " + some[4]), (7, some[1] + " " + some[0]), (7, None), (8, "")]
    want = [(i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, w, kept in corpus.without_repeats(rows_)]
    df = spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, substrings.remove_repeats(df, digest=True, chunk_bytes=chunk_bytes).collect())) == sorted(want)


def brute_groups(some, percent):
    sets = [corpus.shingles(t) for t in some]
    parent = list(range(len(some)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(some)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(some))], sets


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, percent):
    groups, sets = brute_groups(corpus.texts(), percent)
    got = rows(neardup.near_duplicates(docs, percent=percent))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), g, g == i) for i, (s, g) in enumerate(zip(sets, groups))}
    assert len(set(groups)) < len(groups)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    base = [f"w{i}" for i in range(80)]
    some = []
    for i in range(60):
        w = list(base)
        for j in range(i % 4):
            w[(7 * i + 23 * j) % 80] = f"x{i}{j}"
        some.append(" ".join(w))
    groups, _ = brute_groups(some, 85)
    got = rows(neardup.near_duplicates(corpus.frame(spark, some), percent=85))
    assert [got[i]["component_id"] for i in range(60)] == groups


def test_near_duplicates_of_little(spark):
    assert neardup.near_duplicates(corpus.empty(spark)).count() == 0
    got = neardup.near_duplicates(spark.createDataFrame([(None, "a b"), (None, None), (3, "A b"), (3, "c")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 99, r["component_id"]or 99, r["n_shingles"]) for r in got) == [(3, 3, 1), (3, 3, 1), (99, 3, 1), (99, 99, 0)]


def test_odd_sketches_estimate():
    r = np.random.default_rng(2)
    k = 120
    for share in (0.0, 0.1, 0.2):
        a = r.integers(0, 2**63, (k, 300), dtype=np.uint64)
        b = np.where(r.random((k, 300)) < share, r.integers(0, 2**63, (k, 300), dtype=np.uint64), a)
        odd = np.bitwise_count(neardup.odd_sketches(a) ^ neardup.odd_sketches(b)).sum(1)
        assert abs(odd.mean() - 512 * (1 - (1 - 2 / 512) ** (2 * k * share)) / 2) < 4
    assert (odd <= neardup.odd_distance(0.8, k)).all()


def test_token_files(spark, docs):
    some, ids = corpus.texts(), library("word_bpe_49k.json")
    for bits in (False, True):
        manifest = idfile.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "ids"), bits=bits, block=256)
        got, at = rows(idfile.read_ids(manifest, with_ids=True)), 0
        for i, t in enumerate(some):
            want = ids(t)
            assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes())) and bytes(got[i]["ids"]) == want.tobytes()
            at += len(want)
    # files that end early, and the running total over a task's parts
    parts = idfile.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "ids"), block=256, file_ids=2000)
    assert parts.count() > parts.select("shard").distinct().count()
    assert rows(idfile.read_ids(parts)) == rows(idfile.read_ids(manifest))
    assert idfile.read_ids(idfile.write_ids(corpus.empty(spark), public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "ids"))).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_tokens_as_the_library_reads_them(spark, name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    some = ["a <|endoftext|> b", "a b", "", "x<|endoftext|>", "<|startoftext|>y. <|endoftext|><|endoftext|>", "<|EndOfText|> a", "<|endoftext", "|> b", "a  \n <|endoftext|>", None, "a < | endoftext |> b"]
    want = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in enumerate(some)}
    docs = corpus.frame(spark, some).coalesce(1)
    files = rows(idfile.read_ids(idfile.write_ids(docs, public_tokenizers.path(name), new_path(spark, "ids")), with_ids=True))
    assert {i: bytes(r["ids"]) for i, r in files.items()} == {i: x.tobytes() for i, x in want.items()}
    for r in packing.pack(docs, public_tokenizers.path(name), with_ids=True).collect():
        assert bytes(r["ids"]) == want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(want[r["doc_id"]])


def test_id_file_ranges(tmp_path):
    r = np.random.default_rng(1)
    parts = [r.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 7, 1000, 3, 0)]
    for bits in (False, True):
        with open(tmp_path / "x", "wb") as f:
            w = idfile.IdWriter(f, bits=bits, block=64)
            for i, p in enumerate(parts):
                w.add(i if i else None, p)
            w.close()
        with open(tmp_path / "x", "rb") as f:
            x = idfile.IdReader(f)
            assert [(k, d.tolist()) for k, d in x.documents()] == [(i if i else None, p.tolist()) for i, p in enumerate(parts)]
            flat = np.concatenate(parts)
            for a, n in ((0, 5), (60, 10), (1000, 11), (5, 0), (0, len(flat))):
                assert x.read(a, n).tolist() == flat[a : a + n].tolist()
    (tmp_path / "x").write_bytes((tmp_path / "x").read_bytes()[:-9])
    with pytest.raises(Exception), open(tmp_path / "x", "rb") as f:
        idfile.IdReader(f)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_beyond_the_cache(monkeypatch, name):
    """A full cache, pieces that go to the library together, and line feeds between them change no ids."""
    from readweave.llm import encode
    from readweave.llm import text as T

    monkeypatch.setattr(encode, "_MOST_PIECES", 20)
    monkeypatch.setattr(encode, "_JOINED", 3)
    enc = encode.Encoder(public_tokenizers.path(name))
    r = np.random.default_rng(3)
    some = ["".join(r.choice(list("abcdeé, .\n'sIT9"), 60)) for _ in range(50)] + ["", "\n", " x", "it's\nI'm", "a\n\nb"]
    for _ in range(2):
        ids, edge = enc.slice(T.docs_of(pa.array(some)))
        for i, t in enumerate(some):
            assert ids[edge[i] : edge[i + 1]].tolist() == enc.library.encode(t, add_special_tokens=False).ids
    assert len(enc.keys) <= 20


def test_packing_by_differencing_needs_fewer_windows(spark, monkeypatch):
    """Documents up to a window stay whole while long ones fill the room, and windows come from the differencing: dealt in
    turn, the same documents need more windows and leave more room."""
    r = np.random.default_rng(3)
    short = [(i, 0, int(n)) for i, n in enumerate(r.integers(20, 1800, 400))]
    long = [(400 + i, 0, 9000) for i in range(60)]

    def packed():
        full, rest, left = packing.fill(short, long, 2048)
        assert all(sum(p[2] for p in w) == 2048 for w in full)
        got = sorted(p for w in [*full, rest, left] for p in w)
        for d, _, n in short + long:
            own = [p for p in got if p[0] == d]
            assert sum(p[2] for p in own) == n and all(a[1] + a[2] == b[1] for a, b in itertools.pairwise(own))
        cut = sum(1 for d, s, n in got if d < 400 and (s or n < short[d][2]))
        return len(packing.partition(short, 2048)), cut, sum(n for d, _, n in got if d >= 400) - sum(n for *_, n in left)

    windows, cut, filler = packed()
    assert cut == 0 and windows <= -(-sum(p[2] for p in short) // 2048) * 1.05
    monkeypatch.setattr(packing, "differencing", lambda sizes, k: [list(range(len(sizes)))[i::k] for i in range(k)])
    naive = packed()
    assert naive[0] > 1.2 * windows and naive[2] > 2 * filler


def test_packing(spark, docs):
    some, ids = corpus.texts(), library("byte_bpe_50k.json")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=64, block_tokens=1500, with_ids=True).collect()
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    for i, t in enumerate(some):
        want, at = ids(t), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            piece = want[at : at + r["length"]].tobytes()
            assert (r["start"], r["doc_tokens"]) == (at, len(want)) and bytes(r["ids"]) == piece and r["ids_crc32"] == zlib.crc32(piece)
            at += r["length"]
        assert at == len(want)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == 64 or at & (at - 1) == 0 and at < 64
    assert packing.pack(corpus.empty(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_differencing():
    assert packing.differencing([], 3) == [[], [], []]
    r = np.random.default_rng(3)
    for n, k in ((4, 2), (40, 7), (200, 16), (3, 5)):
        sizes = r.integers(1, 1000, n).tolist()
        parts = packing.differencing(sizes, k)
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(n))
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= max(sizes)
    # the classic example: differences 8-7, 6-5, then 4 against both
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.differencing([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


def test_fill_leaves_no_room():
    r = np.random.default_rng(5)
    pieces = [(i, 0, int(n)) for i, n in enumerate(r.integers(1, 64, 300))]
    full, rest, _ = packing.fill(pieces, [], 64)
    assert all(sum(p[2] for p in w) == 64 for w in full) and sum(p[2] for p in rest) < 64
    assert sum(p[2] for w in full for p in w) + sum(p[2] for p in rest) == sum(p[2] for p in pieces)
    assert all(sum(p[2] for p in w).bit_count() == 1 for w in packing.powers_of_two(rest))


def test_partition_takes_more_windows_while_one_is_too_full():
    r, counts = np.random.default_rng(6), []
    for sizes in ([6, 6, 6], [64] * 3, [40] * 50, [33, 31] * 20, *r.integers(1, 65, (5, 200)).tolist(), []):
        capacity = 10 if sizes == [6, 6, 6] else 64
        pieces = [(i, 0, n) for i, n in enumerate(sizes)]
        windows = packing.partition(pieces, capacity)
        counts.append(len(windows))
        assert all(sum(p[2] for p in w) <= capacity for w in windows) and sorted(p for w in windows for p in w) == pieces
        # no count from the least one up to it would do
        for fewer in range(-(-sum(sizes) // capacity), len(windows)):
            assert any(sum(sizes[i] for i in p) > capacity for p in packing.differencing(sizes, fewer))
        full, rest, _ = packing.fill(pieces, [], capacity)
        assert all(sum(p[2] for p in w) == capacity for w in full) and sum(p[2] for w in [*full, rest] for p in w) == sum(sizes)
    assert counts[:3] == [3, 3, 50]


def base_places(t):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(corpus.LOW))
    at = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), sorted(i for i, _ in at), ",".join(sorted({label for _, label in at}))


def test_licenses(spark):
    mit = licenses.NOTICES[0][1]
    some = [
        "Released under the MIT License.", "licensed UNDER the Apache License, Version 2.0; and cc by-nc cc-by/nc", None, "", "cc by", mit.replace("free of charge", "free of any charge"), " ".join(mit.split()[:8]),
        "This work is licensed under the GNU General Public License, version 3.", "under thé mit license under the mit license " * 40, "x " * 4000 + "under the\x00mit\nlicense", *corpus.texts()[:10],
    ]
    docs, spans = licenses.license_scan(corpus.frame(spark, some))
    got = rows(docs)
    for i, t in enumerate(some):
        n, places, labels = base_places(t)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), min(places, default=None), max(places, default=None), labels)
        assert set(filter(None, labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[5]["labels"] == "mit" and got[5]["n_base"] == 0 and got[6]["labels"] == "" and "gpl-3" in got[7]["labels"]
    assert any(r["doc_id"] == 5 and r["coverage"] > 0.9 for r in spans.collect())
    assert licenses.license_scan(corpus.empty(spark))[0].count() == 0
    twice = licenses.license_scan(spark.createDataFrame([(None, some[0]), (7, some[0]), (7, "x")], "doc_id long, text string"))[0]
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in twice.collect()) == [(0, 1), (7, 0), (7, 1)]


def test_written_tables_are_cleared(spark, tmp_path):
    import os

    df = stash(spark.range(3).toDF("x"), "some")
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 3 and os.path.exists(folder)
    clear(spark)
    assert not os.path.exists(folder)
