import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from readweave.llm import graph, text, toxicity, warc
from readweave.llm.tables import new_path


def test_warc_round_trip(spark):
    r = random.Random(2)
    htmls = ["<p>" + " ".join(r.choice(["a", "b", "éé"]) for _ in range(r.randint(0, 400))) for _ in range(60)]
    pages = [(i, f"http://x/{i}\r\nX-Bad: 1", htmls[i % 40]) for i in range(60)] + [(60, None, None), (61, "u", ""), (62, "u", "x" * 300_000), (None, "u", htmls[0]), (None, "u", "only here")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as row", "'x' as frame")
    for least in (0, 100):
        got = warc.read_warcs(warc.write_warcs(df, new_path(spark, "warc"), least=least), with_payload=True).collect()
        assert len(got) == len(pages)
        first = {}
        for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
            first.setdefault(h or "", i)
        for x in got:
            if x["page_id"] is None:
                assert x["record_type"] == ("response" if x["payload"] == b"only here" or least > x["payload_bytes"] else "revisit")
                continue
            raw = (pages[x["page_id"]][2] or "").encode()
            want = "response" if len(raw) < least or first[pages[x["page_id"]][2] or ""] == x["page_id"] else "revisit"
            assert (x["payload_bytes"], x["payload_digest"], x["record_type"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), want)
            assert x["refers_to"] == (first[pages[x["page_id"]][2] or ""] if want == "revisit" else None)
            assert x["payload"] == (raw if want == "response" else None)
    assert warc.read_warcs(warc.write_warcs(df.limit(0), new_path(spark, "warc"))).count() == 0


def test_warc_files_and_ids_of_repeated_pages(spark):
    """Rows that share a page_id have records of their own; files end at a size; the dictionary is made of whole records."""
    pages = [(1, f"u{i}", "<p>" + "abc " * (50 + i % 3)) for i in range(30)] + [(i, "v", f"<html>{i} " + "words of all pages " * 40) for i in range(2, 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_warcs(df, new_path(spark, "warc"), file_bytes=3000)
    assert manifest.count() > 4
    seen = {}
    for name in [r["file"] for r in manifest.collect()]:
        with warc.open_file(name) as f:
            for headers, _ in warc.frames(f):
                assert headers["WARC-Record-ID"] not in seen
                seen[headers["WARC-Record-ID"]] = headers
    again = [h for h in seen.values() if h["WARC-Type"] == "revisit"]
    assert len(seen) == len(pages) and len(again) == 27
    for h in again:
        assert seen[h["WARC-Refers-To"]]["WARC-Type"] == "response" and seen[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    some = warc.sample_records(df, "page_id", "url", "html", records=50, chars=20_000)
    assert some and all(warc.parse(x)[0]["WARC-Type"] == "response" for x in some) and sum(map(len, some)) < 40_000


def test_warc_dictionary_frame(tmp_path):
    import io

    import zstandard

    d = warc.build_dictionary([f"<html><body>{i} shared words of all pages {i * 7}</body></html>".encode() * 3 for i in range(400)], 2000)
    assert d
    raw = warc.record("response", 1, "u", b"body", warc.digest(b"body"))
    data = warc.dictionary_frame(d) + b"".join(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(x) for x in (raw, raw))
    assert [h["WARC-Type"] for h, _ in warc.frames(io.BytesIO(data))] == ["response"] * 2
    with pytest.raises(Exception):
        list(warc.frames(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"x" * 20)))
    assert warc.build_dictionary([]) == b""


def sample(n, seed):
    r = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "nasty", "odious"]
    texts, y = [], []
    for _ in range(n):
        w = [r.choice(plain) for _ in range(r.randint(20, 80))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(r.randint(1, 6)):
                w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", ",", "."]))
        texts.append(" ".join(w).capitalize())
        y.append(int(toxic))
    return texts, np.array(y)


def test_ordinal_regression_on_held_out_texts(spark):
    texts, y = sample(600, 1)
    model = toxicity.fit_ordinal(texts, y, np.ones(600))
    assert (np.diff(model.thresholds) > 0).all()
    new, truth = sample(300, 2)
    severity, p = model.predict(text.docs_of(pa.array(new)))
    assert ((p >= 0.5) == truth).mean() > 0.97
    n = np.array([sum(t.lower().count(b) for b in ("vile", "nasty", "odious")) for t in new])
    assert severity[n >= 5].mean() > severity[n == 1].mean() > severity[n == 0].mean()
    df = spark.createDataFrame([(0, "vile nasty odious vile"), (1, None), (2, ""), (None, "word1"), (0, "word2")], "doc_id long, text string").selectExpr("*", "1 as severity")
    got = toxicity.toxicity(df, model).collect()
    assert sorted((r["doc_id"] or 0, r["toxic"]) for r in got) == [(0, False), (0, False), (0, True), (1, False), (2, False)]
    assert all(0 <= r["severity"] <= 3 for r in got)


def test_ordinal_fit_against_slow_ascent():
    """The fit's likelihood is that of a plain ascent by numeric slopes, and so are the probabilities."""
    r = np.random.default_rng(4)
    x = (r.random((80, 3)) < 0.4) * r.random((80, 3)) * 2
    grade = np.clip((x @ [2.0, 1.0, -0.5] + r.normal(0, 0.7, 80)).round(), 0, 3).astype(int)
    w = r.random(80)
    w /= w.sum()
    doc, col = np.nonzero(x)
    beta, cuts = toxicity.fit_links(doc, col, x[doc, col], grade, w, 3, rounds=2000, penalty=1e-3)

    def above(beta, cuts):
        return 1 / (1 + np.exp(cuts[None] - (x @ beta)[:, None]))

    def value(v):
        up = np.concatenate([np.ones((80, 1)), above(v[:3], v[3] + np.concatenate([[0], np.cumsum(np.exp(v[4:]))])), np.zeros((80, 1))], axis=1)
        p = up[np.arange(80), grade] - up[np.arange(80), grade + 1]
        return (w * np.log(p)).sum() - 1e-3 / 2 * (v[:3] ** 2).sum()

    v = np.array([0.0, 0.0, 0.0, 1.0, 0.0, 0.0])
    for _ in range(4000):
        v = v + 0.5 * np.array([(value(v + e) - value(v - e)) / 2e-5 for e in np.eye(6) * 1e-5])
    found = np.concatenate([beta, cuts[:1], np.log(np.diff(cuts))])
    assert value(found) == pytest.approx(value(v), abs=1e-4)
    assert np.allclose(above(beta, cuts), above(v[:3], v[3] + np.concatenate([[0], np.cumsum(np.exp(v[4:]))])), atol=0.02)


def test_fit_without_both_labels(spark):
    assert toxicity.fit_ordinal([], np.zeros(0, int), np.zeros(0)) is toxicity.NEVER
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert not any(r["toxic"] for r in toxicity.toxicity(docs, model).collect())


def test_components_against_union(spark):
    r = random.Random(6)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (1, 2), (1, 2)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
