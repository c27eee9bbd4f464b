import zlib

import corpus
import corpus_pipeline
import pytest

from readweave.llm import quality, registry


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    some = corpus.texts(n=80)
    item = " ".join(corpus.words(some[2]))
    docs = corpus.frame(spark, [*some, "leak follows here now " + item], extra=False).selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 11 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_and_run(spark, sf):
    """Each stage against the plain way, on what the stage before kept; then all at once."""
    import public_tokenizers
    from test_documents import library, slow_verdict

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    crf = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    item = corpus.shingles(spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "substring dedup", "decontamination", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name == "packing":
            break
        assert out.columns == columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before)
        if name == "quality rules":
            assert set(after) == {i for i, t in before.items() if slow_verdict(t, crf)[1]}
        if name == "near duplicates":
            sets, group = {i: corpus.shingles(t) for i, t in before.items()}, {i: i for i in before}
            for _ in before:  # the smallest id reachable
                for i in sets:
                    for j in sets:
                        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                            group[i] = min(group[i], group[j])
            assert set(after) == {i for i in before if group[i] == i}
        if name == "substring dedup":
            assert {i: corpus.words(t) for i, t in after.items()} == {i: kept for i, _, kept in corpus.without_repeats(sorted(before.items()))}
        if name == "decontamination":
            assert set(after) == {i for i, t in before.items() if 100 * len(item & corpus.shingles(t)) < 80 * len(item)}
        path = f"{sf}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    ids = library("byte_bpe_50k.json")
    assert public_tokenizers.path("byte_bpe_50k.json")
    for rows in (out, corpus_pipeline.run(spark, sf)):
        pieces, windows = {}, {}
        for r in rows.collect():
            pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
            windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert set(pieces) == set(before)
        for i, some in pieces.items():
            want, at = ids(before[i]), 0
            for start, n, crc, total in sorted(some):
                assert (start, crc, total) == (at, zlib.crc32(want[at : at + n].tobytes()), len(want))
                at += n
            assert at == len(want)
        for some in windows.values():
            at = 0
            for offset, n in sorted(some):
                assert offset == at
                at += n
            assert at <= 2048


def test_stages_of_empty_tables_and_clashing_names(spark, sf, tmp_path):
    """Stages take columns named like their own, and tables without rows."""
    clash = ["chunk", "doc", "start", "size", "component", "node", "block", "share", "bucket", "row", "kept", "_r0", "text_"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(12).selectExpr("*", *[f"doc_id as {c}" for c in clash])
    none = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "packing" or out.columns == docs.columns
        assert out.select("doc_id").count() > 0
        assert stage(spark, docs.limit(0), none).count() == 0
    assert corpus_pipeline.run(spark, none).count() == 0


def test_written_tables_go(spark, sf, tmp_path):
    """The pipeline leaves its last documents alone of what it wrote; other results stay."""
    from readweave.llm import tables

    other = tables.stash(spark.range(3).toDF("i"), "other")
    mark = tables.written()
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert tables.written() - mark == 1 and other.count() == 3
    tables.clear(spark, other, since=mark - 1)
    assert tables.written() == mark and other.count() == 3


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from readweave.llm import tables

    unset = SimpleNamespace(get=lambda key, default=None: default, set=lambda *_: None)
    for master, fine in (("local[4]", True), ("yarn", False), ("local-cluster[2,1,1024]", False), ("spark://x:7077", False)):
        spark = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
        if fine:
            assert tables.shared_dir(spark)
        else:
            with pytest.raises(RuntimeError):
                tables.shared_dir(spark)


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(registry.oracles()) <= set(names)
