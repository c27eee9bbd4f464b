import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readweave.functions import kernels as K
from readweave.functions import paths as P
from readweave.functions import sql
from readweave.functions import text as X
from readweave.operators.extract import extract, extract_one
from readweave.operators.matrix import cdist, within_join
from readweave.operators.partial import partial_alignment, partial_distance, partial_ratio


def brute(a, b, swap=True):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if swap and i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def some_words(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice("abcあ😀") for _ in range(r.randint(0, 8))) for _ in range(n)]


def value(spark, left, right, column):
    return spark.createDataFrame([(left, right)], "l string, r string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("left,right,lev,osa", [("kitten", "sitting", 3, 3), ("いんさt", "印刷", 4, 4), ("マトリッツォ", "マリトッツォ", 2, 1), ("ca", "ac", 2, 1), ("ca", "abc", 3, 3), ("", "ab", 2, 2), ("", "", 0, 0)])
def test_known_distances(spark, left, right, lev, osa):
    row = spark.createDataFrame([(left, right)], "l string, r string").select(X.levenshtein("l", "r"), X.osa("l", "r"), X.combined_distance("l", "r")).first()
    assert tuple(row) == (lev, osa, osa)


def test_kernel_against_brute_force():
    a, b = some_words(1500), some_words(1500, 6)
    assert K.edit_batch(a, b).tolist() == [brute(x, y) for x, y in zip(a, b)]
    assert K.edit_batch(a, b, False).tolist() == [brute(x, y, False) for x, y in zip(a, b)]


def test_osa_column_agrees_with_kernel(spark):
    rows = [*zip(some_words(400), some_words(400, 7)), (None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "l string, r string").select("l", "r", X.osa("l", "r").alias("d"), X.damerau_distance("l", "r", 2).alias("c")).collect()
    for r in got:
        want = None if r["l"] is None or r["r"] is None else brute(r["l"], r["r"])
        assert r["d"] == want and r["c"] == (None if want is None else min(want, 3))


def test_cutoffs(spark):
    assert value(spark, "abc", "adc", X.distance("l", "r", 0)) == 1
    assert value(spark, "a" * 4000, "b" * 4000, X.distance("l", "r", 10)) == 11
    assert value(spark, "abc", "adc", X.normalized_similarity("l", "r")) == pytest.approx(2 / 3)
    assert value(spark, "abc", "adc", X.ratio("l", "r", 0.8)) == 0.0
    assert value(spark, "abc", "adc", X.normalized_distance("l", "r")) == pytest.approx(1 / 3)
    assert value(spark, "abc", "adc", X.normalized_distance("l", "r", 0.2)) == 1.0
    assert value(spark, "", "", X.ratio("l", "r")) == 1.0
    assert value(spark, None, "a", X.distance("l", "r", 1)) is None
    assert value(spark, "abc", "acb", X.within_damerau_distance("l", "r", 1)) is True
    assert value(spark, "abc", "acb", X.within_distance("l", "r", 1)) is False


@pytest.mark.parametrize("metric,cutoff,error", [("distance", True, TypeError), ("distance", 1.0, TypeError), ("distance", -1, ValueError), ("ratio", True, TypeError), ("ratio", 1.5, ValueError)])
def test_bad_cutoffs(metric, cutoff, error):
    with pytest.raises(error):
        X.check_cutoff(cutoff, metric)


def sets(spark, left, right, column):
    return spark.createDataFrame([(left, right)], "l array<string>, r array<string>").select(column.alias("x")).first()["x"]


def test_path_sets(spark):
    assert sets(spark, ["insatu", "innsatu"], ["insat"], P.distance_paths("l", "r")) == 1
    assert sets(spark, ["abc", "axc"], ["acb"], P.damerau_distance_paths("l", "r")) == 1
    assert sets(spark, ["abc", "abcd"], ["abxd"], P.normalized_similarity_paths("l", "r")) == 0.75
    assert sets(spark, ["abc", "abcd"], ["abxd"], P.normalized_distance_paths("l", "r")) == 0.25
    assert sets(spark, ["insatu"], ["insat"], P.within_distance_paths("l", "r", 1)) is True
    assert sets(spark, ["insatu"], ["insat"], P.within_distance_paths("l", "r", 0)) is False
    assert sets(spark, ["", ""], [""], P.distance_paths("l", "r")) == 0
    for bad in ([], ["", "a"]):
        with pytest.raises(Exception, match="path set"):
            sets(spark, bad, ["a"], P.distance_paths("l", "r"))


def test_lattices_against_path_pairs():
    r = random.Random(3)
    words = [w for w in some_words(400) if w]
    for _ in range(150):
        a, b = ({r.choice(words) for _ in range(4)} for _ in range(2))
        x, y = K.Lattice.of_paths(a), K.Lattice.of_paths(b)
        assert x.paths(100) == sorted(a) and K.Lattice.parallel(sorted(a)).paths(100) == sorted(a)
        assert K.lattice_distance(x, y) == min(brute(p, q, False) for p in a for q in b)
        assert K.lattice_distance(x, y, True) == min(brute(p, q) for p in a for q in b)
        d, steps = K.lattice_trace(x, y)
        assert d == K.lattice_distance(x, y) == sum(op != "match" for op, *_ in steps)
        assert "".join(s or "" for _, s, _ in steps) in a and "".join(s or "" for *_, s in steps) in b
        assert K.Lattice.unpack(x.pack()) == x


def test_lattice_errors():
    for bad in (lambda: K.Lattice(0, 0, 0, []), lambda: K.Lattice(2, 0, 5, []), lambda: K.Lattice(2, 0, 1, [(1, 0, "a")]), lambda: K.Lattice.of_paths([]), lambda: K.Lattice.of_paths(["", "a"])):
        with pytest.raises(K.LatticeError):
            bad()
    big = K.Lattice.parallel(["a" * 5000])
    with pytest.raises(K.TooLarge):
        K.lattice_distance(big, big)


def test_dot_marks_the_best_path():
    text = K.dot([("left", K.Lattice.of_paths(["abc", "axc"]), "axc")])
    assert text.startswith("digraph") and text.count("color=red") == 3


def frame(spark, words, name):
    return spark.createDataFrame(list(enumerate(words)), f"{name}_id long, {name} string")


def test_matrix(spark):
    q, c = frame(spark, ["abc", "axc"], "query"), frame(spark, ["abc", "acb"], "choice")
    cells = lambda m, **k: {(r["query_id"], r["choice_id"]): r["score"] for r in cdist(q, c, metric=m, **k).collect()}
    assert cells("distance") == {(0, 0): 0, (0, 1): 2, (1, 0): 1, (1, 1): 2}
    assert cells("combined_distance")[0, 1] == 1
    assert cells("normalized_distance", score_cutoff=0.2)[0, 1] == 1.0
    assert cdist(q.limit(0), c).count() == 0 and cdist(q, c.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cdist(q, c, metric="cosine")


def test_matrix_equals_scalar(spark):
    q, c = frame(spark, some_words(12), "query"), frame(spark, some_words(12, 9), "choice")
    for m in X.METRICS:
        rows = cdist(q, c, metric=m).withColumn("again", X.plain(m)("query", "choice")).collect()
        assert len(rows) == 144 and all(r["score"] == r["again"] for r in rows)


def test_extract(spark):
    q, c = frame(spark, ["abc"], "query"), frame(spark, ["axc", "abc", "ayc"], "choice")
    assert [(r["choice"], r["score"], r["choice_id"]) for r in extract(q, c, limit=None).orderBy("rank").collect()] == [("abc", 0, 1), ("axc", 1, 0), ("ayc", 1, 2)]
    assert [r["choice"] for r in extract(q, c, scorer="ratio", limit=2).orderBy("rank").collect()] == ["abc", "axc"]
    assert extract(q, c, limit=-3).count() == 0 and extract(q, c, score_cutoff=0).count() == 1
    assert extract_one(q, c).first()["choice"] == "abc"
    assert extract(q, frame(spark, ["zzz"], "choice"), scorer="ratio", score_cutoff=0.0).count() == 1
    with pytest.raises(TypeError):
        extract(q, c, limit=True)


def align(spark, query, text, *args, **kw):
    a = partial_alignment(spark.createDataFrame([(query, text)], "q string, t string"), "q", "t", *args, **kw).first()["alignment"]
    return None if a is None else tuple(a)


def test_partial(spark):
    assert align(spark, "abc", "xxabczz") == (1.0, 0, 3, 2, 5)
    assert align(spark, "abc", "xxabczz", "distance") == (0, 0, 3, 2, 5)
    assert align(spark, "abc", "xxxx") is None
    assert align(spark, "", "abc") == (1.0, 0, 0, 0, 0)
    assert align(spark, "abc", "", "distance") == (3, 0, 3, 0, 0) and align(spark, "abc", "") is None
    df = spark.createDataFrame([("abc", "xxxx")], "q string, t string")
    assert partial_ratio(df, "q", "t").first()["score"] == 0.0
    assert partial_distance(df, "q", "t", score_cutoff=1).first()["score"] == 2


def test_within_join_against_product(spark):
    a, b = frame(spark, some_words(60), "query"), frame(spark, some_words(60, 9), "choice")
    for most in (0, 1, 2, 3):
        got = {(r["query_id"], r["choice_id"], r["distance"]) for r in within_join(a, b, "query", "choice", most).collect()}
        want = {(r["query_id"], r["choice_id"], r["score"]) for r in cdist(a, b).where(F.col("score") <= most).collect()}
        assert got == want


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("select rw_distance('abc','acb') a, rw_osa('abc','acb') b, rw_similarity('abc','adc') c, rw_distance_paths(array('ab'), array('abc','x')) d, rw_romaji_paths('キー') e, rw_within('a','b',1) f").first()
    assert (row["a"], row["b"], row["d"], row["e"], row["f"]) == (2, 1, 1, ["kii", "ki-"], True) and row["c"] == pytest.approx(2 / 3)


def test_scores_in_a_stream(spark, tmp_path):
    spark.createDataFrame([("abc", "acb")], "l string, r string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("l string, r string").parquet(str(tmp_path / "in")).withColumn("d", X.damerau_distance("l", "r"))
    q = stream.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").first()["d"] == 1


def test_lattice_search_with_cutoffs():
    """The search ends beyond the cutoff, and sees fewer node pairs than the whole table has."""
    r = np.random.default_rng(8)
    for _ in range(60):
        a, b = ([("".join(r.choice(list("abc"), r.integers(1, 6)))) for _ in range(3)] for _ in range(2))
        x, y = K.Lattice.of_paths(a), K.Lattice.of_paths(b)
        for transpose in (False, True):
            d = min(brute(p, q, transpose) for p in a for q in b)
            assert K.lattice_distance(x, y, transpose) == d
            for most in range(6):
                assert K.lattice_distance(x, y, transpose, most) == (d if d <= most else None)


def test_minimal_lattices_where_a_path_begins_another():
    x = K.Lattice.of_paths(["ab", "abc", "abcd", "xbcd"])
    assert x.paths(10) == ["ab", "abc", "abcd", "xbcd"]
    assert len(x.arcs) < len(K.Lattice.parallel(["ab", "abc", "abcd", "xbcd"]).arcs)
    r = np.random.default_rng(2)
    for _ in range(50):
        some = sorted({"".join(r.choice(list("ab"), r.integers(1, 5))) for _ in range(6)})
        assert K.Lattice.of_paths(some).paths(100) == some


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_within_join_of_alike_and_long_strings(spark, most):
    """Strings that share most of themselves, and strings over the length that deletions are written out for."""
    r = np.random.default_rng(5)
    some = ["Supplier#" + f"{i:04d}" for i in range(60)] + ["", "a", "b", "ab"]
    some += ["x" * 63 + "".join(r.choice(list("xy"), 4)) for _ in range(15)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)] + [(None, None)], "i long, t string")
    got = within_join(df.toDF("a", "l"), df.toDF("b", "r"), "l", "r", most).select("a", "b", "distance").collect()
    want = {(i, j, d) for i, x in enumerate(some) for j, y in enumerate(some) if (d := brute(x, y, False)) <= most}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_names_that_clash(spark):
    a = spark.createDataFrame([(1, "ab", "p")], "id long, query string, choice string")
    b = spark.createDataFrame([(2, "abc", "q")], "id long, choice string, query string")
    r = cdist(a, b).first()
    assert (r["id"], r["id_choice"], r["query"], r["choice"], r["choice_query"], r["query_choice"], r["score"]) == (1, 2, "ab", "abc", "p", "q", 1)
    with pytest.raises(ValueError):
        cdist(a, b.withColumnRenamed("id", "score"))


def test_spans_have_a_character(spark):
    df = spark.createDataFrame([("a", "b")], "q string, t string")
    for bad in ({"max_span_chars": 0}, {"metric": "osa"}):
        with pytest.raises(ValueError):
            partial_alignment(df, "q", "t", **bad)
    for bad in ({"max_span_chars": True}, {"metric": 1}):
        with pytest.raises(TypeError):
            partial_alignment(df, "q", "t", **bad)
