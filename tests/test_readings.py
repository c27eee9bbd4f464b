import random

import pytest
from pyspark.sql import functions as F

from readweave.functions import readings as R
from readweave.functions import kernels, romaji, scripts
from readweave.functions import paths as P
from readweave.functions.readings import Options
from readweave.operators import matrix
from readweave.operators.expand import reading_paths, with_overrides
from readweave.operators.extract import extract
from readweave.operators.matrix import cdist
from readweave.operators.partial import partial_alignment, partial_distance
from readweave.operators.scoring import compare, score, within, zero_distance_join
from readweave.sources import lexicon as L

JA = {"WHISKY": ["ウイスキー"], "印刷": ["インサツ"], "モイニャ": ["モイニャ"], "ブナハーブン": ["ブナハーブン"]}
JA_OPTIONS = Options(max_span_chars=8, max_paths=128, longest_match_only=True, max_readings_per_segment=16)
ZH = {"威士忌": ["weishiji"], "布納哈本": ["bunahaben"], "布那哈本": ["bunahaben"], "布呐哈本": ["bunahaben"], "布納哈奔": ["bunahaben"]}
ZH_OPTIONS = Options(max_span_chars=8, max_paths=128, longest_match_only=True)


def find_in(entries):
    def find(s):
        return entries.get(s) or entries.get(romaji.fold_width(s))

    return find


def language(text):
    return set(romaji.romaji_lattice(text).paths(10**6))


@pytest.mark.parametrize("text,some", [("し", {"si", "shi", "ci"}), ("ちゃ", {"cha", "tya", "cya"}), ("チャ", {"cha", "tya", "cya"}), ("いんさt", {"insat"}), ("kょう", {"kyou", "kxyou"}), ("まっちゃ", {"maccha", "mattya", "maxtucha"}), ("チャドーグ", {"chadougu", "chadoogu", "chado-gu"}), ("はい，「です」。", {"hai，「desu」。"})])
def test_spellings(text, some):
    assert some <= language(text)
    assert sorted(set(romaji.romaji_paths(text))) == sorted(language(text))


def test_spelling_limits():
    assert romaji.romaji_paths("キー") == ["kii", "ki-"]
    x = romaji.romaji_lattice("キー" * 32)
    assert x.n < 512 and len(x.arcs) < 1024
    with pytest.raises(romaji.OverLimit):
        romaji.romaji_paths("キー" * 32)
    assert romaji.can_spell("ジョニー・ウォーカー") and not romaji.can_spell("ジョニー・ウォーカー", surface=False)
    with pytest.raises(romaji.NoVariant):
        romaji.romaji_paths("ゎ")
    with pytest.raises(romaji.Unsupported):
        romaji.romaji_paths("ヷ")


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column.alias("x")).first()["x"]


def test_script_columns(spark):
    assert one(spark, "カタカナー", scripts.normalize_kana("s")) == "かたかなー"
    assert one(spark, "ＷＨＩＳＫＹ　１", scripts.fold_width("s")) == "WHISKY 1"
    for raw, plain, tones in (("Wei1 shi4 ji4", "weishiji", "wei1shi4ji4"), ("nu:3 er2", "nver", "nv3er2"), ("11 Qu1", "11qu", "11qu1"), ("Shuang1 11", "shuang", "shuang111")):
        assert one(spark, raw, scripts.normalize_pinyin("s")) == plain
        assert one(spark, raw, scripts.normalize_pinyin("s", "tone3")) == tones
    assert one(spark, "Nu: Er", scripts.normalize_direct_pinyin("s")) == "nver"
    for text in ("abc 1", "", "，a", "印a", " "):
        assert one(spark, text, scripts.is_direct_pinyin("s")) == R.is_direct(text)


def test_segmentations():
    paths, _ = R.segmentations("鬼滅の刃", find_in({"鬼滅": ["キメツ"], "の": ["ノ"], "刃": ["ハ", "ヤイバ"]}), Options(), "ja", False)
    assert [p.reading for p in paths] == ["キメツノハ", "キメツノヤイバ"]
    tea = {"茶": ["チャ"], "道": ["ミチ"], "道具": ["ドーグ"], "具": ["グ"]}
    assert [p.reading for p in R.segmentations("茶道具", find_in(tea), Options(longest_match_only=True), "ja", False)[0]] == ["チャドーグ"]
    _, stats = R.segmentations("刃", find_in({"刃": ["ハ", "ジン", "ヤイバ"]}), Options(max_readings_per_segment=2), "ja", False)
    assert [stats[k] for k in R.STATS] == [1, 0, 0, 3, 2, 1, 2, 2, 0, 0]
    paths, stats = R.segmentations("印さt", find_in({"印": ["イン"]}), Options(), "ja", True)
    assert [(p.reading, [s[2] for s in p.segments]) for p in paths] == [("インさt", ["Dictionary", "Direct"])] and stats["direct_fallback_spans"] == 2
    paths, stats = R.segmentations("威士忌", find_in({"威": ["wei"], "士忌": ["shiji"], "威士忌": ["weishiji"]}), Options(longest_match_only=True), "zh", False)
    assert [p.reading for p in paths] == ["weishiji"] and stats["longest_match_pruned_spans"] == 1
    assert [p.reading for p in R.segmentations("weishi忌", find_in({"忌": ["ji"]}), Options(), "zh", True)[0]] == ["weishiji"]
    assert R.segmentations("", find_in({}), Options(), "ja", False)[0] == []
    many, stats = R.segmentations("刃", find_in({"刃": ["ハ", "ジン", "ヤイバ"]}), Options(max_paths=2), "ja", False)
    assert len(many) == 2 and stats["max_paths_hit_count"] == 1
    for bad in ({"max_span_chars": 257}, {"max_paths": -1}, {"max_readings_per_segment": True}):
        with pytest.raises((ValueError, TypeError)):
            Options(**bad)


@pytest.fixture(scope="module")
def ja(spark):
    return L.from_entries(spark, JA)


@pytest.fixture(scope="module")
def zh(spark):
    return L.from_entries(spark, ZH)


def scored(spark, pairs, metric, lang, lex, options, **kw):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, l string, r string")
    return [r["score"] for r in score(df, "l", "r", metric, lang=lang, lexicon=lex, options=options, **kw).orderBy("i").collect()]


def test_japanese_scores(spark, ja):
    assert scored(spark, [("いんさt", "印刷"), ("WHISKY", "ウイスキー"), ("モイネ", "モニエ"), ("", ""), (None, "a")], "distance", "ja", ja, JA_OPTIONS) == [1, 0, 2, 0, None]
    assert scored(spark, [("モイネ", "モニエ")], "damerau_distance", "ja", ja, JA_OPTIONS) == [1]
    assert scored(spark, [("マトリッツォ", "マリトッツォ")], "combined_distance", "ja", ja, JA_OPTIONS) == [1]
    assert scored(spark, [("いんさt", "印刷")], "ratio", "ja", ja, JA_OPTIONS) == [pytest.approx(6 / 7)]
    assert scored(spark, [("いんさt", "印刷")], "ratio", "ja", ja, JA_OPTIONS, score_cutoff=0.9) == [0.0]
    assert scored(spark, [("いんさt", "印刷")], "distance", "ja", ja, JA_OPTIONS, score_cutoff=0) == [1]


@pytest.mark.parametrize("entries,left,right,longest", [
    ({"茶": ["チャ"], "道具": ["ドーグ"]}, "chadougu", "茶道具", True), ({"M": ["モー"]}, "Mイン", "モーイン", False),
    ({"PX": ["ピーエックス"]}, "PXシェリー", "ピーエックスシェリー", False), ({"WHISKY": ["ウイスキー"]}, "WHISKYバー", "ウイスキーバー", False), ({"印": ["イン"]}, "印さt", "insat", False),
    ({"具": ["グ"]}, "chadou具", "chadougu", False), ({"東": ["トー"]}, "東kょう", "toukyou", False), ({"鬼滅": ["キメツ"], "の": ["ノ"], "刃": ["ヤイバ"]}, "鬼滅のyaiba", "鬼滅の刃", True), ({"抹": ["マッ"], "茶": ["チャ"]}, "抹茶", "mattya", False),
])
def test_readings_meet(spark, entries, left, right, longest):
    lex = L.from_entries(spark, entries)
    assert scored(spark, [(left, right)], "distance", "ja", lex, Options(longest_match_only=longest)) == [0]


def test_errors(spark):
    lex = L.from_entries(spark, {})
    df = spark.createDataFrame([("未知z", "a")], "l string, r string")
    row = score(df, "l", "r", lang="ja", lexicon=lex).first()
    assert row["score"] is None and "未" in row["error"]
    with pytest.raises(Exception, match="unsupported"):
        score(df, "l", "r", lang="ja", lexicon=lex, on_error="raise").collect()
    assert score(spark.createDataFrame([("印", "a")], "l string, r string"), "l", "r", lang="zh", lexicon=lex).first()["error"]
    with pytest.raises(LookupError):
        score(df, "l", "r", lang="ja")
    with pytest.raises(ValueError):
        score(df, "l", "r", options=Options())


def test_large_lattices_go_to_the_kernel(spark, ja):
    long = "キー" * 20
    assert scored(spark, [(long, "ki-" * 20), (long, "ki-" * 19 + "kx")], "distance", "ja", ja, JA_OPTIONS) == [0, 2]
    assert scored(spark, [(long, "ki-" * 20)], "damerau_distance", "ja", ja, JA_OPTIONS) == [0]


def test_chinese_scores(spark, zh):
    pairs = [("bunahabe", "布納哈本"), ("布納哈奔", "布納哈本"), ("weishiji", "wieshiji"), ("weishiji，威士忌。", "威士忌，weishiji。")]
    assert scored(spark, pairs, "distance", "zh", zh, ZH_OPTIONS) == [1, 0, 2, 0]
    assert scored(spark, pairs[2:3], "damerau_distance", "zh", zh, ZH_OPTIONS) == [1]
    assert scored(spark, pairs[2:3], "combined_distance", "zh", zh, ZH_OPTIONS) == [1]
    df = spark.createDataFrame(pairs[1:2], "l string, r string")
    assert within(df, "l", "r", 0, lang="zh", lexicon=zh).first()["within"] is True


def test_comparison_record(spark, ja):
    row = compare(spark.createDataFrame([("いんさt", "印刷")], "l string, r string"), "l", "r", lang="ja", lexicon=ja, options=JA_OPTIONS).first()["comparison"]
    assert tuple(row) == (4, 4, 1, 1, 1)


def test_partial_readings(spark, ja, zh):
    def align(q, t, metric="ratio", lang="ja", lex=ja, o=JA_OPTIONS):
        a = partial_alignment(spark.createDataFrame([(q, t)], "q string, t string"), "q", "t", metric, lang=lang, lexicon=lex, options=o).first()["alignment"]
        return None if a is None else tuple(a)

    assert align("ウイスキー", "ういすきーをのんでいます") == (1.0, 0, 5, 0, 5)
    assert align("ウイスキー", "未知ういすきー。") == (1.0, 0, 5, 2, 7)
    assert align("ウイスキー", "未知。") is None
    df = spark.createDataFrame([("ウイスキー", "未知。")], "q string, t string")
    assert partial_distance(df, "q", "t", lang="ja", lexicon=ja, options=JA_OPTIONS).first()["score"] == 5
    assert align("ブナハーブン", "xxbunahaabunzz") == (1.0, 0, 6, 2, 12)
    assert align("威士忌", "xxweishijizz", lang="zh", lex=zh, o=ZH_OPTIONS) == (1.0, 0, 3, 2, 10)


def test_extract_and_matrix_readings(spark, ja, zh):
    q = spark.createDataFrame([(0, "いんさt")], "query_id long, query string")
    c = spark.createDataFrame([(0, "abc"), (1, "印刷")], "choice_id long, choice string")
    how = {"lang": "ja", "lexicon": ja, "options": JA_OPTIONS}
    assert [(r["choice"], r["score"], r["choice_id"]) for r in extract(q, c, score_cutoff=1, **how).collect()] == [("印刷", 1, 1)]
    cells = cdist(q, c, metric="ratio", **how).collect()
    again = {r["r"]: r["score"] for r in score(spark.createDataFrame([("いんさt", "abc"), ("いんさt", "印刷")], "l string, r string"), "l", "r", "ratio", **how).collect()}
    assert len(cells) == 2 and all(r["score"] == again[r["choice"]] for r in cells)
    q = spark.createDataFrame([(0, "bunahaben")], "query_id long, query string")
    c = spark.createDataFrame(list(enumerate(["布納哈本", "布那哈本", "abc"])), "choice_id long, choice string")
    got = extract(q, c, score_cutoff=0, lang="zh", lexicon=zh, options=ZH_OPTIONS).orderBy("rank").collect()
    assert [r["choice"] for r in got] == ["布納哈本", "布那哈本"]


def test_zero_distance_join(spark, zh):
    a = spark.createDataFrame([(0, "威士忌"), (1, "abc")], "i long, a string")
    b = spark.createDataFrame([(0, "weishiji"), (1, "x")], "j long, b string")
    assert [(r["i"], r["j"]) for r in zero_distance_join(a, b, "a", "b", lang="zh", lexicon=zh).collect()] == [(0, 0)]


def test_zero_distance_join_over_the_limit(spark):
    texts = ["し" * 20, "シ" * 20, "shi" * 20, "si" * 20, "si" * 19 + "x", "し" * 21, "し", "si", "漢", None, ""]
    a = spark.createDataFrame(list(enumerate(texts)), "i long, a string")
    b = spark.createDataFrame(list(enumerate(texts)), "j long, b string")
    got = sorted((r["i"], r["j"]) for r in zero_distance_join(a, b, "a", "b", lang="ja", lexicon=L.from_entries(spark, JA)).collect())
    spelled = {i: romaji.romaji_lattice(t) for i, t in enumerate(texts) if t is not None and t != "漢"}
    assert got == sorted((i, j) for i, x in spelled.items() for j, y in spelled.items() if kernels.lattice_distance(x, y, False) == 0)
    assert {(0, 0), (0, 1), (0, 2), (3, 1), (5, 5), (6, 7)} <= set(got) and (0, 4) not in got


def test_reading_paths_frame(spark):
    lex = L.from_entries(spark, {"鬼滅": ["キメツ"], "の": ["ノ"], "刃": ["ハ", "ヤイバ"]})
    row = reading_paths(spark.createDataFrame([("鬼滅の刃",), ("x",), (None,)], "text string"), lex, "ja").where("text = '鬼滅の刃'").first()
    assert [p["joined_reading"] for p in row["paths"]] == ["キメツノハ", "キメツノヤイバ"] and row["stats"]["unique_paths"] == 6


def test_sources(spark, tmp_path):
    uni = tmp_path / "lex.csv"
    uni.write_text("茶,1,2,3,名詞,普通名詞,一般,*,*,*,チャ,茶,茶,チャ,茶,チャ,和\n道具,1,2,3,名詞,普通名詞,一般,*,*,*,ドウグ,道具,道具,ドーグ,道具,ドーグ,漢\nＷＨＩＳＫＹ,1,2,3,名詞,a,b,*,*,*,ウイスキー,c,d,ウイスキー,e,f,g\nabc,1,2,3,名詞,a,b,*,*,*,エー,c,d,エー,e,f,g\n！,1,2,3,補助記号,a,b,*,*,*,エー,c,d,エー,e,f,g\n", encoding="utf-8")
    rows = {r["surface"]: r["readings"] for r in L.read_unidic(spark, str(uni)).collect()}
    assert rows == {"茶": ["チャ"], "道具": ["ドーグ"], "ＷＨＩＳＫＹ": ["ウイスキー"], "WHISKY": ["ウイスキー"]}
    assert {r["surface"]: r["readings"] for r in L.read_unidic(spark, str(uni), field="lform").collect()}["道具"] == ["ドウグ"]
    short = tmp_path / "short.csv"
    short.write_text("茶,1\n", encoding="utf-8")
    with pytest.raises(Exception, match="column"):
        L.read_unidic(spark, str(short)).collect()
    sud = tmp_path / "sud.csv"
    sud.write_text("蒸留所,1,2,3,蒸溜所,名詞,a,b,c,d,e,ジョウリュウジョ,f\n・,1,2,3,・,補助記号,a,b,c,d,e,キゴウ,f\n謎,1,2,3,謎,名詞,a,b,c,d,e,？？,f\n", encoding="utf-8")
    rows = {r["surface"]: r["readings"] for r in L.read_sudachi(spark, str(sud), exclude_unsupported=True).collect()}
    assert rows == {"蒸留所": ["ジョウリュウジョ"], "蒸溜所": ["ジョウリュウジョ"]}
    ced = tmp_path / "cedict.txt"
    ced.write_text("# CC-CEDICT\n\n威士忌 威士忌 [Wei1 shi4 ji4] /whisky/\n女兒 女儿 [nu:3 er2] /daughter/\n樂 乐 [Le4] /a/\n樂 乐 [Yue4] /b/\n布 布 [[bu4]] /c/\n", encoding="utf-8")
    rows = {r["surface"]: r["readings"] for r in L.read_cedict(spark, str(ced)).collect()}
    assert rows == {"威士忌": ["weishiji"], "女兒": ["nver"], "女儿": ["nver"], "樂": ["le", "yue"], "乐": ["le", "yue"], "布": ["bu"]}
    assert {r["surface"]: r["readings"] for r in L.read_cedict(spark, str(ced), view="tone3").collect()}["樂"] == ["le4", "yue4"]
    ced.write_text("威士忌 威士忌 Wei1 /whisky/\n", encoding="utf-8")
    with pytest.raises(Exception, match="CC-CEDICT"):
        L.read_cedict(spark, str(ced)).collect()


def test_overrides(spark):
    lex = L.overrides(spark, {"version": 1, "entries": [{"surface": " 鬼滅の刃 ", "readings": ["きめつのやいば"]}]})
    rows = {r["text"]: r["paths"] for r in with_overrides(spark.createDataFrame([("鬼滅の刃",), ("し",)], "text string"), lex).collect()}
    assert "kimetunoyaiba" in rows["鬼滅の刃"] and rows["し"] == ["ci", "shi", "si"]
    for bad in ({"version": 2}, {"version": 1, "entries": [{"surface": "", "readings": ["a"]}]}, {"version": 1, "entries": [{"surface": "a", "readings": []}]}, {"version": 1, "entries": [{"surface": "a", "readings": ["b"]}] * 2}):
        with pytest.raises(L.LexiconError):
            L.overrides(spark, bad)


def test_bundles(spark, tmp_path, ja, zh):
    meta = L.save_bundle(ja, str(tmp_path / "ja"), lang="ja", name="test", defaults=JA_OPTIONS)
    got = L.load_bundle(spark, str(tmp_path / "ja"))
    assert meta["entries"] == 4 and got.options == JA_OPTIONS and {r["surface"]: r["readings"] for r in got.lexicon.collect()} == JA
    with pytest.raises(L.LexiconError):
        L.load_bundle(spark, str(tmp_path / "ja"), lang="zh")
    ja.where("surface <> 'WHISKY'").write.mode("overwrite").parquet(str(tmp_path / "ja" / "payload"))
    with pytest.raises(L.LexiconError):
        L.load_bundle(spark, str(tmp_path / "ja"))
    assert L.canonical_checksum(ja, "h") != L.canonical_checksum(zh, "h") and len(L.canonical_checksum(ja, "h", algorithm="fnv1a64-canonical-v1")) == 16
    bad = spark.createDataFrame([("a", ["x", "x"])], L.SCHEMA)
    with pytest.raises(L.LexiconError):
        L.check_lexicon(bad, "ja")
    L.save_bundle(zh, str(tmp_path / "zh"), lang="zh", name="test", view="no-tone", defaults=ZH_OPTIONS)
    L.set_default(L.load_bundle(spark, str(tmp_path / "zh")))
    df = spark.createDataFrame([("bunahabe", "布納哈本")], "l string, r string")
    assert score(df, "l", "r", lang="zh").first()["score"] == 1 and L.get_default("zh") is not None
    L.clear_default()
    assert L.get_default("zh") is None
    assert score(df.select("l", "r", F.lit(1).alias("text")), "l", "r", lang="zh", lexicon=zh).count() == 1


def test_alignment_steps(spark, ja):
    from readweave.functions import paths as P
    from readweave.operators.scoring import align

    df = spark.createDataFrame([("いんさt", "印刷"), ("未", "a")], "l string, r string")
    got = {r["l"]: r for r in align(df, "l", "r", lang="ja", lexicon=ja, options=JA_OPTIONS).select("l", "trace", "error", P.left_of(F.col("trace")).alias("a"), P.right_of(F.col("trace")).alias("b")).collect()}
    r = got["いんさt"]
    assert r["trace"]["distance"] == 1 and r["b"] == r["a"] + "u" and sum(s["op"] != "match" for s in r["trace"]["steps"]) == 1
    assert got["未"]["trace"] is None and got["未"]["error"]


def test_payloads_lookups_and_lists(spark, tmp_path, ja):
    (tmp_path / "p.json").write_text('{"schema_version": 1, "payload_type": "x", "pinyin_view": "no-tone", "entries": [{"surface": "威士忌", "readings": ["weishiji"]}]}', encoding="utf-8")
    lex, view = L.read_payload(spark, str(tmp_path / "p.json"), lang="zh")
    assert view == "no-tone" and L.lookup(lex, "威士忌", "zh") == ["weishiji"] and L.lookup(ja, "ＷＨＩＳＫＹ") == ["ウイスキー"] and L.lookup(ja, "x") is None
    (tmp_path / "q.json").write_text('{"schema_version": 2}', encoding="utf-8")
    with pytest.raises(L.LexiconError):
        L.read_payload(spark, str(tmp_path / "q.json"), lang="ja")
    L.save_bundle(ja, str(tmp_path / "all" / "one"), lang="ja", name="one")
    assert [m["name"] for _, m in L.list_bundles(spark, str(tmp_path / "all"))] == ["one"] and L.list_bundles(spark, str(tmp_path / "none")) == []


def test_graphviz():
    from readweave.operators.graphviz import lattice_dot, pair_dot

    assert "digraph" in lattice_dot("チャ", "ja")
    text = pair_dot("いんさt", "印刷", "ja", JA)
    assert text.index("印刷") < text.index("いんさt") and text.count("color=red") == 11
    assert "digraph" in pair_dot("weishiji", "威士忌", "zh", ZH)


def test_bundles_with_damage(spark, tmp_path, zh):
    """Changed files, paths that lead out, and missing license files."""
    import json
    import pathlib
    import shutil

    path = tmp_path / "b"
    L.save_bundle(zh, str(path), lang="zh", name="b", view="no-tone", license_refs=[{"label": "CC", "path": "license/CC.md"}])
    with pytest.raises(L.LexiconError, match="license file of CC"):
        L.load_bundle(spark, str(path))
    (path / "license").mkdir()
    (path / "license" / "CC.md").write_text("x")
    assert L.load_bundle(spark, str(path)).lang == "zh"
    note = next(pathlib.Path(path / "metadata").glob("part-*"))
    meta = json.loads(note.read_text())

    def changed(**x) -> str:
        at = tmp_path / "changed"
        shutil.rmtree(at, ignore_errors=True)
        shutil.copytree(path, at)
        for f in (at / "metadata").glob("*"):
            f.unlink()
        for f in (at / "metadata").glob(".*"):
            f.unlink()
        (at / "metadata" / "part-0.txt").write_text(json.dumps(meta | x))
        return str(at)

    assert L.load_bundle(spark, changed()).meta["name"] == "b"
    files = {k: "0" * 64 for k in meta["payload"]["files"]}
    with pytest.raises(L.LexiconError, match="digests"):
        L.load_bundle(spark, changed(payload=meta["payload"] | {"files": files}))
    for bad in ("../payload", "/payload", "a/../../b", "file:/x", ""):
        with pytest.raises(L.LexiconError, match="leads out"):
            L.load_bundle(spark, changed(payload=meta["payload"] | {"path": bad}))
    assert L.load_bundle(spark, changed(payload=None)).meta["payload"] is None  # older bundles


def test_names_of_lexicons(spark, tmp_path, ja, monkeypatch):
    L.clear_default()
    L.save_bundle(ja, str(tmp_path / "a"), lang="ja", name="a", source="UniDic")
    L.save_bundle(ja.where("surface = '印刷'"), str(tmp_path / "b"), lang="ja", name="b", source="SudachiDict")
    df = spark.createDataFrame([("insatu", "印刷")], "l string, r string")
    with pytest.raises(LookupError):
        score(df, "l", "r", lang="ja-sudachi")
    monkeypatch.setenv(L.ROOTS, str(tmp_path))
    assert score(df, "l", "r", lang="ja-sudachi").first()["score"] == 0 and L.get_default("ja-sudachi").meta["name"] == "b"
    assert score(df, "l", "r", lang="ja").first()["score"] == 0 and L.get_default("ja-unidic").meta["name"] == "a"
    L.clear_default()
    with pytest.raises(ValueError):
        L.check_lang("ko")
    with pytest.raises(TypeError):
        L.check_lang(None)


def test_payloads_round(spark, tmp_path, zh):
    L.write_payload(zh, str(tmp_path / "p"), payload_type="x", view="no-tone")
    got, view = L.read_payload(spark, str(tmp_path / "p"), lang="zh")
    assert view == "no-tone" and {r["surface"]: r["readings"] for r in got.collect()} == ZH


def test_lattices_over_the_limit(spark, ja):
    """Pairs that no kernel takes have no score and say why; others of the same table are scored."""
    df = spark.createDataFrame([("シ" * 1500, "シ" * 1500), ("し", "shi")], "l string, r string")
    got = {len(r["l"]): r for r in score(df, "l", "r", lang="ja", lexicon=ja).collect()}
    assert got[1]["score"] == 0 and got[1]["error"] is None
    assert got[1500]["score"] is None and "node pairs" in got[1500]["error"]
    with pytest.raises(ValueError):
        score(df.withColumn("error", F.lit(1)), "l", "r", lang="ja", lexicon=ja)
    kept = score(df.withColumn("error", F.lit(1)), "l", "r", lang="ja", lexicon=ja, error_out="why")
    assert {"error", "why", "score"} <= set(kept.columns)


@pytest.mark.parametrize("compression", ["gz", "zst"])
def test_archives(spark, tmp_path, zh, compression):
    """The same bundle gives the same bytes; what is installed is verified."""
    if compression == "zst":
        pytest.importorskip("zstandard")
    from readweave.sources import archive as A

    L.save_bundle(zh, str(tmp_path / "b"), lang="zh", name="whisky", view="no-tone")
    one, two = (str(tmp_path / f"{n}.tar.{compression}") for n in ("one", "two"))
    assert A.write_archive(str(tmp_path / "b"), one, name="whisky-1", compression=compression) == A.write_archive(str(tmp_path / "b"), two, name="whisky-1", compression=compression)
    sums = A.checksums([two, one])
    assert [x.split("  ")[1] for x in sums.splitlines()] == [f"one.tar.{compression}", f"two.tar.{compression}"]
    root = str(tmp_path / "root")
    (got,) = A.install(spark, one, root, sums=sums)
    assert got.meta["name"] == "whisky" and {r["surface"]: r["readings"] for r in got.lexicon.collect()} == ZH
    assert A.where(spark, root, "whisky") == A.where(spark, root, "whisky-1") and A.where(spark, root, "x") is None
    for bad in (sums.replace(sums[:8], "0" * 8), "", sums.replace(sums[:8], "zzzzzzzz")):
        with pytest.raises(L.LexiconError):
            A.install(spark, one, str(tmp_path / "other"), sums=bad)
    with pytest.raises(L.LexiconError, match="already"):
        A.install(spark, two, root)
    assert [m["name"] for _, m in L.list_bundles(spark, root)] == ["whisky"]


def test_archives_that_lead_out(tmp_path):
    import io
    import tarfile

    from readweave.sources import archive as A

    def made(*members):
        path = tmp_path / "x.tar.gz"
        with tarfile.open(path, "w:gz") as tar:
            for name, kind in members:
                info = tarfile.TarInfo(name)
                info.type = kind
                info.size = 3 if kind == tarfile.REGTYPE else 0
                info.linkname = "/etc/passwd"
                tar.addfile(info, io.BytesIO(b"abc") if info.size else None)
        return str(path)

    into = str(tmp_path / "into")
    for bad in ([("../a", tarfile.REGTYPE)], [("/a", tarfile.REGTYPE)], [("a/./b", tarfile.REGTYPE)], [("a", tarfile.SYMTYPE)], [("a", tarfile.LNKTYPE)], [("a", tarfile.FIFOTYPE)], [("a", tarfile.REGTYPE)] * 2):
        with pytest.raises(L.LexiconError):
            A.extract_archive(made(*bad), into)
        assert not (tmp_path / "into").exists()
    fine = made(("a", tarfile.DIRTYPE), ("a/b", tarfile.REGTYPE))
    for limit in ({"max_files": 0}, {"max_bytes": 2}):
        with pytest.raises(L.LexiconError):
            A.extract_archive(fine, into, **limit)
    assert A.extract_archive(fine, into) == ["a/b"] and (tmp_path / "into" / "a" / "b").read_bytes() == b"abc"
    (tmp_path / "no.tar.gz").write_bytes(b"nothing")
    with pytest.raises(L.LexiconError):
        A.extract_archive(str(tmp_path / "no.tar.gz"), str(tmp_path / "into2"))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matrix_scores_each_pair_of_texts_once(spark, monkeypatch):
    """Rows with the same text are scored once, in shares where a text has many; the kernel takes those of a choice together."""
    monkeypatch.setattr(matrix, "ROWS", 3)
    lex = L.from_entries(spark, {"一": ["イチ", "ヒト"], "七": ["ナナ", "シチ"]})
    texts = ["一七一", "七七", "一七一", "七七", None, "未", "一七一", "一七一", "一七一"]
    q = spark.createDataFrame([(0, "sichi", {"a": 1}), (1, "sichi", None), (2, "hitonana", None), (3, None, None)], "query_id long, query string, note map<string,int>")
    c = spark.createDataFrame(list(enumerate(texts)), "choice_id long, choice string")
    find = {"一": ["イチ", "ヒト"], "七": ["ナナ", "シチ"]}.get
    made = cdist(q, c, metric="ratio", lang="ja", lexicon=lex)
    assert "_rows0" in plan_of(made) and made.columns == ["query_id", "query", "note", "choice_id", "choice", "score", "error"]
    rows = made.collect()
    assert sorted((r["query_id"], r["choice_id"]) for r in rows) == [(i, j) for i in range(4) for j in range(len(texts))]
    assert {r["query_id"] for r in rows if r["note"] == {"a": 1}} == {0}
    for r in rows:
        assert r["choice"] == texts[r["choice_id"]]
        want = None if None in (r["query"], r["choice"]) or r["choice"] == "未" else kernels.best_similarity([r["query"]], R.ja_paths(r["choice"], find, Options()))
        assert r["score"] == want and bool(r["error"]) == (r["choice"] == "未")


def test_lattices_of_many_pairs():
    rnd = random.Random(5)
    sets = [sorted({"".join(rnd.choices("abc", k=rnd.randrange(1, 7))) for _ in range(rnd.randrange(1, 6))}) for _ in range(40)] + [[""]]
    packed = [kernels.Lattice.of_paths(s).pack() for s in sets]
    for few in (1, 3, len(sets)):  # pairs of one lattice alone are searched, several go through it together
        at = [(i, j) for i in range(len(sets)) for j in rnd.sample(range(len(sets)), few)]
        some = [(sets[i], sets[j]) for i, j in at]
        left, right = [packed[i] for i, _ in at], [packed[j] for _, j in at]
        assert P.lattice_scores(left, right, True) == [kernels.best_similarity(a, b) for a, b in some]
        assert P.lattice_scores(left, right, False) == [int(kernels.edit_batch([x for x in a for _ in b], [y for _ in a for y in b], False).min()) for a, b in some]
    assert P.lattice_scores([None, packed[0]], [packed[0], None], True) == [None, None]
    long = [kernels.Lattice.of_paths(["ab" * 900 + x]).pack() for x in "cd"]
    assert P.lattice_scores([long[0]] * 2, long, True) == [1.0, 1 - 1 / 1801]


def test_similarity_of_many_spellings_is_searched(spark):
    """Not all pairs of spellings, of which these texts have over 500,000."""
    lex, text = L.from_entries(spark, {}), "シチジュッツシ"
    df = spark.createDataFrame([(text, text + "ン"), ("し", "ち")], "l string, r string")
    made = score(df, "l", "r", "ratio", lang="ja", lexicon=lex)
    assert "lattice_alike" in plan_of(made)
    pairs = [[R.ja_paths(t, lambda _: None, Options()) for t in some] for some in (("し", "ち"), (text, text + "ン"))]
    assert len(pairs[1][0]) * len(pairs[1][1]) > 500_000
    assert [r["score"] for r in made.orderBy("l").collect()] == [kernels.best_similarity(a, b) for a, b in pairs]


def test_extract_scores_pairs_once(spark, ja):
    q = spark.createDataFrame([(0, "いんさt"), (1, "未"), (2, "abc")], "query_id long, query string")
    c = spark.createDataFrame([(0, "abc"), (1, "印刷"), (2, "未"), (3, "印刷")], "choice_id long, choice string")
    made = extract(q, c, lang="ja", lexicon=ja, options=JA_OPTIONS, score_cutoff=1)
    assert plan_of(made).count("ArrowEvalPython") == 1
    assert sorted((r["query_id"], r["rank"], r["choice_id"]) for r in made.collect()) == [(0, 1, 1), (0, 2, 3), (2, 1, 0)]
    all_ranks = extract(q, c, lang="ja", lexicon=ja, options=JA_OPTIONS, limit=None).collect()
    assert sorted((r["query_id"], r["choice_id"]) for r in all_ranks) == [(0, 0), (0, 1), (0, 3), (2, 0), (2, 1), (2, 3)]
