"""Registered queries on readings, with DuckDB SQL that enumerates all spellings.

Texts are made of the tables' keys: numbers in Chinese numerals, in kana and typed in Latin letters, so there are as many
distinct texts as keys. The lexicons have several readings for a numeral, and surfaces of two numerals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.functions import paths as P
from readweave.functions import romaji, scripts
from readweave.functions.readings import Options
from readweave.operators.expand import compare_with_overrides, reading_paths
from readweave.operators.extract import extract, extract_one
from readweave.operators.matrix import cdist
from readweave.operators.partial import partial_alignment, partial_ratio
from readweave.operators.scoring import align, compare, score, within
from readweave.sources import lexicon as L

Query = Callable[[SparkSession, str], DataFrame]

NUMERALS = "零一二三四五六七八九"
JA = {
    "零": ["レイ", "ゼロ"], "一": ["イチ", "ヒト"], "二": ["ニ", "フタ"], "三": ["サン", "ミ"], "四": ["ヨン", "シ"], "五": ["ゴ"], "六": ["ロク"], "七": ["ナナ", "シチ"],
    "八": ["ハチ"], "九": ["キュウ", "ク"], "一八": ["イッパチ"], "二三": ["ツギミ"], "七五": ["シチゴ", "ナノゴ"], "五九": ["ゴクー"],
}
ZH = {
    "零": ["ling"], "一": ["yi", "yao"], "二": ["er", "liang"], "三": ["san"], "四": ["si"], "五": ["wu"], "六": ["liu", "lu"], "七": ["qi"], "八": ["ba"], "九": ["jiu"],
    "一八": ["yaoba"], "七五": ["qiwu", "qw"],
}
TYPED = ["zero", "ichi", "ni", "san", "yon", "go", "roku", "nana", "hachi", "kyuu"]
KANA = ["ゼロ", "いち", "に", "さん", "よん", "ごー", "ろく", "なな", "はっ", "きゅー"]
PINYIN = ["ling", "yi", "er", "san", "si", "wu", "liu", "qi", "ba", "jiu"]
NEEDLES = ["さん", "ナナゴ", "いち"]
OVERRIDES = {"version": 1, "entries": [{"surface": "一二三", "readings": ["ひふみ", "いちにさん"]}, {"surface": "七五三", "readings": ["しちごさん"]}]}
O = Options(max_span_chars=8, max_paths=1024)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def digits(key: str, add: int = 0, size: int = 4) -> Column:
    return F.lpad(((F.col(key) * 7919 + add) % 10**size).cast("string"), size, "0")


def spelled(number: Column, names: list[str]) -> Column:
    """The names of a number's digits, one after the other."""
    return F.array_join(F.transform(F.split(number, ""), lambda x: F.element_at(F.array(*map(F.lit, names)), x.cast("int") + 1)), "")


def slip(text: Column, key: str) -> Column:
    """A text without one character."""
    at = (F.col(key) % F.char_length(text) + 1).cast("int")
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.char_length(text)))


def _pairs(spark: SparkSession, sf: str, table: str, key: str, right: str) -> DataFrame:
    """Numbers of a table's keys in numerals, and what is typed, written in kana or in numerals and kana."""
    rows = _t(spark, sf, table).select(F.col(key).cast("long").alias("id"))
    numerals = F.translate(digits("id"), "0123456789", NUMERALS)
    near = digits("id", 10)
    other = {
        "typed": slip(spelled(digits("id"), TYPED), "id"), "kana": spelled(near, KANA), "pinyin": slip(spelled(digits("id"), PINYIN), "id"),
        "mixed": F.concat(F.translate(F.substring(near, 1, 2), "0123456789", NUMERALS), spelled(F.substring(near, 3, 2), KANA)),
    }[right]
    return rows.select("id", numerals.alias("l"), other.alias("r"))


CUSTOMERS, SUPPLIERS, NATIONS = ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey")


def _score(of: tuple[str, str], right: str, metric: str, lang: str = "ja", **how) -> Query:
    words = JA if lang == "ja" else ZH
    return lambda spark, sf: score(_pairs(spark, sf, *of, right), "l", "r", metric, lang=lang, lexicon=L.from_entries(spark, words), options=O, **how).drop("error")


def _compare(right: str, lang: str = "ja") -> Query:
    words = JA if lang == "ja" else ZH
    return lambda spark, sf: compare(_pairs(spark, sf, *SUPPLIERS, right), "l", "r", lang=lang, lexicon=L.from_entries(spark, words), options=O).select("id", "comparison.*")


def _sides(spark: SparkSession, sf: str, right: str) -> tuple[DataFrame, DataFrame]:
    """What is typed for the nations' numbers, and the suppliers' numbers in numerals."""
    asked = _pairs(spark, sf, *NATIONS, right).select(F.col("id").alias("query_id"), F.col("r").alias("query"))
    return asked, _pairs(spark, sf, *SUPPLIERS, right).select(F.col("id").alias("choice_id"), F.col("l").alias("choice"))


def _cdist(right: str, metric: str, lang: str = "ja", **how) -> Query:
    words = JA if lang == "ja" else ZH
    return lambda spark, sf: cdist(*_sides(spark, sf, right), metric=metric, lang=lang, lexicon=L.from_entries(spark, words), options=O, **how).drop("error")


def _extract(right: str, scorer: str, lang: str = "ja", one: bool = False) -> Query:
    words = JA if lang == "ja" else ZH
    how = {"lang": lang, "options": O}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        best = extract_one if one else extract
        return best(*_sides(spark, sf, right), "query", "choice", scorer, lexicon=L.from_entries(spark, words), **how).select("query_id", "rank", "choice", "choice_id", "score")

    return run


def _haystacks(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(names)), "query_id long, query string")
    return asked.crossJoin(_t(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))).withColumn("text", F.translate(digits("id", 3, 5), "0123456789", NUMERALS))


def _partial(metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = partial_alignment(_haystacks(spark, sf, NEEDLES), "query", "text", metric, lang="ja", lexicon=L.from_entries(spark, JA), options=O)
        return rows.select("query_id", "id", "alignment.*")

    return run


def _partial_zh(spark: SparkSession, sf: str) -> DataFrame:
    rows = _haystacks(spark, sf, ["sanwu", "yaoba", "qi"])
    return partial_ratio(rows, "query", "text", lang="zh", lexicon=L.from_entries(spark, ZH), options=O).select("query_id", "id", "score")


def _paths_with_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf, *CUSTOMERS, "kana").select(F.col("l").alias("text"))
    stats = ("matched_spans", "raw_segment_readings", "used_segment_readings", "candidate_combinations", "unique_paths", "duplicate_joined_readings")
    return reading_paths(rows, L.from_entries(spark, JA), "ja", O).select("text", F.array_join("paths.joined_reading", ",").alias("readings"), *[F.col(f"stats.{x}") for x in stats])


def _longest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf, *CUSTOMERS, "kana").select(F.col("l").alias("text"))
    got = reading_paths(rows, L.from_entries(spark, JA), "ja", O.but(longest_match_only=True))
    return got.select("text", F.array_join("paths.joined_reading", ",").alias("readings"), F.size("paths").alias("n"))


def _spellings(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf, *CUSTOMERS, "kana")
    return rows.select("id", F.explode(F.array_distinct(scripts.romaji_paths("r"))).alias("spelling"))


def _path_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf, *SUPPLIERS, "typed")
    left = F.array("r", F.concat(F.substring("r", 2, 1), F.substring("r", 1, 1), F.substring("r", 3, 99)))
    right = F.array(F.lit("ichini"), F.lit("sanyongo"), F.lit("zeorzero"))
    return rows.select("id", P.damerau_distance_paths(left, right).alias("osa"), P.normalized_distance_paths(left, right).alias("normalized"), P.ratio_paths(left, right, 0.4).alias("ratio"), P.within_damerau_distance_paths(left, right, 5).alias("near"))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    rows = align(_pairs(spark, sf, *SUPPLIERS, "typed"), "l", "r", lang="ja", lexicon=L.from_entries(spark, JA), options=O)
    edits = F.size(F.filter("trace.steps", lambda s: s["op"] != "match"))
    return rows.select("id", F.col("trace.distance").alias("distance"), edits.alias("edits"), P.right_of(F.col("trace")).alias("right_path"))


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.element_at(F.array(F.lit("一二三"), F.lit("七五三"), F.lit("ふみ")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("l"), spelled((F.col("c_custkey") % 100).cast("string"), KANA).alias("r"))
    return compare_with_overrides(rows, "l", "r", L.overrides(spark, OVERRIDES)).select("id", "comparison.surface_levenshtein", "comparison.lattice")


def _file(spark: SparkSession, rows: DataFrame, line: Column, name: str) -> str:
    """A table's rows as text files in the shared folder, for the lexicon sources."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/readweave-shared"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    rows.select(line.alias("value")).write.text(path)
    return path


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a dictionary: surfaces of three numerals, with kana of the customer's number, and a part of speech."""
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), "c_mktsegment")
    surface = F.translate(digits("id", 1, 3), "0123456789", NUMERALS)
    surface = F.when(F.col("id") % 11 == 0, F.lit("ascii")).when(F.col("id") % 13 == 0, F.concat(surface, F.lit("Ａ"))).otherwise(surface)
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("補助記号")).otherwise(F.lit("名詞"))
    return rows.select("id", surface.alias("surface"), kind.alias("kind"), spelled((F.col("id") % 1000).cast("string"), KANA).alias("reading"))


def _readings(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("surface", F.array_join("readings", ",").alias("readings"))


def _unidic(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entries(spark, sf)
    row = [F.lit("x")] * 17
    row[0], row[4], row[10], row[13] = F.col("surface"), F.col("kind"), F.lit("ヨミ"), F.col("reading")
    return _readings(L.read_unidic(spark, _file(spark, rows, F.concat_ws(",", *row), "unidic"), max_readings=3))


def _sudachi(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entries(spark, sf)
    row = [F.lit("x")] * 18
    row[0], row[4], row[5], row[11] = F.col("surface"), F.when(F.col("id") % 7 == 0, F.lit("数")).otherwise(F.lit("*")), F.col("kind"), F.col("reading")
    return _readings(L.read_sudachi(spark, _file(spark, rows, F.concat_ws(",", *row), "sudachi")))


def _cedict(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    number = digits("id", 1, 2)
    pinyin = F.array_join(F.transform(F.split(number, ""), lambda x: F.concat(F.element_at(F.array(*[F.initcap(F.lit(p)) for p in PINYIN]), x.cast("int") + 1), (F.col("id") % 4 + 1).cast("string"))), " ")
    line = F.concat(F.translate(number, "0123456789", NUMERALS), F.lit(" "), F.translate(number, "0123456789", "〇一二三四五六七八九"), F.lit(" ["), pinyin, F.lit("] /number/"))
    return _readings(L.read_cedict(spark, _file(spark, rows, line, "cedict"), view="tone3"))


def queries() -> dict[str, Query]:
    return {
        "ja_typed_distance": _score(CUSTOMERS, "typed", "distance"),
        "ja_typed_cutoff": _score(CUSTOMERS, "typed", "distance", score_cutoff=2),
        "ja_typed_ratio": _score(CUSTOMERS, "typed", "ratio"),
        "ja_typed_normalized": _score(CUSTOMERS, "typed", "normalized_distance", score_cutoff=0.3),
        "ja_typed_osa": _score(SUPPLIERS, "typed", "damerau_distance"),
        "ja_typed_combined": _score(SUPPLIERS, "typed", "combined_distance"),
        "ja_kana_distance": _score(SUPPLIERS, "kana", "distance"),
        "ja_mixed_distance": _score(SUPPLIERS, "mixed", "distance"),
        "ja_mixed_ratio": _score(SUPPLIERS, "mixed", "ratio"),
        "ja_typed_within": lambda spark, sf: within(_pairs(spark, sf, *CUSTOMERS, "typed"), "l", "r", 1, lang="ja", lexicon=L.from_entries(spark, JA), options=O).drop("error"),
        "ja_typed_compare": _compare("typed"),
        "ja_cdist_distance": _cdist("typed", "distance"),
        "ja_cdist_ratio": _cdist("typed", "ratio", score_cutoff=0.5),
        "ja_extract": _extract("typed", "distance"),
        "ja_extract_one": _extract("typed", "ratio", one=True),
        "ja_partial_distance": _partial("distance"),
        "ja_partial_ratio": _partial("ratio"),
        "ja_alignment": _steps,
        "ja_overrides": _overrides,
        "zh_typed_distance": _score(CUSTOMERS, "pinyin", "distance", "zh"),
        "zh_typed_ratio": _score(CUSTOMERS, "pinyin", "ratio", "zh"),
        "zh_typed_compare": _compare("pinyin", "zh"),
        "zh_cdist_normalized": _cdist("pinyin", "normalized_distance", "zh"),
        "zh_extract": _extract("pinyin", "distance", "zh"),
        "zh_partial_ratio": _partial_zh,
        "numeral_readings": _paths_with_stats,
        "numeral_readings_longest": _longest,
        "kana_spellings": _spellings,
        "path_scores": _path_scores,
        "unidic_scan": _unidic,
        "sudachi_scan": _sudachi,
        "cedict_scan": _cedict,
    }


# SQL


def _values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


def _digits(key: str, add: int = 0, size: int = 4) -> str:
    return f"lpad((({key} * 7919 + {add}) % {10**size})::varchar, {size}, '0')"


def _spell(number: str, names: list[str]) -> str:
    return f"array_to_string([{_list(names)}[x::int + 1] for x in string_split({number}, '')], '')"


def _slip(text: str, key: str) -> str:
    return f"substr({text}, 1, ({key} % length({text}))::int) || substr({text}, ({key} % length({text}))::int + 2)"


def _rows(of: tuple[str, str], right: str) -> str:
    """The (id, l, r) of `_pairs`."""
    near = _digits("id", 10)
    other = {
        "typed": _slip(_spell(_digits("id"), TYPED), "id"), "kana": _spell(near, KANA), "pinyin": _slip(_spell(_digits("id"), PINYIN), "id"),
        "mixed": f"translate(substr({near}, 1, 2), '0123456789', '{NUMERALS}') || {_spell(f'substr({near}, 3, 2)', KANA)}",
    }[right]
    return f"(select id, translate({_digits('id')}, '0123456789', '{NUMERALS}') as l, {other} as r from (select {of[1]}::bigint as id from {of[0]}))"


def _lexicon(words: dict[str, list[str]]) -> str:
    return "lex(surface, reading) as " + _values((s, r) for s, rs in words.items() for r in rs)


#: Readings (t, reading) of the texts in t(t), by all segmentations into surfaces, or runs of kana as they are
READINGS = """seg(t, pos, reading) as (select t, 0, '' from t union select t, pos + length(surface), seg.reading || lex.reading
  from seg join (select * from lex union select distinct unnest(regexp_extract_all(t, '[ぁ-ゖァ-ヶー]+')) as surface, surface as reading from t) lex on substr(t, pos + 1, length(surface)) = surface
    and (pos = 0 or not regexp_matches(surface, '^[ぁ-ゖァ-ヶー]') or not regexp_matches(substr(t, pos, 1), '[ぁ-ゖァ-ヶー]'))
    and (not regexp_matches(surface, '[ぁ-ゖァ-ヶー]$') or not regexp_matches(substr(t, pos + length(surface) + 1, 1), '[ぁ-ゖァ-ヶー]')) where pos < length(t)),
rd as (select distinct t, reading from seg where pos = length(t) and t <> '')"""
#: All spellings sp(t, s) of the texts in rd(t, reading), unit by unit, by the last vowel for long-vowel marks
SPELLINGS = f"""u(kana, s) as {_values((k, s) for k, some in romaji.VARIANTS.items() if k not in 'っー' for s in some)},
lv(vowel, s) as {_values((v, s) for v, some in romaji.LONG.items() for s in some)},
kn as (select distinct reading, translate(reading, '{"".join(map(chr, range(0x30A1, 0x30F7)))}', '{"".join(map(chr, range(0x3041, 0x3097)))}') as k from rd),
tok(k, i, pos, unit) as (select distinct k, 0, 0, '' from kn union all
  select k, i + 1, pos + n, substr(k, pos + 1, n) from (select *, case when substr(k, pos + 1, 2) in (select kana from u where length(kana) = 2) then 2 else 1 end as n from tok) where pos < length(k)),
st(k, i, s, vowel) as (
  select k, i, coalesce(u.s, unit), null from tok left join u on kana = unit where i > 0 and unit not in ('っ', 'ー')
  union select k, i, s, vowel from tok, lv where unit = 'ー'
  union select k, i, unnest(['xtu', 'ltu', 'ttu']), null from tok where unit = 'っ'
  union select a.k, a.i, substr(u.s, 1, 1), null from tok a join tok b on a.k = b.k and b.i = a.i + 1 join u on kana = b.unit where a.unit = 'っ' and substr(u.s, 1, 1) not in ('a', 'i', 'u', 'e', 'o', 'n', '-')),
w(k, i, s) as (select distinct k, 0, '' from kn union
  select w.k, w.i + 1, w.s || st.s from w join st on st.k = w.k and st.i = w.i + 1 and (vowel is null or vowel = regexp_extract(w.s, '([aiueo])[^aiueo]*$', 1))),
ends as (select k, max(i) as n from tok group by 1),
sp as (select distinct t, s from rd join kn using (reading) join w using (k) join ends using (k) where i = n)"""


def _ja(source: str, texts: str = "select l as t from p union select r from p") -> str:
    """p: the pairs; rd, sp: readings and spellings of all texts. Latin text is read as it is."""
    return f"with recursive p as {source}, t as (select distinct t from ({texts})), {_lexicon(JA)}, {READINGS}, {SPELLINGS}, sx as (select * from sp union select t, t from t where regexp_matches(t, '^[ -~]*$'))"


def _zh(source: str, texts: str = "select l as t from p union select r from p") -> str:
    return f"with recursive p as {source}, t as (select distinct t from ({texts})), {_lexicon(ZH)}, {READINGS}, sx as (select t, reading as s from rd union select t, t from t where regexp_matches(t, '^[ -~]*$'))"


_WIDE = "".join(sorted(set(NUMERALS + "".join(KANA) + "ふみ")))
_PLAIN = "".join(map(chr, range(ord("A"), ord("Z") + 1))) + "0123456789!#$%&()*+"


def _surface(left: str, right: str) -> str:
    """Levenshtein distance of texts as written: DuckDB's counts bytes, so each wide character becomes a plain one."""
    a, b = (f"translate({x}, '{_WIDE}', '{_PLAIN[: len(_WIDE)]}')" for x in (left, right))
    return f"levenshtein({a}, {b})::int"


_LEV = "min(levenshtein(a.s, b.s))::int"
_SIM = "max(greatest(0.0::double, 1.0::double - levenshtein(a.s, b.s)::double / greatest(length(a.s), length(b.s))))"


def _best(spelled: str, value: str, columns: str = "id, l, r", left: str = "l", right: str = "r") -> str:
    return f"{spelled}, g as (select {columns}, {value} as score from p join sx a on a.t = {left} join sx b on b.t = {right} group by all)"


def _sides_sql(right: str) -> str:
    return f"(select a.id as query_id, a.r as query, b.id as choice_id, b.l as choice from {_rows(NATIONS, right)} a, {_rows(SUPPLIERS, right)} b)"


_SIDES = {"columns": "query_id, query, choice_id, choice", "left": "query", "right": "choice"}
_SIDE_TEXTS = "select query as t from p union select choice from p"


def _spans(names: list[str], lang: str, value: str) -> str:
    """Scores of all spans of a text up to the query's limit."""
    asked = "(select query_id, query, id, translate(" + _digits("id", 3, 5) + f", '0123456789', '{NUMERALS}') as text from (select s_suppkey::bigint as id from supplier), " + "(values " + ", ".join(f"({i}::bigint, '{q}')" for i, q in enumerate(names)) + ") q(query_id, query))"
    made = (_ja if lang == "ja" else _zh)(asked, "select query as t from p union select substr(text, a + 1, b) from p, range(5) x(a), range(1, 6) y(b) where a + b <= 5")
    return f"{made}, li as (select t, greatest(2 * length(t), length(t) + 4, max(length(s))) as most from sx group by t), z as (select query_id, id, a::int as start, b::int as size, {value} as score, {_SIM} as alike from p, range(5) x(a), range(1, 6) y(b), li, sx a, sx b where li.t = query and b <= most and x.a + y.b <= 5 and a.t = query and b.t = substr(text, x.a::int + 1, y.b::int) group by all)"


def oracles(osa: str) -> dict[str, str]:
    """`osa` makes tables of the adjacent-transposition distance (see `catalog`)."""

    def with_osa(spelled: str, source: str) -> str:
        return f"{spelled}, {osa.format(l='x', r='y', source=source)}"

    ids = "select id, l, r, score from g"
    typed_ja, pinyin_zh = _ja(_rows(CUSTOMERS, "typed")), _zh(_rows(CUSTOMERS, "pinyin"))
    pairs = "(select distinct a.s as x, b.s as y from p join sx a on a.t = p.l join sx b on b.t = p.r union select l, r from p)"
    small = with_osa(_ja(_rows(SUPPLIERS, "typed")), pairs)
    small_zh = with_osa(_zh(_rows(SUPPLIERS, "pinyin")), pairs)
    least = "(select p.id, min(osa.osa)::int as osa, min(levenshtein(a.s, b.s))::int as lev from p join sx a on a.t = p.l join sx b on b.t = p.r join osa on osa.l = a.s and osa.r = b.s group by 1)"
    five = f"select p.id, {_surface('p.l', 'p.r')} as surface_levenshtein, o.osa::int as surface_damerau, g.lev as lattice, g.osa as lattice_damerau, least(o.osa, g.lev)::int as combined from p join osa o on o.l = p.l and o.r = p.r join {least} g on g.id = p.id"
    ranked = "select query_id, rank, choice, choice_id, score from (select *, row_number() over (partition by query_id order by score{}, choice_id)::int as rank from g) where rank <= {}"
    span = "select p.query_id, p.id, score, 0::int as src_start, case when m is not null then length(query)::int end as src_end, m.start as dest_start, m.start + m.size as dest_end from p left join (select query_id, id, min(struct_pack(k := {}, size := size, start := start)) as m, {} as score from z where alike > 0 group by 1, 2) using (query_id, id)"
    entries = f"e as (select id, case when id % 11 = 0 then 'ascii' when id % 13 = 0 then n || 'Ａ' else n end as surface, case when c_mktsegment = 'MACHINERY' then '補助記号' else '名詞' end as kind, reading from (select c_custkey::bigint as id, c_mktsegment, translate({_digits('c_custkey', 1, 3)}, '0123456789', '{NUMERALS}') as n, {_spell('(c_custkey % 1000)::varchar', KANA)} as reading from customer) where id % 11 <> 0 and kind <> '補助記号'), f as (select id, surface, reading from e union select id, translate(surface, 'Ａ', 'A'), reading from e)"
    typed = _rows(SUPPLIERS, "typed")
    way = f"(select id, unnest([r, substr(r, 2, 1) || substr(r, 1, 1) || substr(r, 3)]) as x from {typed}) a, (select unnest(['ichini', 'sanyongo', 'zeorzero']) as y) b"
    words = f"(select distinct x, y from {way})"
    override = _values((e["surface"], r) for e in OVERRIDES["entries"] for r in e["readings"])
    custom = f"(select c_custkey as id, ['一二三', '七五三', 'ふみ'][c_custkey % 3 + 1] as l, {_spell('(c_custkey % 100)::varchar', KANA)} as r from customer)"
    suffix = "sub(t, i) as (select t, unnest(range(0, length(t) + 1)) from t), m as (select t, i, length(surface) as n, lex.reading from sub join lex on substr(t, i + 1, length(surface)) = surface)"
    # readings of each suffix: rest(t, i, reading)
    rest = "rest(t, i, reading) as (select t, length(t), '' from t union select m.t, m.i, m.reading || rest.reading from rest join m on m.t = rest.t and m.i + m.n = rest.i)"
    kanji = f"(select translate({_digits('c_custkey')}, '0123456789', '{NUMERALS}') as l, '' as r from customer)"
    return {
        "ja_typed_distance": f"{_best(typed_ja, _LEV)} {ids}",
        "ja_typed_cutoff": f"{_best(typed_ja, f'least({_LEV}, 3)')} {ids}",
        "ja_typed_ratio": f"{_best(typed_ja, _SIM)} {ids}",
        "ja_typed_normalized": f"{_best(typed_ja, _SIM)} select id, l, r, case when 1.0::double - score <= 0.3::double then 1.0::double - score else 1.0::double end as score from g",
        "ja_typed_osa": f"{small} select id, l, r, g.osa as score from p join {least} g using (id)",
        "ja_typed_combined": f"{small} select p.id, p.l, p.r, least(o.osa, g.lev)::int as score from p join {least} g using (id) join osa o on o.l = p.l and o.r = p.r",
        "ja_kana_distance": f"{_best(_ja(_rows(SUPPLIERS, 'kana')), _LEV)} {ids}",
        "ja_mixed_distance": f"{_best(_ja(_rows(SUPPLIERS, 'mixed')), _LEV)} {ids}",
        "ja_mixed_ratio": f"{_best(_ja(_rows(SUPPLIERS, 'mixed')), _SIM)} {ids}",
        "ja_typed_within": f"{_best(typed_ja, _LEV)} select id, l, r, score <= 1 as within from g",
        "ja_typed_compare": f"{small} {five}",
        "ja_cdist_distance": f"{_best(_ja(_sides_sql('typed'), _SIDE_TEXTS), _LEV, **_SIDES)} select * from g",
        "ja_cdist_ratio": f"{_best(_ja(_sides_sql('typed'), _SIDE_TEXTS), _SIM, **_SIDES)} select query_id, query, choice_id, choice, case when score >= 0.5::double then score else 0.0::double end as score from g",
        "ja_extract": f"{_best(_ja(_sides_sql('typed'), _SIDE_TEXTS), _LEV, **_SIDES)} {ranked.format('', 5)}",
        "ja_extract_one": f"{_best(_ja(_sides_sql('typed'), _SIDE_TEXTS), _SIM, **_SIDES)} {ranked.format(' desc', 1)}",
        "ja_partial_distance": f"{_spans(NEEDLES, 'ja', _LEV)} {span.format('score', 'min(score)').replace('0::int as src_start', 'case when m is not null then 0::int end as src_start')}",
        "ja_partial_ratio": f"{_spans(NEEDLES, 'ja', _SIM)} {span.format('-score', 'max(score)').replace('0::int as src_start', 'case when m is not null then 0::int end as src_start')}",
        "ja_alignment": f"{_best(_ja(typed), _LEV)} select id, score as distance, score as edits, r as right_path from g",
        "ja_overrides": f"with recursive p as {custom}, ov(t, reading) as {override}, rd as (select * from ov union select t, t from (select l as t from p union select r from p) where t not in (select t from ov)), {SPELLINGS}, g as (select id, l, r, min(levenshtein(a.s, b.s))::int as lattice from p join sp a on a.t = l join sp b on b.t = r group by all) select id, {_surface('l', 'r')} as surface_levenshtein, lattice from g",
        "zh_typed_distance": f"{_best(pinyin_zh, _LEV)} {ids}",
        "zh_typed_ratio": f"{_best(pinyin_zh, _SIM)} {ids}",
        "zh_typed_compare": f"{small_zh} {five}",
        "zh_cdist_normalized": f"{_best(_zh(_sides_sql('pinyin'), _SIDE_TEXTS), _SIM, **_SIDES)} select query_id, query, choice_id, choice, 1.0::double - score as score from g",
        "zh_extract": f"{_best(_zh(_sides_sql('pinyin'), _SIDE_TEXTS), _LEV, **_SIDES)} {ranked.format('', 5)}",
        "zh_partial_ratio": f"{_spans(['sanwu', 'yaoba', 'qi'], 'zh', _SIM)} select p.query_id, p.id, coalesce(m, 0.0::double) as score from p left join (select query_id, id, max(alike) as m from z group by 1, 2) using (query_id, id)",
        "numeral_readings": f"with recursive p as {kanji}, t as (select distinct l as t from p), {_lexicon(JA)}, {suffix}, {rest}, n as (select t, i, count(*) as n from rest group by 1, 2), c as (select m.t, count(distinct (m.i, m.n)) as spans, count(*) as raw, sum(n.n)::bigint as combinations from m join n on n.t = m.t and n.i = m.i + m.n group by 1), k as (select t, count(*) as paths from rest where i < length(t) group by 1) select t as text, string_agg(reading, ',' order by reading) as readings, any_value(spans)::bigint as matched_spans, any_value(raw)::bigint as raw_segment_readings, any_value(raw)::bigint as used_segment_readings, any_value(combinations)::bigint as candidate_combinations, any_value(paths)::bigint as unique_paths, (any_value(combinations) - any_value(paths))::bigint as duplicate_joined_readings from rest join c using (t) join k using (t) where i = 0 group by 1",
        "numeral_readings_longest": f"with recursive p as {kanji}, t as (select distinct l as t from p), {_lexicon(JA)}, {suffix}, best as (select t, i, max(n) as n from m group by 1, 2), {rest.replace('join m on', 'join (select m.* from m join best using (t, i, n)) m on')} select t as text, string_agg(reading, ',' order by reading) as readings, count(*)::int as n from rest where i = 0 group by 1",
        "kana_spellings": f"with recursive p as {_rows(CUSTOMERS, 'kana')}, rd as (select distinct r as t, r as reading from p), {SPELLINGS} select id, s as spelling from p join sp on sp.t = p.r",
        "path_scores": f"with recursive {osa.format(l='x', r='y', source=words)}, k as (select id, osa.osa, greatest(0.0::double, 1.0::double - levenshtein(x, y)::double / greatest(length(x), length(y))) as sim from {way}, osa where osa.l = x and osa.r = y) select id, min(osa)::int as osa, 1.0::double - max(sim) as normalized, case when max(sim) >= 0.4::double then max(sim) else 0.0::double end as ratio, min(osa) <= 5 as near from k group by 1",
        "unidic_scan": f"with {entries} select surface, array_to_string((list_sort(list(distinct reading)))[:3], ',') as readings from f group by 1",
        "sudachi_scan": f"with {entries} select surface, array_to_string(list_sort(list(distinct reading)), ',') as readings from (select surface, reading from f union select '数', reading from e where id % 7 = 0) group by 1",
        "cedict_scan": f"with e as (select {_digits('c_custkey', 1, 2)} as n, (c_custkey % 4 + 1)::varchar as tone from customer), f as (select n, array_to_string([{_list(PINYIN)}[x::int + 1] || tone for x in string_split(n, '')], '') as reading from e), g as (select translate(n, '0123456789', '{NUMERALS}') as surface, reading from f union select translate(n, '0123456789', '〇一二三四五六七八九'), reading from f) select surface, array_to_string(list_sort(list(distinct reading)), ',') as readings from g group by 1",
    }

