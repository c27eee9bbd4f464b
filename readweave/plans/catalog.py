"""Registered queries of the string-comparison engine, each over whole tables, with DuckDB SQL where SQL has the like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.functions import paths as P
from readweave.functions import scripts
from readweave.functions import text as X
from readweave.functions.readings import Options
from readweave.operators.expand import reading_paths
from readweave.operators.extract import extract, extract_one
from readweave.operators.matrix import cdist, within_join
from readweave.operators.partial import partial_alignment, partial_distance, partial_ratio
from readweave.operators.scoring import compare, score, zero_distance_join
from readweave.plans import readings
from readweave.sources.lexicon import from_entries

Query = Callable[[SparkSession, str], DataFrame]

#: What the queries look for: misspelt words of part names
WORDS = ("metalic", "antqiue", "lavendre blush", "chocolat", "gohst white")
#: A lexicon of Latin and other surfaces; Latin text that it lacks is read as it is
LEXICON = {"WHISKY": ["ウイスキー"], "印刷": ["インサツ"], "茶": ["チャ"], "道具": ["ドーグ"]}
ZH_LEXICON = {"威士忌": ["weishiji"], "布納哈本": ["bunahaben"]}
_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KATA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"
_HIRA = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
_WIDE = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(WORDS)), "query_id long, query string")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct part names, numbered by the smallest part key."""
    return _t(spark, sf, "part").groupBy(F.col("p_name").alias("choice")).agg(F.min("p_partkey").alias("choice_id"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _queries(spark).crossJoin(_names(spark, sf))


def _scored(metric: str, **kw) -> Query:
    return lambda spark, sf: _pairs(spark, sf).withColumn("score", X.plain(metric)("query", "choice", **kw))


def _matrix(metric: str, **kw) -> Query:
    return lambda spark, sf: cdist(_queries(spark), _names(spark, sf), metric=metric, **kw)


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "supplier")
    return within_join(s.select(F.col("s_suppkey").alias("a_key"), F.col("s_name").alias("a")), s.select(F.col("s_suppkey").alias("b_key"), F.col("s_name").alias("b")), "a", "b", 1).select("a_key", "b_key", "distance")


def _customer_segments(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return c.select("c_custkey", X.distance("segment", F.lit("BUILDINGS")).alias("lev"), X.damerau_distance("segment", F.lit("UBILDING"), 2).alias("osa"), X.normalized_similarity("segment", F.lit("MACHINE")).alias("similarity"))


def _names_paths(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("choice", " ")
    rows = _names(spark, sf)
    goal = F.array(F.lit("metalic"), F.lit("chocolat"), F.lit("white"))
    return rows.select("choice_id", P.distance_paths(words, goal).alias("least"), P.normalized_similarity_paths(words, goal).alias("similarity"), P.within_distance_paths(words, goal, 1).alias("near"))


def _kana(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    return n.select("n_nationkey", scripts.normalize_kana(F.translate(F.upper("n_name"), _LATIN, _KATA)).alias("kana"), scripts.fold_width(F.translate(F.upper("n_name"), _LATIN, _WIDE)).alias("plain"))


def _pinyin(spark: SparkSession, sf: str) -> DataFrame:
    field = F.concat_ws(" ", "p_type", F.col("p_size").cast("string"), F.lit("Lu:4"))
    return _t(spark, sf, "part").select("p_partkey", scripts.normalize_pinyin(field).alias("no_tone"), scripts.normalize_pinyin(field, "tone3").alias("tone3"))


def _ja(metric: str) -> Query:
    return lambda spark, sf: score(_pairs(spark, sf), "query", "choice", metric, lang="ja", lexicon=from_entries(spark, LEXICON), options=Options(longest_match_only=True)).drop("error")


def _zh(spark: SparkSession, sf: str) -> DataFrame:
    return score(_pairs(spark, sf), "query", "choice", lang="zh", lexicon=from_entries(spark, ZH_LEXICON)).drop("error")


def _compare(spark: SparkSession, sf: str) -> DataFrame:
    return compare(_pairs(spark, sf), "query", "choice", lang="ja", lexicon=from_entries(spark, LEXICON)).select("query_id", "choice_id", "comparison.*")


def _same_spelling(spark: SparkSession, sf: str) -> DataFrame:
    names = _names(spark, sf)
    tight = names.select(F.col("choice_id").alias("tight_id"), F.upper(F.replace("choice", F.lit(" "))).alias("tight"))
    return zero_distance_join(names, tight, "choice", "tight", lang="zh", lexicon=from_entries(spark, ZH_LEXICON)).select("choice_id", "tight_id")


def _segmented(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "nation").select(F.concat(F.lit("茶道具"), F.translate(F.upper("n_name"), _LATIN, _KATA)).alias("text"))
    return reading_paths(rows, from_entries(spark, LEXICON), "ja", hybrid=True).select("text", F.explode("paths.joined_reading").alias("reading"))


def _spellings(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").select("n_nationkey", F.explode(scripts.romaji_paths(F.translate(F.upper("n_name"), _LATIN, _KATA))).alias("spelling"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest part names of each query word."""
    return extract(_queries(spark), _names(spark, sf)).select("query_id", "rank", "choice", "choice_id", "score")


def queries() -> dict[str, Query]:
    return {
        "surface_distance": _scored("distance"),
        "surface_distance_cutoff": _scored("distance", score_cutoff=8),
        "osa_distance": _scored("damerau_distance"),
        "combined_distance": _scored("combined_distance", score_cutoff=9),
        "normalized_similarity": _scored("normalized_similarity"),
        "normalized_distance": _scored("normalized_distance", score_cutoff=0.7),
        "ratio_cutoff": _scored("ratio", score_cutoff=0.3),
        "customer_segments": _customer_segments,
        "paths_scores": _names_paths,
        "cdist_distance": _matrix("distance", score_cutoff=10),
        "cdist_damerau_distance": _matrix("damerau_distance"),
        "cdist_combined_distance": _matrix("combined_distance"),
        "cdist_normalized_similarity": _matrix("normalized_similarity", score_cutoff=0.25),
        "cdist_normalized_distance": _matrix("normalized_distance"),
        "cdist_ratio": _matrix("ratio"),
        "partial_alignment": lambda spark, sf: partial_alignment(_pairs(spark, sf), "query", "choice", "distance").select("query_id", "choice_id", "alignment.*"),
        "partial_distance": lambda spark, sf: partial_distance(_pairs(spark, sf), "query", "choice", score_cutoff=3),
        "partial_ratio": lambda spark, sf: partial_ratio(_pairs(spark, sf), "query", "choice"),
        "extract_topk": entry,
        "extract_one": lambda spark, sf: extract_one(_queries(spark), _names(spark, sf), "query", "choice", "ratio", score_cutoff=0.2).select("query_id", "choice", "choice_id", "score"),
        "within_join": _suppliers,
        "kana_normalize": _kana,
        "pinyin_normalize": _pinyin,
        "ja_distance": _ja("distance"),
        "ja_ratio": _ja("ratio"),
        "zh_distance": _zh,
        "ja_compare": _compare,
        "zero_distance_join": _same_spelling,
        "reading_paths": _segmented,
        "romaji_spellings": _spellings,
    } | readings.queries()


_PAIRS = "q(query_id, query) as (values " + ", ".join(f"({i}::bigint, '{w}')" for i, w in enumerate(WORDS)) + "), n as (select p_name as choice, min(p_partkey) as choice_id from part group by 1), p as (select * from q, n)"
_SIM = "greatest(0.0::double, 1.0::double - levenshtein(query, choice)::double / greatest(length(query), length(choice)))"
#: Optimal string alignment row by row; t is a cell without its left neighbour, of which the running minimum takes care
_OSA = """s as (select distinct {l} as l, {r} as r, string_split({l}, '') as a, string_split({r}, '') as b, length({l}) as la, length({r}) as lb from {source}),
d(l, r, i, prev2, prev) as (select l, r, 0::bigint, []::bigint[], range(0, lb + 1) from s
  union all select d.l, d.r, d.i + 1, d.prev, (select list(v order by j) from (
      select j, least(d.i + 1 + j, coalesce(min(t + (j - k)) filter (where k <= j), 1000000000)) as v
      from (select unnest(range(0, s.lb + 1)) as j) jj left join (
        select k, least(d.prev[k + 1] + 1, d.prev[k] + (a[d.i + 1] <> b[k])::bigint, case when d.i > 0 and k > 1 and a[d.i + 1] = b[k - 1] and a[d.i] = b[k] then d.prev2[k - 1] + 1 else 1000000000 end) as t
        from (select unnest(range(1, s.lb + 1)) as k) kk) tt on true group by j))
  from d join s on s.l = d.l and s.r = d.r where d.i < s.la),
osa as (select s.l, s.r, prev[lb + 1]::int as osa from d join s on s.l = d.l and s.r = d.r and d.i = s.la)"""


def _on_pairs(expression: str) -> str:
    return f"with {_PAIRS} select *, {expression} as score from p"


def _osa_on_pairs(expression: str = "osa") -> str:
    return f"with recursive {_PAIRS}, {_OSA.format(l='query', r='choice', source='p')} select p.*, {expression} as score from p join osa on query = l and choice = r"


_SPANS = f"with {_PAIRS}, x as (select *, unnest(range(0, length(choice))) as start from p), y as (select *, unnest(range(1, least(greatest(2 * length(query), length(query) + 4), length(choice) - start) + 1)) as size from x), z as (select query_id, query, choice_id, choice, start, size, substr(choice, start + 1, size) as span from y)"


def oracles() -> dict[str, str]:
    flat = "flatten([[{e} for g in ['metalic', 'chocolat', 'white']] for w in string_split(choice, ' ')])"
    lev = flat.format(e="levenshtein(w, g)")
    sim = flat.format(e="greatest(0.0::double, 1.0::double - levenshtein(w, g)::double / greatest(length(w), length(g)))")
    best = f"{_SPANS}, s as (select query_id, query, choice_id, choice, min(struct_pack(score := levenshtein(query, span), size := size, start := start)) as m from z group by all)"
    tokens = "[lower(replace(replace(t, 'u:', 'v'), 'ü', 'v')) for t in string_split(p_type || ' ' || p_size || ' Lu:4', ' ') if t <> '']"
    ranked = f"with {_PAIRS}, s as (select *, levenshtein(query, choice)::int as score from p)"
    segment = _OSA.format(l="c_mktsegment", r="goal", source="(select distinct c_mktsegment, 'UBILDING' as goal from customer)")
    direct = "replace(lower(replace(choice, ' ', '')), 'u:', 'v')"
    asked = "replace(lower(replace(query, ' ', '')), 'u:', 'v')"
    return {
        "surface_distance": _on_pairs("levenshtein(query, choice)::int"),
        "surface_distance_cutoff": _on_pairs("least(levenshtein(query, choice), 9)::int"),
        "osa_distance": _osa_on_pairs(),
        "combined_distance": _osa_on_pairs("least(osa, 10)"),
        "normalized_similarity": _on_pairs(_SIM),
        "normalized_distance": _on_pairs(f"case when 1.0::double - {_SIM} <= 0.7::double then 1.0::double - {_SIM} else 1.0::double end"),
        "ratio_cutoff": _on_pairs(f"case when {_SIM} >= 0.3::double then {_SIM} else 0.0::double end"),
        "customer_segments": f"with recursive {segment} select c_custkey, levenshtein(c_mktsegment, 'BUILDINGS')::int as lev, least(osa, 3) as osa, greatest(0.0::double, 1.0::double - levenshtein(c_mktsegment, 'MACHINE')::double / greatest(length(c_mktsegment), 7)) as similarity from customer join osa on l = c_mktsegment",
        "paths_scores": f"with {_PAIRS} select choice_id, list_min({lev})::int as least, list_max({sim}) as similarity, list_min({lev}) <= 1 as near from n",
        "cdist_distance": _on_pairs("least(levenshtein(query, choice), 11)::int"),
        "cdist_damerau_distance": _osa_on_pairs(),
        "cdist_combined_distance": _osa_on_pairs(),
        "cdist_normalized_similarity": _on_pairs(f"case when {_SIM} >= 0.25::double then {_SIM} else 0.0::double end"),
        "cdist_normalized_distance": _on_pairs(f"1.0::double - {_SIM}"),
        "cdist_ratio": _on_pairs(_SIM),
        "partial_alignment": f"{best} select query_id, choice_id, m.score::int as score, 0 as src_start, length(query)::int as src_end, m.start::int as dest_start, (m.start + m.size)::int as dest_end from s",
        "partial_distance": f"{best} select query_id, query, choice_id, choice, least(m.score, 4)::int as score from s",
        "partial_ratio": f"{_SPANS} select query_id, query, choice_id, choice, max({_SIM.replace('choice', 'span')}) as score from z group by all",
        "extract_topk": f"{ranked}, r as (select *, row_number() over (partition by query_id order by score, choice_id)::int as rank from s) select query_id, rank, choice, choice_id, score from r where rank <= 5",
        "extract_one": f"with {_PAIRS}, s as (select *, {_SIM} as score from p), r as (select *, row_number() over (partition by query_id order by score desc, choice_id) as k from s where score >= 0.2::double) select query_id, choice, choice_id, score from r where k = 1",
        "within_join": "select a.s_suppkey as a_key, b.s_suppkey as b_key, levenshtein(a.s_name, b.s_name)::int as distance from supplier a, supplier b where levenshtein(a.s_name, b.s_name) <= 1",
        "kana_normalize": f"select n_nationkey, translate(upper(n_name), '{_LATIN}', '{_HIRA}') as kana, upper(n_name) as plain from nation",
        "pinyin_normalize": f"with t as (select p_partkey, {tokens} as t from part) select p_partkey, regexp_replace(array_to_string([case when regexp_matches(x, '[a-z]') then regexp_replace(x, '[1-5]', '', 'g') else x end for x in t], ''), '([A-Za-z])[1-5]+', '\\1', 'g') as no_tone, array_to_string(t, '') as tone3 from t",
        "ja_distance": _on_pairs("levenshtein(query, choice)::int"),
        "ja_ratio": _on_pairs(_SIM),
        "zh_distance": _on_pairs(f"levenshtein({asked}, {direct})::int"),
        "ja_compare": f"with recursive {_PAIRS}, {_OSA.format(l='query', r='choice', source='p')} select query_id, choice_id, levenshtein(query, choice)::int as surface_levenshtein, osa as surface_damerau, levenshtein(query, choice)::int as lattice, osa as lattice_damerau, least(osa, levenshtein(query, choice))::int as combined from p join osa on query = l and choice = r",
        "zero_distance_join": f"with {_PAIRS} select a.choice_id, b.choice_id as tight_id from n a join n b on replace(a.choice, ' ', '') = replace(b.choice, ' ', '')",
        "reading_paths": f"select distinct '茶道具' || translate(upper(n_name), '{_LATIN}', '{_KATA}') as text, 'チャドーグ' || translate(upper(n_name), '{_LATIN}', '{_KATA}') as reading from nation",
        "romaji_spellings": f"with recursive p as (select n_nationkey, translate(upper(n_name), '{_LATIN}', '{_KATA}') as r from nation), rd as (select distinct r as t, r as reading from p), {readings.SPELLINGS} select n_nationkey, s as spelling from p join sp on sp.t = p.r",
    } | readings.oracles(_OSA)
