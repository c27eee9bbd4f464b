"""Lexicons: DataFrames (surface string, readings array<string>), one row a surface, readings sorted and distinct.

Sources: UniDic and Sudachi CSV, CC-CEDICT text, override files. Sink and source of its own: Parquet sorted by surface,
so a lookup of few surfaces skips row groups, with a JSON file of metadata beside it.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readweave.functions import scripts
from readweave.functions.readings import Options
from readweave.functions.romaji import fold_width

SCHEMA = T.StructType([T.StructField("surface", T.StringType()), T.StructField("readings", T.ArrayType(T.StringType()))])
# Columns of the sources, from 0
UNIDIC = {"surface": 0, "pos1": 4, "lform": 10, "pron": 13}
SUDACHI = {"surface": 0, "normalized": 4, "pos1": 5, "reading": 11}
# Limits on a lexicon that is loaded
MAX_ENTRIES = {"ja": 3_000_000, "zh": 2_000_000}
MAX_READINGS, MAX_STRING_BYTES = 256, 16 * 1024


class LexiconError(ValueError):
    """A lexicon source or bundle that breaks its contract."""


def gather(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(surface, reading) rows to a lexicon; readings are sorted before `most` of them are kept."""
    readings = F.array_sort(F.collect_set("reading"))
    return rows.groupBy("surface").agg((readings if most is None else F.slice(readings, 1, most)).alias("readings")).where(F.size("readings") > 0)


def from_entries(spark: SparkSession, entries: Iterable[tuple[str, Iterable[str]]] | dict[str, Iterable[str]]) -> DataFrame:
    """A small lexicon from Python values."""
    items = entries.items() if isinstance(entries, dict) else entries
    return spark.createDataFrame([(s, sorted(set(r))) for s, r in items], SCHEMA)


def _csv(spark: SparkSession, path: str | list[str], columns: dict[str, int]) -> DataFrame:
    """Named columns of headerless CSV; a row that lacks one is an error."""
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(columns.values()) + 1)])
    raw = spark.read.schema(wide).csv(path, header=False, escape='"', mode="PERMISSIVE", emptyValue="", nullValue="\0")
    return raw.select(*[F.coalesce(F.col(f"c{i}"), F.raise_error(F.lit(f"a row has no column {i}"))).alias(name) for name, i in columns.items()])


def _ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def _named(rows: DataFrame, names: list[Column]) -> DataFrame:
    return rows.select(F.explode(F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull()))).alias("surface"), "reading")


def read_unidic(spark: SparkSession, path: str | list[str], *, field: str = "pron", exclude_ascii: bool = True, exclude_symbols: bool = True, max_readings: int | None = None) -> DataFrame:
    """UniDic lex.csv. Surfaces in full width are found in plain width too, even where plain ones are excluded."""
    if field not in ("pron", "lform"):
        raise ValueError("the reading field must be 'pron' or 'lform'")
    rows = _csv(spark, path, {"surface": UNIDIC["surface"], "pos1": UNIDIC["pos1"], "reading": UNIDIC[field]})
    rows = rows.where((F.col("surface") != "*") & (F.col("reading") != "*"))
    if exclude_ascii:
        rows = rows.where(~_ascii(F.col("surface")))
    if exclude_symbols:
        rows = rows.where(~F.col("pos1").contains("記号"))
    return gather(_named(rows, [F.col("surface"), scripts.fold_width("surface")]), max_readings)


def read_sudachi(spark: SparkSession, path: str | list[str], *, exclude_ascii: bool = True, exclude_symbols: bool = True, include_normalized: bool = True, exclude_unsupported: bool = False, max_readings: int | None = None) -> DataFrame:
    """Sudachi lexicon CSV (of one or more files), also by the normalized form."""
    rows = _csv(spark, path, SUDACHI)
    rows = rows.where(~F.col("surface").isin("*", "") & ~F.col("reading").isin("*", ""))
    if exclude_ascii:
        rows = rows.where(~_ascii(F.col("surface")))
    if exclude_symbols:
        rows = rows.where(~F.col("pos1").contains("記号"))
    if exclude_unsupported:
        # a reading is tested once, however many surfaces have it
        good = rows.select("reading").distinct().where(scripts.can_spell_reading("reading"))
        rows = rows.join(good, "reading", "left_semi")
    names = [F.col("surface"), scripts.fold_width("surface")]
    if include_normalized:
        usable = ~F.col("normalized").isin("*", "") & (~_ascii(F.col("normalized")) if exclude_ascii else F.lit(True))
        names.append(F.when(usable, F.col("normalized")))
    return gather(_named(rows, names), max_readings)


def read_cedict(spark: SparkSession, path: str | list[str], *, view: str = "no-tone", max_readings: int | None = None) -> DataFrame:
    """CC-CEDICT text: `traditional simplified [pinyin] /definition/`, by both surfaces. Malformed lines are an error."""
    lines = spark.read.text(path).select(F.rtrim(F.col("value"), F.lit("\r")).alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    pattern = r"^\s*(\S+)\s+(\S+)\s*(?:\[\[(.+?)\]\]|\[(?!\[)(.+?)\])\s*/"
    part = lambda i: F.regexp_extract("line", pattern, i)
    pinyin = F.concat(part(3), part(4))
    rows = lines.select(part(1).alias("traditional"), part(2).alias("simplified"), F.when(F.col("line").rlike(pattern), pinyin).otherwise(F.raise_error(F.concat(F.lit("not a CC-CEDICT entry: "), F.col("line")))).alias("pinyin"))
    rows = rows.select("traditional", "simplified", scripts.normalize_pinyin("pinyin", view).alias("reading")).where(F.col("reading") != "")
    return gather(_named(rows, [F.col("traditional"), F.col("simplified")]), max_readings)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """A YAML or JSON file {version: 1, entries: [{surface, readings}]}; its readings keep their order.

    A file of exceptions is small; it is read on the driver. YAML needs a YAML library.
    """
    return overrides(spark, _yaml_or_json(spark, path))


def _yaml_or_json(spark: SparkSession, path: str):
    raw = "".join(r["value"] + "\n" for r in spark.read.text(path).toLocalIterator())
    try:
        return json.loads(raw)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise LexiconError("YAML needs a YAML library; JSON does without") from e
        return yaml.safe_load(raw)


def read_payload(spark: SparkSession, path: str, *, lang: str) -> tuple[DataFrame, str | None]:
    """A YAML or JSON payload {schema_version: 1, payload_type, [pinyin_view], entries: [{surface, readings}]}: the lexicon
    and the view. Large lexicons belong into bundles, whose payload is Parquet."""
    data = _yaml_or_json(spark, path)
    if not isinstance(data, dict) or data.get("schema_version") != 1 or "payload_type" not in data:
        raise LexiconError("unknown payload")
    view = scripts.check_view(data["pinyin_view"]) if lang == "zh" else None
    lexicon = spark.createDataFrame([(e.get("surface"), e.get("readings")) for e in data.get("entries") or []], SCHEMA)
    check_lexicon(lexicon, lang)
    return lexicon, view


def overrides(spark: SparkSession, data: dict) -> DataFrame:
    if not isinstance(data, dict) or data.get("version") != 1:
        raise LexiconError("overrides must have version 1")
    seen: dict[str, list[str]] = {}
    for entry in data.get("entries") or []:
        surface, readings = str(entry["surface"]).strip(), [str(r).strip() for r in entry.get("readings") or []]
        if not surface:
            raise LexiconError("an override has an empty surface")
        if not readings or "" in readings:
            raise LexiconError(f"{surface}: no readings, or an empty one")
        if surface in seen or len(set(readings)) < len(readings):
            raise LexiconError(f"{surface}: repeated")
        seen[surface] = readings
    return spark.createDataFrame(list(seen.items()), SCHEMA)


# Bundles


def canonical_checksum(lexicon: DataFrame, header: str, view: str | None = None, algorithm: str = "sha256-canonical-v1") -> str:
    """A checksum over entries in the order of their surfaces, streamed through the driver a partition at a time."""
    if algorithm == "sha256-canonical-v1":
        state, take = hashlib.sha256(), None
    elif algorithm == "fnv1a64-canonical-v1":
        state, take = None, 0xCBF29CE484222325
    else:
        raise LexiconError(f"unknown checksum {algorithm!r}")

    def put(data: bytes) -> None:
        nonlocal take
        if state is not None:
            state.update(data)
        else:
            for b in data:
                take = ((take ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF

    def text(tag: bytes, s: str) -> None:
        raw = s.encode()
        put(tag + str(len(raw)).encode() + b"\n" + raw + b"\n")

    put(header.encode() + b"\n")
    if view is not None:
        text(b"V", view)
    for row in lexicon.orderBy("surface").toLocalIterator():
        text(b"S", row["surface"])
        put(f"R{len(row['readings'])}\n".encode())
        for r in row["readings"]:
            text(b"r", r)
    return state.hexdigest() if state is not None else f"{take:016x}"


def check_lexicon(lexicon: DataFrame, lang: str) -> int:
    """The number of entries; an error where one breaks the contract or a limit."""
    long = lambda c: F.octet_length(c) > MAX_STRING_BYTES
    bad = F.col("surface").isNull() | (F.col("surface") == "") | F.col("readings").isNull() | (F.size("readings") == 0) | (F.size("readings") > MAX_READINGS) | long("surface")
    bad = bad | F.exists("readings", lambda r: r.isNull() | (r == "") | long(r)) | (F.size(F.array_distinct("readings")) < F.size("readings"))
    if lang == "zh":
        bad = bad | F.exists("readings", lambda r: r != scripts.normalize_artifact_reading(r, "tone3"))
    got = lexicon.agg(F.count("*").alias("n"), F.count_distinct("surface").alias("surfaces"), F.count(F.when(bad, 1)).alias("bad")).first()
    if got["bad"] or got["surfaces"] < got["n"]:
        raise LexiconError(f"{got['bad']} entries are malformed, {got['n'] - got['surfaces']} repeat a surface")
    if got["n"] > MAX_ENTRIES[lang]:
        raise LexiconError(f"over {MAX_ENTRIES[lang]} entries")
    return got["n"]


HEADER = "readweave.lexicon/v1"


def _hadoop(spark: SparkSession, path: str):
    """A path with its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of each data file of a folder, by name. Files are read by the executors; a payload has few."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return {r["name"]: r["digest"] for r in files.where(~F.col("name").startswith("_") & ~F.col("name").startswith(".")).orderBy("name").collect()}


def inside(folder: str, path: str) -> str:
    """A path that a bundle names, within the bundle's folder; an error where it leads out."""
    parts = path.split("/")
    if not path or path.startswith("/") or ":" in path or "\\" in path or ".." in parts:
        raise LexiconError(f"{path!r} leads out of the bundle")
    return f"{folder.rstrip('/')}/{path}"


def save_bundle(lexicon: DataFrame, path: str, *, lang: str, name: str, source: str = "", view: str | None = None, defaults: Options | None = None, license_refs: list[dict[str, str]] | None = None) -> dict:
    """Write the Parquet payload and its metadata; returns the metadata. `license_refs` are {label, path} of files that
    stand, or will stand, in the bundle's folder."""
    if lang not in MAX_ENTRIES:
        raise ValueError("lang must be 'ja' or 'zh'")
    spark = lexicon.sparkSession
    lexicon.select("surface", "readings").sort("surface").write.mode("overwrite").parquet(f"{path}/payload")
    stored = spark.read.parquet(f"{path}/payload")
    meta = {
        "schema_version": 1, "lang": lang, "name": name, "source": source, "pinyin_view": view, "entries": check_lexicon(stored, lang), "checksum_algorithm": "sha256-canonical-v1",
        "checksum": canonical_checksum(stored, HEADER, view), "defaults": vars(defaults or Options()), "license": license_refs or [],
        "payload": {"path": "payload", "file_digest_algorithm": "sha256-file-v1", "files": file_digests(spark, f"{path}/payload")},
    }
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return meta


class Bundle:
    """A stored lexicon with its metadata and default options."""

    def __init__(self, lexicon: DataFrame, meta: dict) -> None:
        self.lexicon, self.meta = lexicon, meta
        self.lang: str = meta["lang"]
        self.options = Options(**meta["defaults"])


def load_bundle(spark: SparkSession, path: str, *, lang: str | None = None, verify: bool = True) -> Bundle:
    """A stored lexicon. Paths that its metadata names must lie in its folder, and the license files must be there. With
    `verify`, so must exactly the payload files that the metadata lists, unchanged, and entries and checksum must agree.
    Metadata without file digests (older bundles) is checked by entries and checksum alone."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    if meta.get("schema_version") != 1 or meta.get("lang") not in MAX_ENTRIES:
        raise LexiconError("unknown bundle")
    if lang is not None and meta["lang"] != lang:
        raise LexiconError(f"a bundle for {meta['lang']}, not {lang}")
    for ref in meta.get("license") or []:
        place, store = _hadoop(spark, inside(path, ref["path"]))
        if not store.exists(place):
            raise LexiconError(f"the license file of {ref.get('label')} is missing")
    payload = meta.get("payload") or {"path": "payload"}
    folder = inside(path, payload["path"])
    if verify and "files" in payload:
        if payload.get("file_digest_algorithm") != "sha256-file-v1":
            raise LexiconError(f"unknown file digest {payload.get('file_digest_algorithm')!r}")
        if file_digests(spark, folder) != payload["files"]:
            raise LexiconError("the digests of the payload's files differ from the metadata")
    lexicon = spark.read.schema(SCHEMA).parquet(folder)
    if verify:
        if check_lexicon(lexicon, meta["lang"]) != meta["entries"]:
            raise LexiconError("the number of entries differs from the metadata")
        if canonical_checksum(lexicon, HEADER, meta["pinyin_view"], meta["checksum_algorithm"]) != meta["checksum"]:
            raise LexiconError("the checksum differs from the metadata")
    return Bundle(lexicon, meta)


def write_payload(lexicon: DataFrame, path: str, *, payload_type: str, view: str | None = None) -> None:
    """A payload file as `read_payload` takes it: JSON, which is YAML too, with an entry in each line, in the order of the
    surfaces. The folder `path` has the one file."""
    head = json.dumps({"schema_version": 1, "payload_type": payload_type, **({"pinyin_view": view} if view else {})}, ensure_ascii=False)[:-1] + ', "entries": ['
    first = lexicon.agg(F.min("surface").alias("first"))
    entry = F.to_json(F.struct("surface", "readings"))
    rows = lexicon.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), "surface", F.when(F.col("surface") == F.col("first"), entry).otherwise(F.concat(F.lit(","), entry)).alias("value"))
    spark = lexicon.sparkSession
    ends = spark.createDataFrame([(0, None, head), (2, None, "]}")], "part int, surface string, value string")
    rows.union(ends).orderBy("part", "surface").select("value").coalesce(1).write.mode("overwrite").text(path)


def list_bundles(spark: SparkSession, root: str) -> list[tuple[str, dict]]:
    """(path, metadata) of the bundles in a folder, in the order of their names."""
    folder, store = _hadoop(spark, root)
    if not store.exists(folder):
        return []
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    paths = sorted(f.getPath().toString() for f in store.listStatus(folder) if f.isDirectory() and store.exists(make(f.getPath(), "metadata")))
    return [(p, json.loads(spark.read.text(f"{p}/metadata").first()["value"])) for p in paths]


def lookup(lexicon: DataFrame, surface: str, lang: str = "ja") -> list[str] | None:
    """Readings of one surface; in Japanese, of its plain-width form if it has none."""
    found = {r["surface"]: r["readings"] for r in lexicon.where(F.col("surface").isin(surface, fold_width(surface) if lang == "ja" else surface)).collect()}
    return found.get(surface) or (found.get(fold_width(surface)) if lang == "ja" else None)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


#: Folders of bundles in which default lexicons are looked for, separated like search paths
ROOTS = "READWEAVE_LEXICONS"
#: The names that calls know lexicons by, and their languages
NAMES = {"ja": "ja", "ja-unidic": "ja", "ja-sudachi": "ja", "zh": "zh"}
_defaults: dict[str, Bundle] = {}


def check_lang(lang: str) -> str:
    """The language of a name; `ja-unidic` and `ja-sudachi` tell which Japanese lexicon is meant."""
    if not isinstance(lang, str):
        raise TypeError("the language is a str")
    if lang not in NAMES:
        raise ValueError(f"the language is one of {', '.join(NAMES)}, not {lang!r}")
    return NAMES[lang]


def set_default(bundle: Bundle, name: str | None = None) -> None:
    """Use a bundle where a call gives a name only: its language, or one of the names that tell lexicons apart."""
    if name is not None and check_lang(name) != bundle.lang:
        raise ValueError(f"{name!r} is no name for a lexicon of {bundle.lang}")
    _defaults[name or bundle.lang] = bundle


def get_default(name: str) -> Bundle | None:
    """The bundle that was set for a name; `ja` and `ja-unidic` stand for each other."""
    check_lang(name)
    return _defaults.get(name) or _defaults.get({"ja": "ja-unidic", "ja-unidic": "ja"}.get(name, ""))


def clear_default(name: str | None = None) -> None:
    if name is None:
        _defaults.clear()
        return
    check_lang(name)
    _defaults.pop(name, None)


def find_default(spark: SparkSession, name: str) -> Bundle | None:
    """The bundle for a name: the one that was set, else the first in the folders of $READWEAVE_LEXICONS, whose source
    names Sudachi exactly if the name does. What is found is verified, and kept as the name's default."""
    if (known := get_default(name)) is not None:
        return known
    for root in filter(None, os.environ.get(ROOTS, "").split(os.pathsep)):
        for path, meta in list_bundles(spark, root):
            if meta.get("lang") == check_lang(name) and ("sudachi" in str(meta.get("source")).lower()) == (name == "ja-sudachi"):
                set_default(load_bundle(spark, path), name)
                return _defaults[name]
    return None


def resolve(lang: str | None, lexicon: DataFrame | Bundle | None, options: Options | None) -> tuple[str, DataFrame, Options]:
    """Language, lexicon and options of a call; a bundle's own options stand where none are given."""
    if isinstance(lexicon, Bundle):
        if lang is not None and check_lang(lang) != lexicon.lang:
            raise ValueError("the bundle is for another language")
        return lexicon.lang, lexicon.lexicon, options or lexicon.options
    if lexicon is not None:
        if lang is None:
            raise ValueError("a lexicon needs its language")
        return check_lang(lang), lexicon, options or Options()
    spark = SparkSession.getActiveSession()
    bundle = find_default(spark, lang) if spark is not None else get_default(lang)
    if bundle is None:
        raise LookupError(f"no default lexicon for {lang}; set one, pass one, or name a folder of bundles in ${ROOTS}")
    return bundle.lang, bundle.lexicon, options or bundle.options
