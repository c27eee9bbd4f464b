"""Kana and pinyin helpers as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from readweave.functions import romaji
from readweave.functions.text import Text, _c

_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
_WIDE = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = " " + "".join(map(chr, range(0x21, 0x7F)))
_WHITE = "[" + "".join(f"\\u{ord(c):04X}" for c in sorted(romaji.WHITE)) + "]"
_NEUTRAL = "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in romaji.NEUTRAL)


def normalize_kana(s: Text) -> Column:
    """Katakana to hiragana; the long-vowel mark and the rest stay."""
    return F.translate(_c(s), _KATAKANA, _HIRAGANA)


def is_kana(s: Text) -> Column:
    """Whether every character (at least one) is kana or the long-vowel mark."""
    return _c(s).rlike("^[\\u3041-\\u3096\\u30A1-\\u30F6\\u30FC]+$")


def fold_width(s: Text) -> Column:
    """Full-width ASCII and the ideographic space to their plain forms."""
    return F.translate(_c(s), _WIDE, _NARROW)


def _drop_tones(s: Column) -> Column:
    return F.regexp_replace(s, "(?<=[A-Za-z])[1-5]+", "")


def _plain_u(s: Column) -> Column:
    return F.replace(F.replace(F.lower(s), F.lit("u:"), F.lit("v")), F.lit("ü"), F.lit("v"))


def normalize_pinyin(s: Text, view: str = "no-tone") -> Column:
    """A pinyin field, token by token: lower case, u: and ü as v; without tones, digits 1 to 5 go from tokens that have
    letters. Tokens are joined, and digits that now follow a letter go too."""
    keep = check_view(view) == "tone3"
    tokens = F.filter(F.split(_c(s), _WHITE + "+"), lambda t: t != "")
    one = lambda t: _plain_u(t) if keep else F.when(_plain_u(t).rlike("[a-z]"), F.regexp_replace(_plain_u(t), "[1-5]", "")).otherwise(_plain_u(t))
    joined = F.array_join(F.transform(tokens, one), "")
    return joined if keep else _drop_tones(joined)


def check_view(view: str) -> str:
    if view in ("no-tone", "notone", "normal"):
        return "no-tone"
    if view == "tone3":
        return view
    raise ValueError("the pinyin view must be 'no-tone' or 'tone3'")


def normalize_direct_pinyin(s: Text) -> Column:
    """Pinyin typed as such: no white space, ASCII letters in lower case, u: as v."""
    upper = "".join(map(chr, range(65, 91)))
    return F.replace(F.translate(F.regexp_replace(_c(s), _WHITE, ""), upper, upper.lower()), F.lit("u:"), F.lit("v"))


def normalize_artifact_reading(s: Text, view: str = "no-tone") -> Column:
    out = F.regexp_replace(_plain_u(_c(s)), _WHITE, "")
    return out if check_view(view) == "tone3" else _drop_tones(out)


def is_direct_pinyin(s: Text) -> Column:
    """Not empty, and only ASCII, white space and neutral punctuation."""
    return _c(s).rlike(f"^[\\u0000-\\u007F{_WHITE[1:-1]}{_NEUTRAL}]+$")


@F.pandas_udf(ArrayType(StringType()))
def romaji_paths(s: pd.Series) -> pd.Series:
    """All spellings in the order of the variants; null where there is none, or more than the limits."""

    def one(x):
        try:
            return None if x is None else romaji.romaji_paths(x)
        except romaji.ReadingError:
            return None

    return s.map(one)


@F.pandas_udf(BooleanType())
def can_spell_surface(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else romaji.can_spell(x))


@F.pandas_udf(BooleanType())
def can_spell_reading(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else romaji.can_spell(x, surface=False))


@F.pandas_udf(StringType())
def romaji_lattice(s: pd.Series) -> pd.Series:
    """The packed lattice of all spellings; null where a character can't be spelled."""

    def one(x):
        try:
            return None if x is None else romaji.romaji_lattice(x).pack()
        except romaji.ReadingError:
            return None

    return s.map(one)
