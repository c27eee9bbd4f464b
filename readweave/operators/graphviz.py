"""Graphviz text of readings, for looking at one pair on the driver."""

from __future__ import annotations

from readweave.functions import kernels as K
from readweave.functions import readings as R
from readweave.functions.readings import Options
from readweave.functions.romaji import fold_width


def lattice_of(text: str, lang: str, entries: dict[str, list[str]], options: Options | None = None) -> K.Lattice:
    """A text's lattice by a small lexicon."""

    def find(s: str) -> list[str] | None:
        return entries.get(s) or (entries.get(fold_width(s)) if lang == "ja" else None)

    if lang == "ja":
        return R.ja_lattice(text, find, options or Options())
    return K.Lattice.of_paths(R.zh_paths(text, find, options or Options()))


def lattice_dot(text: str, lang: str, entries: dict[str, list[str]] | None = None, options: Options | None = None) -> str:
    return K.dot([(text, lattice_of(text, lang, entries or {}, options), None)])


def pair_dot(left: str, right: str, lang: str, entries: dict[str, list[str]] | None = None, options: Options | None = None) -> str:
    """Both lattices, the right one first, with the paths of a best alignment marked."""
    a, b = (lattice_of(t, lang, entries or {}, options) for t in (left, right))
    _, steps = K.lattice_trace(a, b)
    return K.dot([(right, b, "".join(y or "" for *_, y in steps)), (left, a, "".join(x or "" for _, x, _ in steps))])
