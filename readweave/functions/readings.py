"""Readings of one text by a lexicon: segmentation into surfaces, and the choice between direct and lexicon spellings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from readweave.functions import romaji
from readweave.functions.kernels import Lattice
from readweave.functions.romaji import ReadingError, Unsupported

Find = Callable[[str], list[str] | None]
#: In the order in which they are reported
STATS = ("matched_spans", "longest_match_pruned_spans", "direct_fallback_spans", "raw_segment_readings", "used_segment_readings", "pruned_segment_readings", "candidate_combinations", "unique_paths", "duplicate_joined_readings", "max_paths_hit_count")
# The largest options
MOST = {"max_span_chars": 256, "max_paths": 16_384, "max_readings_per_segment": 256}


@dataclass(frozen=True)
class Options:
    max_span_chars: int = 8
    max_paths: int = 1024
    longest_match_only: bool = False
    max_readings_per_segment: int | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name == "longest_match_only":
                if not isinstance(v, bool):
                    raise TypeError("longest_match_only must be a bool")
            elif v is not None:
                if isinstance(v, bool) or not isinstance(v, int):
                    raise TypeError(f"{f.name} must be an int")
                if not 0 <= v <= MOST[f.name]:
                    raise ValueError(f"{f.name} must be between 0 and {MOST[f.name]}")

    def but(self, **changes) -> "Options":
        """With the given options in place of these, where they are not None."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


@dataclass(frozen=True)
class Path:
    """A joined reading and its segments: (surface, reading, "Dictionary" or "Direct")."""

    reading: str
    segments: tuple[tuple[str, str, str], ...]


def direct_end(text: str, start: int, usable: Callable[[str], bool]) -> int | None:
    """The end of the longest run from `start` whose every beginning can be read as it is."""
    end = start
    while end < len(text) and usable(text[start : end + 1]):
        end += 1
    return end if end > start else None


def segmentations(text: str, find: Find, o: Options, lang: str, hybrid: bool) -> tuple[list[Path], Counter]:
    """Paths through the whole text, from the end to the beginning, in the order of their joined readings.

    At each place, spans that the lexicon has are tried from short to long, their readings in order, before each path of
    the rest; the first segmentation of a joined reading counts, and `max_paths` readings end the place. A hybrid search
    also takes the one longest run that can be read as it is.
    """
    stats: Counter = Counter()
    n = len(text)
    if not n or not o.max_span_chars or not o.max_paths:
        return [], stats
    usable = romaji.can_spell if lang == "ja" else is_direct
    rest: list[list[Path]] = [[] for _ in range(n)] + [[Path("", ())]]
    longest = o.longest_match_only and not (hybrid and lang == "ja")
    for start in range(n - 1, -1, -1):
        here: dict[str, Path] = {}

        def extend(surface: str, reading: str, source: str, end: int, here=here) -> bool:
            """False once the place is full."""
            for tail in rest[end]:
                stats["candidate_combinations"] += 1
                joined = reading + tail.reading
                if joined in here:
                    stats["duplicate_joined_readings"] += 1
                else:
                    here[joined] = Path(joined, ((surface, reading, source), *tail.segments))
                    stats["unique_paths"] += 1
                if len(here) >= o.max_paths:
                    stats["max_paths_hit_count"] += 1
                    return False
            return True

        spans = [(end, found) for end in range(start + 1, min(n, start + o.max_span_chars) + 1) if rest[end] and (found := find(text[start:end])) is not None]
        stats["matched_spans"] += len(spans)
        if longest and spans:
            stats["longest_match_pruned_spans"] += len(spans) - 1
            spans = spans[-1:]
        room = True
        for end, found in spans:
            used = found if o.max_readings_per_segment is None else found[: o.max_readings_per_segment]
            stats["raw_segment_readings"] += len(found)
            stats["used_segment_readings"] += len(used)
            stats["pruned_segment_readings"] += len(found) - len(used)
            room = all(extend(text[start:end], r, "Dictionary", end) for r in used)
            if not room:
                break
        if hybrid and room and (end := direct_end(text, start, usable)) and rest[end]:
            stats["direct_fallback_spans"] += 1
            surface = text[start:end]
            extend(surface, surface if lang == "ja" else direct_pinyin(surface), "Direct", end)
        rest[start] = [here[k] for k in sorted(here)]
    return rest[0], stats


# Chinese


def is_direct(text: str) -> bool:
    return bool(text) and all(c < "\x80" or c in romaji.WHITE or romaji.is_neutral(c) for c in text)


def direct_pinyin(text: str) -> str:
    kept = "".join(c for c in text if c not in romaji.WHITE)
    return "".join(c.lower() if c.isascii() else c for c in kept).replace("u:", "v")


def zh_paths(text: str, find: Find, o: Options) -> list[str]:
    if is_direct(text):
        return [direct_pinyin(text)]
    for hybrid in (False, True):
        if some := segmentations(text, find, o, "zh", hybrid)[0]:
            return [p.reading for p in some]
    raise Unsupported(f"no reading of {text!r}")


# Japanese


def has_ascii(text: str) -> bool:
    return any(c.isascii() and c.isalnum() for c in text)


def _pieces(path: Path) -> list[tuple[str, bool]]:
    return [(reading, source == "Direct") for _, reading, source in path.segments]


def _whole(text: str, find: Find, o: Options) -> list[str]:
    found = find(text) or []
    return found if o.max_readings_per_segment is None else found[: o.max_readings_per_segment]


def _ascii_word_known(text: str, find: Find) -> bool:
    """Whether a run of ASCII letters and digits within other characters is a surface. A single one counts at the start
    of the text or before its end only."""
    if text.isascii() or not has_ascii(text):
        return False
    i = 0
    while i < len(text):
        if not has_ascii(text[i]):
            i += 1
            continue
        j = i
        while j < len(text) and has_ascii(text[j]):
            j += 1
        if (i == 0 or j < len(text) or j - i > 1) and find(text[i:j]) is not None:
            return True
        i = j
    return False


def ja_lattice(text: str, find: Find, o: Options) -> Lattice:
    ascii_inside = has_ascii(text)
    if not ascii_inside:
        try:
            return romaji.romaji_lattice(text)
        except ReadingError:
            pass
        joined = [[(p.reading, False)] for p in segmentations(text, find, o, "ja", False)[0]]
        if joined and (lat := romaji.lattice_of_readings(joined)):
            return lat
    elif romaji.can_spell(text):
        ways = [[(text, True)], *([(r, False)] for r in _whole(text, find, o))]
        if _ascii_word_known(text, find):
            ways += [_pieces(p) for p in segmentations(text, find, o, "ja", True)[0]]
        if lat := romaji.lattice_of_readings(ways):
            return lat
    for hybrid in (False, True):
        some = segmentations(text, find, o, "ja", hybrid)[0]
        if some and (lat := romaji.lattice_of_readings([_pieces(p) for p in some])):
            return lat
    return romaji.romaji_lattice(text)


def _spelled(ways: list[list[tuple[str, bool]]]) -> set[str]:
    """Spellings of all ways that can be spelled; over the limits is an error."""
    out: set[str] = set()
    for segments in ways:
        if sum(len(t) for t, _ in segments) > romaji.MAX_CHARS:
            raise romaji.OverLimit(f"more than {romaji.MAX_CHARS} characters")
        try:
            out.update(romaji.spell([u for t, surface in segments for u in romaji.units(t, surface)]))
        except (romaji.Unsupported, romaji.NoVariant):
            continue
        if len(out) > romaji.MAX_PATHS:
            raise romaji.OverLimit(f"more than {romaji.MAX_PATHS} spellings")
    return out


def ja_paths(text: str, find: Find, o: Options) -> list[str]:
    try:
        direct = romaji.romaji_paths(text)
    except ReadingError as e:
        error = e
    else:
        if not has_ascii(text):
            return direct
        out = set(direct) | _spelled([[(r, False)] for r in _whole(text, find, o)])
        if _ascii_word_known(text, find):
            out |= _spelled([_pieces(p) for p in segmentations(text, find, o, "ja", True)[0]])
        return sorted(out)
    for hybrid in (False, True):
        if out := _spelled([_pieces(p) for p in segmentations(text, find, o, "ja", hybrid)[0]]):
            return sorted(out)
    raise error
