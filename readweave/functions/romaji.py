"""Kana to romaji: units of a text, the variants of each, and the lattice or list of all spellings."""

from __future__ import annotations

from readweave.functions.kernels import Lattice

# Spellings of kana units
VARIANTS: dict[str, tuple[str, ...]] = {
    "あ": ("a",), "い": ("i",), "う": ("u",), "え": ("e",), "お": ("o",),
    "か": ("ka",), "き": ("ki",), "く": ("ku",), "け": ("ke",), "こ": ("ko",),
    "さ": ("sa",), "し": ("si", "shi", "ci"), "す": ("su",), "せ": ("se",), "そ": ("so",),
    "た": ("ta",), "ち": ("ti", "chi"), "つ": ("tu", "tsu"), "て": ("te",), "と": ("to",),
    "な": ("na",), "に": ("ni",), "ぬ": ("nu",), "ね": ("ne",), "の": ("no",),
    "は": ("ha",), "ひ": ("hi",), "ふ": ("hu", "fu"), "へ": ("he",), "ほ": ("ho",),
    "ま": ("ma",), "み": ("mi",), "む": ("mu",), "め": ("me",), "も": ("mo",),
    "や": ("ya",), "ゆ": ("yu",), "よ": ("yo",),
    "ら": ("ra",), "り": ("ri",), "る": ("ru",), "れ": ("re",), "ろ": ("ro",),
    "わ": ("wa",), "を": ("wo", "o"), "ん": ("n", "nn", "m"),
    "が": ("ga",), "ぎ": ("gi",), "ぐ": ("gu",), "げ": ("ge",), "ご": ("go",),
    "ざ": ("za",), "じ": ("zi", "ji"), "ず": ("zu",), "ぜ": ("ze",), "ぞ": ("zo",),
    "だ": ("da",), "ぢ": ("di", "ji"), "づ": ("du", "zu"), "で": ("de",), "ど": ("do",),
    "ば": ("ba",), "び": ("bi",), "ぶ": ("bu",), "べ": ("be",), "ぼ": ("bo",),
    "ぱ": ("pa",), "ぴ": ("pi",), "ぷ": ("pu",), "ぺ": ("pe",), "ぽ": ("po",), "ゔ": ("vu",),
    "ぁ": ("xa", "la"), "ぃ": ("xi", "li"), "ぅ": ("xu", "lu"), "ぇ": ("xe", "le"), "ぉ": ("xo", "lo"),
    "ゃ": ("xya", "lya"), "ゅ": ("xyu", "lyu"), "ょ": ("xyo", "lyo"), "っ": ("xtu", "ltu", "ttu"), "ー": ("-",),
    "しゃ": ("sya", "sha", "cya"), "しゅ": ("syu", "shu", "cyu"), "しょ": ("syo", "sho", "cyo"),
    "ちゃ": ("tya", "cha", "cya"), "ちゅ": ("tyu", "chu", "cyu"), "ちょ": ("tyo", "cho", "cyo"),
    "じゃ": ("zya", "ja", "jya"), "じゅ": ("zyu", "ju", "jyu"), "じょ": ("zyo", "jo", "jyo"),
}
# The other digraphs have one spelling, these consonants before ya, yu, yo
for _kana, _consonant in {"き": "ky", "に": "ny", "ひ": "hy", "み": "my", "り": "ry", "ぎ": "gy", "び": "by", "ぴ": "py"}.items():
    for _small, _vowel in {"ゃ": "a", "ゅ": "u", "ょ": "o"}.items():
        VARIANTS[_kana + _small] = (_consonant + _vowel,)
# What a long-vowel mark may stand for after each vowel
LONG = {"a": ("a", "-"), "i": ("i", "-"), "u": ("u", "-"), "e": ("e", "i", "-"), "o": ("o", "u", "-"), "": ("-",)}
SMALL_Y = {"ゃ": "ya", "ゅ": "yu", "ょ": "yo"}
# Limits on written-out spellings
MAX_CHARS, MAX_PATHS, MAX_SYMBOLS = 1024, 65_536, 1_048_576
#: Punctuation that a surface may hold as it is: (first, last)
NEUTRAL = ((0xB7, 0xB7), (0x2010, 0x2015), (0x2018, 0x201F), (0x2026, 0x2026), (0x3001, 0x3002), (0x3008, 0x3011), (0x3014, 0x301F), (0x3030, 0x3030), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
#: White space by Unicode's property (Python's isspace also has U+001C to U+001F)
WHITE = frozenset(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


class ReadingError(ValueError):
    """A text that can't be spelled out."""


class Unsupported(ReadingError):
    """A character that is neither ASCII nor kana (nor neutral punctuation, in a surface)."""


class NoVariant(ReadingError):
    """A kana without a spelling in the table."""


class OverLimit(ReadingError):
    """More spellings than the limits on written-out paths."""


def hiragana(c: str) -> str:
    return chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c


def is_kana(c: str) -> bool:
    return "ぁ" <= hiragana(c) <= "ゖ" or c == "ー"


def is_neutral(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in NEUTRAL)


def fold_width(s: str) -> str:
    return "".join(" " if c == "　" else chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in s)


def units(text: str, surface: bool = True) -> list[tuple[str, bool]]:
    """(unit, is it kana) in order; digraphs of the table are taken greedily. Readings admit no punctuation."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        i += 1
        if c in WHITE:
            out.append((" ", False))
        elif c < "\x80" or surface and is_neutral(c):
            out.append((c, False))
        elif not is_kana(c):
            raise Unsupported(f"unsupported character {c!r} at {i - 1}")
        else:
            pair = hiragana(c) + hiragana(text[i]) if i < len(text) else ""
            if len(pair) == 2 and pair in VARIANTS:
                out.append((pair, True))
                i += 1
            else:
                out.append((hiragana(c), True))
    return out


def _spellings(unit: tuple[str, bool]) -> tuple[str, ...]:
    if not unit[1]:
        return (unit[0],)
    if unit[0] not in VARIANTS:
        raise NoVariant(f"no spelling of {unit[0]!r}")
    return VARIANTS[unit[0]]


def steps(some: list[tuple[str, bool]]) -> list[tuple[str, ...] | None]:
    """The spellings at each step; None stands for a long-vowel mark, which depends on the last vowel."""
    out: list[tuple[str, ...] | None] = []
    i = 0
    while i < len(some):
        unit, kana = some[i]
        after = some[i + 1] if i + 1 < len(some) else None
        i += 1
        if kana and unit == "ー":
            out.append(None)
        elif not kana and unit.isascii() and unit.isalpha() and unit.lower() not in "aiueo" and after and after[1] and after[0] in SMALL_Y:
            out.append(tuple(dict.fromkeys(unit + s for s in (SMALL_Y[after[0]], *VARIANTS[after[0]]))))
            i += 1
        elif kana and unit == "っ":
            # besides its own spellings, the doubled first consonant of what follows
            doubled = [s[0] for s in _spellings(after) if s[0] not in "aiueon-"] if after else []
            out.append(tuple(dict.fromkeys([*VARIANTS["っ"], *doubled])))
        else:
            out.append(tuple(dict.fromkeys(_spellings((unit, kana)))))
    return out


def _vowel(path: str, last: str) -> str:
    return next((c for c in reversed(path) if c in "aiueo"), last)


def spell(some: list[tuple[str, bool]]) -> list[str]:
    """All spellings written out, in the order of the variants."""
    paths = [""]
    for step in steps(some):
        new: list[str] = []
        total = 0
        if step is not None and len(paths) * len(step) > MAX_PATHS:
            raise OverLimit(f"more than {MAX_PATHS} spellings")
        for p in paths:
            for s in LONG[_vowel(p, "")] if step is None else step:
                new.append(p + s)
                total += len(new[-1])
                if len(new) > MAX_PATHS or total > MAX_SYMBOLS:
                    raise OverLimit("more spellings than the limits")
        paths = new
    return paths


def romaji_paths(text: str) -> list[str]:
    if len(text) > MAX_CHARS:
        raise OverLimit(f"more than {MAX_CHARS} characters")
    return spell(units(text))


def can_spell(text: str, surface: bool = True) -> bool:
    """Whether all units have spellings, without writing them out."""
    try:
        steps(units(text, surface))
    except ReadingError:
        return False
    return True


class _Builder:
    """Grows a lattice step by step. Spellings meet again where they agree on the last vowel, the only thing that a later
    long-vowel mark looks back at, so lattices stay small where written-out spellings multiply."""

    def __init__(self) -> None:
        self.arcs: dict[tuple[int, int, str], None] = {}
        self.n = 1

    def node(self) -> int:
        self.n += 1
        return self.n - 1

    def chain(self, at: int, word: str, to: int) -> None:
        for c in word[:-1]:
            new = self.node()
            self.arcs[at, new, c] = None
            at = new
        self.arcs[at, to, word[-1]] = None

    def add(self, some: list[tuple[str, ...] | None], end: int) -> None:
        front = {"": 0}
        for k, step in enumerate(some):
            last = k == len(some) - 1
            new: dict[str, int] = {}
            for vowel, at in front.items():
                for word in LONG[vowel] if step is None else step:
                    v = _vowel(word, vowel)
                    to = end if last else new.setdefault(v, self.node()) if v not in new else new[v]
                    self.chain(at, word, to)
            front = new

    def lattice(self, end: int) -> Lattice:
        """Nodes renumbered so that arcs lead upwards."""
        follow: dict[int, list[int]] = {}
        degree = [0] * self.n
        for s, t, _ in self.arcs:
            follow.setdefault(s, []).append(t)
            degree[t] += 1
        order, ready = [], [i for i in range(self.n) if not degree[i]]
        while ready:
            x = ready.pop()
            order.append(x)
            for t in follow.get(x, ()):
                degree[t] -= 1
                if not degree[t]:
                    ready.append(t)
        place = {x: i for i, x in enumerate(order)}
        # all nodes but the end come from the start; the end has the largest number
        return Lattice(self.n, place[0], place[end], sorted({(place[s], place[t], c) for s, t, c in self.arcs}))


def lattice_of(alternatives: list[list[tuple[str, bool]]]) -> Lattice:
    """One lattice of alternative unit sequences."""
    spelled = [steps(a) for a in alternatives]
    if all(not s for s in spelled):
        return Lattice(1, 0, 0, [])
    builder = _Builder()
    end = builder.node()
    for s in spelled:
        if s:
            builder.add(s, end)
    return builder.lattice(end)


def romaji_lattice(text: str) -> Lattice:
    return lattice_of([units(text)])


def lattice_of_readings(inputs: list[list[tuple[str, bool]]], supported_only: bool = True) -> Lattice | None:
    """Alternatives as segments (text, is it a surface): each segment is cut into units by itself. Alternatives that can't
    be spelled are skipped, or raise; None if none is left."""
    kept = []
    for segments in inputs:
        try:
            some = [u for text, surface in segments for u in units(text, surface)]
            steps(some)
        except (Unsupported, NoVariant):
            if not supported_only:
                raise
            continue
        kept.append(some)
    return lattice_of(kept) if kept else None
