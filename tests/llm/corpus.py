"""A small corpus with the awkward cases, and plain versions of what the operators compute."""

import random
import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOW) if lower else text or "")


def shingles(text, k=5):
    w = words(text, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def texts(seed=11, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé日") for _ in range(r.randint(1, 7))) for _ in range(120)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    out = []
    for i in range(n):
        w = [r.choice(vocabulary) + r.choice(["", "", "", ".", ",", "!"]) for _ in range(r.randint(0, 120))]
        if i % 7 == 3:
            w[r.randint(0, len(w)) : 0] = passage.split()
        t = "".join(x + r.choice([" ", " ", " ", "\n", "  ", "\t", "  "]) for x in w)
        out.append(t)
        if i % 5 == 0:  # a near copy
            c = list(w)
            if len(c) > 60:
                c[r.randrange(len(c))] = "changed"
            out.append(" ".join(c))
        if i % 9 == 0:  # an exact copy
            out.append(t)
    return [*out, "", None, " ", "\n\n", "One", "a b c", "A B C", None, "x " * 3000 + "end", "word " * 19, "word " * 20, "w" * 5000, "Ünï ÇÖDE ß 😀 " * 30]


def without_repeats(some, size=20):
    """(id, words, kept words) of (id, text) rows: words of windows that start earlier go."""
    seen, out = {}, []
    for i, t in some:
        w = words(t)
        for j in range(len(w) - size + 1):
            seen.setdefault(tuple(w[j : j + size]), []).append((i, j))
    for i, t in some:
        w = words(t)
        gone = {k for j in range(len(w) - size + 1) if min(seen[tuple(w[j : j + size])]) < (i, j) for k in range(j, j + size)}
        out.append((i, w, [x for k, x in enumerate(w) if k not in gone]))
    return out


def frame(spark, some=None, extra=True):
    """doc_id, text and columns whose names the operators use themselves."""
    rows = [(i, t) for i, t in enumerate(texts() if some is None else some)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "doc_id as row", "'x' as chunk", "text as w", "1.5D as score", "cast(null as string) as component") if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
