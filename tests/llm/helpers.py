"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
CLASHING = "id long, n long, key string, spans string, _chunk int, row string, score double, line_no int, piece int, item long, stand long"


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def edited(text: str, seed: int, edits: int) -> str:
    draw, parts = random.Random(seed), text.split(" ")
    for _ in range(edits):
        parts[draw.randrange(len(parts))] = f"x{draw.randrange(10**6)}"
    return " ".join(parts)


def awkward_texts() -> list[str | None]:
    base = prose(1, 120)
    passage = prose(2, 60)
    return [
        None,
        "",
        " ",
        "\n\n",
        "one",
        "One",
        "one two three four",
        "one two three four five",
        "ONE two\tthree four\nfive",
        base,
        base,
        base,
        base.upper(),
        edited(base, 3, 3),
        edited(base, 4, 12),
        prose(5, 80) + " " + passage + " " + prose(6, 30),
        passage + "\n" + prose(7, 50),
        "é ß 日本語 " * 40,
        "a a a a a " * 30,
        prose(8, 30_000, 5000),
        "  lead and trail  ",
        "tab\tand\x0bvertical\x0cfeed\r\nend",
        "nbsp\xa0here and <|endoftext|> there",
        "x" * 5000,
    ]


def documents(spark, texts=None, clash: bool = True, first: int = 0):
    """(doc_id, text) and, with ``clash``, columns named like those the operators use inside."""
    texts = awkward_texts() if texts is None else texts
    rows = [(first + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        for column in CLASHING.split(", "):
            name, kind = column.split()
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


def repeated_spans(texts: list[str | None], window: int) -> list[tuple[int, int, bytes]]:
    split = [words(t) for t in texts]
    seen = collections.Counter(b" ".join(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[b" ".join(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingle_set(text: str | None, n: int = 5) -> set:
    w = [bytes(x).lower() for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def roots(count: int, links) -> list[int]:
    parent = list(range(count))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(count)]


def jaccard_roots(sets: list[set], percent: int = 75) -> list[int]:
    def linked(a, b):
        common = len(a & b)
        return a and b and 100 * common >= percent * (len(a) + len(b) - common)

    return roots(len(sets), [(i, j) for j in range(len(sets)) for i in range(j) if linked(sets[i], sets[j])])
