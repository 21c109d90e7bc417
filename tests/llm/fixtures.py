"""Odd rows, and plain-Python renditions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter

import xxhash

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Columns that carry names the operators use themselves.
CLASHING = "doc_id long, text string, fp string, score string, kept string, digest string, g string"
LONG = "many words of a very long text number " * 20_000


def odd_documents(spark):
    """Null, empty and blank texts, copies, a repeated row, a null id, a very long text."""
    texts = [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, "one"),
        (5, "One two three four five six seven eight nine ten eleven"),
        (6, "One  two three four five six seven eight nine ten eleven\n"),
        (7, "Onetwothreefourfivesixseveneightnineteneleven"),
        (8, LONG),
        (9, "naïve café 日本語 🙂 <|endoftext|>   ▁mark it's 12,5 A.B."),
        (10, "x y z\nx y z\n\nx y z\nx y z\nx y z\nx y z"),
        (10, "x y z\nx y z\n\nx y z\nx y z\nx y z\nx y z"),
        (None, "a text without an id, which is long enough to be kept as it is"),
    ]
    return spark.createDataFrame([(i, t, *"abcde") for i, t in texts], CLASHING)


def no_documents(spark):
    return spark.createDataFrame([], CLASHING)


def fingerprint(text: str) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        bits.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


def groups(links: list[tuple], nodes) -> dict:
    """Smallest connected node of every node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)
