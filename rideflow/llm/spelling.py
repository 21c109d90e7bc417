"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

The vocabulary is dealt to lists in which every pair one edit apart meets once. Two words, the
shorter of length s, differ from their first different character on; if that lies in the second half
they share their first half, else their last. So a word is listed under its halves, for its own
length as s and for one less; a list has the words of length s and s + 1 under one half, and holds
the rest of each word. A list that is too long is halved again by the same rule, until none is or
single characters are left, so no list grows with the vocabulary.

A task sorts the rests of its lists into one list, the list's number standing in front, and goes
through it by character. The words that share their beginning so far are a range, given by the common
prefix lengths (LCP) of neighbours, and have one banded row of the edit matrix in common: a pair of
ranges carries the three cells within one edit of the diagonal to all pairs of their subranges, and a
pair whose cells exceed one edit is skipped with all words in it. All pairs of ranges of one length
advance together in numpy.

Words are runs of letters, lower-cased for A-Z; a drawn one in ``MISSPELT`` loses a character, known
by a checksum of the document's id and the run. Null texts have no words; a null id counts as an
empty one. Very long texts and words are taken whole. Repeated rows count each time. Of near words
with equal numbers the smallest in code-point order is the form. An empty table gives no rows. Other
columns of any name are no matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rideflow.session import stage

RUN = "[A-Za-zÀ-ÿ]+"
MISSPELT = 97
SHORTEST = 5
FEWEST = 3
RATIO = 2
# Words in a list; a longer one is halved unless single characters are left.
MOST_LISTED = 2048
# Pairs of words that the lists a task takes together may make.
_PAIRS = 1 << 22
_ROWS = 1 << 15
# Characters that they may hold, the longest word counting for all.
_CELLS = 1 << 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# Vocabulary


def runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every word of every text as ``w``, some of them misspelt."""
    found = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= SHORTEST)
    ascii_only = F.octet_length("run") == F.length("run")
    lower = found.select(
        "i", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("r")
    )
    marked = lower.select("r", F.crc32(F.concat("i", F.lit(":"), "r").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("r").cast("long")).cast("int")
    short = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    return marked.select(F.when(F.col("h") % MISSPELT == 0, short).otherwise(F.col("r")).alias("w"))


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fewest: int = FEWEST
) -> DataFrame:
    """``word`` and its number ``n``, of the words that are long and frequent enough."""
    # Counts are summed within each task before they are shuffled.
    counted = runs(docs, id_col, text_col).where(F.length("w") >= SHORTEST).groupBy("w").count()
    return counted.where(F.col("count") >= fewest).select(
        F.col("w").alias("word"), F.col("count").alias("n")
    )


# Lists


def _listed(words: DataFrame) -> DataFrame:
    """All words as the middle between an empty beginning and end, for both values of ``s``."""
    length = F.length("word")
    both = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("s"))
    return both.where("s > 0").select("word", "n", "s", F.lit(0).alias("a"), F.col("s").alias("b"))


def _halved(rows: DataFrame) -> DataFrame:
    """Both halves of the interval from ``a`` to ``b`` that the first difference may lie in."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    ends = F.array(
        F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b"))
    )
    return rows.select("word", "n", "s", F.explode(ends).alias("i")).select("word", "n", "s", "i.*")


def _key() -> Column:
    """What the words of a list share: s, the interval, the characters before and after it.

    The part after is aligned with the words' ends; the numbers in front keep it apart.
    """
    after = F.col("s") - F.col("b")
    return F.xxhash64(
        "s", "a", "b",
        F.substring("word", F.lit(1), F.col("a")),
        F.when(after > 0, F.substring("word", F.length("word") - after + 1, after)).otherwise(""),
    )


def lists(words: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """``key, s, a, b, word, n``: every pair of words one edit apart is in one list, or in more that
    tell by the interval which of them has to report it.

    Keys are hashes; two lists that share one are compared as one, and the pairs are judged by their
    whole words.
    """
    open_rows, done = _listed(words), []
    while True:
        keyed = _halved(open_rows).where("a < b").withColumn("key", _key())
        sizes = keyed.groupBy("key").agg(
            F.count("*").alias("size"), F.sum(F.col("b") - F.col("a")).alias("cells")
        )
        too_long = (F.col("size") > most) | (F.col("cells") > _CELLS)
        many = stage(sizes.where((F.col("size") > 1) & too_long).select("key"), "spelling-many")
        if many.isEmpty():
            done.append(keyed)
            break
        done.append(keyed.join(many, "key", "left_anti"))
        # What can't be halved any more differs in one character only, so its size is bounded.
        long_ones = stage(keyed.join(many, "key", "left_semi"), "spelling-long")
        done.append(long_ones.where("b - a < 2"))
        open_rows = long_ones.where("b - a >= 2").drop("key")
        if open_rows.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# Dynamic programming over a sorted list


def sorted_list(group: np.ndarray, middles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, code points in rows (one column too many, zeros after the end), lengths."""
    lengths = np.array([len(m) for m in middles], np.int64)
    width = int(lengths.max(initial=0)) + 1
    codes = np.zeros((len(middles), width), np.int32)
    flat = np.frombuffer("".join(middles).encode("utf-32-le"), np.int32)
    codes[np.arange(width) < lengths[:, None]] = flat
    order = np.lexsort((*codes.T[::-1], group))
    return order, codes[order], lengths[order]


def _common(group: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """LCP of each row with the one before it; -1 if the group is another."""
    if len(codes) < 2:
        return np.full(len(codes), -1, np.int64)
    differ = codes[1:] != codes[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), codes.shape[1])
    return np.concatenate([[-1], np.where(group[1:] != group[:-1], -1, lcp)])


def near_pairs(group: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, first below second, of the words of one group that are one edit apart.

    Rows are sorted by group and code points and differ from each other.
    """
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none
    lcp = _common(group, codes)
    starts = np.flatnonzero(lcp < 0)
    # Pairs of ranges, as numbers of ranges of the present length, with the cells of their prefixes
    # (one character less of the second, one less of the first, whole both).
    left = right = np.arange(len(starts))
    big = np.int8(9)
    less_b = np.full(len(starts), big, np.int8)
    less_a, whole = less_b.copy(), np.zeros(len(starts), np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(codes.shape[1]):
        below = np.flatnonzero(lcp <= depth)
        first = np.searchsorted(below, starts)
        count = np.diff(np.append(first, len(below)))
        # A word that has ended goes one character on, its end, and then no further.
        count[lengths[starts] < depth] = 0
        # All pairs of subranges, the first not after the second.
        each = count[left] * count[right]
        at = np.repeat(np.arange(len(left)), each)
        if not len(at):
            break
        inner = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        i = first[left][at] + inner // count[right][at]
        j = first[right][at] + inner % count[right][at]
        keep = i <= j
        at, i, j = at[keep], i[keep], j[keep]
        x, y = codes[below[i], depth], codes[below[j], depth]
        if depth:
            before_x, before_y = codes[below[i], depth - 1], codes[below[j], depth - 1]
            new_b = np.minimum(whole[at] + 1, less_b[at] + (x != before_y))
            new_a = np.minimum(whole[at] + 1, less_a[at] + (before_x != y))
        else:
            new_b = new_a = whole[at] + 1
        new = np.minimum(whole[at] + (x != y), np.minimum(new_b, new_a) + 1)
        alive = np.minimum(new, np.minimum(new_b, new_a)) <= 1
        i, j = i[alive], j[alive]
        less_b, less_a, whole = (c[alive].astype(np.int8) for c in (new_b, new_a, new))
        a, b = below[i], below[j]
        la, lb = lengths[a], lengths[b]
        # Ends reached at this length: equally long, or either one longer.
        both, d = (a != b), depth + 1
        hit = both & (
            ((la == d) & (lb == d) & (whole == 1))
            | ((la == d) & (lb == d - 1) & (less_b == 1))
            | ((la == d - 1) & (lb == d) & (less_a == 1))
        )
        found.append((a[hit], b[hit]))
        starts, left, right = below, i, j
    if not found:
        return none, none
    a, b = (np.concatenate(x) for x in zip(*found))
    return np.minimum(a, b), np.maximum(a, b)


def _one_edit(u: str, v: str) -> bool:
    """Whether two words of which the first is no longer are exactly one edit apart."""
    at = next((k for k, (x, y) in enumerate(zip(u, v)) if x != y), len(u))
    return u[at + (len(u) == len(v)) :] == v[at + 1 :] and u != v


def _reported(rows: pa.Table) -> pa.RecordBatch:
    """Words of whole lists with their number of near words and the best of them."""
    _, group, size = np.unique(rows.column("key").to_numpy(), return_inverse=True, return_counts=True)
    rows = rows.filter(pa.array(size[group] > 1))
    s, a, b = (rows.column(c).to_numpy() for c in ("s", "a", "b"))
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    group = group[size[group] > 1]
    middles = [w[p : len(w) - (t - q)] for w, t, p, q in zip(words, s, a, b)]
    order, codes, lengths = sorted_list(group, middles)
    if (_common(group[order], codes) == codes.shape[1]).any():
        # Two lists have one hash: they are told apart by what it was made of.
        whole = [(k, *r, w[: r[1]], w[len(w) - (r[0] - r[2]) :]) for k, *r, w in zip(group, s, a, b, words)]
        numbers = {key: i for i, key in enumerate(dict.fromkeys(whole))}
        group = np.array([numbers[key] for key in whole])
        order, codes, lengths = sorted_list(group, middles)
    x, y = near_pairs(group[order], codes, lengths)
    x, y = order[x], order[y]
    size = np.array([len(w) for w in words], np.int64)
    # Words of length s and s + 1 under one key, the difference within the interval.
    fits = (np.minimum(size[x], size[y]) == s[x]) & (s[x] == s[y]) & (a[x] == a[y]) & (b[x] == b[y])
    pairs = []
    for i, j in zip(x[fits].tolist(), y[fits].tolist()):
        u, v = sorted((words[i], words[j]), key=len)
        if not _one_edit(u, v):
            continue
        start = next((k for k, (c, d) in enumerate(zip(u, v)) if c != d), len(u))
        if a[i] <= min(start, s[i] - 1) < b[i]:
            pairs += [(i, j), (j, i)]
    best: dict[int, tuple[int, int, str]] = {}
    for i, j in pairs:
        count, number, word = best.get(i, (0, -1, ""))
        better = n[j] > number or (n[j] == number and words[j] < word)
        best[i] = (count + 1, int(n[j]), words[j]) if better else (count + 1, number, word)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in best], pa.string()),
            pa.array([c for c, _, _ in best.values()], pa.int64()),
            pa.array([m for _, m, _ in best.values()], pa.int64()),
            pa.array([w for _, _, w in best.values()], pa.string()),
        ],
        names=["word", "n_near", "near_n", "near_word"],
    )


def near_words(words: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """Per word with near ones: their number, the largest n among them and its smallest word."""
    listed = lists(words, most)
    columns = ("key", "s", "a", "b", "word", "n")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            """Reports all lists held but the last one, of which more may come."""
            nonlocal held, rows
            table = pa.concat_tables(held).combine_chunks()
            keys = table.column("key").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(keys, prepend=~keys[0])), len(keys))
            ends = cuts[1:] if last else cuts[1:-1]
            width = table.column("b").to_numpy() - table.column("a").to_numpy() + 2
            begin, pairs, upto, wide = 0, 0, 0, 0
            for end in ends.tolist():
                size, mine = end - upto, int(width[upto]) if end - upto > 1 else 0
                cells = (end - begin) * max(wide, mine)
                if upto > begin and (
                    pairs + size * size > _PAIRS or end - begin > _ROWS or cells > _CELLS
                ):
                    yield _reported(table.slice(begin, upto - begin))
                    begin, pairs, wide = upto, 0, 0
                pairs += size * size
                upto, wide = end, max(wide, mine)
            if upto > begin:
                yield _reported(table.slice(begin, upto - begin))
            held = [table.slice(upto)] if upto < len(table) else []
            rows = sum(len(t) for t in held)

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
                if rows > 4 * _ROWS:
                    yield from settle(False)
        if held:
            yield from settle(True)

    placed = listed.select(*columns).repartition("key").sortWithinPartitions("key")
    found = placed.mapInArrow(scan, "word string, n_near long, near_n long, near_word string")
    # Of equally frequent ones the smallest word: sums and extremes are folded before the shuffle.
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near_word").alias("w"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.w").alias("near_word")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and the last word ``root`` that its forms lead to; ``forms`` has word and form.

    Every round doubles the steps taken, so the rounds grow with the logarithm of the longest way.
    """
    current = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = current.select(F.col("word").alias("w"), F.col("root").alias("further"))
        joined = current.join(ahead, F.col("root") == F.col("w"), "left")
        new = stage(
            joined.select("word", F.coalesce("further", "root").alias("root"), F.col("w").alias("moved")),
            "spelling-roots",
        )
        current = new.select("word", "root")
        if new.where("moved is not null").isEmpty():
            return current


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LISTED
) -> DataFrame:
    """Every word of the vocabulary: word, n, n_near, form, form_n, root."""
    words = stage(vocabulary(docs, id_col, text_col), "spelling-words")
    near = near_words(words, most)
    takes = F.col("near_n") >= RATIO * F.col("n")
    judged = stage(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(takes, F.col("near_word")).alias("form"),
            F.when(takes, F.col("near_n")).alias("form_n"),
        ),
        "spelling-judged",
    )
    led = roots(judged.where("form is not null")).withColumnRenamed("word", "__w")
    return judged.join(led, F.col("word") == F.col("__w"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
