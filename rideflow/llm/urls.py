"""URL filters: a cascade of Bloom filters that is exact over all keys of the corpus.

A URL's keys are its host's suffixes at label borders, each with the beginnings of its path in the
lengths that the rules have, and alone. The keys of all pages are the universe. The first filter
encodes the listed keys; the next one those keys of the universe that pass it without being listed;
the one after that the listed keys that pass the second, and so on until nothing passes wrongly. A
key of the universe is listed just if it gets through an odd number of filters. Pages are judged
where they lie: the filters go to them, no page is joined or shuffled.

A URL that fits rules gets the verdict of the longest; any other one is blocked if one of its hosts
is listed, else allowed. Hosts are listed by a table of any size, which meets the universe once, key
by key, and by names that are listed under any domain. Listed hosts are taken without case of A-Z;
null ones, empty ones and those with a ``/`` list nothing, repeated ones count once. Null URLs, and those without ``://``, have an empty host and path, fit
nothing and are allowed. Repeated rows are judged alike, each row once. Very long URLs are read
whole. An empty table, or a list without keys, gives no rows or no listed host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rideflow.session import stage

#: Rules (host and path, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Names whose hosts are listed under any domain.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
# Bits per key and probes of the first filter and of the others: 1 in 100 and 1 in 2 pass wrongly.
FIRST, OTHERS = (10, 7), (2, 1)
# Bits of a filter that may be sent to the tasks; longer lists are looked up by a join.
MOST_BITS = 1 << 26

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> dict[str, Column]:
    """Host and path of a URL."""
    rest = _rest(url)
    return {
        "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *_LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    }


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a URL, the longest first, those of the longer host first among equals."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    beginnings = F.filter(
        F.array(*(F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in [0, *lengths])),
        lambda p: p.isNotNull(),
    )
    every = F.flatten(
        F.transform(suffixes, lambda s: F.transform(beginnings, lambda p: F.concat(s, p)))
    )
    order = F.array_sort(
        F.transform(every, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(order, lambda s: s["k"])
    )


@dataclass(frozen=True)
class Level:
    """One filter: a table of one row with its 64-bit words, its number, bits and probes."""

    words: DataFrame
    number: int
    bits: int
    probes: int


def _bit(key: Column, number: int, probe: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(number), probe), F.lit(bits))


def _filter(encoded: DataFrame, number: int, size: int) -> Level:
    """The filter of ``size`` keys; set bits are summed up word by word before they meet."""
    per_key, probes = FIRST if number == 0 else OTHERS
    bits = max(64, -(-size * per_key // 64) * 64)
    at = encoded.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(probes - 1)),
                lambda p: _bit(F.col("key"), number, p, bits),
            )
        ).alias("at")
    )
    place = F.col("at").bitwiseAND(F.lit(63)).cast("int")
    one_bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    mine = at.select(F.shiftright("at", 6).alias("w"), one_bit.alias("b"))
    every = encoded.sparkSession.range(bits // 64).select(
        F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b")
    )
    words = mine.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    one = words.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("x"))
    written = stage(one.select(F.transform("x", lambda s: s["b"]).alias("words")), "bloom")
    return Level(written, number, bits, probes)


def _passes(key: Column, level: Level, words: Column) -> Column:
    """Whether all probes of a key find their bit."""

    def found(probe: Column) -> Column:
        at = _bit(key, level.number, probe, level.bits)
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        place = at.bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftright", word, place).bitwiseAND(F.lit(1)) == 1

    return F.forall(F.sequence(F.lit(0), F.lit(level.probes - 1)), found)


def _column(level: Level) -> str:
    return f"__bloom{level.number}"


def with_filters(df: DataFrame, levels: list[Level]) -> DataFrame:
    """``df`` with the filters' words as constants."""
    for level in levels:
        df = df.withColumn(_column(level), level.words.scalar())
    return df


def listed(key: Column, levels: list[Level]) -> Column:
    """Membership of a key of the universe, in a table ``with_filters``."""
    answer = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        answer = F.when(_passes(key, level, F.col(_column(level))), answer).otherwise(i % 2 == 1)
    return answer


def cascade(universe: DataFrame) -> list[Level] | None:
    """Filters for a written table of ``key`` and ``listed``; None if they'd be too large."""
    encoded, others = universe.where("listed"), universe.where("not listed")
    levels: list[Level] = []
    while size := encoded.count():
        if size * FIRST[0] > MOST_BITS:
            return None
        level = _filter(encoded, len(levels), size)
        levels.append(level)
        tested = with_filters(others, [level])
        wrong = tested.where(_passes(F.col("key"), level, F.col(_column(level))))
        encoded, others = stage(wrong.select("key", "listed"), "bloom-wrong"), encoded
    return levels


def judge(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    names: tuple[str, ...] = LISTED_NAMES,
    hosts: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict.

    ``hosts`` is a table of listed hosts, its first column; each lists its subdomains too.
    """
    verdicts = dict(rules)
    lengths = sorted({len(r) - r.index("/") for r in verdicts})
    urls = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("__url"))
    split = urls.select("page_id", *(c.alias(n) for n, c in parts(F.col("__url")).items()))
    keyed = split.withColumn("__keys", keys(F.col("host"), F.col("path"), lengths))
    is_rule = lambda k: k.isin(*verdicts)
    named = lambda k: (
        ~F.contains(k, F.lit("/")) & F.split_part(k, F.lit("."), F.lit(1)).isin(*names)
    )
    every = keyed.select(F.explode("__keys").alias("key")).distinct()
    by_name = is_rule(F.col("key")) | named(F.col("key"))
    if hosts is None:
        marked = every.withColumn("listed", by_name)
    else:
        # Both sides hold a key once.
        tabled = every.join(_listing(hosts), "key", "left")
        marked = tabled.select("key", (by_name | F.col("__tabled").isNotNull()).alias("listed"))
    universe = stage(marked, "url-keys")
    levels = cascade(universe)
    if levels is None:
        found = _joined(keyed, universe)
    else:
        found = with_filters(keyed, levels).withColumn(
            "__found", F.filter("__keys", lambda k: listed(k, levels))
        )
    rule = F.get(F.filter("__found", is_rule), F.lit(0))
    table = F.create_map(*(F.lit(x) for pair in rules for x in pair))
    own = F.when(F.size("__found") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("rule", rule).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(F.element_at(table, F.col("rule")), own).alias("verdict"),
    )


def _listing(hosts: DataFrame) -> DataFrame:
    """The distinct keys of a table of hosts."""
    name = F.translate(hosts[hosts.columns[0]].cast("string"), *_LOWER)
    plain = hosts.select(name.alias("key")).where("key <> '' and not contains(key, '/')")
    return plain.distinct().withColumn("__tabled", F.lit(True))


def _joined(keyed: DataFrame, universe: DataFrame) -> DataFrame:
    """The listed keys of every page by a join, for lists beyond any filter that could be sent."""
    hosts = keyed.select("host", "path", "__keys").distinct()
    pairs = hosts.select("host", "path", F.posexplode("__keys").alias("at", "key"))
    hits = pairs.join(universe.where("listed").select("key"), "key")
    lists = hits.groupBy("host", "path").agg(
        F.array_sort(F.collect_list(F.struct("at", "key"))).alias("x")
    )
    none = F.array().cast("array<string>")
    found = F.coalesce(F.transform("x", lambda s: s["key"]), none)
    return keyed.join(lists, ["host", "path"], "left").withColumn("__found", found)
