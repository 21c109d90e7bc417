"""Quality rules: fixed counts and a log-likelihood ratio of hashed n-grams, in SQL functions only.

Two multinomials over hashed word n-grams are counted, one over all documents, one over the trusted
ones. A document's score is the mean, over its n-grams, of the logarithm of the ratio of the two
probabilities, so length doesn't matter. A document is kept if the base rules and the score both let
it pass; nothing is drawn at random.

Null texts count as empty. Empty and very short texts fail the base rules; the score of a text
without words is 0. Repeated rows are judged alike, each row once. Without any trusted document all
scores are 0 and the base rules decide. Rows of an empty table: none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rideflow.llm.common import small_side, words
from rideflow.session import stage

# Buckets of the n-grams, at any size of the corpus.
BUCKETS = 1 << 20
# Least share of all n-grams that a bucket needs to be told apart from the others. The frequent ones
# have the same share in a corpus of any size; the rest, however many there are, is one class.
RARE_SHARE = 2e-6
# Pseudo-counts of every class in both multinomials: a share of the trusted n-grams, so that an
# n-gram of a given frequency has the same ratio in a corpus of any size, but never fewer than these.
SMOOTHING = 8.0
SMOOTHING_SHARE = 3e-6
_CHUNK = 1 << 10
# Ratios are whole thousandths, so that sums are exact.
SCALE = 1000
LOWEST_SCORE = -0.15
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """Words in windows of five that occur twice or more, from the words' hashes.

    Equal windows are found by sorting their hashes within the document; no row leaves its place.
    """

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.get(starts, j + 1) - p))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    def starts(ordered: Column) -> Column:
        twins = F.transform(
            ordered,
            lambda s, j: F.when(
                F.equal_null(s["h"], F.get(ordered, j + 1)["h"])
                | F.equal_null(s["h"], F.get(ordered, j - 1)["h"]),
                s["i"],
            ),
        )
        return F.array_sort(F.filter(twins, lambda p: p.isNotNull()))

    def count(windows: Column) -> Column:
        ordered = F.array_sort(
            F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )
        repeats = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(repeats, _let(ordered, lambda o: _let(starts(o), covered))).otherwise(0)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))),
    )
    found = F.when(F.size(hashes) >= WINDOW, _let(windows, count)).otherwise(0)
    return found.cast("bigint")


def base_columns(text: Column, tokens: Column, hashes: Column) -> dict[str, Column]:
    """The fixed counts and the verdict of the base rules."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_words = F.size(tokens).cast("bigint")
    repeated = repeated_words(hashes)
    return {
        "n_words": n_words,
        "word_chars": F.aggregate(
            tokens, F.lit(0).cast("bigint"), lambda total, w: total + F.length(w)
        ),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated,
    }


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with text, words and their hashes under private names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumns({"__text": text, "__words": words(text)})
    return found.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))


def _buckets(hashes: Column) -> Column:
    """Bucket of every word and every pair of neighbours."""
    mask = F.lit(BUCKETS - 1)
    one = F.transform(hashes, lambda h: h.bitwiseAND(mask).cast("int"))
    two = F.transform(
        hashes,
        lambda h, i: F.when(
            i > 0, F.xxhash64(F.get(hashes, i - 1), h).bitwiseAND(mask).cast("int")
        ),
    )
    return F.concat(one, F.filter(two, lambda b: b.isNotNull()))


def log_ratios(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row with an array: for each bucket ln of its class's trusted over its overall probability,
    in thousandths.

    Counts are summed within each task before they are shuffled; there are ``BUCKETS`` of them,
    whatever the size of the corpus. A bucket of at least ``RARE_SHARE`` of all n-grams is a class of
    its own, all others are one class, so that every n-gram counts. ``trusted`` has the ids of the
    trusted documents in ``doc_id``.
    """
    ids = trusted.select(F.col("doc_id").alias("__id")).dropna().distinct()
    flagged = docs.select(F.col(id_col).alias("__key"), text_col).join(
        small_side(ids.withColumn("__t", F.lit(1))), F.col("__key") == F.col("__id"), "left"
    )
    grams = _hashed(flagged, text_col).select(
        F.explode(_buckets(F.col("__hashes"))).alias("b"), F.coalesce("__t", F.lit(0)).alias("t")
    )
    counted = grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    table = stage(counted, "quality-counts")
    whole = table.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    spark = docs.sparkSession
    if not whole["t"]:
        return spark.range(1).select(F.array_repeat(F.lit(0).cast("smallint"), BUCKETS).alias("r"))
    frequent = F.col("n") >= RARE_SHARE * whole["n"]
    rest = table.where(~frequent).agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    # Both multinomials are smoothed alike, the overall counts scaled to the trusted total: a class
    # that is rare tells little, whether trusted documents happen to have it or not.
    smoothing, share = max(SMOOTHING, SMOOTHING_SHARE * whole["t"]), whole["t"] / whole["n"]

    def ratio(n: Column, t: Column) -> Column:
        return F.round(SCALE * F.log((t + smoothing) / (n * share + smoothing))).cast("smallint")

    common = ratio(F.lit(rest["n"] or 0), F.lit(rest["t"] or 0))
    told = table.where(frequent).select("b", ratio(F.col("n"), F.col("t")).alias("r"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("b"), common.alias("c"))
    dense = every.join(told, "b", "left").select("b", F.coalesce("r", "c").alias("r"))
    # In runs first, so that the single row is put together from few and narrow parts.
    run = F.transform(F.array_sort(F.collect_list(F.struct("b", "r"))), lambda x: x["r"])
    runs = dense.groupBy((F.col("b") / _CHUNK).cast("int").alias("k")).agg(run.alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "x")))
    return stage(
        runs.agg(F.flatten(F.transform(ordered, lambda y: y["x"])).alias("r")), "quality-ratios"
    )


def judge(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``score`` and ``kept``.

    The ratios are a scalar subquery of fixed size; each document is then scored where it lies.
    """
    ratios = log_ratios(docs, trusted, id_col, text_col)
    base = base_columns(F.col("__text"), F.col("__words"), F.col("__hashes"))
    found = F.struct(
        *(c.alias(n) for n, c in base.items()), _buckets(F.col("__hashes")).alias("__buckets")
    )
    # An exploded array of one: no later filter is moved below the counting, where it would have to
    # count anew for every mention of a column.
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in (*base, "score", "base_failed", "kept")]
    counted = _hashed(docs, text_col).select(*columns, F.explode(F.array(found)).alias("__found"))
    named = counted.select(*columns, "__found.*").withColumn("__r", ratios.scalar())
    total = F.aggregate("__buckets", F.lit(0).cast("bigint"), lambda a, b: a + F.get("__r", b))
    score = F.when(F.size("__buckets") > 0, total / F.size("__buckets") / SCALE).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = named.withColumns({"base_failed": failed, "score": score}).drop("__buckets", "__r")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= LOWEST_SCORE))


def kept(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and no other."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    rows = docs.select(own, F.col(id_col).alias("__id"), F.col(text_col).alias("__body"))
    judged = judge(rows, trusted, "__id", "__body").where("kept")
    return judged.select(*(F.col("__row")[c].alias(c) for c in docs.columns))
