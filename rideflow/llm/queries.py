"""One query per operator over its whole table, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rideflow.llm import (
    chat,
    counts,
    exact,
    factors,
    lm,
    packing,
    pieces,
    quality,
    simhash,
    spelling,
    toxicity,
    urls,
    whitening,
)
from rideflow.llm.common import in_fold

Query = Callable[[SparkSession, str], DataFrame]

# Least score of a good document.
GOOD = 0.3


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    docs = read(spark, folder, "documents")
    return packing.packed(docs, vocabulary("word_bpe_49k.json")).drop("ids")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score and verdict of every document, learnt from labelled ones outside a fold."""
    docs = read(spark, folder, "documents")
    field = toxicity.learn(docs, read(spark, folder, "labels"))
    return toxicity.scored(docs, field).select(
        "doc_id",
        in_fold(F.col("doc_id"), toxicity.FOLDS).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        F.when(F.col("toxicity.score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("toxicity.spans").alias("n_spans"),
    )


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document as number and checksum, with both verdicts of parity."""
    docs = read(spark, folder, "documents")
    return pieces.encoded(docs, vocabulary("piece_bpe_32k.model")).drop("ids")


def op5_chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation from every participant's perspective, spans to be learnt as text."""
    spans = F.transform("learn", lambda s: F.concat_ws("-", s["a"], s["b"]))
    made = chat.perspectives(read(spark, folder, "conversations"))
    return made.withColumn("learn", F.array_join(spans, ","))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base verdict and n-gram verdict of every document."""
    trusted = read(spark, folder, "labels").where("quality = 1")
    return quality.judge(read(spark, folder, "documents"), trusted).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("score", 6).alias("score"),
    )


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge(read(spark, folder, "pages"))


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document by words alone and by the n-gram automaton."""
    scored = lm.scores(read(spark, folder, "documents"))
    # The order of addition differs by engine in the last digits.
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Which copy of each document stays."""
    return exact.copies(read(spark, folder, "documents")).drop("keep_file")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram tokens of every document, counted over a trie of its task's words."""
    docs = read(spark, folder, "documents")
    return counts.token_counts(docs, vocabulary("piece_bpe_32k.model"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the leading components of the distinct ones, at equal variance."""
    return whitening.whitened(read(spark, folder, "embeddings"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with its near words' number, its form and the form at the end."""
    return spelling.variants(read(spark, folder, "documents"))


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Score and verdict of every document, learnt from labelled ones outside a fold."""
    docs, metadata = read(spark, folder, "documents"), ["n_chars"]
    model = factors.learn(docs, read(spark, folder, "labels"), metadata=metadata)
    return factors.scored(docs, model, metadata=metadata, to="score").select(
        "doc_id",
        in_fold(F.col("doc_id"), factors.FOLDS).alias("held_out"),
        "score",
        F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_packing,
        op3_toxicity,
        op4_sentencepiece,
        op5_chat_perspectives,
        op6_quality_rules,
        op7_url_filters,
        op8_lm_scores,
        op9_exact_dedup,
        op10_token_counts,
        op11_embedding_whitening,
        op12_spelling_variants,
        op13_quality_classifier,
    )
}

ORACLES: dict[str, str] = {
    "op5_chat_perspectives": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS who,
                   replace(coalesce(text, ''), '<|', '<||') AS body
            FROM conversations
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id
                       ORDER BY turn NULLS FIRST, who, md5(body)) - 1 AS rank
            FROM t
        ), people AS (
            SELECT DISTINCT conv_id, who AS perspective FROM t
        ), lines AS (
            SELECT r.*, rank // 256 AS part, perspective, who = perspective AS mine,
                   '<|im_start|>' || CASE WHEN who = perspective THEN 'assistant'
                       ELSE 'user name=' || regexp_replace(who, '[\s>]', '_', 'g') END
                       || chr(10) AS opening
            FROM ranked r JOIN people ON r.conv_id IS NOT DISTINCT FROM people.conv_id
        ), placed AS (
            SELECT *, sum(length(opening) + length(body) + 11) OVER (
                       PARTITION BY conv_id, perspective, part ORDER BY rank
                       ROWS UNBOUNDED PRECEDING) AS finish
            FROM lines
        )
        SELECT conv_id, perspective, part,
               string_agg(opening || body || '<|im_end|>' || chr(10), '' ORDER BY rank)
                   AS text,
               coalesce(string_agg(CAST(finish - length(body) - 11 AS BIGINT) || '-'
                   || CAST(finish AS BIGINT), ',' ORDER BY finish) FILTER (mine), '') AS learn,
               count(*) AS n_turns, count(*) FILTER (mine) AS n_assistant
        FROM placed GROUP BY conv_id, perspective, part
    """,
    "op7_url_filters": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN contains(url, '://')
                       THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
            FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ), ruled AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%'
                    THEN 'example.org/en/1'
                WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%'
                    THEN 'example.org/es/'
                WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
                WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
                WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN len(list_intersect(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win',
                'cheap-pills', 'free-bets', 'spam-farm'])) > 0 THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op9_exact_dedup": r"""
        WITH clean AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c
            FROM documents
        ), best AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY c ORDER BY n DESC, doc_id NULLS LAST)
                       AS keep_id,
                   count(*) OVER (PARTITION BY c) AS group_size,
                   row_number() OVER (PARTITION BY c, doc_id ORDER BY n DESC) AS copy
            FROM clean
        )
        SELECT doc_id, keep_id, group_size,
               doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(c) AS text_sha256
        FROM best
    """,
    "op8_lm_scores": r"""
        WITH RECURSIVE bits(i, step, c) AS (
            SELECT i, 0, i FROM range(256) AS r(i)
            UNION ALL
            SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
            FROM bits WHERE step < 8
        ), crc_table AS (
            SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
        ), docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words,
                   hex(coalesce(CAST(doc_id AS VARCHAR), '')) AS x
            FROM documents
        ), folds AS (
            SELECT r, doc_id, words, doc_id IS NOT NULL AND xor(4294967295, list_reduce(
                       list_transform(range(1, 1 + length(x) // 2),
                           lambda k: CAST('0x' || substr(x, 2 * k - 1, 2) AS BIGINT)),
                       lambda h, b: xor(h >> 8, t[xor(h, b) % 256 + 1]), 4294967295)) % 10 = 0 AS held
            FROM docs, crc_table
        ), tokens AS (
            SELECT r, held, unnest(list_concat(words, [chr(10)])) AS w,
                   unnest(list_concat([''], words)) AS p
            FROM folds
        ), single AS (
            SELECT w, count(*) FILTER (NOT held) AS n FROM tokens GROUP BY w
        ), before AS (
            SELECT p, count(*) FILTER (NOT held) AS n FROM tokens GROUP BY p
        ), pairs AS (
            SELECT p, w, count(*) FILTER (NOT held) AS n FROM tokens GROUP BY p, w
        ), sizes AS (
            SELECT coalesce(sum(n), 0) AS train, count(*) FILTER (n > 0) AS v FROM single
        ), steps AS (
            SELECT p, w, single.n > 0 AS known, (single.n + 0.1::DOUBLE) / (train + 0.1::DOUBLE * (v + 1)) AS base,
                   (pairs.n + 50 * base) / (before.n + 50) AS chance
            FROM pairs JOIN single USING (w) JOIN before USING (p), sizes
        ), sums AS (
            SELECT r, count(*) AS n_tokens, count(*) FILTER (known) AS n_known,
                   sum(log10(base)) AS base_score, sum(log10(chance)) AS score
            FROM tokens JOIN steps USING (p, w) GROUP BY r
        )
        SELECT doc_id, held AS held_out, n_tokens, n_known, CAST(train AS BIGINT) AS train_tokens,
               round(base_score, 6) AS base_score, round(score, 6) AS score
        FROM folds JOIN sums USING (r), sizes
    """,
    "op12_spelling_variants": r"""
        WITH RECURSIVE bits(i, step, c) AS (
            SELECT i, 0, i FROM range(256) AS r(i)
            UNION ALL
            SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
            FROM bits WHERE step < 8
        ), crc_table AS (
            SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
        ), runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r,
                   count(*) AS times
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
            WHERE length(run) >= 5 GROUP BY ALL
        ), summed AS (
            SELECT r, times, xor(4294967295, list_reduce(
                       list_transform(range(1, 1 + length(x) // 2),
                           lambda k: CAST('0x' || substr(x, 2 * k - 1, 2) AS BIGINT)),
                       lambda h, b: xor(h >> 8, t[xor(h, b) % 256 + 1]), 4294967295)) AS h
            FROM (SELECT r, times, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r) AS x FROM runs), crc_table
        ), words AS (
            SELECT w AS word, CAST(sum(times) AS BIGINT) AS n
            FROM (SELECT times, CASE WHEN h % 97 = 0
                      THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2)
                      ELSE r END AS w FROM summed)
            WHERE length(w) >= 5 GROUP BY w HAVING sum(times) >= 3
        ), losses AS (
            SELECT DISTINCT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS less
            FROM (SELECT word, n, unnest(range(1, 1 + length(word))) AS k FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n AS m FROM losses a JOIN losses b USING (k, less)
            WHERE a.word <> b.word
            UNION SELECT a.word, w.word, w.n FROM losses a JOIN words w ON a.less = w.word
            UNION SELECT w.word, a.word, a.n FROM losses a JOIN words w ON a.less = w.word
        ), best AS (
            SELECT word, count(*) AS n_near, min((-m, other)) AS b FROM near GROUP BY word
        ), judged AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form,
                   CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n
            FROM words LEFT JOIN best USING (word)
        ), led AS (
            SELECT word, form AS root FROM judged WHERE form IS NOT NULL
            UNION ALL
            SELECT led.word, judged.form FROM led JOIN judged ON led.root = judged.word
            WHERE judged.form IS NOT NULL
        )
        SELECT j.word, j.n, j.n_near, j.form, j.form_n, coalesce(last.root, j.word) AS root
        FROM judged j LEFT JOIN (
            SELECT led.word, led.root FROM led JOIN judged ON led.root = judged.word WHERE judged.form IS NULL
        ) last ON j.word = last.word
    """,
}
