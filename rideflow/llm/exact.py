"""Exact de-duplication by a stream with keyed state, in DataFrame and SQL functions only.

Texts are equal if they are the same once white space is deleted. Each document is reduced to a
digest of that form, its length, its id and the file it lies in. A stream over these narrow rows
keeps, for each digest, the best copy seen so far and the number of copies, in a disk-backed state
store that never expires, so copies find each other however far apart they arrive. Of equal texts
the longest original stays, of these the smallest id; a null id is the last choice. Documents whose
digest was met before are then compared with the text that stays byte for byte; should two texts
share a digest, their group is parted by the texts themselves.

Null texts count as empty, all empty texts are copies of each other. Of rows that repeat an id with
an equal text one row stays; they are numbered and reduced to one within each task, so that very many
of them are no load. Rows of an empty table: none. Other columns of any name are no matter.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rideflow.llm.common import WHITE, documents
from rideflow.session import scratch_path, stage

# Bytes of narrow rows in one micro-batch of the stream.
BYTES_PER_TRIGGER = 4 << 30

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else every state partition reserves space for logs it may never write.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    order = F.struct(
        (-F.col("n_chars")).alias("shorter"), F.isnull("doc_id").alias("no_id"), "doc_id", "file"
    )
    return rows.groupBy(*keys).agg(F.min(order).alias("keep"), F.count("*").alias("group_size"))


def stream_groups(spark: SparkSession, path: str, schema, bytes_per_trigger: int) -> DataFrame:
    """Best copy and number of copies by digest, from the narrow rows in ``path``.

    Every micro-batch writes the digests it touched under its own number, so a batch that runs again
    after a failure replaces its own output. A digest's last row has the smallest ``keep`` and the
    largest count.
    """
    out = scratch_path(spark, "exact-groups")
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_trigger))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _settings(spark, _STORE):
        job = (
            _grouped(rows.parquet(path), "digest")
            .writeStream.outputMode("update")
            .option("checkpointLocation", scratch_path(spark, "exact-state"))
            .foreachBatch(save)
            .trigger(availableNow=True)
            .start()
        )
        job.awaitTermination()
    touched = spark.read.parquet(out)
    return touched.groupBy("digest").agg(
        F.min("keep").alias("keep"), F.max("group_size").alias("group_size")
    )


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows with their normalised texts, which must have the digest they are known by."""
    found = docs.select(F.col("doc_id").alias("__id"), "text")
    narrow = wanted.hint("shuffle_hash")
    joined = found.join(narrow, F.col("__id").eqNullSafe(F.col("doc_id")))
    clean = joined.withColumn("clean", normalised(F.col("text")))
    return clean.where(F.sha2("clean", 256) == F.col("text_sha256")).drop("__id", "text")


def copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    bytes_per_trigger: int = BYTES_PER_TRIGGER,
) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256, keep_file."""
    spark = docs.sparkSession
    plain = documents(docs, id_col, text_col)
    clean = normalised(F.col("text"))
    path = scratch_path(spark, "exact-rows")
    plain.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.input_file_name().alias("file"),
        F.sha2(clean, 256).alias("text_sha256"),
        digest(clean).alias("digest"),
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    groups = stream_groups(spark, path, rows.schema, bytes_per_trigger)
    numbered = rows.join(groups, "digest").withColumn("row", F.monotonically_increasing_id())
    decided = stage(numbered, "exact-decided")

    # Byte for byte: a group's texts are the same if the smallest is the largest. Both are found in
    # each task before anything is shuffled, so a large group is no load.
    repeated = decided.where("group_size > 1").select("doc_id", "digest", "text_sha256")
    # Equal rows once: each row of ``plain`` then meets one of them, not all of its copies.
    repeated = repeated.distinct()
    ends = _texts(plain, repeated).groupBy("digest").agg(
        F.min("clean").alias("least"), F.max("clean").alias("most")
    )
    mixed = stage(ends.where("least <> most").select("digest"), "exact-mixed")
    if not mixed.isEmpty():
        decided = _parted(plain, decided, mixed)

    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
    several = F.col("group_size") > 1
    # Of rows with the id that stays the longest, of equal ones the first as they were written.
    first = decided.where(several & stays).groupBy("doc_id", "text_sha256").agg(
        F.min(F.struct((-F.col("n_chars")).alias("shorter"), "row"))["row"].alias("__row")
    ).select("__row")
    marked = decided.where(several).join(first, F.col("row") == F.col("__row"), "left")
    kept = F.col("__row").isNotNull()
    whole = decided.where(~several).withColumn("kept", F.lit(True)).unionByName(
        marked.withColumn("kept", kept).drop("__row")
    )
    return whole.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        "kept",
        "text_sha256",
        F.col("keep.file").alias("keep_file"),
    )


def _parted(docs: DataFrame, decided: DataFrame, mixed: DataFrame) -> DataFrame:
    """``decided`` with the groups of digests that different texts share parted by text."""
    fine = decided.join(mixed, "digest", "left_anti")
    rows = decided.join(mixed, "digest", "left_semi").drop("keep", "group_size")
    texts = _texts(docs, rows.dropDuplicates(["doc_id", "text_sha256", "n_chars"]))
    again = texts.dropDuplicates(["doc_id", "text_sha256", "n_chars"]).select(
        "doc_id", "text_sha256", "n_chars", "clean"
    )
    whole = rows.join(
        again.withColumnsRenamed({"doc_id": "__id", "text_sha256": "__sha", "n_chars": "__n"}),
        F.col("doc_id").eqNullSafe(F.col("__id"))
        & (F.col("text_sha256") == F.col("__sha"))
        & (F.col("n_chars") == F.col("__n")),
    ).drop("__id", "__sha", "__n")
    groups = _grouped(whole, "digest", "clean")
    return fine.unionByName(whole.join(groups, ["digest", "clean"]).select(fine.columns))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decisions = stage(copies(docs, id_col, text_col), "exact-decisions")
    kept = decisions.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    repeats = decisions.groupBy("doc_id").count().where("count > 1")
    if repeats.isEmpty():
        return docs.join(kept, docs[id_col].eqNullSafe(F.col("__id")), "left_semi")
    sha = F.sha2(normalised(F.coalesce(docs[text_col], F.lit(""))), 256)
    found = docs.withColumn("__own", sha).join(
        kept, docs[id_col].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_semi"
    )
    longest = Window.partitionBy(id_col, "__own").orderBy(F.desc(F.length(text_col)))
    first = found.withColumn("__copy", F.row_number().over(longest)).where("__copy = 1")
    return first.drop("__own", "__copy")
