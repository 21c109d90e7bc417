"""Index of the keys a Parquet table holds, whoever wrote its rows.

The table's files are the truth; the index is a summary of some of them. It consists of segments,
each a Parquet folder of keys dealt to buckets by hash and a list of the files they come from, and of
a manifest that names the valid segments. Before a look-up, files that no segment covers are read,
the key column alone, and become a segment; so it doesn't matter whether rows came by an append, by
SQL, or from a job that died before it told the index. If a covered file is gone, the index is made
anew.

A refresh writes one segment, into which smaller ones before it are merged, so their number grows
with the logarithm of the keys. It becomes valid by one rename of the new manifest; a refresh that
ends early leaves the manifest before it. One writer per table at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Keys in a bucket of a segment.
BUCKET_KEYS = 1 << 20
# A segment is merged into the new one unless it has so many times its keys.
GROWTH = 4
# New files that are read by their names; more are picked from a read of the whole folder.
NAMED_FILES = 2000
_NAME = r"((?:[^/]+=[^/]*/)*[^/]+)$"


def index_place(path: str) -> str:
    return f"{path.rstrip('/')}_index"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def make_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _file_system(spark, path)
    fs.mkdirs(folder)


def _manifests(spark: SparkSession, place: str) -> list[int]:
    """Numbers of the manifests, rising."""
    fs, folder = _file_system(spark, place)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _read_manifest(spark: SparkSession, place: str, number: int) -> list[dict]:
    text = spark.read.text(f"{place}/manifest-{number:010d}.json", wholetext=True).first()[0]
    return json.loads(text)["segments"]


def segments(spark: SparkSession, path: str) -> list[dict]:
    """The valid segments, oldest first: name, number of keys, number of buckets."""
    place = index_place(path)
    numbers = _manifests(spark, place)
    return _read_manifest(spark, place, numbers[-1]) if numbers else []


def commit(spark: SparkSession, path: str, valid: list[dict]) -> None:
    """Make ``valid`` the index's segments, and drop what only the manifests before the last had."""
    place = index_place(path)
    fs, _ = _file_system(spark, place)
    jvm = spark._jvm
    numbers = _manifests(spark, place)
    new = numbers[-1] + 1 if numbers else 0
    draft = jvm.org.apache.hadoop.fs.Path(f"{place}/draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(json.dumps({"segments": valid}).encode())
    stream.close()
    if not fs.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{place}/manifest-{new:010d}.json")):
        raise RuntimeError(f"another writer has changed the index of {path}")
    # The manifest before the new one stays for readers that have begun with it.
    keep = {s["name"] for n in [*numbers[-1:], new] for s in _read_manifest(spark, place, n)}
    for old in numbers[:-1]:
        gone = {s["name"] for s in _read_manifest(spark, place, old)} - keep
        for name in (*gone, f"manifest-{old:010d}.json"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{place}/{name}"), True)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _table_files(spark: SparkSession, path: str) -> DataFrame:
    """``file``: names of the table's files, with their partition's folder; none is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return found.select("path", F.regexp_extract("path", _NAME, 1).alias("file"))


def _covered(spark: SparkSession, path: str, valid: list[dict]) -> DataFrame:
    places = [f"{index_place(path)}/{s['name']}/files" for s in valid]
    return spark.read.schema("file string").parquet(*places)


def _keys(spark: SparkSession, path: str, segment: dict, kind: str) -> DataFrame:
    place = f"{index_place(path)}/{segment['name']}/keys"
    return spark.read.schema(f"key {kind}, bucket int").parquet(place)


def _new_keys(spark: SparkSession, path: str, key: str, fresh: DataFrame) -> DataFrame:
    """The key column of the table's files in ``fresh``."""
    named = fresh.limit(NAMED_FILES + 1).collect()
    if len(named) <= NAMED_FILES:
        rows = spark.read.option("basePath", path).parquet(*[r["path"] for r in named])
    else:
        whole = spark.read.parquet(path)
        rows = whole.withColumn("_file", F.regexp_extract("_metadata.file_path", _NAME, 1)).join(
            fresh.select("file"), F.col("_file") == F.col("file"), "left_semi"
        )
    return rows.select(F.col(key).alias("key")).where("key is not null")


def refresh(spark: SparkSession, path: str, key: str) -> list[dict]:
    """Bring the index of the table at ``path`` up to its files; the segments that are valid then."""
    valid = segments(spark, path)
    files = _table_files(spark, path)
    if valid:
        covered = _covered(spark, path, valid)
        if not covered.join(files, "file", "left_anti").isEmpty():
            valid = []
            fresh = files
        else:
            fresh = files.join(covered, "file", "left_anti")
    else:
        fresh = files
    # Fixed here: files that come later are for the next refresh.
    fresh = fresh.persist()
    try:
        if fresh.isEmpty():
            return valid
        keys = _new_keys(spark, path, key, fresh).distinct().persist()
        rows = keys.count()
        kind = keys.schema["key"].dataType.simpleString()
        merged: list[dict] = []
        while valid and valid[-1]["keys"] < GROWTH * (rows + sum(s["keys"] for s in merged)):
            merged.append(valid.pop())
        total = rows + sum(s["keys"] for s in merged)
        buckets = 1
        while buckets * BUCKET_KEYS < total:
            buckets *= 2
        name = f"segment-{uuid.uuid4().hex}"
        place = f"{index_place(path)}/{name}"
        for segment in merged:
            keys = keys.unionByName(_keys(spark, path, segment, kind).select("key"))
        dealt = keys.withColumn("bucket", _bucket("key", buckets))
        dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").write.partitionBy(
            "bucket"
        ).parquet(f"{place}/keys")
        names = fresh.select("file")
        if merged:
            names = names.unionByName(_covered(spark, path, merged))
        names.coalesce(1 + total // BUCKET_KEYS).write.parquet(f"{place}/files")
        valid = [*valid, {"name": name, "keys": total, "buckets": buckets}]
        commit(spark, path, valid)
        return valid
    finally:
        fresh.unpersist()


def known_keys(spark: SparkSession, path: str, fresh: DataFrame, key: str) -> DataFrame | None:
    """The keys of ``fresh`` that the table may hold, and others of their buckets; None if it is empty.

    Of each segment only the buckets of the new keys are read.
    """
    valid = refresh(spark, path, key)
    kind = fresh.schema[key].dataType.simpleString()
    found: DataFrame | None = None
    for segment in valid:
        keys = _keys(spark, path, segment, kind)
        count = segment["buckets"]
        if count > 1:
            mine = [r[0] for r in fresh.select(_bucket(key, count).alias("b")).distinct().collect()]
            if len(mine) < count:
                keys = keys.where(F.col("bucket").isin(mine))
        part = keys.select(F.col("key").alias(key))
        found = part if found is None else found.unionByName(part)
    return found
