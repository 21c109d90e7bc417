"""Near-duplicates by 64-bit SimHash fingerprints, compared exactly in tiles.

A fingerprint is a majority vote of the XXH64 hashes of a text's word shingles, bit by bit. Distinct
fingerprints are laid out by the population counts of their four 16-bit quarters. Two fingerprints
can't be closer than the sum of the differences of those counts, so a tile is compared only with
tiles whose counts differ by no more than the radius in all; there numpy takes the exclusive-or of
all rows with all rows and counts the bits. No pair within the radius is missed. A pair of tiles
reports a spanning forest of its links, not every pair, so a large group costs as many rows as it
has members. Components come from rounds of star contraction, each a pair of joins.

Null and empty texts have fingerprint zero and are linked like any other; a text of fewer words than
a shingle is one shingle. Repeated rows get the same answer each. Very long texts are hashed whole.
A null id takes part, but as component id the smallest id that isn't null stands. An empty table
gives no rows. Other columns of any name are no matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rideflow.llm.common import documents
from rideflow.session import stage

SHINGLE = 3
RADIUS = 3
SEED = 42
# Fingerprints in a tile; a tile pair compares at most the square of it.
TILE = 4096
_ROWS_AT_ONCE = 256
_QUARTERS = 4
# Links that one task may settle by itself.
_CHUNK = 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text in UTF-8."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_digest
    hashes = b"".join(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())]
    )
    bits = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 1 << 16):
        bits += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(rows)).tobytes(), "big")


def _text_hash(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False
) -> DataFrame:
    """``doc_id`` and its fingerprint ``fp`` as a signed long; on demand the text's hash ``sha``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1)]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signed), *batch.columns[2:]],
                names=["doc_id", "fp", *batch.schema.names[2:]],
            )

    plain = documents(docs, id_col, text_col)
    sha = [_text_hash(F.col("text")).alias("sha")] if with_hash else []
    return plain.select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary"), *sha
    ).mapInArrow(mark, "doc_id long, fp long" + (", sha binary" if with_hash else ""))


def _quarters(fp: str):
    """Population counts of the four quarters."""
    return [
        F.bit_count(F.shiftrightunsigned(F.col(fp), 16 * q).bitwiseAND(F.lit(0xFFFF)))
        for q in range(_QUARTERS)
    ]


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of counts within the radius, one of each pair of opposites."""
    found = [()]
    for _ in range(_QUARTERS):
        found = [(*o, d) for o in found for d in range(-radius, radius + 1)]
    return [o for o in found if sum(map(abs, o)) <= radius and o >= (0,) * _QUARTERS]


def _cell(counts) -> F.Column:
    """One number for four counts of 0 to 16."""
    cell = F.lit(0)
    for c in counts:
        cell = cell * 32 + c + 4
    return cell


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs of ``left`` and ``right`` that differ in at most ``radius`` bits."""
    found = []
    for at in range(0, len(left), _ROWS_AT_ONCE):
        apart = np.bitwise_count(left[at : at + _ROWS_AT_ONCE, None] ^ right[None, :])
        i, j = np.nonzero(apart <= radius)
        found.append(np.stack([i + at, j], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with the smallest node it is connected to, itself left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def tiles(distinct: DataFrame) -> DataFrame:
    """Tiles of at most about ``TILE`` fingerprints of equal counts: cell, tile, fps.

    The sizes of the cells, at most 17 ** 4 numbers, tell how many tiles a cell is dealt to.
    """
    placed = distinct.withColumn("cell", _cell(_quarters("fp")))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn(
        "tile", F.pmod(F.xxhash64("fp"), F.col("parts"))
    )
    return dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps"))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a`` to ``b`` that connect all fingerprints within the radius of each other."""
    table = stage(tiles(distinct), "simhash-tiles")
    steps = [sum(d * 32 ** (_QUARTERS - 1 - q) for q, d in enumerate(o)) for o in _offsets(radius)]
    other = table.select(
        F.explode(F.lit(steps)).alias("step"), "cell", F.col("tile").alias("t1"), "fps"
    ).select((F.col("cell") + F.col("step")).alias("cell"), "step", "t1", F.col("fps").alias("f1"))
    pairs = other.join(table, "cell").where("step <> 0 or t1 <= tile").select("f1", "fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settled() -> pa.RecordBatch:
            a, b = forest(*(np.concatenate(x) for x in zip(*held))) if held else (_NONE, _NONE)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"]
            )

        for batch in batches:
            for f1, fps in zip(batch.column(0), batch.column(1)):
                left, right = (x.values.to_numpy() for x in (f1, fps))
                at = close_pairs(left.view(np.uint64), right.view(np.uint64), radius)
                if len(at):
                    held.append(forest(left[at[:, 0]], right[at[:, 1]]))
            if sum(len(a) for a, _ in held) > _CHUNK:
                yield settled()
        yield settled()

    return pairs.mapInArrow(compare, "a long, b long")


_NONE = np.zeros(0, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node ``root`` it is connected to, for all nodes with links.

    Large and small stars alternate: first each node's larger neighbours, then its smaller ones are
    tied to the smallest in reach. Every round is written to the shared folder. All groupings are
    minima, summed up before the shuffle, so a node with many links is no load.
    """
    current = stage(_directed(edges), "simhash-links")
    while True:
        large = stage(_star(_both_ways(current), "u > v"), "simhash-large")
        small = stage(_star(large, "true"), "simhash-small")
        if _same(small, current):
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        current = small


def _directed(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, larger: str) -> DataFrame:
    """Ties the neighbours of every node to the smallest of them, all links from large to small."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("c"), F.least("m", "u").alias("m")
    )
    tied = edges.join(lowest, F.col("u") == F.col("c"))
    if larger == "true":  # edges go from large to small: the centre itself is tied too
        around = tied.select(F.col("v").alias("x"), "m").unionByName(
            lowest.select(F.col("c").alias("x"), "m")
        )
    else:  # edges go both ways: only neighbours beyond the centre
        around = tied.where("v > u").select(F.col("v").alias("x"), "m")
    return around.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two link tables without repeats hold the same links: sizes and sums of hashes."""

    def sums(t: DataFrame):
        mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
        return t.agg(F.count("*").alias("n"), F.sum(mixed).alias("s")).first()

    return sums(a) == sums(b)


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``root`` and ``component_id`` of all fingerprints."""
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    roots = components(links(distinct.select("fp"), radius))
    known = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return known.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """A row per document: doc_id, fingerprint as 16 hex digits, component_id."""
    marked = stage(fingerprints(docs, id_col, text_col), "simhash-marked")
    return marked.join(_classes(marked, radius).drop("root"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, a null id last, then of the smallest
    hash of the text. Ids may be null or repeated; a row is known by its id and the hash."""
    marked = stage(fingerprints(docs, id_col, text_col, with_hash=True), "simhash-marked")
    classes = _classes(marked, RADIUS).drop("component_id")
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "sha")
    chosen = marked.join(classes, "fp").groupBy("root").agg(F.min(order).alias("first"))
    first = stage(
        chosen.select(F.col("first.doc_id").alias("__id"), F.col("first.sha").alias("__sha")),
        "simhash-first",
    )
    # All rows of one id and text are in one component, so a pair is chosen once at most.
    kept = docs.withColumn("__own", _text_hash(docs[text_col])).join(
        first, docs[id_col].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_semi"
    )
    repeats = marked.groupBy("doc_id", "sha").count().where("count > 1")
    if not repeats.isEmpty():
        kept = kept.dropDuplicates([id_col, "__own"])
    return kept.drop("__own")
