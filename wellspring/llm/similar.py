"""Links between texts whose sets of word shingles have a Jaccard similarity of at least ``similarity``, found by prefix filtering, so that none is missed.

Two sets of similarity t have a shingle in common among the first n - ceil(t n) + 1 of each (n its size), in whatever order all sets are read. Shingles that
many texts share come last in that order, so that a passage common to many texts brings no two of them together; which these are is taken from a sample,
which decides the work and not the result. Sets that meet at a shingle are candidates and are compared as a whole.

Equal sets are one node. Only the first shingles are moved for the search. Of a pair of candidates, first the numbers of shingles in each of ``SEGMENTS`` ranges of
hashes are compared: their Manhattan distance is never more than the number of shingles in one set only, so where it is too large the pair is not similar. Only
texts of pairs that pass are moved, and compared exactly. Each set is compared with two others to begin with: at each shingle all sets meet the one of least and the one of
greatest name, and a set is compared with those of either kind that it meets most often; then only pairs that are still apart. So a large group of near copies does not make
all its pairs, but a crowd of sets that share rare shingles without being similar does.

Shingles outside the sample's common ones are met in one exchange, by a window for each; a common one may be a third of all sets', so the sets are joined to its two names, which
are aggregated first, and a join that is skewed is split.

Null, empty and wordless texts have the empty set. Texts of fewer words than ``width`` have one shingle, all their words. Case is ignored for A-Z.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm import _hashing as H
from wellspring.llm._common import byte_list, cut, kept, pieces, utf8
from wellspring.llm.components import components
from wellspring.scratch import BROADCAST_ROWS

#: Rows of the sample at least, and its share of all rows: a shingle in some COMMON * SHARE rows counts as common, however many rows there are, so crowds do not grow with the table.
SAMPLE = 4_000
SHARE = 16
COMMON = 4
MOST_COMMON = 1 << 20
SEGMENTS = 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct hashes of the text's runs of ``width`` words, sorted."""
    data = np.frombuffer((text or b"").translate(_LOWER), dtype=np.uint8)
    starts, ends = H.word_spans(data)
    if not len(starts):
        return np.empty(0, dtype=np.int64)
    words = H.word_hashes(data, starts, ends)
    return np.unique(H.grams(H.prefix(words, H.WORD_BASE), min(width, len(words)), H.WORD_BASE).view(np.int64))


def set_name(shingles: np.ndarray) -> int:
    """A set's name, equal for equal sets."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def first_keys(shingles: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first shingles of a set, the common ones last, and how many of them are common: one at least of them is among those of any set that is similar enough."""
    late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles if len(common) else np.zeros(len(shingles), dtype=bool)
    wanted, rare = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1, shingles[~late]
    return np.concatenate((rare, shingles[late]))[:wanted], max(0, min(wanted, len(shingles)) - len(rare))


def segment_counts(shingles: np.ndarray) -> bytes:
    """How many shingles are in each range of hashes, 255 at most: a byte each. Cutting at 255 brings no two sets further apart."""
    return np.minimum(np.bincount(shingles.view(np.uint64) >> np.uint64(56), minlength=SEGMENTS), 255).astype(np.uint8).tobytes()


def common_shingles(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """The shingles that occur most in a sample of about one row of ``SHARE``, or of about ``SAMPLE`` rows if that is more, ``MOST_COMMON`` at most, sorted."""
    part = min(SHARE, max(1, docs.count() // SAMPLE))
    sample = docs.select(utf8(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [shingle_set(t, width) for t in byte_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, dtype=np.int64), *found]))], names=["key"])

    seen = sample.mapInArrow(run, "key bigint").groupBy("key").count().where(F.col("count") >= COMMON)
    return np.sort(seen.orderBy(F.desc("count"), "key").limit(MOST_COMMON).select("key").toArrow()["key"].to_numpy().astype(np.int64))


def _compare(width: int, similarity: float):
    """A batch function: the pairs (a, b) whose texts' sets are similar enough. Rows of one b stand together, so its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in (small for whole in pieces(batches, "text_a") for small in pieces(iter([whole]), "text_b")):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for name, x, y in zip(b, byte_list(batch.column("text_a")), byte_list(batch.column("text_b")), strict=True):
                if name != last:
                    last, held = name, shingle_set(y, width)
                own = shingle_set(x, width)
                both = len(np.intersect1d(own, held, assume_unique=True))
                good.append((1 + similarity) * both >= similarity * (len(own) + len(held)) - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _may_be_similar(similarity: float):
    """A batch function: the pairs (a, b) whose segment counts do not rule out that their sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(byte_list(batch.column(c))), dtype=np.uint8).reshape(-1, SEGMENTS).astype(np.int16) for c in ("counts_a", "counts_b"))
            apart = np.abs(x - y).sum(axis=1)
            both = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array((1 + similarity) * apart <= (1 - similarity) * both + 1e-9))

    return run


def similar_links(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of set names of the given similarity or more, whose components are those of all such pairs.

    ``found``: id, digest (of the text), name, size, counts (:func:`segment_counts`), keys and common (:func:`first_keys`) of every row of ``docs``.
    """
    if not 0 < similarity <= 1:
        raise ValueError("a similarity is over 0 and at most 1")
    of = (F.first(c).alias(c) for c in ("size", "counts", "keys", "common"))
    reps = kept(found.groupBy("name").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("rep"), *of))
    rare, late = (reps.select("name", "size", F.explode(F.expr(part)).alias("key")) for part in ("slice(keys, 1, size(keys) - common)", "slice(keys, size(keys) - common + 1, common)"))
    own, at = F.struct("name", "size"), Window.partitionBy("key")
    rare = rare.select("key", "name", "size", F.min(own).over(at).alias("low"), F.max(own).over(at).alias("high")).where("low.name < high.name")
    ends = late.groupBy("key").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low.name < high.name")
    met = kept(rare.unionByName(late.join(ends, "key").select(*rare.columns)))
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(utf8(text_col)).alias("digest"), utf8(text_col).alias("text"))

    def fits(a: str, b: str):
        return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - F.lit(1e-9)

    def similar(pairs: DataFrame) -> DataFrame:
        a, b = (reps.select(F.col("name").alias(x), F.col("size").alias(f"size_{x}"), F.col("counts").alias(f"counts_{x}")) for x in ("a", "b"))
        likely = kept(pairs.join(a, "a").join(b, "b").select("a", "b", "size_a", "size_b", "counts_a", "counts_b").mapInArrow(_may_be_similar(similarity), "a bigint, b bigint"))
        names = likely.select(F.col("a").alias("name")).unionByName(likely.select(F.col("b").alias("name"))).distinct()
        wanted = cut(reps.select("name", F.col("rep.id").alias("rep_id"), F.col("rep.digest").alias("rep_digest")).join(names, "name", "left_semi"))
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        texts = named.join(wanted, (F.col("digest") == F.col("rep_digest")) & F.col("id").eqNullSafe(F.col("rep_id"))).groupBy("name").agg(F.first("text").alias("text"))
        x, y = (texts.select(F.col("name").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
        return cut(likely.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(_compare(width, similarity), "a bigint, b bigint"))

    sides = [F.struct(F.lit(k).alias("side"), F.col(f"{c}.name").alias("name"), F.col(f"{c}.size").alias("size")) for k, c in enumerate(("low", "high"))]
    pairs = met.select("name", "size", F.explode(F.array(*sides)).alias("to")).where(F.col("name") != F.col("to.name")).where(fits("size", "to.size"))
    best = pairs.groupBy("name", F.col("to.side").alias("side"), F.col("to.name").alias("b")).agg(F.count("*").alias("n")).groupBy("name", "side").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    tied = similar(best.select(F.least("name", "b").alias("a"), F.greatest("name", "b").alias("b")).distinct())
    placed = kept(met.select("key", "name", "size").join(components(tied).withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name")))
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    apart = kept(placed.join(apart, "key", "left_semi"))
    x, y = (apart.select("key", F.col("name").alias(k), F.col("size").alias(f"size_{k}"), F.col("component").alias(f"component_{k}")) for k in ("a", "b"))
    rest = x.join(y, "key").where("a < b and component_a <> component_b").where(fits("size_a", "size_b")).select("a", "b").distinct()
    return tied.unionByName(similar(rest))
