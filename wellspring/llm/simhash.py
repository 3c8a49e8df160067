"""SimHash near-duplicates: fingerprints, then links between fingerprints that differ in at most ``distance`` bits, then components.

A fingerprint is cut into segments and mapped to the vector of its segments' bit counts. The Manhattan distance of two such vectors is never more than
the fingerprints' Hamming distance, so near fingerprints are near in that grid. Two vectors within distance 2 have a grid point within 1 of both;
every fingerprint therefore announces itself at its own grid point and at those one step away, and candidates are the fingerprints that meet at a point.
Candidates are verified on the fingerprints themselves.

Only distinct fingerprints are linked, so exact copies never form pairs. Where more than ``dense`` fingerprints meet at a point, the grid is too coarse for
them: they are mapped again with segments of half as many bits, down to segments of one bit, where the Manhattan distance is the Hamming distance and no
more than 65 fingerprints can meet. All grids are exact, and the work grows in proportion to the number of fingerprints.

Where a ``similarity`` is given, texts whose sets of ``shingle``-word shingles are at least that similar (Jaccard) are linked too. Such texts have fingerprints
some 10 bits apart at 0.8, too far for any grid, so they are found on the sets themselves (see ``similar``).

Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows share a fingerprint. A null id has no say in a component's
smallest id. Columns of the documents may have any names. Very long texts are read whole, in a task's memory. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm._common import byte_list, cut, free, kept, pieces, utf8
from wellspring.llm.components import components
from wellspring.llm.similar import common_shingles, first_keys, segment_counts, set_name, shingle_set, similar_links

BITS = 64
SEGMENT_BITS = 4
DISTANCE = 2
DENSE = 64
#: Fingerprints that one task announces at their grid points.
ANNOUNCED = 10_000
SHINGLE = 3
SIMILAR_SHINGLE = 5

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_of(text: bytes | None, width: int = SHINGLE) -> int:
    """The majority of the shingles' hash bits; a bit is 1 if it is set in over half of them."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    hashes = np.fromiter([digest(line[i:j], 42) for i, j in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64, count=len(starts))
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BIT_OF for k in range(8)])
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _fingerprints(width: int, sets):
    """A batch function; ``sets`` is none, or the shingles' width, a broadcast of the common ones and the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = byte_list(batch.column("text"))
            prints = np.array([fingerprint_of(t, width) for t in texts], dtype=np.uint64).view(np.int64)
            more, names = [], []
            if sets is not None:
                shingle, common, similarity = sets
                found = [shingle_set(t, shingle) for t in texts]
                keys, late = zip(*(first_keys(x, common.value, similarity) for x in found), strict=True)
                flat = pa.array(np.concatenate([np.empty(0, dtype=np.int64), *keys]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in keys]))), pa.int32()), flat)
                more, names = [pa.array([set_name(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array([segment_counts(x) for x in found], pa.binary()), lists, pa.array(late, pa.int32())], ["name", "size", "counts", "keys", "common"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(prints), *more], names=["id", "digest", "print", *names])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, sets=None) -> DataFrame:
    """``id``, ``digest`` (a hash of the text), ``print``, the fingerprint as a signed long, and with ``sets`` the ``name``, ``size``, segment ``counts``, first ``keys`` and number of ``common`` ones among them of its shingle set, of every row."""
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(utf8(text_col)).alias("digest"), utf8(text_col).alias("text"))
    return named.mapInArrow(_fingerprints(width, sets), f"id {named.schema['id'].dataType.simpleString()}, digest bigint, print bigint" + ", name bigint, size int, counts binary, keys array<bigint>, common int" * (sets is not None))


def _hex(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def _grid_points(print_col: str, segment_bits: int) -> Column:
    """The fingerprint's grid point and those one step away within the grid, each as a long: every count has its own bits in it."""
    wide = segment_bits.bit_length()
    count = [F.bit_count(F.shiftrightunsigned(print_col, k * segment_bits).bitwiseAND(F.lit((1 << segment_bits) - 1))).cast("bigint") for k in range(BITS // segment_bits)]
    own = F.lit(0).cast("bigint")
    for k, c in enumerate(count):
        own = own.bitwiseOR(F.shiftleft(c, k * wide))
    # A step up or down changes one count's bits, by exclusive or with what changes in them.
    up = [F.when(c < segment_bits, F.shiftleft(c.bitwiseXOR(c + 1), k * wide)) for k, c in enumerate(count)]
    down = [F.when(c > 0, F.shiftleft(c.bitwiseXOR(c - 1), k * wide)) for k, c in enumerate(count)]
    return F.concat(F.array(own), F.transform(F.array_compact(F.array(*up, *down)), lambda step: own.bitwiseXOR(step)))


def _announced(prints: DataFrame, segment_bits: int) -> DataFrame:
    """``print`` and ``point`` of each fingerprint, dealt by their number first: few bytes become many rows."""
    spread = prints.repartition(prints.count() // ANNOUNCED + 1, "print")
    return spread.select("print", F.explode(_grid_points("print", segment_bits)).alias("point"))


def links(prints: DataFrame, segment_bits: int = SEGMENT_BITS, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b), a < b, of all distinct ``print`` values at ``distance`` (2 at most) bits or less."""
    if not 0 <= distance <= 2:
        raise ValueError("the grid's steps are for a distance of 2 bits at most")
    if segment_bits not in (1, 2, 4, 8):
        raise ValueError("segments have 1, 2, 4 or 8 bits")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    out = []
    while True:
        met = _announced(prints, segment_bits)
        crowd = cut(met.groupBy("point").agg(F.count("*").alias("n")).where("n > 1"))
        thin = crowd.where(F.col("n") <= dense) if segment_bits > 1 else crowd
        few = met.join(thin.select("point"), "point", "left_semi")
        out.append(few.select("point", F.col("print").alias("a")).join(few.select("point", F.col("print").alias("b")), "point").where((F.col("a") < F.col("b")) & near).select("a", "b"))
        thick = crowd.where(F.col("n") > dense).select("point")
        if segment_bits == 1 or thick.isEmpty():
            return reduce(DataFrame.unionByName, out).distinct()
        prints = cut(met.join(thick, "point", "left_semi").select("print").distinct())
        segment_bits //= 2


def _similar_prints(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Pairs of fingerprints (a, b) that tie together the fingerprints of equal or similar shingle sets."""
    of = cut(found.select("name", "print").distinct())
    least = of.groupBy("name").agg(F.min("print").alias("least"))
    a, b = (least.select(F.col("name").alias(x), F.col("least").alias(f"least_{x}")) for x in ("a", "b"))
    similar = similar_links(found, docs, id_col, text_col, shingle, similarity).join(a, "a").join(b, "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    return similar.unionByName(of.join(least, "name").select(F.col("least").alias("a"), F.col("print").alias("b"))).where("a < b")


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, segment_bits: int, distance: int, dense: int, similarity: float | None = None, shingle: int = SIMILAR_SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Ids with fingerprints, and the smallest id of each fingerprint's component."""
    sets = None if similarity is None else (shingle, docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, shingle)), similarity)
    found = kept(fingerprints(docs, id_col, text_col, width, sets))
    distinct = cut(found.groupBy("print").agg(F.min("id").alias("least")))
    pairs = links(distinct.select("print"), segment_bits, distance, dense)
    if similarity is not None:
        pairs = pairs.unionByName(_similar_prints(docs, found, id_col, text_col, shingle, similarity))
    of = components(pairs)
    named = distinct.join(of.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return found, cut(named.join(least, "component").select("print", "component", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, segment_bits: int = SEGMENT_BITS, distance: int = DISTANCE, dense: int = DENSE, similarity: float | None = None, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """One row per document row: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links."""
    found, label = _labelled(docs, id_col, text_col, width, segment_bits, distance, dense, similarity, shingle)
    return found.join(label, "print").select(F.col("id").alias(id_col), _hex("print").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, segment_bits: int = SEGMENT_BITS, distance: int = DISTANCE, dense: int = DENSE, similarity: float | None = None, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """``docs`` with its own columns, one row of each component: that of the smallest id (nulls last), of equal ids that of the least text hash."""
    found, label = _labelled(docs, id_col, text_col, width, segment_bits, distance, dense, similarity, shingle)
    row = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    rows = found.groupBy("id", "digest", "print").agg(F.count("*").alias("n")).join(label, "print")
    digest, own = free(docs.columns, "digest"), free(docs.columns, "kept_id")
    of, n = free([*docs.columns, digest, own], "kept_digest"), free(docs.columns, "kept_n")
    least = cut(rows.groupBy("component").agg(F.min_by(F.struct("id", "digest", "n"), row).alias("kept")).select(F.col("kept.id").alias(own), F.col("kept.digest").alias(of), F.col("kept.n").alias(n)))
    named = docs.withColumn(digest, F.xxhash64(utf8(text_col)))
    named = named.join(least, named[id_col].eqNullSafe(least[own]) & (named[digest] == least[of]), "left_semi")
    if not least.where(F.col(n) > 1).isEmpty():
        named = named.dropDuplicates([id_col, digest])
    return named.select(*docs.columns)
