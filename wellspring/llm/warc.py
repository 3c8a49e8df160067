"""WARC fixity audit by Merkle trees.

Pages become WARC records, records become archives of ``per_archive`` consecutive page ids. In an archive, records are leaves in the order of their byte
offsets; ``fanout`` neighbouring nodes, an ordered range of offsets, make the node above, up to the archive's root. Two replicas are compared by roots, and
only below a node that differs are its children compared, level by level, down to the records that differ. A replica's records take their places in the tree by
their WARC-Record-ID (see :func:`aligned`), so a lost or inserted record is one difference and shifts no other. An archive's rows meet in one
group per node, never more than ``fanout`` of them; different archives are independent. The order of an archive of over ``large_bytes`` comes from running sums over parts of an archive (a
page id and a range of record hashes), over hashes and lengths only, with equal records as one row. An archive's bytes are written and read in segments of about ``segment_bytes``.

A node's hash is the SHA-256 of a line for each child in order, ``hash:first-end``, its hexadecimal hash and its range of byte offsets; a leaf's hash is that of the record's bytes.
So a root vouches for every record's bytes and place. A record whose bytes are right but whose range is another is ``moved``: records that changed places, or all that
follow one that was lost, inserted or has another length. Of records with one id in a replica's archive, the first in its order takes the place and the others are ``extra``.

Null page ids take a hash of the page in their place. Null URLs and pages are empty. Repeated rows are repeated records. Pages of equal ids are ordered by a hash of
their records; those of equal hashes too are equal. Columns of the pages may have any names. A record is held whole in a task's memory, however long. A record or archive
that only one replica has is reported as ``missing`` (not in the replica) or ``extra``. An empty table gives empty trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspring.llm._common import byte_list, cut
from wellspring.scratch import BROADCAST_ROWS

PER_ARCHIVE = 256
FANOUT = 16
SEGMENT_BYTES = 4 << 20
LARGE_BYTES = 32 << 20
_BLOCK = 1 << 16


# The head of a record up to its id, and from there on; fixed values of the format. The pages carry no date, so it is a parameter.
_TYPE, _ID, _DATE, _TARGET, _LENGTH = "WARC/1.1\r\nWARC-Type: resource\r\n", "WARC-Record-ID: <urn:uuid:", ">\r\nWARC-Date: ", "\r\nWARC-Target-URI: ", "\r\nContent-Type: text/html\r\nContent-Length: "
DATE = "2024-01-01T00:00:00Z"


def record_id(archive: Column, seq: Column) -> Column:
    """The id of an archive's record: a hash of its place, in the form of a UUID."""
    digest = F.md5(F.concat_ws(":", archive.cast("string"), seq.cast("string")).cast("binary"))
    return F.concat_ws("-", *(F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_archive: int = PER_ARCHIVE, large_bytes: int = LARGE_BYTES, date: str = DATE) -> DataFrame:
    """``archive``, ``seq``, ``offset``, ``length``, ``record`` (bytes) and ``id`` of each page's record."""
    url, html = F.coalesce(F.translate(F.col(url_col), "\r\n", ""), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    rest = F.concat(F.lit(_DATE + date + _TARGET), url, F.lit(_LENGTH), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))
    made = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.xxhash64(url_col, html_col)).alias("key"), rest.cast("binary").alias("record"))
    length = F.octet_length("record").cast("bigint") + F.lit(len(_TYPE) + len(_ID) + 36)
    placed = made.withColumn("archive", F.floor(F.col("key") / per_archive)).withColumn("length", length).withColumn("digest", F.xxhash64("record"))
    # Archives that fit a task are ranked whole, in the exchange that also serves to write them.
    big = cut(placed.groupBy("archive").agg(F.sum("length").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > large_bytes) | (F.col("n") > large_bytes // 512)).select("archive"))
    order = Window.partitionBy("archive").orderBy("key", "digest")
    whole = F.concat(F.lit(_TYPE + _ID).cast("binary"), record_id(F.col("archive"), F.col("seq")).cast("binary"), F.col("record")).alias("record")
    columns = ["archive", "seq", "offset", "length", whole, "id"]
    if big.isEmpty():
        return _ranked(placed, order).select(columns)
    # A small archive is over ``large_bytes`` in no case, so their number over that is what can be large, and is checked.
    few = F.broadcast(big) if big.count() <= BROADCAST_ROWS else big
    small = _ranked(placed.join(few, "archive", "left_anti"), order).select(columns)
    return small.unionByName(_ranked_by_parts(placed.join(few, "archive", "left_semi")).select(columns))


def _ranked(placed: DataFrame, order) -> DataFrame:
    return placed.withColumn("seq", (F.row_number().over(order) - 1).cast("bigint")).withColumn("offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _ranked_by_parts(placed: DataFrame) -> DataFrame:
    """The same for archives of any size: ranks from running sums over parts, equal records as one row until they get their places."""
    row = ["archive", "key", "digest", "length", "none"]
    placed = placed.withColumn("none", F.col("id").isNull())
    found = cut(_places(placed.groupBy(*row).agg(F.count("*").alias("n"))))
    several = found.where("n > 1")
    equal = placed.join(several, row, "left_semi").groupBy(*row, "id", "record").count().drop("count").join(several, row)
    blocks = equal.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _BLOCK))))
    each = blocks.withColumn("k", F.explode(F.sequence(F.col("block") * _BLOCK, F.least(F.col("n") - 1, F.col("block") * _BLOCK + (_BLOCK - 1)))))
    each = each.withColumn("seq", F.col("seq") + F.col("k")).withColumn("offset", F.col("offset") + F.col("k") * F.col("length"))
    return placed.join(found.where("n = 1"), row).unionByName(each, allowMissingColumns=True)


def _places(rows: DataFrame) -> DataFrame:
    """``seq`` and ``offset`` of the first of each row's ``n`` equal records in its archive, in the order of key and digest."""
    rows = rows.withColumn("part", F.shiftright("digest", 52))
    bytes_of = F.col("n") * F.col("length")
    inside = Window.partitionBy("archive", "key", "part").orderBy("digest", "length", "none").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("archive").orderBy("key", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("archive", "key", "part").agg(F.sum("n").alias("n"), F.sum(bytes_of).alias("bytes"))
    before = parts.select("archive", "key", "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("seq_before"), F.coalesce(F.sum("bytes").over(across), F.lit(0)).alias("bytes_before"))
    own = rows.withColumn("seq", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("offset", F.coalesce(F.sum(bytes_of).over(inside), F.lit(0)))
    return own.join(before, ["archive", "key", "part"]).select("archive", "key", "digest", "length", "none", "n", (F.col("seq") + F.col("seq_before")).alias("seq"), (F.col("offset") + F.col("bytes_before")).alias("offset"))


def _join_rows(rows: pa.Table) -> pa.Table:
    held, seq = byte_list(rows.column("record")), rows.column("seq").to_numpy()
    content = b"".join([held[k] or b"" for k in np.argsort(seq, kind="stable").tolist()])
    late = rows.column("segment")[0].as_py() > 0
    first, start = (int(seq.min()), int(rows.column("offset").to_numpy().min())) if late else (0, 0)
    return pa.table({"archive": rows.column("archive").slice(0, 1), "segment": rows.column("segment").slice(0, 1), "first": pa.array([first], pa.int64()), "start": pa.array([start], pa.int64()), "content": pa.array([content], pa.binary())})


def archives(made: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``archive``, ``segment``, ``first``, ``start`` (number and offset of its first record) and ``content``, its records' bytes in order.

    The records that start in a stretch of ``segment_bytes`` are a segment; a record has 150 bytes at least, so a segment's rows are bounded too.
    """
    cutting = made.select("archive", F.floor(F.col("offset") / segment_bytes).alias("segment"), "seq", "offset", "record")
    return cutting.groupBy("archive", "segment").applyInArrow(_join_rows, "archive bigint, segment bigint, first bigint, start bigint, content binary")


_SPLIT = "archive bigint, seq bigint, offset bigint, length bigint, record binary, record_id string"
_NAME = b"warc-record-id: <urn:uuid:"


def _split_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            archive, segment, first, start, content = (batch.column(name)[k].as_py() for name in ("archive", "segment", "first", "start", "content"))
            starts, found, names, at = [], [], [], 0
            while at < len(content):
                body = content.index(b"\r\n\r\n", at) + 4
                head = content[at:body].split(b"\r\n")
                size = next(int(line[15:]) for line in head if line[:15].lower() == b"content-length:")
                names.append(next((line[len(_NAME) : -1].decode("latin-1") for line in head if line[: len(_NAME)].lower() == _NAME), None))
                starts.append(start + at)
                found.append(content[at : body + size + 4])
                at = body + size + 4
            n = len(found)
            columns = [pa.array([segment] * n, pa.int64()), pa.array([archive] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(starts, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(found, pa.binary()), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "archive", "seq", "offset", "length", "record", "record_id"])


def split_archives(held: DataFrame) -> DataFrame:
    """``archive``, ``seq``, ``offset``, ``length``, ``record`` and ``record_id`` of each record in archives' bytes, counted on from where each segment starts."""
    return held.select("archive", "segment", "first", "start", "content").mapInArrow(_split_segments, f"segment bigint, {_SPLIT}").drop("segment")


def write_archives(made: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """WARC files below ``path``, one for each segment of an archive: the records end with two line breaks, which the text format puts after each."""
    text = F.expr("substring(record, 1, length - 4)").cast("string").alias("value")
    named = made.select("archive", F.floor(F.col("offset") / segment_bytes).alias("segment"), "offset", text)
    ordered = named.repartition("archive", "segment").sortWithinPartitions("archive", "segment", "offset")
    ordered.select("archive", "segment", "value").write.partitionBy("archive", "segment").option("lineSep", "\r\n\r\n").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of such files, as :func:`split_archives` gives them; places and offsets count on from where each segment starts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = lambda name: F.regexp_extract("path", rf"{name}=(-?\d+)", 1).cast("bigint").alias(name)
    zero = F.lit(0).cast("bigint")
    found = files.select(part("archive"), part("segment"), zero.alias("first"), zero.alias("start"), "content").mapInArrow(_split_segments, f"segment bigint, {_SPLIT}")
    before = Window.partitionBy("archive").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("archive", "segment").agg(F.sum("length").alias("bytes"), F.count("*").alias("n")).select("archive", "segment", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return found.join(sizes, ["archive", "segment"]).select("archive", (F.col("seq") + F.col("first")).alias("seq"), (F.col("offset") + F.col("start")).alias("offset"), "length", "record", "record_id")


def aligned(replica: DataFrame, primary: DataFrame) -> DataFrame:
    """A replica's records (of :func:`split_archives`) with ``seq`` that of the primary's record of the same id; records of other ids come after the primary's last place."""
    own = primary.select("archive", F.col("seq").alias("place"), record_id(F.col("archive"), F.col("seq")).alias("record_id"))
    last = primary.groupBy("archive").agg(F.max("seq").alias("last"))
    # The first record of an id in the replica; the others have no place. A count of copies is all that meets at an id.
    first = replica.where("record_id is not null").groupBy("archive", "record_id").agg(F.min("seq").alias("seq"))
    found = replica.join(first.join(own, ["archive", "record_id"]), ["archive", "record_id", "seq"], "left").join(last, "archive", "left")
    # An unknown record keeps its own number, after the primary's; where that has no such archive, from 0.
    return found.withColumn("seq", F.coalesce("place", F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("seq"))).drop("place", "last")


def tree(made: DataFrame, fanout: int = FANOUT, levels: int | None = None) -> DataFrame:
    """From records, or their ``hash`` in place of them: ``archive``, ``level`` (0 for leaves), ``node``, ``first``, ``end`` (byte offsets) and ``hash`` of every node; the root of every archive is at the last level."""
    level = cut(made.select("archive", F.col("seq").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("end"), (F.col("hash") if "hash" in made.columns else F.sha2("record", 256)).alias("hash")))
    if levels is None:
        levels = depth(level.withColumnRenamed("node", "seq"), fanout)
    out = level.withColumn("level", F.lit(0))
    # Each level is a small part of the one below; only the leaves are worth keeping.
    for k in range(1, levels + 1):
        line = F.concat("hash", F.lit(":"), F.col("first").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("\n"))
        children = F.array_sort(F.collect_list(F.struct("node", line.alias("line"))))
        level = level.groupBy("archive", F.floor(F.col("node") / fanout).alias("up")).agg(F.min("first").alias("first"), F.max("end").alias("end"), children.alias("c")).select("archive", F.col("up").alias("node"), "first", "end", F.sha2(F.array_join(F.col("c.line"), "").cast("binary"), 256).alias("hash"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("archive", "level", "node", "first", "end", "hash")


def depth(made: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the leaves that the largest archive needs, one at least."""
    most = made.agg(F.max("seq")).first()[0] or 0
    return max(1, math.ceil(math.log(most + 1, fanout) - 1e-9))


def audit(primary: DataFrame, replica: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two trees: ``archive``, ``seq``, ``status`` (corrupt, moved, missing, extra), and the byte range ``first`` to ``end``.

    Starts from the roots; each level keeps the nodes below a differing one whose hashes or ranges differ. A moved record's range is the primary's.
    """
    bad = None
    for k in range(levels, -1, -1):
        a, b = (t.where(F.col("level") == k).select("archive", "node", "first", "end", "hash") for t in (primary, replica))
        if bad is not None:
            above = bad.select("archive", F.col("node").alias("up"))
            a, b = (t.withColumn("up", F.floor(F.col("node") / fanout)).join(above, ["archive", "up"], "left_semi").drop("up") for t in (a, b))
        joined = a.alias("a").join(b.alias("b"), ["archive", "node"], "full").where(~F.struct("a.hash", "a.first", "a.end").eqNullSafe(F.struct("b.hash", "b.first", "b.end")))
        status = F.when(F.col("b.hash").isNull(), "missing").when(F.col("a.hash").isNull(), "extra").when(F.col("a.hash") == F.col("b.hash"), "moved").otherwise("corrupt")
        bad = cut(joined.select("archive", "node", status.alias("status"), F.coalesce("a.first", "b.first").alias("first"), F.coalesce("a.end", "b.end").alias("end")))
    return bad.withColumnRenamed("node", "seq")
