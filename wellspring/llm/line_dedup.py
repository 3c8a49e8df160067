"""Line dedup across sites: lines that occur on many distinct sites are boilerplate and are removed from every document.

Lines are the parts of a text between line feeds; a line without other characters than white space is never removed. Per line hash, HyperLogLog sketches
of the sites are built before the shuffle and merged after it. Lines whose estimate is clear of the threshold are decided by it; those near the threshold,
within ``margin`` standard errors, get an exact distinct count. A sketch of few sites is practically exact, so little is near.

Only DataFrame functions are used. Lines go through the shuffle as 8-byte hashes with a sketch, and for the exact count as distinct pairs of hash and site, so
a very common line is one row of each task. Removal joins back the positions of the hit lines by document, not by line, so a line that a third of all documents have stays spread.

Null text stays null and has no lines; an empty text has one line, which is blank. A null site counts as no site. Repeated rows are treated alike, and
count once per site. Very long texts are one row of lines each. An empty table gives an empty result. Columns of the documents may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm._common import cut, free

MIN_SITES = 10
LG_K = 12
MARGIN = 3.0


def _lines(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) == ""


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """``line`` (its 64-bit hash) and ``sites`` (estimated or exact) of every line on ``min_sites`` sites or more."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.explode(_lines(F.col(text_col))).alias("text"), F.col(site_col).cast("string").alias("site")).where(~_blank(F.col("text")) & F.col("site").isNotNull()).select(F.xxhash64("text").alias("line"), "site")
    error = 1.04 / (2 ** (lg_k / 2))
    sketches = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    spread = cut(sketches.where(F.col("sites") >= min_sites * (1 - margin * error) - 1))
    far = F.col("sites") > min_sites * (1 + margin * error) + 1
    near = spread.where(~far).select("line")
    exact = lines.distinct().join(near, "line", "left_semi").groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return cut(spread.where(far).unionByName(exact))


def _hits(docs: DataFrame, lines: DataFrame, key: Column, text_col: str) -> DataFrame:
    """The positions of the lines to remove (``gone``), by document (``key``)."""
    placed = docs.where(F.col(text_col).isNotNull()).select(key.alias("key"), F.posexplode(_lines(F.col(text_col))).alias("at", "line_text")).where(~_blank(F.col("line_text"))).select("key", "at", F.xxhash64("line_text").alias("line"))
    return placed.join(lines.select("line"), "line", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def _kept(text_col: str, gone: str) -> Column:
    """The lines that stay. The lines are bound to a variable, so that they are split once; the positions that stay come from a hash set."""

    def at_places(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.transform(places, lambda i: F.get(lines, i))

    return F.transform(F.array(_lines(F.col(text_col))), at_places)[0]


def _joined(docs: DataFrame, text_col: str, id_col: str, site_col: str, **rule) -> tuple[DataFrame, str]:
    """``docs`` with the positions of its lines that are boilerplate, or null, and the name of that column, which is none of its own."""
    gone, key = free(docs.columns, "gone"), free(docs.columns, "key")
    # Two hashes, as of very many documents some share one.
    row = [F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)]
    both = F.struct(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit(1), *row).alias("b"))
    hits = _hits(docs, boilerplate(docs, text_col, site_col, **rule), both, text_col).select(F.col("key").alias(key), F.col("gone").alias(gone))
    return docs.withColumn(key, both).join(hits, key, "left").drop(key), gone


def remove_boilerplate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", site_col: str = "source", **rule) -> DataFrame:
    """``docs`` with its own columns, its texts less boilerplate lines; documents stay, even those that end up empty.

    ``rule``: ``min_sites``, ``lg_k``, ``margin`` of :func:`boilerplate`.
    """
    joined, gone = _joined(docs, text_col, id_col, site_col, **rule)
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(_kept(text_col, gone), "\n"))
    return joined.withColumn(text_col, text).select(*docs.columns)


def report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", site_col: str = "source", **rule) -> DataFrame:
    """One row per document: its id, ``n_lines``, ``n_removed`` and ``kept_sha256`` of the text that stays (null: empty)."""
    found, gone = _joined(docs.select(id_col, text_col, site_col), text_col, id_col, site_col, **rule)
    kept = F.when(F.col(gone).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(_kept(text_col, gone), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_lines(F.col(text_col))))
    n_removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    return found.select(id_col, n_lines.cast("bigint").alias("n_lines"), n_removed.cast("bigint").alias("n_removed"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
