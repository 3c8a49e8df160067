"""Substring dedup on words: passages of ``width`` words that occur more than once are found everywhere and removed.

1. Documents are dealt into buckets of about ``bucket_bytes`` by a hash of the row; that one exchange serves all steps. Rows of equal id and text are
   dealt as one row with their number, and become that many rows again at the end.
2. In each text the phrases of ``seed`` words that are least by hash among those of some window are its anchors. Equal windows have equal anchors, so only
   windows whose anchor occurs twice in the corpus can recur. A few hundredths of all positions are anchors, and only those are counted over the corpus.
3. The windows with such anchors are hashed (128 bits) and counted: those seen twice are confirmed recurring passages.
4. For each bucket, an Aho-Corasick automaton is compiled of the confirmed passages met there: the maximal runs of confirmed windows are tiled by
   windows, and equal tiles are one pattern. The bucket's documents are streamed through it, and every occurrence is located by text, not by hash.

An automaton holds at most its bucket's text, whatever the corpus; a passage that a third of all documents share is counted once per bucket before it
is shuffled, and buckets meet in groups of ``fan``, so that no task holds all rows of a common passage. Windows are judged on the input.

Null, empty and wordless texts have no words. Repeated rows are documents like any other, so their passages recur. Texts of fewer words than ``width`` keep
all of them. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm import _hashing as H
from wellspring.llm._common import byte_list, kept, pieces, utf8

WIDTH = 35
SEED = 8
BUCKET_BYTES = 2 << 20
#: Buckets whose rows of one key meet in one window: some megabytes.
FAN = 1 << 16
_BLOCK = 1 << 16


def dealt(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> DataFrame:
    """``bucket``, ``id``, ``text`` (bytes, see :func:`texts_of`), ``copies`` (rows of this id and text), with as many buckets as the corpus needs at ``bucket_bytes`` each."""
    return dealt_into(docs, id_col, text_col, bucket_bytes)[0]


def dealt_into(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> tuple[DataFrame, int]:
    """The rows of :func:`dealt`, and the number of buckets."""
    named = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    buckets = (named.agg(F.sum(F.length("text"))).first()[0] or 0) // bucket_bytes + 1
    # Only rows whose hash occurs twice are grouped by their texts, so that the others are not moved for it.
    row = F.xxhash64("id", "text")
    twice = kept(named.groupBy(row.alias("row")).agg(F.count("*").alias("n")).where("n > 1").select("row"))
    rows = named.withColumn("copies", F.lit(1).cast("bigint"))
    if not twice.isEmpty():
        hashed = named.withColumn("row", row)
        grouped = hashed.join(twice, "row", "left_semi").groupBy("id", "text").agg(F.count("*").alias("copies"))
        rows = hashed.join(twice, "row", "left_anti").select("id", "text", F.lit(1).cast("bigint").alias("copies")).unionByName(grouped)
    shown = rows.select(F.pmod(row, F.lit(buckets)).alias("bucket"), "id", "text", "copies")
    return shown.mapInArrow(_packed, f"bucket bigint, id {shown.schema['id'].dataType.simpleString()}, text binary, copies bigint"), buckets


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are what is moved most, so they are packed for it, each by itself."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches, "text"):
        packed = [None if t is None else packer.compress(t) for t in byte_list(batch.column("text"))]
        yield batch.set_column(2, "text", pa.array(packed, pa.binary()))


def texts_of(docs: pa.Table) -> list[bytes | None]:
    """The texts of dealt rows, unpacked."""
    unpacker = zstandard.ZstdDecompressor()
    return [None if t is None else unpacker.decompress(t) for t in byte_list(docs.column("text"))]


def expanded(out: DataFrame) -> DataFrame:
    """Every row ``copies`` times, by blocks so that no array grows with them; without that column."""
    blocks = out.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / _BLOCK))))
    each = blocks.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(_BLOCK).cast("bigint"), F.col("copies") - F.col("__block") * _BLOCK))))
    return each.drop("copies", "__block", "__copy")


def counted(docs: pa.Table) -> Iterator[tuple[bytes | None, int]]:
    """Each text with 1, or 2 for several copies: what occurs in it recurs then, and no count is asked for more."""
    return zip(texts_of(docs), np.minimum(docs.column("copies").to_numpy(), 2).tolist(), strict=True)


def totalled(rows: DataFrame, buckets: int, *key: str, fan: int = FAN) -> DataFrame:
    """``rows`` (bucket, key, n and more; one row of a key in a bucket) with ``home``, true on one row of each key, and there n over all buckets as ``total``.

    On a key's other rows ``total`` is more than 1. Buckets meet in groups of ``fan``, then the groups' first rows in groups of ``fan`` groups and so on, so that no
    window holds more than ``fan`` rows, whatever the number of buckets a key is in.
    """
    size, settled = 1, []
    while True:
        size *= fan
        same = Window.partitionBy(*key) if size >= buckets else Window.partitionBy(*key, F.col("bucket") - F.pmod("bucket", F.lit(size)))
        rows = rows.withColumn("total", F.sum("n").over(same)).withColumn("home", F.col("bucket") == F.min("bucket").over(same))
        if size >= buckets:
            return reduce(DataFrame.unionByName, settled, rows)
        rows = kept(rows)
        settled.append(rows.where("not home"))
        rows = rows.where("home").withColumn("n", F.col("total")).drop("total", "home")


def recurring(rows: DataFrame, buckets: int, *key: str, fan: int = FAN) -> DataFrame:
    """``bucket`` and key of the rows (bucket, key, n) whose key has n > 1 over all buckets."""
    return totalled(rows, buckets, *key, fan=fan).where(F.col("total") > 1).select("bucket", *key)


class Words:
    """One text's words with their hashes."""

    def __init__(self, text: bytes | None):
        data = np.frombuffer(text or b"", dtype=np.uint8)
        self.starts, self.ends = H.word_spans(data)
        self.n = len(self.starts)
        self.hashes = H.word_hashes(data, self.starts, self.ends)
        self.sums = H.prefix(self.hashes, H.WORD_BASE)

    def anchors(self, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Each window's anchor hash, and the hashes at anchor positions."""
        hashes = H.grams(self.sums, seed, H.WORD_BASE)
        least, chosen = H.anchors(hashes, width - seed + 1)
        return least, hashes[chosen]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of all windows, as two longs."""
        return H.grams(self.sums, width, H.WORD_BASE), H.grams(H.prefix(self.hashes, H.SECOND_BASE), width, H.SECOND_BASE)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _anchor_rows(width: int, seed: int):
    def run(docs: pa.Table) -> pa.Table:
        found = [x for t, copies in counted(docs) for x in [Words(t).anchors(width, seed)[1]] * copies]
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"bucket": pa.repeat(docs.column("bucket")[0], len(keys)), "anchor": _signed(keys), "n": pa.array(n)})

    return run


def _window_rows(width: int, seed: int):
    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        known = np.sort(_unsigned(anchors.column("anchor")))
        first, second = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)]
        if len(known):
            for text, copies in counted(docs):
                words = Words(text)
                likely = is_in(words.anchors(width, seed)[0], known)
                if likely.any():
                    a, b = words.windows(width)
                    first += [a[likely]] * copies
                    second += [b[likely]] * copies
        a, b = np.concatenate(first), np.concatenate(second)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, dtype=np.int64)
        bucket = (docs if docs.num_rows else anchors).column("bucket")[0]
        return pa.table({"bucket": pa.repeat(bucket, len(new)), "first": _signed(a[new]), "second": _signed(b[new]), "n": pa.array(np.diff(np.append(new, len(a))))})

    return run


def is_in(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


def compile_automaton(passages: set[str]) -> ahocorasick.Automaton | None:
    """An automaton whose values are the passages' lengths; none for no passages."""
    automaton = ahocorasick.Automaton()
    for passage in passages:
        automaton.add_word(passage, len(passage))
    automaton.make_automaton()
    return automaton if len(automaton) else None


def locate(automaton: ahocorasick.Automaton | None, line: str, words: list[str], width: int) -> np.ndarray:
    """The word positions at which a passage of ``width`` words starts in ``line``, the words joined and enclosed by spaces."""
    if automaton is None or len(words) < width:
        return np.empty(0, dtype=np.int64)
    at = np.fromiter((end - size + 1 for end, size in automaton.iter(line)), dtype=np.int64)
    return np.searchsorted(np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)))[:-1], at)


def _remove_rows(width: int):
    def run(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        # Of the confirmed hashes one half is enough to know a bucket's own windows by.
        known = np.sort(_unsigned(confirmed.column("first")))
        # Latin-1 keeps bytes apart as characters, so the automaton works on the text's bytes.
        texts = [t or b"" for t in texts_of(docs)]
        split = [[w.decode("latin-1") for w in t.split()] for t in texts]
        passages: set[str] = set()
        if len(known):
            for words, text in zip(split, texts, strict=True):
                if len(words) >= width:
                    for start, end in H.runs(is_in(Words(text).windows(width)[0], known)).tolist():
                        for k in {*range(start, end, width), end - 1}:
                            passages.add(f" {' '.join(words[k : k + width])} ")
        automaton = compile_automaton(passages)
        n, removed, digest, kept_text, spans = [], [], [], [], []
        for words in split:
            gone = H.covered(locate(automaton, f" {' '.join(words)} ", words, width), width, len(words))
            kept = " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words).encode("latin-1")
            n.append(len(words))
            removed.append(int(gone.sum()))
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept)
            spans.append(H.runs(gone).tolist())
        return pa.table(
            {"id": docs.column("id"), "copies": docs.column("copies"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept_text, pa.binary()).cast(pa.string()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
        )

    return run


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> DataFrame:
    """One row per document row: its id, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept`` (the words that stay, joined by spaces) and ``spans`` (runs of removed words)."""
    held, buckets = dealt_into(docs, id_col, text_col, bucket_bytes)
    kind = held.schema["id"].dataType.simpleString()
    by_bucket = held.groupBy("bucket")
    anchors = recurring(by_bucket.applyInArrow(_anchor_rows(width, seed), "bucket bigint, anchor bigint, n bigint"), buckets, "anchor", fan=fan)
    windows = by_bucket.cogroup(anchors.groupBy("bucket")).applyInArrow(_window_rows(width, seed), "bucket bigint, first bigint, second bigint, n bigint")
    confirmed = recurring(windows, buckets, "first", "second", fan=fan).select("bucket", "first")
    out = by_bucket.cogroup(confirmed.groupBy("bucket")).applyInArrow(_remove_rows(width), f"id {kind}, copies bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string, spans array<array<bigint>>")
    return expanded(out).withColumnRenamed("id", id_col)
