"""Benchmark decontamination: find the benchmark's word windows in training texts, then drop the documents or the spans.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, which is a rule on single bytes of UTF-8. A window is
``n`` consecutive words of one item; an item of fewer words, but not none, is one window. The distinct windows of one block of the benchmark are
broadcast as a set of hashes in sorted arrays with the items' words, on which a hit is verified. A block has at most twice ``block_bytes`` of item texts and ids, or one
item, which is known before it is collected, and its index ``INDEX_SHARE`` times that; a larger benchmark is scanned block by block. Every document
is read whole; no row is shuffled while there is one block.

Null or wordless texts have no words and no hits. Items with null text or no words have no windows. Repeated rows are judged alike, one by one;
an item id that occurs on several rows counts once, and equal items are collected once. An empty benchmark hits nothing. A null item id can hit, but is not
listed. Very long texts are scanned whole. Columns of the documents may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm import _hashing as H
from wellspring.llm._common import byte_list, free, pieces, utf8

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Bytes of an index for each byte of item texts and ids, at most; words of one letter come near it. And what an index may have whatever the text.
INDEX_SHARE, INDEX_LEAST = 40, 1 << 20
SHARE = 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words of a text."""
    return text.translate(_FOLD).split() if text else []


@dataclass
class _Windows:
    """Windows of one length: sorted hashes, the first word of one of each, and runs of item numbers."""

    hashes: np.ndarray
    place: np.ndarray
    first: np.ndarray
    items: np.ndarray


class WindowIndex:
    """The distinct windows of some benchmark items, by length, over the items' normalised words."""

    def __init__(self, items: list[tuple[object, bytes | None]], n: int = WINDOW):
        held = [(item, words) for item, text in items if (words := words_of(text))]
        self.names = sorted({str(item) for item, _ in held if item is not None})
        number = {name: k for k, name in enumerate(self.names)}
        self.line = b" ".join(w for _, words in held for w in words)
        data = np.frombuffer(self.line, dtype=np.uint8)
        self.starts, self.ends = (x.astype(np.uint32) for x in H.word_spans(data))
        sums = [H.prefix(H.word_hashes(data, self.starts, self.ends), base) for base in (H.WORD_BASE, H.SECOND_BASE)]
        count = np.fromiter((len(words) for _, words in held), dtype=np.int64, count=len(held))
        own = np.fromiter((-1 if item is None else number[str(item)] for item, _ in held), dtype=np.int32, count=len(held))
        begin = np.cumsum(count) - count
        self.windows: dict[int, _Windows] = {}
        for width in np.unique(np.minimum(count, n)).tolist():
            which = np.flatnonzero(np.minimum(count, n) == width)
            many = count[which] - width + 1
            of = np.repeat(which, many)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[of]
            a, b = (H.span_hash(s, place, place + width, base) for s, base in zip(sums, (H.WORD_BASE, H.SECOND_BASE), strict=True))
            order = np.lexsort((own[of], b, a))
            a, b, place, item = a[order], b[order], place[order], own[of][order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            fresh = new.copy()
            fresh[1:] |= item[1:] != item[:-1]
            listed = fresh & (item >= 0)
            start = np.flatnonzero(new)
            self.windows[width] = _Windows(a[start], place[start].astype(np.uint32), np.append(np.concatenate(([0], np.cumsum(listed)))[start], listed.sum()).astype(np.uint32), item[listed])

    @property
    def nbytes(self) -> int:
        return len(self.line) + self.starts.nbytes + self.ends.nbytes + sum(x.nbytes for w in self.windows.values() for x in (w.hashes, w.place, w.first, w.items)) + sum(map(len, self.names))

    def find(self, text: bytes | None) -> tuple[np.ndarray, set[str]]:
        """Which words of a text lie inside an occurrence of a window, and the ids of the items with such windows."""
        folded = text.translate(_FOLD) if text else b""
        data = np.frombuffer(folded, dtype=np.uint8)
        starts, ends = H.word_spans(data)
        hit, items = np.zeros(len(starts) + 1, dtype=np.int32), set()
        if not len(starts):
            return np.zeros(0, dtype=bool), items
        sums = H.prefix(H.word_hashes(data, starts, ends), H.WORD_BASE)
        for width, held in self.windows.items():
            keys = H.grams(sums, width, H.WORD_BASE)
            at = np.searchsorted(held.hashes, keys)
            for k in np.flatnonzero(held.hashes[np.minimum(at, len(held.hashes) - 1)] == keys).tolist():
                plain, w = b" ".join(folded[starts[k] : ends[k + width - 1]].split()), int(at[k])
                while w < len(held.hashes) and held.hashes[w] == keys[k]:
                    p = held.place[w]
                    if plain == self.line[self.starts[p] : self.ends[p + width - 1]]:
                        items.update(self.names[i] for i in held.items[held.first[w] : held.first[w + 1]].tolist())
                        hit[k] += 1
                        hit[k + width] -= 1
                        break
                    w += 1
        return np.cumsum(hit[:-1]) > 0, items


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), utf8(text_col).alias("text")).distinct()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[tuple[int, int]]:
    """Shares (parts, rest) of the items' hashes, each of at most twice ``block_bytes`` of texts and ids, or of one item: what a hash deals unevenly is dealt again."""
    items = _items(benchmark, item_col, text_col)
    size, h = F.length("text") + F.coalesce(F.length(F.col("item").cast("string")), F.lit(0)), F.xxhash64("item", "text")
    parts = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // block_bytes))
    out, todo = [], [(1, 0)] if parts == 1 else [(parts, None)]
    while todo:
        n, rest = todo.pop(0)
        if n == 1:
            out.append((1, 0))
            continue
        own = items if rest is None else items.where(F.pmod(h, F.lit(n // 2)) == rest)
        for r in own.groupBy(F.pmod(h, F.lit(n)).alias("rest")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect():
            if r.bytes <= 2 * block_bytes or r.n == 1:
                out.append((n, r.rest))
            else:
                todo.append((2 * n, r.rest))
    return sorted(out)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, n: int, blocks: list[tuple[int, int]]) -> Iterator:
    """Broadcast indexes of the items in blocks, whose sizes are known before anything is collected: an index has ``INDEX_SHARE`` bytes at most for each of its texts and ids, and ``INDEX_LEAST``."""
    items = _items(benchmark, item_col, text_col)
    for parts, rest in blocks:
        block = [(r.item, bytes(r.text)) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == rest).collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(WindowIndex(block, n))


def _scan(shared):
    """A batch function: a row's key, word count, hit spans as word positions, and item ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in pieces(batches, "text"):
            counts, hits, items, found_spans = [], [], [], []
            for text in byte_list(batch.column("text")):
                hit, found = index.find(text)
                counts.append(len(hit))
                hits.append(int(hit.sum()))
                items.append(sorted(found))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                found_spans.append(edges.reshape(-1, 2).tolist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(found_spans, pa.list_(pa.list_(pa.int64())))],
                names=[*(name for name in batch.schema.names if name != "text"), "n_words", "n_hit", "items", "spans"],
            )

    return run


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: its id, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings), ``spans`` (hit word runs) and ``contaminated``."""
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(utf8(text_col)).alias("digest"), utf8(text_col).alias("text"))
    schema = f"id {named.schema['id'].dataType.simpleString()}, digest bigint, n_words bigint, n_hit bigint, items array<string>, spans array<array<bigint>>"
    frames = [named.mapInArrow(_scan(shared), schema) for shared in _indexes(benchmark, item_col, item_text_col, n, _blocks(benchmark, item_col, item_text_col, block_bytes))]
    out = frames[0].drop("digest") if len(frames) == 1 else _merged(frames)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("id", id_col)


def _merged(frames: list[DataFrame]) -> DataFrame:
    """The hits of several blocks brought together by document; a hit word counts once."""
    hits = frames[0]
    for frame in frames[1:]:
        hits = hits.unionByName(frame)
    # Spans in order of their starts become maximal runs: one that begins within or right after the last run makes that longer.
    last = lambda runs: F.element_at(runs, -1)
    longer = lambda runs, s: F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.array(last(runs)[0], F.greatest(last(runs)[1], s[1]))))
    merged = F.aggregate("found", F.array().cast("array<array<bigint>>"), lambda runs, s: F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))[1] >= s[0]), longer(runs, s)).otherwise(F.concat(runs, F.array(s))))
    joined = (
        hits.where("n_hit > 0")
        .distinct()
        .groupBy("id", "digest")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
        .select(F.col("id").alias("hit_id"), F.col("digest").alias("hit_digest"), "items", merged.alias("found"))
        .withColumn("n_hit", F.aggregate("found", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0]))
    )
    counts = frames[0].select("id", "digest", "n_words")
    return counts.join(joined, counts["id"].eqNullSafe(joined["hit_id"]) & counts["digest"].eqNullSafe(joined["hit_digest"]), "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("found", F.array().cast("array<array<bigint>>")).alias("spans")
    )


def _remove(shared, text_col: str, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in pieces(batches, text_col):
            keep, texts = [], []
            for text in byte_list(batch.column(text_col)):
                hit, _ = index.find(text)
                keep.append(not hit.any() or SHARE * int(hit.sum()) < len(hit))
                texts.append(_without(text, hit) if spans and hit.any() else text)
            if spans:
                at = batch.schema.get_field_index(text_col)
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(pa.string()).cast(batch.schema.field(at).type))
            else:
                yield batch.filter(pa.array(keep))

    return run


def _remove_found(text_col: str, spans_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts = []
            for text, spans in zip(byte_list(batch.column(text_col)), batch.column(spans_col).to_pylist(), strict=True):
                if spans:
                    hit = np.zeros(len(words_of(text)), dtype=bool)
                    for start, end in spans:
                        hit[start:end] = True
                    text = _without(text, hit)
                texts.append(text)
            at = batch.schema.get_field_index(text_col)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(pa.string()).cast(batch.schema.field(at).type))
            yield batch.select(batch.schema.names[:-1])

    return run


def _without(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words; what stands between words stays."""
    marks = np.frombuffer(text.translate(_FOLD), dtype=np.uint8) != 32
    starts = np.flatnonzero(np.diff(np.concatenate(([False], marks)).astype(np.int8)) == 1)
    word = np.zeros(len(marks), dtype=np.int64)
    word[starts] = 1
    gone = marks & hit[np.maximum(np.cumsum(word) - 1, 0)]
    return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with its own columns, less contaminated documents, or less the hit words where ``remove`` is ``"spans"``.

    With several blocks, documents and spans are judged on the input by ``scan`` over all of them, and spans are removed in one pass.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if len(blocks) == 1:
        (shared,) = _indexes(benchmark, item_col, item_text_col, n, blocks)
        return docs.mapInArrow(_remove(shared, text_col, remove == "spans"), docs.schema)
    digest, bad, spans = (free(docs.columns, name) for name in ("digest", "found_digest", "found_spans"))
    named = docs.withColumn(digest, F.xxhash64(utf8(text_col)))
    found = scan(named, benchmark, digest, text_col, item_col, item_text_col, n, block_bytes).withColumnRenamed(digest, bad)
    if remove == "documents":
        return named.join(found.where("contaminated").select(bad).distinct(), named[digest] == F.col(bad), "left_anti").drop(digest)
    found = found.where("n_hit > 0").select(bad, F.col("spans").alias(spans)).dropDuplicates([bad])
    joined = named.join(found, named[digest] == found[bad], "left")
    return joined.select(*docs.columns, spans).mapInArrow(_remove_found(text_col, spans), docs.schema)
