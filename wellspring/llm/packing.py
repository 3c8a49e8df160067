"""Packing by cutting-stock column generation: documents become sequences of at most ``capacity`` tokens with little padding.

Every document is tokenised whole and gets an end token. Full pieces of ``capacity`` tokens are cut off its front; what remains is one piece, so a
document that fits is never cut. Piece lengths, rounded up to ``quantum``, form a histogram of at most ``capacity / quantum`` classes, whatever the
corpus; pieces too short for that go together in bundles of equal lengths, which make items of about ``BUNDLE`` tokens. On that histogram a linear program over patterns (multisets of classes that fit in a sequence) is solved by column generation: a revised simplex
holds the master, and an unbounded knapsack by dynamic programming prices new patterns. Patterns are rounded down, the few pieces left over (a number that
depends on the classes alone) are placed first-fit-decreasing, and the pieces of each class, ranked in Spark, take the patterns' slots in order.

Ranks come from counts by class and hash bucket, so neither a class nor the whole table passes through one task. Only the histogram reaches the driver.
A sequence is padded to ``capacity``, but one whose length is a power of two is not.

Null or empty texts have no tokens but the end token. Repeated rows are packed as often as they occur; rows that tie in rank are equal. An empty table
gives no pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm import _hashing as H
from wellspring.llm._common import byte_list, cut, pieces, utf8

CAPACITY = 4096
QUANTUM = 8
END_ID = 2
CACHE = 150_000
PART_BYTES = 64
BATCH_BYTES = 2_000_000
#: Tokens in which equally short pieces go together, those of at most a quarter of it.
BUNDLE = 256
GAP = 5e-4
#: Patterns taken from one pricing, and kept at hand.
MORE, POOL = 64, 4096

# The tokenizer's pattern; fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """Of each character below 256, its UTF-8 bytes in byte-level letters: printable bytes stand for themselves, the others, in order, for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


_BYTE_LETTER = _byte_letters()


class Recent:
    """Values by key. When ``limit`` of them are held they become the older generation, from which those still in use come back: common keys stay."""

    def __init__(self, limit: int):
        self.limit, self.young, self.older = limit, {}, {}

    def values(self, keys: list, make) -> list:
        """Of each key its value, by ``make(position, key)`` where it is not held."""
        out = list(map(self.young.get, keys))
        for k in [k for k, value in enumerate(out) if value is None]:
            value = self.older.get(keys[k])
            out[k] = make(k, keys[k]) if value is None else value
            if len(keys[k]) <= PART_BYTES:
                self.young[keys[k]] = out[k]
                if len(self.young) >= self.limit:
                    self.older, self.young = self.young, {}
        return out


# Kinds of bytes: white space, letters (of several bytes too), digits, anything else.
_SPACES, _LETTER, _DIGIT, _MARK = range(4)
_KIND = np.full(256, _MARK, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACES
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LEAD = 0xC3  # of U+00C0 to U+00FF, all letters but the two below
_TIMES, _DIVIDED = 0x97, 0xB7


class WordTokenizer:
    """Ids of texts as unsigned 32-bit numbers, by way of the ids of the distinct parts of a batch.

    Where the tokenizer drops white space and splits by letters, digits and the rest, as is checked, a text's ids are those of its white-space separated
    words; and a text of ASCII and Latin-1 letters is split into the tokenizer's own pieces, of which there are fewer. Other tokenizers get whole texts.
    Parts are found, hashed (64 bits, compared within a batch only) and put together again in numpy; the tokenizer sees each distinct part once, unless
    it is remembered: at most two times ``cache`` parts, none of over ``PART_BYTES`` bytes.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        state = json.loads(self.tokenizer.to_str())
        split = [p for p in (state.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.by_word = any(p["invert"] and p["behavior"] == "Removed" and p["pattern"].get("Regex") == SPLIT for p in split)
        self.recent = Recent(cache)

    def _ids(self, part: bytes, piece: bool) -> bytes:
        """Ids of a part. One that the tokenizer's pattern does not split further goes to its model at once, in its letters for bytes."""
        text = part.decode()
        if not piece:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.model.tokenize(text if text.isascii() and text.isprintable() else text.translate(_BYTE_LETTER))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_word:
            return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids if t else [], dtype="<u4") for t in texts]
        # Two more line feeds, so that what follows a part can be looked at.
        blob = b"\n".join([*(t or b"" for t in texts), b"", b""])
        firsts = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
        data, kind, odd = _classed(np.frombuffer(blob, dtype=np.uint8), firsts)
        starts, ends = _parts(data, kind)
        if not len(starts):
            return [np.empty(0, dtype="<u4")] * len(texts)
        hashes = H.word_hashes(data, starts, ends)
        distinct, where = np.unique(hashes, return_inverse=True)
        place = np.empty(len(distinct), dtype=np.int64)
        place[where] = np.arange(len(hashes))
        folded = data.tobytes()
        whole = odd[np.searchsorted(firsts, starts[place], side="right") - 1]
        parts = [folded[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
        values = self.recent.values(parts, lambda k, part: self._ids(part, not whole[k]))
        table = np.frombuffer(b"".join(values), dtype="<u4")
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        base = np.cumsum(sizes) - sizes
        count = sizes[where]
        before = np.cumsum(count) - count
        ids = table[np.repeat(base[where] - before, count) + np.arange(count.sum())]
        edge = np.append(before, count.sum())[np.searchsorted(starts, firsts)]
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _classed(raw: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, their kinds, and which texts have other than ASCII and Latin-1 letters; in those, only white space is told from the rest."""
    data, kind = _FOLD[raw], _KIND[raw]
    odd = np.zeros(len(firsts), dtype=bool)
    bad = [np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))]  # <|, which may begin a special token
    high = np.flatnonzero(raw >= 128)
    if len(high):
        lead = high[raw[high] == _LEAD]
        follow = lead + 1
        then = raw[np.minimum(follow, len(raw) - 1)]
        good = (then >= 128) & (then < 192) & (then != _TIMES) & (then != _DIVIDED)
        fine = np.zeros(len(raw), dtype=bool)
        fine[lead[good]] = fine[follow[good]] = True
        bad.append(high[~fine[high]])
        data[follow[good & (then < 0x9F)]] += 32
    bad = np.concatenate(bad)
    if len(bad):
        odd[np.searchsorted(firsts, bad, side="right") - 1] = True
        for k in np.flatnonzero(odd).tolist():
            own = slice(firsts[k], firsts[k + 1])
            data[own] = raw[own]
            kind[own] = np.where(kind[own] == _SPACES, _SPACES, _LETTER)
    return data, kind, odd


def _parts(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one kind, of digits one by one, with the endings of the pattern (``'s`` and so on) as parts of their own."""
    edge = np.ones(len(kind), dtype=bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    mark = np.flatnonzero((data == 39) & (kind == _MARK) & edge)
    mark = mark[mark + 2 < len(data)]
    mark = mark[kind[mark + 1] == _LETTER]
    a, b = data[mark + 1], data[mark + 2]
    one = np.isin(a, np.frombuffer(b"stmd", dtype=np.uint8))
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    for these, width in ((mark[one], 1), (mark[two], 2)):
        edge[these + 1] = False
        edge[these + 1 + width] = True
    places = np.flatnonzero(edge)
    own = kind[places] != _SPACES
    return places[own], np.append(places[1:], len(kind))[own]


def _cut_pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        end = np.array([end_id], dtype="<u4")
        for batch in pieces(batches, "text", BATCH_BYTES):
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for row, ids in enumerate(tokenizer.encode(byte_list(batch.column("text")))):
                ids = np.concatenate((ids, end))
                total = len(ids)
                for start in range(0, total, capacity):
                    piece = ids[start : start + capacity]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def cut_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` of each piece."""
    named = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return named.mapInArrow(_cut_pieces(tokenizer_path, capacity, end_id), f"id {named.schema['id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def price(values: np.ndarray, sizes: np.ndarray, capacity: int, more: int = 0) -> tuple[float, np.ndarray]:
    """The multiset of items of most value within ``capacity`` (unbounded knapsack by dynamic programming): its value and counts.

    With ``more``, counts are rows: the best multiset, then the best ones that hold a given item, for the ``more`` items where those are worth most.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_up, values_up = sizes[order], values[order]
    fit = np.searchsorted(sizes_up, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fit[c]:
            gain = best[c - sizes_up[:k]] + values_up[:k]
            if gain[i := int(gain.argmax())] > best[c] + 1e-12:
                best[c], last[c] = gain[i], order[i]

    def counts_at(c: int) -> np.ndarray:
        counts = np.zeros(len(sizes), dtype=np.int64)
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                counts[last[c]] += 1
                c -= sizes[last[c]]
        return counts

    top = counts_at(capacity)
    if not more:
        return float(best[capacity]), top
    held = values + best[capacity - sizes]
    rows = [top]
    for i in np.argsort(-held, kind="stable")[:more].tolist():
        rows.append(counts_at(capacity - int(sizes[i])))
        rows[-1][i] += 1
    return float(best[capacity]), np.unique(np.stack(rows), axis=0)


def _first_fit(demand: np.ndarray, sizes: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns that first-fit-decreasing makes of the demand, each as often as it fits."""
    left, out = demand.astype(np.int64), []
    order = np.argsort(-sizes, kind="stable").tolist()
    while left.any():
        room, counts = capacity, np.zeros(len(sizes), dtype=np.int64)
        for i in order:
            counts[i] = min(left[i], room // sizes[i])
            room -= counts[i] * sizes[i]
        left -= counts * (left[counts > 0] // counts[counts > 0]).min()
        out.append(counts)
    return out


def solve(demand: np.ndarray, sizes: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """The linear program's patterns with their multiplicities: fewest sequences that cover ``demand`` pieces of each size.

    Starts from one pattern per class, with those of first-fit-decreasing at hand, and adds the pattern of best price until the duals' bound proves the number of
    sequences to be at most 1 + ``gap`` times the least. It always ends: each step but those without progress lowers the number of sequences, and after as many
    steps without progress as there are classes the demand is shifted by a tiny amount of its own for each class, which lets no basis come again.
    """
    n = len(sizes)
    patterns = [np.where(np.arange(n) == i, capacity // sizes[i], 0) for i in range(n)]
    inverse = np.diag(1.0 / (capacity // sizes))
    demand = demand.astype(float)
    x = inverse @ demand
    pool = np.stack(_first_fit(demand, sizes, capacity)) if n else np.empty((0, n))
    step = idle = 0
    while True:
        duals = inverse.sum(axis=0)
        worth = pool @ duals if len(pool) else np.empty(0)
        if len(worth) and worth.max() > 1 + gap:
            column = pool[int(worth.argmax())].copy()  # a view would keep the whole pool
        else:
            value, found = price(np.maximum(duals, 0), sizes, capacity, MORE)
            if value <= 1 + gap:
                break
            gains = found @ duals
            column = found[int(gains.argmax())].copy()
            pool = np.concatenate((pool[np.argsort(-worth)[: POOL - len(found)]], found)) if len(pool) else found
            if gains.max() <= 1 + gap:  # only negative duals made it look better
                break
        direction = inverse @ column
        up = direction > 1e-7
        ratios = np.where(up, x / np.where(up, direction, 1), np.inf)
        # Of pivots that are as good, the largest keeps the basis well conditioned.
        out = int(np.where(ratios <= ratios.min() * (1 + 1e-9) + 1e-12, direction, -1.0).argmax())
        idle = idle + 1 if ratios[out] <= 1e-12 else 0
        x = x - ratios[out] * direction
        x[out] = ratios[out]
        x = np.maximum(x, 0)
        inverse[out] /= direction[out]
        rest = direction.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
        patterns[out] = column
        step += 1
        if idle > n:
            demand = demand + demand.max() * 1e-9 * np.random.default_rng(step).random(n)
            x, idle = np.maximum(inverse @ demand, 0), 0
        if step % 50 == 0:
            inverse = np.linalg.inv(np.stack(patterns, axis=1).astype(float))
            x = np.maximum(inverse @ demand, 0)
    return list(zip(patterns, x, strict=True))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size to count) with whole multiplicities that hold exactly the pieces of the histogram (size to count)."""
    sizes = np.array(sorted(histogram, reverse=True), dtype=np.int64)
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    out: list[tuple[dict[int, int], int]] = []

    def use(counts: np.ndarray, times: int) -> None:
        if times > 0:
            out.append(({int(s): int(c) for s, c in zip(sizes, counts, strict=True) if c}, int(times)))
            left[:] -= counts * times

    if len(sizes):
        for counts, times in sorted(solve(left, sizes, capacity), key=lambda p: -p[1]):
            counts = np.asarray(counts, dtype=np.int64)
            use(counts, min([int(times + 1e-9), *(left[counts > 0] // counts[counts > 0])]))
    for counts in _first_fit(left, sizes, capacity):
        use(counts, min(left[counts > 0] // counts[counts > 0]))
    return out


def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By size: the first rank, first sequence and count per sequence of each run of slots that its ranked pieces take."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for counts, times in patterns:
        for size, count in counts.items():
            runs.setdefault(size, []).append((taken.get(size, 0), sequence, count))
            taken[size] = taken.get(size, 0) + count * times
        sequence += times
    return {size: tuple(np.array(v, dtype=np.int64) for v in zip(*found, strict=True)) for size, found in runs.items()}


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, items = shared.value
        for batch in batches:
            key, rank = batch.column("key").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(key), dtype=np.int64)
            for k in np.unique(key).tolist():
                own = key == k
                size, before, together = items[k]
                first, base, count = slots[size]
                item = before + rank[own] // together
                at = np.searchsorted(first, item, side="right") - 1
                sequence[own] = base[at] + (item - first[at]) // count[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("key", "rank")), pa.array(sequence)], names=[*(n for n in batch.schema.names if n not in ("key", "rank")), "sequence_id"])

    return run


def _items(lengths: dict[int, int], capacity: int, quantum: int) -> tuple[dict[int, int], dict[int, tuple[int, int, int]]]:
    """From piece counts by key (see :func:`_key`): items by size, and of each key its items' size, how many items of that size come before, and its pieces in an item."""
    bundle = min(BUNDLE, capacity)
    demand: dict[int, int] = {}
    of: dict[int, tuple[int, int, int]] = {}
    for key, n in sorted(lengths.items()):
        together = 1 if key > bundle // 4 else min(n, bundle // key)
        size = -(-(key * together) // quantum) if key <= bundle // 4 else min(key - bundle, capacity // quantum)
        of[key] = (size, demand.get(size, 0), together)
        demand[size] = demand.get(size, 0) - (-n // together)
    return demand, of


def _key(capacity: int, quantum: int) -> Column:
    """The length itself of short pieces, the size class and ``BUNDLE`` of others."""
    bundle = min(BUNDLE, capacity)
    return F.when(F.col("length") <= bundle // 4, F.col("length")).otherwise(F.ceil(F.col("length") / quantum) + bundle).cast("bigint")


def _ranked(cuts: DataFrame, buckets: int) -> DataFrame:
    """``rank`` of each piece among those of its ``key``, from 0: a bucket's first rank, and the place in its bucket."""
    named = cuts.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = named.groupBy("key", "bucket").agg(F.count("*").alias("n")).select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("key", "bucket").orderBy("id", "start", "ids_crc32")
    return named.withColumn("place", F.row_number().over(inside) - 1).join(first, ["key", "bucket"]).withColumn("rank", F.col("first") + F.col("place")).drop("bucket", "first", "place")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, quantum: int = QUANTUM, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cuts = cut(cut_documents(docs, tokenizer_path, id_col, text_col, capacity, end_id)).withColumn("key", _key(capacity, quantum))
    lengths = {r["key"]: r["n"] for r in cuts.groupBy("key").agg(F.count("*").alias("n")).collect()}
    demand, items = _items(lengths, capacity, quantum)
    shared = spark.sparkContext.broadcast((_slots(plan(demand, capacity // quantum)), items))
    ranked = _ranked(cuts, max(1, sum(lengths.values()) // 20_000))
    kind = cuts.schema["id"].dataType.simpleString()
    placed = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "key", "rank").mapInArrow(_place(shared), f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint")
    before = Window.partitionBy("sequence_id").orderBy("id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumnRenamed("id", id_col)
