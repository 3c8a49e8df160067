"""Suffix-array dedup on bytes: strings of ``width`` bytes that start at more than one place in the corpus are removed wherever they stand.

1. Documents are dealt into buckets by a hash of the row, equal rows as one with their number; that exchange serves all steps. In each text the ``seed``-byte strings that are least by hash among
   those of some window are its anchors; a window belongs to the last of its least ones. Equal windows belong to equal anchors.
2. A place's context is the text of all windows that belong to it; a context that occurs twice recurs as a whole. Windows on either side of a context's
   middle share a core, the text common to all of that side; a context neither of whose cores occurs elsewhere cannot recur (that is so for short common
   lines). What is left is contexts that share a core and differ; their texts are fetched, each once.
3. Those are dealt by core into shards of about ``shard_bytes``. In each shard a Burrows-Wheeler transform is made of the texts, and common prefixes are
   derived by interval expansion up to ``width`` (see ``bwt``): neighbours that share ``width`` bytes are recurring windows.
4. A core with more than ``shard_bytes`` of different texts (a passage that very many documents share, each with its own surroundings) is split again
   into the halves of its windows, each with the core of its own. Equal texts merge on the way, so after at most log2(``width``) rounds every group
   fits. Nothing is left out.
5. The results go back to the buckets by context, and every text is cut.

Null and empty texts have no bytes. Repeated rows are documents like any other, so their texts recur if long enough. Texts shorter than ``width`` stay. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm import _hashing as H
from wellspring.llm._common import kept
from wellspring.llm.bwt import recurring_starts
from wellspring.llm.phrase_dedup import BUCKET_BYTES, FAN, _signed, _unsigned, counted, dealt_into, expanded, is_in, recurring, texts_of, totalled

WIDTH = 400
SEED = 32
SHARD_BYTES = 1 << 20
SHARDS_A_TASK = 8
#: Tasks that a stage is dealt into at most; beyond, each has more shards, one after the other.
MOST_TASKS = 50_000

_RANGES = pa.list_(pa.list_(pa.int64()))


def contexts(text: bytes | None, width: int, seed: int, known: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, anchor place, first window, last window) of each place that windows belong to; of the ``known`` (sorted) anchors if given."""
    data = np.frombuffer(text or b"", dtype=np.uint8)
    if len(data) < width:
        return
    hashes = H.grams(H.byte_prefix(data), seed, H.BYTE_BASE)
    reach = width - seed
    least, chosen = H.anchors(hashes, reach + 1)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    values = least[starts]
    ends = np.append(starts[1:], len(least)) - 1
    if known is not None:
        held = is_in(values, known)
        starts, ends, values = starts[held], ends[held], values[held]
    if not len(starts):
        return
    places = np.flatnonzero(chosen)
    of: dict[int, list[int]] = {}
    for value, place in zip(hashes[places].tolist(), places.tolist(), strict=True):
        of.setdefault(value, []).append(place)
    for start, end, value in zip(starts.tolist(), ends.tolist(), values.tolist(), strict=True):
        own = [p for p in of[value] if start <= p <= end + reach]
        for k, place in enumerate(own):
            first, last = max(start, place - reach), min(end, place, own[k + 1] - reach - 1 if k + 1 < len(own) else end)
            if first <= last:
                yield value, place, first, last


def _name(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _anchor_rows(width: int, seed: int):
    def run(docs: pa.Table) -> pa.Table:
        found = []
        for text, copies in counted(docs):
            data = np.frombuffer(text or b"", dtype=np.uint8)
            if len(data) >= width:
                hashes = H.grams(H.byte_prefix(data), seed, H.BYTE_BASE)
                found += [hashes[H.anchors(hashes, width - seed + 1)[1]]] * copies
        keys, n = np.unique(np.concatenate(found or [np.empty(0, dtype=np.uint64)]), return_counts=True)
        return pa.table({"bucket": pa.repeat(docs.column("bucket")[0], len(keys)), "anchor": _signed(keys), "n": pa.array(n)})

    return run


def _cores(text: bytes, place: int, first: int, last: int, width: int, seed: int) -> list[int]:
    """Hashes of the text that all windows on the left share, and of that on the right, where there are such windows."""
    middle = (seed - width) // 2
    out = []
    if first - place <= middle:
        out.append(xxhash.xxh3_64_intdigest(text[place + middle : place + seed], 1) - (1 << 63))
    if last - place > middle:
        out.append(xxhash.xxh3_64_intdigest(text[place : place + middle + 1 + width], 2) - (1 << 63))
    return out


def _context_rows(width: int, seed: int):
    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        known = np.sort(_unsigned(anchors.column("anchor")))
        n: Counter = Counter()
        about: dict[bytes, tuple[int, list[int]]] = {}
        for text, copies in counted(docs) if len(known) else ():
            for value, place, first, last in contexts(text, width, seed, known):
                name = _name(text[first : last + width])
                n[name] += copies
                if name not in about:
                    about[name] = (value, _cores(text, place, first, last, width, seed))
        values = np.array([about[k][0] for k in n], dtype=np.uint64)
        bucket = (docs if docs.num_rows else anchors).column("bucket")[0]
        return pa.table({"bucket": pa.repeat(bucket, len(n)), "context": pa.array(n, pa.binary()), "anchor": _signed(values), "cores": pa.array([about[k][1] for k in n], pa.list_(pa.int64())), "n": pa.array(n.values(), pa.int64())})

    return run


def _fetch_rows(width: int, seed: int):
    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        left = dict(zip(wanted.column("context").to_pylist(), wanted.column("n").to_pylist(), strict=True))
        known = np.unique(_unsigned(wanted.column("anchor")))
        found, values, counts, rel, texts = [], [], [], [], []
        for text in texts_of(docs) if left else []:
            for value, place, first, last in contexts(text, width, seed, known):
                piece = text[first : last + width]
                if (name := _name(piece)) in left:
                    counts.append(left.pop(name))
                    found.append(name)
                    values.append(value)
                    rel.append(first - place)
                    texts.append(piece)
        return pa.table({"context": pa.array(found, pa.binary()), "anchor": _signed(np.array(values, dtype=np.uint64)), "n": pa.array(counts, pa.int64()), "rel": pa.array(rel, pa.int64()), "text": pa.array(texts, pa.binary())})

    return run


def _shard_rows(width: int):
    def run(held: pa.Table) -> pa.Table:
        masks = recurring_starts(held.column("text").to_pylist(), width)
        return pa.table({"context": held.column("context"), "ranges": pa.array([H.runs(m).tolist() for m in masks], _RANGES)})

    return run


def _decided(spans: DataFrame, shard_bytes: int, width: int) -> DataFrame:
    """``context`` and ``ranges`` (recurring windows) of spans (context, group, n, text) in groups that fit a shard; a span seen twice recurs whole."""
    total = spans.agg(F.sum(F.length("text"))).first()[0] or 0
    shard = F.pmod(F.col("group"), F.lit(total // shard_bytes + 1)).alias("shard")
    # Few bytes take long, so shards are dealt by their number and not put together by their bytes.
    tasks = min(total // (SHARDS_A_TASK * shard_bytes) + 1, MOST_TASKS)
    return spans.select("context", "text", shard).repartition(tasks, "shard").groupBy("shard").applyInArrow(_shard_rows(width), "context binary, ranges array<array<bigint>>")


def _whole(width: int) -> Column:
    return F.array(F.array(F.lit(0).cast("bigint"), F.length("text").cast("bigint") - F.lit(width - 1)))


def _halves(spans: DataFrame, width: int) -> DataFrame:
    """Each span's windows in two, by their place about the anchor; ``group`` is then the text that all windows of the half share. ``shift``: windows skipped."""
    middle = F.floor((F.col("low") + F.col("high")) / 2)
    half = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))).alias("half")
    own = [c for c in ("top", "skip") if c in spans.columns]
    cutting = spans.select("context", "group", "rel", "n", "text", *own, half).select("context", "group", "rel", "n", "text", *own, "half.low", "half.high")
    last = F.col("rel") + F.length("text") - width
    cutting = cutting.withColumn("s", F.greatest("rel", "low")).withColumn("e", F.least(last, F.col("high"))).where("s <= e and low <= high")
    core = F.expr(f"substring(text, cast(high - rel + 1 as int), cast(low - high + {width} as int))")
    text = F.expr(f"substring(text, cast(s - rel + 1 as int), cast(e - s + {width} as int))")
    return cutting.select(F.col("context").alias("parent"), F.xxhash64("group", "low", "high", core).alias("group"), (F.col("s") - F.col("rel")).alias("shift"), F.col("s").alias("rel"), "low", "high", "n", text.alias("text"), *own).withColumn("context", F.unhex(F.md5("text")))


def _merged(children: DataFrame) -> DataFrame:
    return kept(children.groupBy("context", "group").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("text", "rel", "low", "high"))))


def _resolve(spans: DataFrame, width: int, seed: int, shard_bytes: int) -> DataFrame:
    """``context`` and ``ranges`` for the spans (context, anchor, rel, n, text) that occur once but share a core with others.

    All are split twice to begin with, as most quarters are equal and need no transform.
    """
    all = spans.withColumnRenamed("anchor", "group").withColumn("low", F.lit(seed - width).cast("bigint")).withColumn("high", F.lit(0).cast("bigint")).withColumn("top", F.when(F.col("n") == 1, F.col("context"))).withColumn("skip", F.lit(0).cast("bigint"))
    quarters = _halves(_halves(all, width).withColumn("skip", F.col("skip") + F.col("shift")), width)
    links = kept(quarters.where("top is not null").select("top", "context", (F.col("skip") + F.col("shift")).alias("shift")))
    held, out = _merged(quarters), []
    while True:
        sizes = held.groupBy("group").agg(F.sum(F.length("text")).alias("bytes"), F.count("*").alias("k")).where("k > 1")
        found = _decided(held.join(sizes.where(F.col("bytes") <= shard_bytes).select("group"), "group", "left_semi"), shard_bytes, width)
        known = found.unionByName(held.where("n > 1").select("context", _whole(width).alias("ranges"))).where(F.size("ranges") > 0)
        out.append(links.join(known, "context").select(F.col("top").alias("context"), F.transform("ranges", lambda r: F.transform(r, lambda x: x + F.col("shift"))).alias("ranges")))
        large = held.join(sizes.where(F.col("bytes") > shard_bytes).select("group"), "group", "left_semi")
        if large.isEmpty():
            break
        children = _halves(large, width)
        links = kept(links.join(children.select(F.col("parent").alias("context"), F.col("context").alias("child"), F.col("shift").alias("further")), "context").select("top", F.col("child").alias("context"), (F.col("shift") + F.col("further")).alias("shift")))
        held = _merged(children)
    return reduce(DataFrame.unionByName, out).groupBy("context").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _ranges(decided: dict, name: bytes, windows: int) -> list:
    """A context's recurring windows: none if it is not decided, all if no ranges are given."""
    found = decided.get(name, ())
    return [(0, windows)] if found is None else found


def _remove_rows(width: int, seed: int):
    def run(docs: pa.Table, decided: pa.Table) -> pa.Table:
        ranges = dict(zip(decided.column("context").to_pylist(), decided.column("ranges").to_pylist(), strict=True))
        known = np.unique(_unsigned(decided.column("anchor")))
        n, removed, spans, digest, kept_text = [], [], [], [], []
        for text in texts_of(docs):
            text = text or b""
            marks = np.zeros(len(text) + 1, dtype=np.int64)
            for _, _, first, last in contexts(text, width, seed, known) if len(known) else ():
                for a, b in _ranges(ranges, _name(text[first : last + width]), last - first + 1):
                    marks[first + a] += 1
                    marks[first + b - 1 + width] -= 1
            gone = np.cumsum(marks[:-1]) > 0
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            n.append(len(text))
            removed.append(int(gone.sum()))
            spans.append(H.runs(gone).tolist())
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept)
        return pa.table({"id": docs.column("id"), "copies": docs.column("copies"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, _RANGES), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept_text, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """One row per document row: its id, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs), ``kept_sha256`` and ``kept`` (bytes)."""
    held, buckets = dealt_into(docs, id_col, text_col, bucket_bytes)
    kind = held.schema["id"].dataType.simpleString()
    by_bucket = held.groupBy("bucket")
    anchors = recurring(by_bucket.applyInArrow(_anchor_rows(width, seed), "bucket bigint, anchor bigint, n bigint"), buckets, "anchor", fan=fan)
    found = by_bucket.cogroup(anchors.groupBy("bucket")).applyInArrow(_context_rows(width, seed), "bucket bigint, context binary, anchor bigint, cores array<bigint>, n bigint")
    # A later join leaves null contexts out. There are none; said here, it is the same in all branches, and they share the contexts and their exchange.
    found = totalled(found.where(F.col("context").isNotNull()), buckets, "context", fan=fan)
    cores = found.where("home").select("bucket", "context", "anchor", F.col("total").alias("n"), F.explode("cores").alias("core"))
    # All columns are used in each branch, so that the branches share one exchange of contexts.
    useful = cores.groupBy("core").agg(F.count("context").alias("k"), F.min("n").alias("least"), F.min("bucket").alias("b"), F.count("anchor").alias("a")).where("k > 1 and least = 1 and b >= 0 and a > 0").select("core")
    wanted = cores.join(useful, "core", "left_semi").groupBy("context").agg(F.min("bucket").alias("bucket"), F.min("anchor").alias("anchor"), F.min("n").alias("n"))
    fetched = by_bucket.cogroup(wanted.groupBy("bucket")).applyInArrow(_fetch_rows(width, seed), "context binary, anchor bigint, n bigint, rel bigint, text binary")
    open_or_twice = found.join(wanted.select("context", F.struct("bucket", "anchor", "n").alias("open")), "context", "left").where("total > 1 or open is not null")
    # One table for both, so that the buckets' exchange and the contexts are computed once.
    both = kept(open_or_twice.select("bucket", "context", "anchor", "cores", "total").unionByName(fetched.withColumnRenamed("n", "total"), allowMissingColumns=True))
    once = _resolve(both.where("text is not null").select("context", "anchor", "rel", F.col("total").alias("n"), "text"), width, seed, shard_bytes)
    places = both.where("text is null")
    whole = F.lit(None).cast("array<array<bigint>>")  # all windows of a context
    decided = places.where("total > 1").select("bucket", "context", "anchor", whole.alias("ranges")).unionByName(places.where("total = 1").join(once, "context").select("bucket", "context", "anchor", "ranges"))
    out = by_bucket.cogroup(decided.groupBy("bucket")).applyInArrow(_remove_rows(width, seed), f"id {kind}, copies bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept_sha256 string, kept binary")
    return expanded(out).withColumnRenamed("id", id_col)
