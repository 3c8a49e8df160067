"""Runs in texts: stretches of words that repeat with a period, found by matching aligned blocks.

A run is a stretch of consecutive words with smallest period q, at least ``max(least, 2 q)`` words long, that no neighbouring word extends with period q.

For each power of two B, the blocks of B words that begin at multiples of B are keys of an Aho-Corasick automaton over the words' numbers. In a run whose
period is from 2 B - 1 to 4 B - 2, the first q words hold such a block as a whole, and it occurs again q words later. So each occurrence of a block at a distance of that scale is
a seed; it is extended word by word in both directions for as long as words q apart are equal, which gives the run exactly.

Before that, words that cannot be in any run are put aside: in a run each word occurs twice, so a word that occurs once in a stretch ends it, and what is
left between such words is a shorter stretch, in which this is asked again until nothing changes. Stretches of fewer than ``least`` words hold no run. This loses no
run, and in prose little is left to search.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm._common import byte_list, pieces, utf8

#: Words of a shortest run, whatever its period.
LEAST = 12


def stretches(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """First and last word (exclusive) of the stretches, as rows, in which every word occurs twice at least."""
    spans = np.array([[0, len(words)]], dtype=np.int64)
    changed = True
    while changed:
        spans = spans[spans[:, 1] - spans[:, 0] >= least]
        if not len(spans):
            return spans
        sizes = spans[:, 1] - spans[:, 0]
        at = np.concatenate([np.arange(a, b) for a, b in spans])
        of = np.repeat(np.arange(len(spans)), sizes)
        order = np.lexsort((words[at], of))
        w, s = words[at][order], of[order]
        same = np.concatenate(([False], (w[1:] == w[:-1]) & (s[1:] == s[:-1]), [False]))
        alone = np.empty(len(at), dtype=bool)
        alone[order] = ~same[1:] & ~same[:-1]
        changed = alone.any()
        if changed:
            inside = np.zeros(len(words) + 2, dtype=np.int8)
            inside[at[~alone] + 1] = 1
            # Neighbouring stretches stay apart, as nothing joins them.
            edges = np.diff(inside)
            first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            spans = np.column_stack([first, last])
    return spans


def _equal(words: np.ndarray, a: int, q: int, step: int, stop: int) -> int:
    """How many words from a on, in steps of 1 or -1, are equal to those q later; ``stop`` at most."""
    n, size = 0, 16
    while n < stop:
        size = min(size, stop - n)
        at = a + step * n
        here = words[at : at + size] if step > 0 else words[at - size + 1 : at + 1][::-1]
        there = words[at + q : at + q + size] if step > 0 else words[at + q - size + 1 : at + q + 1][::-1]
        differ = here != there
        if differ.any():
            return n + int(differ.argmax())
        n, size = n + size, size * 2
    return n


class Found:
    """The runs found so far, by period; those of one period begin and end in the same order."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, first: int, last: int, period: int) -> None:
        insort(self.runs.setdefault(period, []), (first, last))

    def within(self, first: int, last: int, period: int) -> bool:
        """Whether a run whose period divides this one holds all the words from first to last."""
        for p, held in self.runs.items():
            if period % p == 0:
                at = bisect_right(held, (first, last))
                # The last run that begins there or before; of runs with one period the latest also ends last.
                if any(s <= first and last <= e for s, e in held[max(0, at - 1) : at + 1]):
                    return True
        return False

    def covered(self, n: int, most: int) -> np.ndarray:
        """For each word, how far a run with a period of at most ``most`` that began by then goes."""
        out = np.zeros(n, dtype=np.int64)
        for p, held in self.runs.items():
            if p <= most:
                for s, e in held:
                    out[s] = max(out[s], e)
        return np.maximum.accumulate(out)

    def sorted(self) -> list[tuple[int, int, int]]:
        return sorted((s, p, e) for p, held in self.runs.items() for s, e in held)


def _scale(words: np.ndarray, numbers: tuple[int, ...], size: int, least: int, found: Found) -> None:
    """Adds the runs of one stretch whose periods are from 2 size - 1 to 4 size - 2."""
    n, near, far = len(words), 2 * size - 1, 4 * size - 2
    covered = found.covered(n, size)
    # Deep inside a run of a period p of at most the block's words, equal blocks are multiples of p apart: they give that run again.
    starts = np.arange(0, n - size - near + 1, size)
    starts = starts[covered[starts] < starts + far + size]
    if not len(starts):
        return
    places: dict[tuple[int, ...], list[int]] = {}
    for i in starts.tolist():
        places.setdefault(numbers[i : i + size], []).append(i)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, key in enumerate(places):
        automaton.add_word(key, k)
    automaton.make_automaton()
    occurrences: list[list[int]] = [[] for _ in places]
    # Only where a block could occur again is searched; what lies deep inside known runs is not.
    begins, ends = starts + near, np.minimum(starts + far + size, n)
    apart = np.flatnonzero(begins[1:] > ends[:-1])
    for a, b in zip(begins[np.concatenate(([0], apart + 1))].tolist(), ends[np.concatenate((apart, [len(ends) - 1]))].tolist(), strict=True):
        for last, k in automaton.iter(numbers[a:b]):
            occurrences[k].append(a + last - size + 1)
    blocks = sorted((i, k) for k, held in enumerate(places.values()) if occurrences[k] for i in held)
    reached: dict[int, int] = {}
    for i, k in blocks:
        held = occurrences[k]
        for j in held[bisect_left(held, i + near) : bisect_right(held, i + far)]:
            q = j - i
            # Words that were reached before, or that a run of a part of this period holds, would be found again.
            if reached.get(q, 0) > i or found.within(i, j, q):
                continue
            before = _equal(words, i - 1, q, -1, i)
            after = _equal(words, i + size, q, 1, n - q - i - size)
            first, last = i - before, i + size + after + q
            reached[q] = last - q
            if last - first >= max(least, 2 * q):
                found.add(first, last, q)


def runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a text's word numbers as (first word, length, period), by first word, then period."""
    out = []
    for a, b in stretches(words, least).tolist():
        stretch, found, size = words[a:b], Found(), 1
        numbers = tuple(stretch.tolist())
        while 2 * (2 * size - 1) <= b - a:
            _scale(stretch, numbers, size, least, found)
            size *= 2
        out += [(a + s, e - s, p) for s, p, e in found.sorted()]
    return out


_OUT = "row bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            counts, all_runs, texts = [], [], []
            for text in byte_list(batch.column(1)):
                # Without an argument bytes are split at runs of 0x09 to 0x0D and space.
                words = (text or b"").split()
                number: dict[bytes, int] = {}
                held = runs(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64), least)
                if held:
                    stays = np.ones(len(words), dtype=bool)
                    for start, length, period in held:
                        stays[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(stays)]
                    counts.append(len(stays))
                else:
                    counts.append(len(words))
                all_runs.append([{"start": a, "length": n, "period": p} for a, n, p in held])
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64()), pa.array(all_runs, type=_RUN), pa.array(texts, type=pa.binary())], names=["id", "n_words", "runs", "collapsed"])

    return work


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: the id under its own name, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text without what repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. In ``collapsed`` words are joined by one space, and a word is left out if any run contains it after that run's first
    ``period`` words.

    A text that is null, empty or only white space has no words and no runs. Rows with a null id stay and are searched like others; repeated rows are each searched and stay. Runs of equal
    length and start with different periods are all there. Texts are read whole, however long; one text is one task's work, its memory proportional to its words.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(_find(least), _OUT.replace("row bigint", f"id {kind}"))
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def plant_tails(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text, where texts of every tenth hash of ids go on periodically from some word.

    With h the CRC-32 of the id in decimals, g = floor(h / 10) and n words: if h % 10 is 0, each word i from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    Other texts, those without words, and rows with a null id are as they were.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    held = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), h.alias("h"), F.expr("h div 10").alias("g"))
    chosen = held.where("h % 10 = 0").withColumn("w", F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda x: x != "")).where("size(w) > 0")
    chosen = chosen.withColumn("n", F.size("w").cast("bigint")).withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    # The period's words as often as they are needed, and the words before them.
    tail = F.expr("slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a + p - 1) div p))), 1, int(n - a))")
    planted = chosen.select("id", F.concat_ws(" ", F.expr("slice(w, 1, int(a))"), tail).alias("text"))
    rest = held.where("h is null or h % 10 <> 0 or text is null or not text rlike '[^ \\\\x09-\\\\x0D]'").select("id", "text")
    return rest.unionByName(planted).select(F.col("id").alias(id_col), F.col("text").alias(text_col))
