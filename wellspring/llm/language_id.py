"""Language ID by interpolated Kneser-Ney character models, one per language, with a calibrated rejection.

The models are fitted on a bounded sample of labelled rows: of each language, the ``sample_docs`` rows whose hashes are lowest, of each of them all or a hashed window
of ``sample_chars`` characters, fewer where there are so many languages that all together would pass ``sample_total`` characters. One in ten of the rows is held
back to calibrate the rejection. Only hashes are ranked, those below a limit that follows from the number of rows of the language; the texts are fetched
afterwards. Spark counts the sample's character n-grams; the model made of the counts is broadcast and, like the sample, bounded. Every document is then
scored whole, in parallel, without a shuffle.

A model is, for each order, a sorted array of n-gram hashes (64 bits of sums of characters times odd numbers, for any alphabet) with one column of
log-probabilities for each of ``BLOCK`` languages, and the same for contexts with their back-off weights. A text's language is the one of least cross-entropy per
character, of equal ones the first by name.

A text is lower-cased and every run of other characters than letters (Unicode's categories of letters, so not ``2/3`` or numerals in one sign) becomes one space. Null
texts and texts without a letter are ``und`` with score 0. Rows with null text, label or id are not learned from; a row with a null id counts as held out. Repeated
rows are learned from once and scored alike. Very long texts are scored whole. If nothing can be learned, every row is ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm._common import cut, kept, pieces
from wellspring.scratch import BROADCAST_ROWS

ORDER = 5
BLOCK = 4
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
SAMPLE_TOTAL = 32_000_000
MARGIN = 1.0
#: Nats by which a text of one character may exceed its limit; of n characters by the square root of n less, as a mean of n terms varies.
SHORT = 4.0
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")
# Numerals that are neither letters nor decimal digits, which the pattern above takes for letters. Few texts have any, and a set tells faster than a pattern.
_NUMERALS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_NO_NUMERALS = dict.fromkeys(map(ord, _NUMERALS), " ")
_PAD = " " * (ORDER - 1)
_WEIGHT = np.random.default_rng(23).integers(1, 2**63, size=ORDER, dtype=np.uint64) | np.uint64(1)


def normalise(text: str | None) -> str:
    """Lower-case letters and single spaces, with a space at the end; empty if there is no letter."""
    if text and not text.isascii() and not _NUMERALS.isdisjoint(text):
        text = text.translate(_NO_NUMERALS)
    plain = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return plain + " " if plain else ""


@dataclass
class Level:
    """Of one order: n-gram hashes with log-probabilities, context hashes with back-off weights; a column per language."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    back_off: np.ndarray


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), dtype=bool)


def _points(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hashes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of ``ORDER`` characters, the last one first: the hashes of their n-grams and of these n-grams' contexts, a column per order."""
    own = np.cumsum((symbols + np.uint64(1)) * _WEIGHT, axis=1, dtype=np.uint64)
    before = np.zeros_like(own)
    before[:, 1:] = np.cumsum((symbols[:, 1:] + np.uint64(1)) * _WEIGHT[:-1], axis=1, dtype=np.uint64)
    return own, before


class KneserNey:
    """Models of all languages, in blocks; ``limits`` has each language's largest cross-entropy that is not rejected."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        self.limits = np.full(len(self.languages), np.inf)
        self.base = -np.log(len({gram[-1] for grams in counts.values() for gram in grams}) + 1.0)
        self.blocks = [self._block([_tables(counts[language]) for language in self.languages[k : k + BLOCK]]) for k in range(0, len(self.languages), BLOCK)]

    def _block(self, tables: list) -> list[Level]:
        levels: list[Level] = []
        for order in range(1, ORDER + 1):
            grams, first = np.unique(np.concatenate([t[order - 1][0] for t in tables]), return_index=True)
            own, before = _hashes(np.concatenate([t[order - 1][4] for t in tables])[first])
            contexts = np.unique(np.concatenate([t[order - 1][2] for t in tables]))
            lower = self._at(levels, len(tables), own, before)
            log_p, back_off = np.empty((len(grams), len(tables)), dtype=np.float32), np.zeros((len(contexts), len(tables)), dtype=np.float32)
            c_at, _ = _find(contexts, before[:, order - 1])
            for k, table in enumerate(tables):
                held, share, own_contexts, weight, _ = table[order - 1]
                at, known = _find(own_contexts, contexts)
                back_off[known, k] = np.log(weight[at[known]])
                at, known = _find(held, grams)
                p = np.exp(back_off[c_at, k] + lower[:, k])
                p[known] += share[at[known]]
                log_p[:, k] = np.log(p)
            levels.append(Level(grams, log_p, contexts, back_off))
        return levels

    def _at(self, levels: list[Level], width: int, own: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log-probabilities of n-grams of the levels' highest order, by way of lower orders where they are not known; (n, languages of the block)."""
        total = np.zeros((len(own), width), dtype=np.float32)
        rest = np.arange(len(own))
        for k in range(len(levels), 0, -1):
            level = levels[k - 1]
            at, known = _find(level.grams, own[rest, k - 1])
            total[rest[known]] += level.log_p[at[known]]
            rest = rest[~known]
            at, known = _find(level.contexts, before[rest, k - 1])
            total[rest[known]] += level.back_off[at[known]]
        total[rest] += self.base
        return total

    def log_p(self, symbols: np.ndarray) -> np.ndarray:
        """Log-probabilities under every language of the first of each row of characters (last one first), after the others."""
        own, before = _hashes(symbols)
        return np.hstack([self._at(levels, levels[0].log_p.shape[1], own, before) for levels in self.blocks])

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Nats per character of each normalised text under each language; infinite for empty texts."""
        out = np.full((len(texts), len(self.languages)), np.inf)
        full = [k for k, t in enumerate(texts) if t]
        if not full or not self.languages:
            return out
        sizes = np.array([len(texts[k]) for k in full])
        points = _points(_PAD + _PAD.join(texts[k] for k in full))
        n = len(points) - ORDER + 1
        grams = np.zeros(n, dtype=np.uint64)
        for k in range(ORDER):
            grams += (points[ORDER - 1 - k : ORDER - 1 - k + n] + np.uint64(1)) * _WEIGHT[k]
        starts = np.concatenate(([0], np.cumsum(sizes[:-1] + len(_PAD))))
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[starts] += 1
        np.subtract.at(inside, starts + sizes, 1)
        own = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        distinct, where = np.unique(grams[own], return_inverse=True)
        first = np.empty(len(distinct), dtype=np.int64)
        first[where] = np.arange(len(own))
        log_p = self.log_p(points[own[first][:, None] + np.arange(ORDER - 1, -1, -1)])[where]
        ends = np.cumsum(sizes)
        out[full] = -np.add.reduceat(log_p, ends - sizes, axis=0, dtype=np.float64) / sizes[:, None]
        return out


def _tables(grams: dict[str, int]) -> list[tuple[np.ndarray, ...]]:
    """By order: n-grams, their discounted shares, contexts, the contexts' weights for lower orders, and the n-grams' characters, last one first."""
    symbols = _points("".join(grams)).reshape(-1, ORDER)[:, ::-1]
    counts = np.fromiter(grams.values(), dtype=float, count=len(grams))
    out = []
    for order in range(ORDER, 0, -1):
        own, before = _hashes(symbols)
        codes, first, where = np.unique(own[:, order - 1], return_index=True, return_inverse=True)
        counts = np.bincount(where, weights=counts)
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, of = np.unique(before[first, order - 1], return_inverse=True)
        total, types = np.bincount(of, weights=counts), np.bincount(of)
        symbols = symbols[first]
        out.append((codes, (counts - discount) / total[of], contexts, discount * types / total, symbols))
        counts = np.ones(len(codes))
    return out[::-1]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            line = normalise(text)
            if line:
                line = _PAD + line
                found.update((lang, line[k : k + ORDER]) for k in range(len(line) - ORDER + 1))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "gram", "n"])


def _judge(model: KneserNey, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
    """Of each text: language, score, cross-entropy, and whether it is accepted."""
    lines = [normalise(t) for t in texts]
    entropy = model.cross_entropy(lines)
    out = []
    for line, row in zip(lines, entropy, strict=True):
        if not line or not model.languages:
            out.append((UNKNOWN, 0.0, None, False))
            continue
        best = int(row.argmin())
        score = 1.0 / float(np.exp(-(row - row[best]) * min(len(line), 50)).sum())
        out.append((model.languages[best], score, float(row[best]), bool(row[best] <= model.limits[best] + SHORT / len(line) ** 0.5)))
    return out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            lang, score, entropy, accepted = zip(*_judge(shared.value, batch.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(accepted, pa.bool_())], names=["id", "lang_pred", "score", "cross_entropy", "accepted"])

    return run


def _keep(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 1 << 20):
            yield batch.filter(pa.array([accepted for *_, accepted in _judge(shared.value, batch.column(text_col).to_pylist())], pa.bool_()))

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is never learned from: its id is null or its id's CRC-32 is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_total: int = SAMPLE_TOTAL, margin: float = MARGIN) -> KneserNey:
    """Models of the languages among rows that are not held out.

    A language's limit is the largest cross-entropy of its calibration rows plus ``margin`` nats; a language without such rows has no limit.
    """
    usable = docs.where(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("at"), F.col(text_col).alias("text"))
    rows = usable.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n")).cache()
    # Of a language of about n different rows those whose hashes lie below a share of all that holds some four times as many rows as are wanted.
    share = F.least(F.lit(1.0), F.lit(4.0 * sample_docs + 64) / F.col("n"))
    limit = rows.select("lang", F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0**63).cast("bigint")).alias("limit"))
    languages = max(1, rows.count())
    chars = max(1, min(sample_chars, sample_total // (languages * sample_docs)))
    order = Window.partitionBy("lang").orderBy("at")
    low = usable.select("lang", "at").join(limit, "lang").where(F.col("at").bitwiseAND(F.lit((1 << 63) - 1)) <= F.col("limit")).select("lang", "at").distinct()
    ranked = cut(low.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs))
    rows.unpersist()
    start = F.pmod(F.col("at"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    # The ranking has at most ``sample_docs`` rows a language, of 30 bytes; it is broadcast while that is some megabytes.
    chosen = F.broadcast(ranked) if languages * sample_docs <= BROADCAST_ROWS else ranked
    sample = kept(usable.join(chosen, ["lang", "at"]).select("lang", "k", F.substring("text", start, F.lit(chars)).alias("text")).dropDuplicates(["lang", "k"]))
    grams = sample.where("k % 10 <> 0 or k = 1").mapInArrow(_count_grams, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for row in grams.toPandas().sort_values(["lang", "gram"]).itertuples(index=False):
        counts.setdefault(row.lang, {})[row.gram] = row.n
    model = KneserNey(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    check = sample.where("k % 10 = 0").select(F.col("lang").alias("id"), "text").mapInArrow(_predict(shared), "id string, lang_pred string, score double, cross_entropy double, accepted boolean")
    for row in check.where("id = lang_pred").groupBy("lang_pred").agg(F.max("cross_entropy").alias("most")).collect():
        model.limits[model.languages.index(row.lang_pred)] = row.most + margin
    return model


def predict(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id, ``lang_pred``, ``score``, ``cross_entropy`` (null for ``und``) and ``accepted``."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {named.schema['id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, accepted boolean"
    return named.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), schema).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: KneserNey, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with their own columns."""
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), text_col), docs.schema)
