"""Exact search for the highest inner products with an impact-ordered index, processed score at a time.

Vectors are dealt to blocks. A block's index has, for each dimension, its rows in the order of their quantised component (``level``): a segment is the rows of one
dimension and level. For a query, a segment's impact is how much more it can add to a score than the dimension's worst level. Segments are processed by
descending impact, in rounds of which each goes down to half the impact of the one before; each segment adds its impact to the accumulators of its rows. After a round, a row has at
most what it has gathered, and for each dimension in which it has not been met the largest impact not yet processed there: all dimensions' together, less the least of those met for
each time that it was. It has at least what it has gathered, less what quantising may have added. Rows whose most is
below the k-th highest score known (of this block's least scores, or of earlier blocks' exact ones) are proven out. Rounds end once few rows are left or all
segments are processed; the rows left are scored exactly. Nothing else ends a search.

Blocks of queries of bounded size are sent to the tasks, each of which takes its blocks of the index one by one and keeps the k best of each query, so that a
task gives at most k rows a query. Rows are scored against a stated set of queries in blocks; no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm import vectors

#: Levels on either side of zero, and rounds that a query's impacts are processed in at most.
LEVELS, ROUNDS = 64, 6

_INDEX = "ids binary, components binary, bits int, step bigint, rows binary, level binary, ends binary"


def _indexed(width: int):
    def build(table: pa.Table) -> pa.Table:
        values = vectors.matrix(table["vector"], width)
        ids = table["id"].to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        top = max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0
        step = max(1, -(-(top + 1) // LEVELS))
        level = values // step
        rows = np.argsort(level, axis=0, kind="stable")
        ordered = np.take_along_axis(level, rows, axis=0)
        # ends[d, u]: rows of dimension d below level u - LEVELS.
        ends = np.stack([np.searchsorted(ordered[:, d], np.arange(-LEVELS, LEVELS + 1)) for d in range(width)]) if width else np.zeros((0, 2 * LEVELS + 1), dtype=np.int64)
        held = vectors.narrow(values)
        cells = [ids.tobytes(), held.tobytes(), held.dtype.itemsize, step, rows.T.astype(np.int32).tobytes(), ordered.T.astype(np.int16).tobytes(), ends.astype(np.int32).tobytes()]
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([c], type=t) for c, t in zip(cells, kinds, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])

    return build


class Block:
    """One block's index in memory."""

    def __init__(self, row: dict, width: int):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        n = len(self.ids)
        self.values = np.frombuffer(row["components"], dtype=f"i{row['bits']}").reshape(n, width)
        self.step = row["step"]
        self.rows = np.frombuffer(row["rows"], dtype=np.int32).reshape(width, n)
        self.level = np.frombuffer(row["level"], dtype=np.int16).reshape(width, n)
        self.ends = np.frombuffer(row["ends"], dtype=np.int32).reshape(width, 2 * LEVELS + 1)
        self.low, self.high = (self.level[:, 0].astype(np.int64), self.level[:, -1].astype(np.int64)) if n else (np.zeros(width, np.int64),) * 2
        # Levels above a dimension's lowest, for positive components of a query, and below its highest, for negative ones.
        self.above, self.below = self.level - self.low[:, None].astype(np.float64), self.high[:, None].astype(np.float64) - self.level
        self.row, self.add = np.empty(n * width, dtype=np.intp), np.empty(n * width)

    def possible(self, query: np.ndarray, k: int, known: float, few: int) -> np.ndarray:
        """Places of the rows that may be among the k highest scores or reach ``known``, found score at a time."""
        n, used = len(self.ids), np.flatnonzero(query)
        if n <= few or not len(used):
            return np.arange(n)
        q = query[used].astype(np.float64)
        weight = np.abs(q) * self.step
        span = (self.high - self.low)[used]
        most = weight * span
        # What each dimension's worst level adds at most, and what quantising may have added over all dimensions.
        worst = np.where(q > 0, q * (self.low[used] * self.step + self.step - 1), q * (self.high[used] * self.step)).sum()
        vague = (np.abs(q) * (self.step - 1)).sum()
        slack = 1e-12 * (most.sum() + abs(worst) + vague)
        gathered, met, up, places = np.zeros(n), np.zeros(n), (q > 0).tolist(), used.tolist()
        done, left, top, bar = np.zeros(len(used), dtype=np.int64), np.arange(n), most.max(), known
        for turn in range(1, ROUNDS + 1):
            # Levels down from a dimension's best whose impact is over the floor; in the last round, all.
            floor = top / 2**turn
            reach = np.minimum(span + 1, np.ceil((most - floor) / weight).astype(np.int64)) if turn < ROUNDS else span + 1
            reach = np.maximum(done, reach)
            rest = np.where(reach <= span, weight * (span - reach), 0.0)
            if turn < ROUNDS and rest.sum() + worst >= bar > -np.inf:
                continue  # A row that was not met at all could still reach the bar, so this round would rule none out; the next one does its work.
            start = np.where(q > 0, self.ends[used, self.high[used] - reach + 1 + LEVELS], self.ends[used, self.low[used] + done + LEVELS])
            end = np.where(q > 0, self.ends[used, self.high[used] - done + 1 + LEVELS], self.ends[used, self.low[used] + reach + LEVELS])
            m = 0
            for i in np.flatnonzero(end > start).tolist():
                d, a, b = places[i], int(start[i]), int(end[i])
                self.row[m : m + b - a] = self.rows[d, a:b]
                np.multiply((self.above if up[i] else self.below)[d, a:b], weight[i], out=self.add[m : m + b - a])
                m += b - a
            done = reach
            gathered += np.bincount(self.row[:m], weights=self.add[:m], minlength=n)
            met += np.bincount(self.row[:m], minlength=n)
            # A row was met in dimensions that were touched, so it has none of what is left there.
            unmet = rest.sum() - met * (rest[done > 0].min() if (done > 0).any() else 0.0)
            least = gathered + (worst - vague - slack)
            bar = max(known, np.partition(least, n - k)[n - k]) if n >= k else known
            left = np.flatnonzero(gathered + unmet + (worst + slack) >= bar)
            if len(left) <= few:
                break
        return left

    def best(self, query: np.ndarray, query_id: int, k: int, held: tuple[np.ndarray, np.ndarray], few: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those held and of this block's rows, as scores and ids in order."""
        known = held[0][-1] if len(held[0]) == k else -np.inf
        # The query's own row may take a place, so one more is asked for.
        at = self.possible(query, k + int((self.ids == query_id).sum()), known, few)
        at = at[self.ids[at] != query_id]
        score = np.concatenate((held[0], self.values[at].astype(np.int64) @ query))
        ids = np.concatenate((held[1], self.ids[at]))
        order = np.lexsort((ids, -score))[:k]
        return score[order], ids[order]


def _search(width: int, k: int, few: int):
    def work(queries: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = queries
        none = np.empty(0, dtype=np.int64)
        held = [(none, none)] * len(ids)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0], width)
                vectors.fits(wanted, block.values)
                held = [block.best(wanted[j], int(ids[j]), k, held[j], few) for j in range(len(ids))]
        sizes = [len(s) for s, _ in held]
        columns = [np.repeat(np.arange(len(ids)), sizes), np.repeat(ids, sizes), np.concatenate([i for _, i in held] or [none]), np.concatenate([s for s, _ in held] or [none])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["place", "query_id", "vec_id", "score"])

    return work


def search(df: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 2048, query_rows: int = 32_768, few: int = 64) -> DataFrame:
    """The k highest scores of each query row against all other rows: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    A score is the inner product of the vectors' components ``floor(scale * x)``, exact; ties go to the smaller id. ``queries`` says which rows, by ``id``, are queries;
    a row of the query's own id is none of its results. Queries with fewer than k other rows get all of them.

    Rows with a null id or vector, or a null or non-finite component, take no part. An empty vector is all zeros, and a shorter one goes on with zeros. A row that is repeated as
    a whole counts once; rows of one id with different vectors are different rows, and different queries. Other columns are not read, whatever their names. An empty table gives
    no rows. Components so large that a score could leave 64 bits are an error. Texts play no part.

    ``block_rows``: rows of an index block on average. ``query_rows``: queries that are sent to the tasks at once. ``few``: rows that are scored exactly without further rounds.
    """
    spark = df.sparkSession
    rows = vectors.integer_vectors(df, id_col, vector_col, scale)
    width = vectors.width_of(rows)
    blocks = vectors.index(rows, block_rows, _indexed(width), _INDEX)
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for table in vectors.query_blocks(rows.where(queries), query_rows):
        asked = (table["id"].to_numpy().astype(np.int64), vectors.matrix(table["vector"], width))
        found = vectors.in_tasks(spark, blocks, asked, _search(width, k, max(few, k)), "place bigint, query_id bigint, vec_id bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
        out = out.unionByName(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    return out
