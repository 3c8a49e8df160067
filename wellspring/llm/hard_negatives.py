"""Hard negatives by a vantage-point tree over norm-augmented vectors.

In a block of vectors whose largest squared norm is m, each vector v gets one more component, the square root of m - |v|^2, and an anchor a gets a zero. All vectors
are then equally long, and the squared distance from a to v is |a|^2 + m - 2 a.v: a window of scores is an annulus of distances around the anchor, and nearest first
is highest score first. A vantage-point tree halves the block by distance from a vantage row, again and again; a node keeps how near and far from its parent's
vantage its rows are, which bounds their distances from any anchor by the triangle inequality.

A traversal is incremental: nodes and rows wait in one queue by their largest possible score, a node is opened and a leaf's rows are scored only when nothing that
waits can be better, and nodes outside the annulus are never opened. Bounds are taken a little wide for rounding; scores themselves are integers and exact. A traversal ends when
k rows are there and nothing can be before the last of them.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm import vectors

#: Rows of a leaf at most.
LEAF = 32

_INDEX = "ids binary, labels binary, components binary, bits int, nodes binary, largest bigint"
#: A node: first and last row (exclusive), left and right child (0: a leaf), the vantage's row, and its rows' least and largest distance from the parent's vantage.
_NODE = np.dtype([("first", "i4"), ("last", "i4"), ("left", "i4"), ("right", "i4"), ("vantage", "i4"), ("near", "f8"), ("far", "f8")])


def grow(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A tree over integer vectors: the order of rows in which each node's are together, the nodes, and the largest squared norm."""
    norms = (values * values).sum(axis=1)
    largest = int(norms.max()) if len(norms) else 0
    wide = np.column_stack([values.astype(np.float64), np.sqrt(np.maximum(largest - norms, 0).astype(np.float64))])
    order, nodes, open_nodes = np.arange(len(values)), [(0, len(values), 0, 0, -1, 0.0, np.inf)], [0]
    while open_nodes:
        i = open_nodes.pop()
        a, b, *_, near, far = nodes[i]
        if b - a <= LEAF:
            continue
        own = order[a:b]
        away = np.linalg.norm(wide[own] - wide[own].mean(axis=0), axis=1)
        vantage = int(own[np.argmax(away)])
        away = np.linalg.norm(wide[own] - wide[vantage], axis=1)
        by = np.argsort(away, kind="stable")
        order[a:b], away = own[by], away[by]
        half = (b - a) // 2
        nodes[i] = (a, b, len(nodes), len(nodes) + 1, vantage, near, far)
        open_nodes += [len(nodes), len(nodes) + 1]
        nodes += [(a, a + half, 0, 0, -1, away[0], away[half - 1]), (a + half, b, 0, 0, -1, away[half], away[-1])]
    # Vantages are named by their places in the final order.
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    out = np.array(nodes, dtype=_NODE)
    out["vantage"] = np.where(out["vantage"] >= 0, place[out["vantage"]] if len(order) else 0, -1)
    return order, out, largest


def _indexed(width: int):
    def build(table: pa.Table) -> pa.Table:
        values, ids, labels = vectors.matrix(table["vector"], width), table["id"].to_numpy().astype(np.int64), table["label"].to_numpy().astype(np.int64)
        first = np.argsort(ids, kind="stable")
        vectors.fits(values, values)
        order, nodes, largest = grow(values[first])
        order = first[order]
        held = vectors.narrow(values[order])
        cells = [ids[order].tobytes(), labels[order].tobytes(), held.tobytes(), held.dtype.itemsize, nodes.tobytes(), largest]
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
        return pa.table([pa.array([c], type=t) for c, t in zip(cells, kinds, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])

    return build


class Tree:
    """One block's tree in memory, for the anchors of a batch."""

    def __init__(self, row: dict, width: int, anchors: np.ndarray):
        self.ids, self.labels = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["labels"], dtype=np.int64)
        held = np.frombuffer(row["components"], dtype=f"i{row['bits']}").reshape(len(self.ids), width)
        vectors.fits(anchors, held)
        self.values = held.astype(np.int64)
        nodes = np.frombuffer(row["nodes"], dtype=_NODE)
        self.nodes = nodes.tolist()
        self.anchors = anchors
        # Twice the part of a squared distance that is no score, and each anchor's distance from each vantage.
        self.sums = (anchors * anchors).sum(axis=1) + row["largest"]
        inner = np.flatnonzero(nodes["vantage"] >= 0)
        apart = np.zeros((len(anchors), len(nodes)))
        apart[:, inner] = np.sqrt(np.maximum(self.sums[:, None] - 2 * (anchors @ self.values[nodes["vantage"][inner]].T), 0).astype(np.float64))
        self.apart = apart

    def nearest(self, j: int, low: int, high: int, wanted: np.ndarray) -> Iterator[tuple[int, int]]:
        """Scores and ids of the rows ``wanted`` whose score with anchor j is from ``low`` to ``high``, the highest first, of equal ones the smallest id first."""
        total, anchor, apart = float(self.sums[j]), self.anchors[j], self.apart[j]
        slack = 1e-9 * total + 1e-3
        # An entry: minus the largest possible score, 0 for a node and 1 for a row (nodes first, as they may hold equal scores with smaller ids), the node or the id, the bounds of distance.
        queue = [(-np.inf, 0, 0, 0.0, np.inf)]
        while queue:
            bound, row, what, near, far = heapq.heappop(queue)
            if row:
                yield -bound, what
                continue
            first, last, left, right, *_ = self.nodes[what]
            if not left:
                here = first + np.flatnonzero(wanted[first:last])
                score = self.values[here] @ anchor
                inside = (score >= low) & (score <= high)
                for s, i in zip(score[inside].tolist(), self.ids[here[inside]].tolist(), strict=True):
                    heapq.heappush(queue, (-s, 1, i, 0.0, 0.0))
                continue
            from_vantage = apart[what]
            for child in (left, right):
                *_, nearest, farthest = self.nodes[child]
                inner, outer = max(near, from_vantage - farthest, nearest - from_vantage), min(far, from_vantage + farthest)
                best, least = (total - inner * inner) / 2 + slack, (total - outer * outer) / 2 - slack
                if best >= low and least <= high:
                    heapq.heappush(queue, (-min(best, high), 0, child, inner, outer))


def _take(held: list[tuple[int, int]], score: int, row_id: int, k: int) -> None:
    """Puts a row among the first k of (minus score, id)."""
    insort(held, (-score, row_id))
    del held[k:]


def _full(held: list[tuple[int, int]], k: int) -> float:
    """The score below which no row is wanted any more."""
    return -held[-1][0] if len(held) == k else -np.inf


def _rows(columns: list[list[int]], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names.replace(" bigint", "").split(", "))


_POSITIVES = "place bigint, positive_id bigint, positive_score bigint"


def _positives(width: int, k: int):
    """For each anchor the k other rows of its label with the highest scores, of a task's blocks."""

    def work(asked: tuple[np.ndarray, np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, values = asked
        held: list[list[tuple[int, int]]] = [[] for _ in ids]
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree(batch.slice(i, 1).to_pylist()[0], width, values)
                same = {label: tree.labels == label for label in np.unique(labels)}
                for j in range(len(ids)):
                    for score, found in tree.nearest(j, max(_full(held[j], k), -(1 << 62)), 1 << 62, same[labels[j]]):
                        if score < _full(held[j], k):
                            break
                        if found != ids[j]:
                            _take(held[j], score, found, k)
        flat = [(j, found, -s) for j, rows in enumerate(held) for s, found in rows]
        yield _rows([[r[c] for r in flat] for c in range(3)], _POSITIVES)

    return work


_NEGATIVES = "place bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _negatives(width: int, k: int, share: tuple[int, int]):
    """For each anchor and positive the k rows of other labels with the highest scores in the positive's window, of a task's blocks; an anchor's windows share one traversal."""

    def work(asked: tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int]]]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, values, positives = asked
        windows = [[(-(-share[0] * p // share[1]), p) for _, p in rows] for rows in positives]
        held: list[list[list[tuple[int, int]]]] = [[[] for _ in rows] for rows in positives]
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree(batch.slice(i, 1).to_pylist()[0], width, values)
                other = {label: tree.labels != label for label in np.unique(labels)}
                for j in range(len(ids)):
                    floor = lambda j=j: min(max(low, _full(rows, k)) for (low, high), rows in zip(windows[j], held[j], strict=True) if low <= high)
                    tops = [high for low, high in windows[j] if low <= high]
                    if not tops:
                        continue
                    least = floor()
                    for score, found in tree.nearest(j, least, max(tops), other[labels[j]]):
                        if score < least:
                            break
                        for (low, high), rows in zip(windows[j], held[j], strict=True):
                            if low <= score <= high:
                                _take(rows, score, found, k)
                        least = floor()
        flat = [(j, int(ids[j]), p, s, found, -n) for j in range(len(ids)) for (p, s), rows in zip(positives[j], held[j], strict=True) for n, found in rows]
        yield _rows([[r[c] for r in flat] for c in range(6)], _NEGATIVES)

    return work


def mine(
    df: DataFrame, anchors: Column, label: Column, n_positives: int = 5, k: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 2048, anchor_rows: int = 16_384
) -> DataFrame:
    """For each anchor and each of its positives, the first k rows of another label whose score is at most the positive's and at least ``share`` of it:
    ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    A score is the inner product with the anchor of components ``floor(scale * x)``, exact; rows are in the order of score, highest first, then of id. An anchor's positives are its first
    ``n_positives`` other rows of its label, all if there are fewer. ``anchors`` says which rows, by ``id``, are anchors; ``label`` gives a row's label in terms of the columns of ``df``.
    A positive with a negative score has no window, as 80 % of it is more than it is.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. An empty vector is all zeros, and a shorter one goes on with zeros. A row that is repeated as a
    whole counts once; rows of one id with different vectors or labels are different rows and different anchors, but none is a positive of an anchor of its own id.
    Other columns are not read, whatever their names. An empty table gives no rows. Components so large that a score could leave 64 bits are an error. Texts play no part.

    ``block_rows``: rows of a tree on average. ``anchor_rows``: anchors that are sent to the tasks at once. All rows of a label are never together: a task has its trees, and gives at
    most k rows for an anchor and positive.
    """
    spark = df.sparkSession
    rows = vectors.integer_vectors(df.where(label.isNotNull()), id_col, vector_col, scale, label=label.cast("bigint"))
    width = vectors.width_of(rows)
    blocks = vectors.index(rows, block_rows, _indexed(width), _INDEX)
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for table in vectors.query_blocks(rows.where(anchors), anchor_rows):
        asked = (table["id"].to_numpy().astype(np.int64), table["label"].to_numpy().astype(np.int64), vectors.matrix(table["vector"], width))
        first = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("positive_score"), "positive_id"))
        near = vectors.in_tasks(spark, blocks, asked, _positives(width, n_positives), _POSITIVES).withColumn("nth", first).where(F.col("nth") <= n_positives)
        positives: list[list[tuple[int, int]]] = [[] for _ in asked[0]]
        # At most n_positives rows for each anchor of the block.
        for j, p, s in zip(*(c.to_pylist() for c in near.select("place", "positive_id", "positive_score").toArrow().columns), strict=True):
            positives[j].append((p, s))
        found = vectors.in_tasks(spark, blocks, (*asked, positives), _negatives(width, k, share), _NEGATIVES)
        rank = F.row_number().over(Window.partitionBy("place", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
        out = out.unionByName(found.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return out
