import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import hard_negatives, topk_search, vectors

WIDE = "vec_id bigint, embedding array<float>, label int, score bigint, place int, id string, vector int"


def rows_of(seed, n=700, width=8):
    """Vectors in clusters, many of them equal (ties under different ids), and rows of every odd kind."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    out = [(int(i), [float(np.float32(x)) for x in np.round(centres[k] + 0.3 * rng.normal(size=width), 1)], int(rng.integers(0, 4))) for i, k in enumerate(rng.integers(0, 5, n))]
    out[: n // 3] = [(i, [0.5] * width, label) for i, _, label in out[: n // 3]]
    out += [(n, None, 1), (n + 1, [None] + [0.1] * (width - 1), 1), (n + 2, [float("nan")] * width, 1), (n + 3, [float("inf")] * width, 2), (n + 4, [], 1), (n + 5, [0.25], 2), (None, [0.1] * width, 1), (n + 6, [0.1] * width, None)]
    out += [out[5], out[100], (100, [1.0] * width, 3), (10**12, [-2.0] * width, 0)]
    return out


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x", 3) for i, v, label in rows], WIDE)


def kept_rows(rows, scale, width, labelled):
    """What takes part: (id, integers, label), repeated rows once."""
    out = set()
    for i, v, label in rows:
        if i is None or v is None or (labelled and label is None) or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(scale * float(np.float32(x)))) for x in v] + [0] * (width - len(v))
        out.add((i, tuple(whole), (label, len(v)) if labelled else len(v)))
    return sorted(out)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("block,queries,few", [(64, 5, 12), (2048, 1000, 64), (100, 1000, 10)])
def test_topk_search_equals_brute_force(spark, block, queries, few):
    rows = rows_of(3)
    held = kept_rows(rows, 1024, 8, False)
    expected = []
    for i, v, _ in held:
        if i % 50 == 0:
            best = sorted((-dot(v, w), j) for j, w, _ in held if j != i)[:10]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    found = topk_search.search(table_of(spark, rows), F.col("id") % 50 == 0, block_rows=block, query_rows=queries, few=few)
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_segments_rule_rows_out_before_all_are_processed():
    """With a known score, far rows are proven out: fewer rows are left than there are, and the best is always among them."""
    rng = np.random.default_rng(1)
    values = rng.integers(-500, 500, size=(500, 16))
    import pyarrow as pa

    made = topk_search._indexed(16)(pa.table({"id": pa.array(np.arange(500)), "vector": pa.array(values.tolist(), type=pa.list_(pa.int64()))}))
    block = topk_search.Block(made.to_pylist()[0], 16)
    for query in values[:40]:
        scores = values @ query
        left = block.possible(query, 5, -np.inf, 5)
        assert set(np.argsort(-scores)[:5]) <= set(left) and len(left) < 250
        assert set(np.flatnonzero(scores >= 400_000)) <= set(block.possible(query, 5, 400_000.0, 5)) | set(np.flatnonzero(scores < np.sort(scores)[-5]))
    assert len(block.possible(np.zeros(16, dtype=np.int64), 5, 1.0, 5)) == 500


def test_rows_are_ruled_out_before_most_postings_in_many_dimensions():
    """Vectors without structure and a known score: a round that can rule nothing out is put off, and of the postings, all of which were processed before, at least a tenth are not."""
    rng = np.random.default_rng(5)
    values = np.floor(128 * rng.normal(size=(2000, 64))).astype(np.int64)
    import pyarrow as pa

    made = topk_search._indexed(64)(pa.table({"id": pa.array(np.arange(2000)), "vector": pa.array(values.tolist(), type=pa.list_(pa.int64()))}))
    block = topk_search.Block(made.to_pylist()[0], 64)
    processed, calls = 0, 0

    class Counting(np.ndarray):
        def __getitem__(self, at):
            nonlocal processed, calls
            if isinstance(at, tuple) and isinstance(at[1], slice):
                processed, calls = processed + int(at[1].stop - at[1].start), calls + 1
            return np.asarray(self)[at]

    block.rows = block.rows.view(Counting)
    queries = np.floor(128 * rng.normal(size=(20, 64))).astype(np.int64)
    for query in queries:
        scores = values @ query
        known = float(np.sort(scores)[-4])
        assert set(np.flatnonzero(scores >= known)) <= set(block.possible(query, 10, known, 128))
    assert processed < 0.9 * 20 * values.size and calls < 20 * 64 * 4


@pytest.mark.parametrize("block,anchors", [(64, 7), (2048, 1000), (150, 1000)])
def test_hard_negatives_equal_brute_force(spark, block, anchors):
    rows = rows_of(4)
    held = kept_rows(rows, 256, 8, True)
    expected = []
    for i, v, (label, _) in held:
        if i % 20 == 0:
            positives = sorted((-dot(v, w), j) for j, w, (other, _) in held if j != i and other == label)[:5]
            others = sorted((-dot(v, w), j) for j, w, (other, _) in held if other != label)
            for p, positive in positives:
                inside = [(n, j) for n, j in others if 80 * -p <= 100 * -n <= 100 * -p][:5]
                expected += [(i, positive, k + 1, j, -p, -n) for k, (n, j) in enumerate(inside)]
    found = hard_negatives.mine(table_of(spark, rows), F.col("id") % 20 == 0, F.col("label"), block_rows=block, anchor_rows=anchors)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and dict(found.dtypes)["rank"] == "int"
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_tree_gives_an_annulus_nearest_first_without_opening_all_nodes():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, size=(30, 6))
    values = centres[np.arange(1500) % 30] + rng.integers(-60, 60, size=(1500, 6))
    order, nodes, largest = hard_negatives.grow(values)
    assert sorted(order) == list(range(1500)) and (nodes["last"] - nodes["first"])[nodes["left"] == 0].max() <= hard_negatives.LEAF
    values = np.ascontiguousarray(values[order])
    ids = rng.permutation(1500)
    row = {"ids": ids.tobytes(), "labels": np.zeros(1500, np.int64).tobytes(), "components": values.tobytes(), "bits": 8, "nodes": nodes.tobytes(), "largest": largest}
    tree = hard_negatives.Tree(row, 6, values[:20])
    scored = 0

    class Counting(np.ndarray):
        def __getitem__(self, at):
            nonlocal scored
            if isinstance(at, slice):
                scored += at.stop - at.start
            return np.asarray(self)[at]

    for j in range(20):
        scores = values @ values[j]
        low, high = int(np.sort(scores)[-400]), int(np.sort(scores)[-50])
        expected = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if low <= s <= high)
        assert [(-int(s), i) for s, i in tree.nearest(j, low, high, np.ones(1500, dtype=bool))] == expected
        first = next(tree.nearest(j, low, high, np.ones(1500, dtype=bool).view(Counting)))
        assert (-int(first[0]), first[1]) == expected[0]
    assert scored < 20 * 1500 / 2


def test_searches_of_empty_tables(spark):
    empty = table_of(spark, [])
    assert topk_search.search(empty, F.col("id") % 1 == 0).collect() == []
    assert hard_negatives.mine(empty, F.col("id") % 1 == 0, F.col("label")).collect() == []
    alone = table_of(spark, [(100, [1.0, 2.0], 1), (7, None, 1)])
    assert topk_search.search(alone, F.col("id") % 100 == 0).collect() == []
    assert hard_negatives.mine(alone, F.col("id") % 100 == 0, F.col("label")).collect() == []


def test_scores_beyond_64_bits_are_refused():
    with pytest.raises(OverflowError):
        vectors.fits(np.array([[1 << 40, 0]]), np.array([[1 << 40, 0]]))


def test_blocks_of_queries_are_bounded_and_whole(spark):
    rows = spark.range(1000).select("id", F.array("id").alias("vector"))
    sizes = [(t.num_rows, t["id"].to_pylist()) for t in vectors.query_blocks(rows, 60)]
    assert max(n for n, _ in sizes) <= 60 and sorted(i for _, ids in sizes for i in ids) == list(range(1000))
