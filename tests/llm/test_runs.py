import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wellspring.llm import periodic_runs, queries


def brute_runs(words, least=12):
    """All (start, length, period) by definition: for each period, the longest stretches in which words that far apart are equal, less those with a smaller period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x + q < n:
            a = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            if x - a >= q:
                found.setdefault((a, x + q), q)
            x += 1
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, 2 * q))


def word_lists(seed, n):
    """Words over few letters, with repeats of many periods and exponents, some broken, some overlapping."""
    rng = random.Random(seed)
    for _ in range(n):
        letters, words = rng.choice([1, 2, 3, 5, 40]), []
        while len(words) < rng.choice([0, 11, 12, 30, 90, 160]):
            unit = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 4, 6, 7, 8, 14, 15, 16, 31]))]
            words += (unit * rng.choice([1, 1, 2, 3, 5]))[rng.randrange(len(unit)) :]
        yield words


@pytest.mark.parametrize("least", [12, 4])
def test_runs_equal_brute_force(least):
    for words in word_lists(least, 800):
        assert [(a, n, p) for a, n, p in periodic_runs.runs(np.array(words, dtype=np.int64), least)] == sorted((a, n, q) for a, n, q in brute_runs(words, least)), words


def test_stretches_lose_no_run():
    for words in word_lists(1, 300):
        spans = periodic_runs.stretches(np.array(words, dtype=np.int64))
        assert all(any(s <= a and a + n <= e for s, e in spans) for a, n, _ in brute_runs(words))
    prose = np.arange(5000)
    prose[2000:2024] = np.tile(prose[2000:2012], 2)
    assert periodic_runs.stretches(prose).tolist() == [[2000, 2024]]


def test_long_texts_of_one_word_and_of_one_long_period():
    assert periodic_runs.runs(np.zeros(60_000, dtype=np.int64)) == [(0, 60_000, 1)]
    unit = np.random.default_rng(1).permutation(30_000)
    assert periodic_runs.runs(np.tile(unit, 2)[:-1]) == []
    assert periodic_runs.runs(np.concatenate((unit, unit, unit[:5]))) == [(0, 60_005, 30_000)]


def texts():
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "no break", "tick tock " * 30, "\x1cfs " * 13, "a\x00b " * 12]
    for words in word_lists(5, 60):
        out.append(random.Random(len(words)).choice([" ", "\n", "\t  "]).join(f"w{k}é" for k in words) + " ")
    return [*out, out[9], out[9], " ".join(f"v{k % 700}" for k in range(40_000))]


def collapsed(words, runs):
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


def test_find_runs_equals_brute_force(documents):
    rows = [*enumerate(texts()[:-1]), (None, "x y " * 9), (None, None), (-3, "x y " * 9)]
    found = periodic_runs.find_runs(documents(rows)).collect()
    expected = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute_runs(words)
        expected.append((i, len(words), runs, " ".join(collapsed(words, runs))))
    assert sorted(map(repr, ((r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in found))) == sorted(map(repr, expected))
    assert periodic_runs.find_runs(documents(rows).where("false")).collect() == []


def planted(i, text):
    """The contract's change of a text's words, read from it word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_query_equals_brute_force(spark, documents, tmp_path):
    base = texts()
    # The last text is long; it goes to an id whose text gets a periodic tail, and to one whose text does not.
    chosen = [k for k in range(5000) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(k, base[k % (len(base) - 1)]) for k in range(300)] + [(k, base[j]) for j, k in enumerate(chosen[40 : 40 + len(base)])] + [(None, base[9]), (1, base[-1]), (2, base[9]), (2, base[9])]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic_runs(spark, str(tmp_path))
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    expected, known = [], {}
    for i, text in rows:
        words = planted(i, text)
        key = tuple(words)
        if key not in known:
            known[key] = brute_runs(words) if len(words) < 2000 else [(a, n, q) for a, n, q in periodic_runs.runs(np.unique(words, return_inverse=True)[1])]
        runs = known[key]
        length, start, period = min((-n, a, q) for a, n, q in runs) if runs else (None, None, None)
        length = -length if runs else None
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        expected.append((i, len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    assert sum(r[1] > 0 for r in expected) > 100
