import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from wellspring.llm import _hashing as H
from wellspring.llm import bwt, line_dedup, phrase_dedup, simhash, suffix_dedup
from wellspring.llm.components import components


def texts(seed, n=60):
    """Prose with copies, shared passages at odd places, repeats inside a text, white space of all kinds, nulls and empty texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéñ", k=rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    out = [None, "", " \t\n", "one", None]
    for k in range(n):
        body = rng.choices(words, k=rng.choice([3, 40, 90, 200]))
        if k % 3 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage.split()[rng.randint(0, 20) :]
        if k % 5 == 0:
            body += body[:50]
        out.append(rng.choice([" ", "\n", "\t "]).join(body))
        if k % 7 == 0:
            out += [out[-1]] * 2
    out.append(" ".join(["tick", "tock"] * 80))
    return out


def repeated_mask(sequences, width):
    """By brute force: which items lie in a window that starts anywhere else too."""
    starts = {}
    for d, s in enumerate(sequences):
        for i in range(len(s) - width + 1):
            starts.setdefault(tuple(s[i : i + width]) if isinstance(s, list) else s[i : i + width], []).append((d, i))
    masks = [np.zeros(len(s), dtype=bool) for s in sequences]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                masks[d][i : i + width] = True
    return masks


@pytest.mark.parametrize("width,seed", [(35, 8), (10, 3)])
def test_phrase_dedup_equals_brute_force(documents, width, seed):
    rows = list(enumerate(texts(width)))
    rows += [rows[9], (None, rows[9][1]), (None, None)]
    found = phrase_dedup.remove_passages(documents(rows), width=width, seed=seed, bucket_bytes=20_000).collect()
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    expected = [(i, len(w), int(m.sum()), " ".join(x for x, g in zip(w, m, strict=True) if not g)) for (i, _), w, m in zip(rows, split, repeated_mask(split, width), strict=True)]
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found))) == sorted(map(repr, expected))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)


@pytest.mark.parametrize("width,seed,shard", [(400, 32, 1 << 20), (60, 12, 1 << 20), (60, 12, 2000)])
def test_suffix_dedup_equals_brute_force(documents, width, seed, shard):
    rows = list(enumerate(texts(width)))
    rows += [rows[9], (None, rows[9][1]), (None, None)]
    found = suffix_dedup.remove_repeats(documents(rows), width=width, seed=seed, bucket_bytes=20_000, shard_bytes=shard).collect()
    data = [(t or "").encode() for _, t in rows]
    expected = []
    for (i, _), d, m in zip(rows, data, repeated_mask(data, width), strict=True):
        expected.append((i, len(d), int(m.sum()), len(H.runs(m)), hashlib.sha256(np.frombuffer(d, np.uint8)[~m].tobytes()).hexdigest()))
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found))) == sorted(map(repr, expected))


@pytest.mark.parametrize("module,run", [(phrase_dedup, "remove_passages"), (suffix_dedup, "remove_repeats")])
def test_repeated_rows_meet_as_one(documents, module, run):
    text = " ".join(f"w{k}" for k in range(120))
    rows = [(1, text)] * 300 + [(None, text + " x")] * 200 + [(2, "alone " + " ".join(f"v{k}" for k in range(120))), (3, None), (3, None)]
    held = phrase_dedup.dealt(documents(rows), "doc_id", "text", 4_000).collect()
    assert sorted((r.id or 0, r.copies) for r in held) == [(0, 200), (1, 300), (2, 1), (3, 2)]
    found = getattr(module, run)(documents(rows), bucket_bytes=4_000).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.n_removed > 0) for r in found} == {(1, True), (None, True), (2, False), (3, False)}
    assert sum(r.doc_id == 1 for r in found) == 300 and sum(r.doc_id is None for r in found) == 200
    assert "copies" not in found[0].asDict()


def test_buckets_meet_in_groups(spark, documents):
    """A text in most buckets: rounds of groups give the rows of a single one."""
    rng = random.Random(8)
    shared = " ".join(f"s{k}" for k in range(70))
    rows = [(k, " ".join(f"u{rng.random()}" for _ in range(20)) + f" {shared} x{k}") for k in range(40)] + list(enumerate(texts(5, 12), 100))
    wide, narrow = ([sorted(map(repr, run(documents(rows), bucket_bytes=1_000, fan=fan).collect())) for run in (phrase_dedup.remove_passages, suffix_dedup.remove_repeats)] for fan in (1 << 16, 3))
    assert wide == narrow
    counts = [(b, "often", 1) for b in range(30)] + [(7, "once", 1), (29, "twice", 2)]
    found = phrase_dedup.totalled(spark.createDataFrame(counts, "bucket bigint, key string, n bigint"), 30, "key", fan=3).collect()
    assert len(found) == len(counts)
    assert {(r.key, r.total) for r in found if r.home} == {("often", 30), ("once", 1), ("twice", 2)}
    assert sum(r.home for r in found) == 3 and all(r.total > 1 for r in found if not r.home)


def test_interval_expansion_equals_plain_common_prefixes():
    rng = random.Random(3)
    parts = [bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(12)] + [b"ab" * 30, b"", b"ab" * 30]
    text, _ = bwt.joined(parts)
    for limit in (3, 8, 25):
        order = bwt.suffix_order(text, limit)
        suffixes = [tuple(text[i:]) for i in order]
        assert [s[:limit] for s in suffixes] == sorted(s[:limit] for s in suffixes)
        plain = [0] + [next((k for k in range(limit) if k >= len(a) or k >= len(b) or a[k] != b[k]), limit) for a, b in zip(suffixes, suffixes[1:], strict=False)] + [0]
        assert bwt.common_prefixes(text, order, limit).tolist() == plain


@pytest.mark.parametrize("module", [phrase_dedup.remove_passages, suffix_dedup.remove_repeats])
def test_repeats_of_an_empty_table(documents, module):
    assert module(documents([(1, "x")]).where("doc_id > 1")).collect() == []


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, distance):
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                label[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k in range(len(prints)):
        groups.setdefault(root(k), []).append(ids[k])
    return [min((i for i in groups[root(k)] if i is not None), default=None) for k in range(len(prints))]


def test_simhash_equals_brute_force(documents):
    rows = list(enumerate(texts(5)))
    rows += [(i + 1000, " ".join(["extra", *(t or "").split()])) for i, t in rows[20:40]] + [(None, "lonely text of no one"), (None, None), (7, "other text, same id")]
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(rows)).collect()), key=repr)
    prints = [plain_fingerprint(t) for _, t in rows]
    expected = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_components(prints, [i for i, _ in rows], 2), strict=True)]
    assert found == sorted(expected, key=repr)
    kept = simhash.keep_one(documents(rows))
    assert kept.columns == documents(rows).columns
    assert kept.count() == len({c if c is not None else (p,) for (_, _, c), p in zip(expected, prints, strict=True)})


def test_names_of_columns_do_not_clash(spark):
    rows = [(k, f"text of {k // 2} and more words here", "mine", "own", k, 0) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string, kept_id string, print bigint, source int")
    assert {tuple(r) for r in simhash.keep_one(docs).collect()} == {r for r in rows if r[0] % 2 == 0}
    lines = spark.createDataFrame([(k, "common\nown", f"s{k}", "mine", "own", 5) for k in range(12)], "doc_id bigint, text string, source string, key string, gone string, __key int")
    assert {tuple(r)[3:] for r in line_dedup.remove_boilerplate(lines, min_sites=20).collect()} == {("mine", "own", 5)}
    assert {r.text for r in line_dedup.remove_boilerplate(lines, min_sites=10).collect()} == {""}


def test_similar_texts_are_linked_like_brute_force(documents):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    rows = [(900, None), (901, ""), (902, "Two words"), (903, "two  WORDS")]
    common = rng.choices(words, k=40)
    for k in range(40):
        base = rng.choices(words, k=rng.choice([8, 60, 200])) + common * (k % 2)
        for _ in range(rng.choice([1, 3, 40 if k == 0 else 4])):
            copy = list(base)
            for at in rng.sample(range(len(copy)), len(copy) // rng.choice([30, 60, 90, 150])):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    prints = [simhash.fingerprint_of((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and near(a, b):
                label = [label[b] if x == label[a] else x for x in label]
    expected = {}
    for (i, _), x in zip(rows, label, strict=True):
        expected[x] = min(expected.get(x, i), i)
    assert 40 < len(expected) < len(rows) - 30
    found = simhash.near_duplicates(documents(rows), similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: expected[x] for (i, _), x in zip(rows, label, strict=True)}
    assert sorted(r.doc_id for r in simhash.keep_one(documents(rows), similarity=0.8).collect()) == sorted(expected.values())


@pytest.mark.parametrize("distance,dense,bits", [(2, 64, 4), (2, 1, 4), (2, 3, 8), (1, 64, 4), (1, 1, 4), (0, 1, 4)])
def test_links_equal_brute_force(spark, distance, dense, bits):
    rng = random.Random(11)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            p = base
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints | {0, 1, 1 << 63})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print bigint")
    pairs = {(min(a, b), max(a, b)) for a, b in ((r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, bits, distance, dense).collect())}
    assert pairs == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance}
    found = {r.node % (1 << 64): r.component % (1 << 64) for r in components(simhash.links(frame, bits, distance, dense)).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(found.get(p, p), set()).add(p)
    expected = {}
    for p, c in zip(prints, plain_components(prints, prints, distance), strict=True):
        expected.setdefault(c, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(50)] + [(1000 + k, 999) for k in range(1, 40)] + [(5000, 5000)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys([999, *range(1001, 1040)], 999)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_line_dedup(spark):
    rows = [(k, f"only {k}\ncommon line\n\n \nsome sites", f"site{k % 12}", 0) for k in range(24)]
    rows = [(i, t if k % 12 < 5 else t.replace("some sites", f"else {k}"), s, x) for k, (i, t, s, x) in enumerate(rows)]
    rows += [(100, None, "site1", 1), (101, "", "site2", 1), (102, "common line", None, 2), (None, "common line\nx\n", "site3", 3), (0, rows[0][1], "site0", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, line int")
    kept = sorted(((r.doc_id, r.text, r.source, r.line) for r in line_dedup.remove_boilerplate(docs, min_sites=6).collect()), key=repr)
    assert kept == sorted(((i, None if t is None else "\n".join(x for x in t.split("\n") if x != "common line"), s, x) for i, t, s, x in rows), key=repr)
    found = {(r.doc_id, r.n_lines): r.n_removed for r in line_dedup.report(docs, min_sites=6).collect()}
    assert found[100, 0] == 0 and found[101, 1] == 0 and found[102, 1] == 1 and found[None, 3] == 1
    assert line_dedup.report(docs.where("false")).collect() == []


def test_line_dedup_near_the_threshold_is_exact(spark):
    rows = [(100 * n + k, f"line {n}", f"s{k}") for n in range(1, 40) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = line_dedup.boilerplate(docs, min_sites=20, lg_k=5).count()
    assert found == 20


def test_words_made_by_doubling_are_different(documents):
    """Thue-Morse words have equal polynomial hashes modulo 2**64, whatever the base."""
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    same = " ".join(f"w{k}" for k in range(34))
    found = phrase_dedup.remove_passages(documents([(1, f"{same} {a}"), (2, f"{same} {b}"), (3, "x")])).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 0, 3: 0}
    again = phrase_dedup.remove_passages(documents([(1, f"{same} {a}"), (2, f"{same} {a}")])).collect()
    assert {r.doc_id: r.n_removed for r in again} == {1: 35, 2: 35}


def test_what_counts_as_common_does_not_grow_with_the_table(spark, monkeypatch):
    """A passage in a twelfth of the rows is common in a sample that is a share of them, and hardly there in one of a fixed number of rows."""
    from wellspring.llm import similar

    monkeypatch.setattr(similar, "SAMPLE", 12)
    monkeypatch.setattr(similar, "SHARE", 4, raising=False)
    passage = "this passage is in many texts and so brings no two of them together"
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)) + (f" {passage}" if i % 12 == 0 else "")) for i in range(1200)]
    common = similar.common_shingles(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", 5)
    assert set(similar.shingle_set(passage.encode(), 5).tolist()) <= set(common.tolist())
