import random
import re
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wellspring.llm import decontamination, language_id, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_tokens_of_words_are_tokens_of_texts():
    tokenizer, own = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH, cache=50)
    rng = random.Random(1)
    parts = ["Hello", "WORLD's", "n't", "é", "é", "ΣΟΦΟΣ", "12345", "<|endoftext|>", "a<|startoftext|>b", "日本語", "🙂!!", " ", "İ", "x\x1cy", "--", "'ll", " ", "ﬁ", "̀"]
    assert own.by_word
    texts = []
    latin = ["Hello", "WORLD's", "n't", "é", "ÀÉßÿ", "123", "--", "'ll", "''s", "\x00\x1f", "\x7f", "a.b,c", "_x_", "DON'T"]
    for k in range(600):
        text = "".join(rng.choice(parts if k % 2 else latin) + rng.choice(["", " ", "\n", "\t ", "\x0b", "　"]) for _ in range(rng.randint(0, 30)))
        texts.append(text)
    for batch in (texts, texts[:1], [""], [None, "a", None], [], ["'"], ["it's"], ["'s", "'l", "l", "'"], ["x" * 500, "\u65e5" * 500]):
        found = own.encode([None if t is None else t.encode() for t in batch])
        assert len(found) == len(batch)
        for text, ids in zip(batch, found, strict=True):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_packing_holds_every_token_once(documents):
    rng = random.Random(3)
    words = [w for w in "the of and a to in he have it that for they with as not on she at by this we you do but from or which one".split()]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 500, 3000, 9000])))) for k in range(160)] + [(None, "null id"), (3, "same id"), (200, None), (201, ""), (4, "twice"), (4, "twice")]
    found = packing.pack(documents(rows), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    pieces = {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for s in range(0, len(ids), 4096):
            key = (i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids))
            pieces[key] = pieces.get(key, 0) + 1
    got = {}
    for r in found:
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[key] = got.get(key, 0) + 1
    assert got == pieces
    sequences = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    padded = sum(n if n & (n - 1) == 0 else 4096 for n in sequences.values())
    assert max(sequences.values()) <= 4096 and 1 - sum(sequences.values()) / padded < 0.05
    assert packing.pack(documents(rows).where("false"), PATH).collect() == []


def test_short_pieces_fill_sequences(documents):
    rows = [(k, " ".join(["of"] * (k % 5 * 7 + 1))) for k in range(6000)] + [(7, "one more " * 2000)]
    found = packing.pack(documents(rows), PATH).collect()
    sequences = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert len(found) == 6001 and max(sequences.values()) <= 4096 and sum(sequences.values()) / (4096 * len(sequences)) > 0.95


@pytest.mark.parametrize("seed", range(4))
def test_column_generation_reaches_the_bound(seed):
    rng = random.Random(seed)
    sizes = rng.sample(range(3, 60), 12)
    histogram = {s: rng.randint(1, 400) for s in sizes}
    patterns = packing.plan(histogram, 64)
    held = {s: sum(p.get(s, 0) * n for p, n in patterns) for s in sizes}
    assert held == histogram and all(sum(s * c for s, c in p.items()) <= 64 for p, _ in patterns)
    demand, order = np.array([histogram[s] for s in sorted(sizes)], float), np.array(sorted(sizes))
    solved = packing.solve(demand, order, 64, gap=1e-7)
    bound = sum(x for _, x in solved)
    assert np.allclose(sum(np.asarray(p) * x for p, x in solved), demand)
    assert sum(n for _, n in patterns) <= bound * (1 + packing.GAP) + len(sizes) and bound >= sum(s * n for s, n in histogram.items()) / 64 - 1e-6


def test_pricing_equals_enumeration():
    values, sizes = np.array([5.0, 4.0, 3.1]), np.array([7, 5, 4])
    best = max(sum(c * v for c, v in zip(cs, values, strict=True)) for cs in product(range(6), repeat=3) if sum(c * s for c, s in zip(cs, sizes, strict=True)) <= 20)
    value, counts = packing.price(values, sizes, 20)
    assert value == pytest.approx(best) == pytest.approx(float(counts @ values)) and counts @ sizes <= 20


def plain_scan(text, items, n=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        k = min(n, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_decontamination_equals_brute_force(spark, documents, block):
    rng = random.Random(6)
    words = [f"w{k}é" if k % 9 == 0 else f"W{k}" for k in range(80)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([2, 12, 13, 30])))) for k in range(12)] + [(50, None), (51, "?!"), (None, " ".join(make(14))), (3, " ".join(make(15)))]
    rows = [(0, None), (1, ""), (2, "..")]
    for k in range(40):
        body = make(rng.choice([5, 40, 300]))
        if k % 2:
            at = rng.randint(0, len(body))
            body[at:at] = (rng.choice(items)[1] or "").split()[rng.randint(0, 3) :]
        rows.append((k + 3, rng.choice([" ", ", ", "-"]).join(body).upper() if k % 3 == 0 else " ".join(body)))
    rows += [(7, rows[9][1]), (None, rows[9][1]), rows[9]]
    docs, bench = documents(rows), spark.createDataFrame(items, "item_id bigint, text string")
    expected = [(i, *plain_scan(t, items)) for i, t in rows]
    found = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.scan(docs, bench, block_bytes=block).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    runs = {(r.doc_id, r.n_hit): r.spans for r in decontamination.scan(docs, bench, block_bytes=block).collect()}
    assert all(sum(b - a for a, b in v) == k[1] and all(x[1] < y[0] for x, y in zip(v, v[1:], strict=False)) for k, v in runs.items())
    kept = decontamination.decontaminate(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(repr(row) for row, x in zip(rows, expected, strict=True) if not x[-1])
    cut = decontamination.decontaminate(docs, bench, remove="spans", block_bytes=block).collect()
    lengths = sorted(len(decontamination.words_of(r.text.encode())) for r in cut if r.text)
    assert lengths == sorted(x[1] - x[2] for (_, t), x in zip(rows, expected, strict=True) if t)
    assert not any(r.contaminated or r.n_hit for r in decontamination.scan(docs, bench.where("false")).collect())


def test_spans_of_several_blocks_are_judged_on_the_input(spark, documents):
    words = [f"w{k}" for k in range(80)]
    items = [(k, " ".join(words[k * 5 : k * 5 + 20])) for k in range(10)]
    rows = [(0, " ".join(["a", *words[:65], "b"])), (1, " ".join(words[:20] + ["x"] + words[20:25])), (2, None), (3, ""), (4, "y z")]
    rows += [rows[0], (5, " ".join(words[20:27] + words[:20] + words[27:33]))]
    docs, bench = documents(rows), spark.createDataFrame(items, "item_id bigint, text string")
    assert len(decontamination._blocks(bench, "item_id", "text", 300)) > 2
    one, many = (sorted(map(repr, ((r.doc_id, r.text) for r in decontamination.decontaminate(docs, bench, remove="spans", block_bytes=b).collect()))) for b in (1 << 24, 300))
    assert many == one
    assert decontamination.decontaminate(docs, bench, remove="spans", block_bytes=300).columns == docs.columns
    assert {len(decontamination.words_of(r.text.encode())) for r in decontamination.decontaminate(docs, bench, remove="spans", block_bytes=300).where("doc_id = 0").collect()} == {2}


def test_columns_may_have_the_names_of_internal_ones(spark):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 30]), "mine", "own", 7) for k in range(30)] + [(40, "y", "mine", "own", 7)], "doc_id bigint, text string, digest string, found_digest string, spans int")
    bench = spark.createDataFrame([(k, " ".join(words[k * 15 : k * 15 + 14])) for k in range(4)], "item_id bigint, text string")
    for block, remove in product((1 << 24, 40), ("documents", "spans")):
        found = decontamination.decontaminate(docs, bench, remove=remove, block_bytes=block)
        assert found.columns == docs.columns and {tuple(r)[2:] for r in found.collect()} == {("mine", "own", 7)}


def test_an_index_is_small():
    rng = random.Random(8)
    for words in ([f"word{k}" for k in range(5000)], list("abcdefghij")):
        text = " ".join(rng.choices(words, k=40_000)).encode()
        assert decontamination.WindowIndex([(1, text), (2, text)]).nbytes < decontamination.INDEX_LEAST + decontamination.INDEX_SHARE * 2 * len(text)


def corpus(seed):
    rng = random.Random(seed)
    letters = {"en": "etaoinshrdlu", "fr": "esaitnruléàô", "de": "enisratdhuüö"}
    lexicon = {}
    for lang, chars in letters.items():
        inner = random.Random(lang)
        lexicon[lang] = ["".join(inner.choices(chars, weights=range(len(chars), 0, -1), k=inner.randint(2, 8))) for _ in range(150)]
    return [(k, " ".join(rng.choices(lexicon[lang], k=40)), lang) for k, lang in enumerate(rng.choices(list(letters), k=300))]


def test_language_models_predict_held_out_rows_and_reject_noise(spark):
    rows = corpus(1)
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", None), (None, rows[0][1], "fr"), (1003, rows[1][1].upper(), None)]
    docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    found = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(found[i].lang_pred == lang for i, lang in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    assert [(found[i].lang_pred, found[i].accepted) for i in (1000, 1001, 1002)] == [("und", False)] * 3
    assert found[1003].lang_pred == rows[1][2]
    rng = random.Random(9)
    noise = [(k, " ".join("".join(rng.choices("qxzjkwvy", k=9)) for _ in range(40))) for k in range(20)]
    assert language_id.keep_identified(spark.createDataFrame(noise, "doc_id bigint, text string"), model).count() == 0
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 300
    assert language_id.predict(docs, language_id.fit(docs.where("false"))).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(docs.where("false"), model).collect() == []


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = corpus(2)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a, b = (language_id.fit(spark.createDataFrame(x, "doc_id bigint, text string, lang string")) for x in (rows, other))
    assert a.languages == b.languages and all((x.grams == y.grams).all() and (x.log_p == y.log_p).all() for x, y in zip(a.blocks[0], b.blocks[0], strict=True))


def test_probabilities_sum_to_one():
    grams = {"de": {"    a": 3, "   ab": 2, "  aba": 2, " abab": 1, "ababa": 4, "baba ": 1}, "en": {"    b": 2, "   bb": 1}}
    grams |= {f"x{k}": {"    c": 1, "   ca": k + 1} for k in range(5)}
    model = language_id.KneserNey(grams)
    known = [ord(c) for c in " abc"]
    for context in ("    ", "abab", "   b"):
        rows = np.array([[s, *map(ord, reversed(context))] for s in [*known, 0x4E00]], dtype=np.uint64)
        assert np.allclose(np.exp(model.log_p(rows)).sum(axis=0), 1, atol=1e-5)


def test_numerals_are_no_letters(spark):
    model = language_id.fit(spark.createDataFrame(corpus(3), "doc_id bigint, text string, lang string"))
    rows = [(k, t) for k, t in enumerate(["\u00b2", "\u00bd", "\u2460 \u2167", "12_", "a\u00bd", "\u65e5", "\U0001d7ce"])]
    found = {r.doc_id: r.lang_pred for r in language_id.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert [found[k] == "und" for k in range(7)] == [True, True, True, True, False, False, True]


def test_many_letters_and_languages(spark):
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    lexicon = {f"l{k:03d}": letters[k * 30 : k * 30 + 30] for k in range(200)}
    rows = [(k, "".join(rng.choices(lexicon[lang], k=60)), lang) for k, lang in enumerate(sorted(lexicon) * 8)]
    rows += [(10_000 + k, rows[0][1], rows[0][2]) for k in range(2)] + [(5, rows[5][1], rows[5][2])] * 50 + [(20_000, "x" * 90_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs, sample_docs=20, sample_chars=1000)
    assert len(model.languages) == 201 and "long" in model.languages
    found = language_id.predict(docs, model).collect()
    truth = {i: lang for i, _, lang in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) / len(found) > 0.99 and len(found) == len(rows)


def test_labels_of_sampled_rows_are_bounded(spark):
    rows = [(k, "some words here", "aa") for k in range(500)] + [(1000 + k, "andere worte da", "bb") for k in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_docs=5)
    assert model.languages == ["aa", "bb"]


def test_a_row_that_is_repeated_hides_no_language(spark):
    few = [(k, " ".join(f"{a}{b}" for a in "xyz" for b in ("qu", "wo", "ri", chr(97 + k % 26))), "bb") for k in range(1, 60)]
    many = [(k, " ".join(f"{a}{b}" for a in "mnl" for b in ("ea", "io", chr(97 + k % 26))), "aa") for k in range(100, 160)]
    one = spark.range(200_000).select(F.lit(few[0][0]).alias("doc_id"), F.lit(few[0][1]).alias("text"), F.lit("bb").alias("lang"))
    docs = spark.createDataFrame(few + many, "doc_id bigint, text string, lang string").unionByName(one)
    model = language_id.fit(docs)
    assert model.languages == ["aa", "bb"]
    found = language_id.predict(spark.createDataFrame(few, "doc_id bigint, text string, lang string"), model).collect()
    assert {r.lang_pred for r in found} == {"bb"}


def test_long_ids_and_uneven_blocks_are_no_reason_to_refuse(spark, documents):
    items = spark.createDataFrame([(f"{k}-" + "i" * 500, f"word{k}") for k in range(3000)], "item_id string, text string")
    assert len(decontamination._blocks(items, "item_id", "text", 1 << 24)) == 1
    blocks = decontamination._blocks(items, "item_id", "text", 40_000)
    sizes = [items.where(F.pmod(F.xxhash64(F.col("item_id"), F.col("text").cast("binary")), F.lit(n)) == rest).agg(F.sum(F.length("item_id") + F.length("text"))).first()[0] for n, rest in blocks]
    assert max(sizes) <= 80_000 and sum(sizes) == items.agg(F.sum(F.length("item_id") + F.length("text"))).first()[0]
    docs = documents([(1, "word7 and word2999"), (2, "none")])
    for size in (1 << 24, 400_000):
        assert {r.doc_id: len(r["items"]) for r in decontamination.scan(docs, items, block_bytes=size).collect()} == {1: 2, 2: 0}
    # One item larger than a block is a block.
    assert decontamination._blocks(items.limit(1), "item_id", "text", 10) != []


def test_packing_patterns_hold_no_pool():
    """A pattern of the plan has memory of its own: as a row of the pool that it was taken from it would keep that whole, one pool for each step."""
    rng = np.random.default_rng(3)
    sizes = np.unique(rng.integers(9, 256, 90))[::-1]
    solved = packing.solve(rng.integers(1, 9, len(sizes)), sizes, 512)
    assert len(solved) == len(sizes) and all(p.base is None or p.base.nbytes <= 2 * p.nbytes for p, _ in solved)
