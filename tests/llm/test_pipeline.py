"""The pipeline's stages against plain versions of them, each on its own input."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wellspring.llm import language_id, simhash
from wellspring.scratch import written

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_lines(rows):
    sites = {}
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c") and s is not None:
                sites.setdefault(line, set()).add(s)
    out = []
    for i, t, lang, s, _ in rows:
        kept = None if t is None else "\n".join(x for x in t.split("\n") if len(sites.get(x, ())) < 10)
        out.append((i, kept, lang, s, None if kept is None else len(kept)))
    return out


def plain_near(rows):
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := lower(t or "").split()) else set() for _, t, *_ in rows]
    prints = [simhash.fingerprint_of((t or "").encode()) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and ((prints[a] ^ prints[b]).bit_count() <= 2 or 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])):
                label = [label[b] if x == label[a] else x for x in label]
    best = {}
    for k, x in enumerate(label):
        if x not in best or rows[k][0] < rows[best[x]][0]:
            best[x] = k
    return [rows[k] for k in best.values()]


def plain_clean(rows, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {tuple(w[k : k + 13]) for t in items for w in [fold(t)] for k in range(len(w) - 12)}
    out = []
    for row in rows:
        words, hit = fold(row[1]), set()
        for k in range(len(words) - 12):
            if tuple(words[k : k + 13]) in windows:
                hit |= set(range(k, k + 13))
        if not hit or 20 * len(hit) < len(words):
            out.append(row)
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, path = random.Random(21), str(tmp_path_factory.mktemp("pipeline"))
    lexicon = {lang: ["".join(random.Random(lang + str(k)).choices(chars, k=1 + k % 7)) for k in range(120)] for lang, chars in (("en", "etaoinshrd"), ("fr", "esaitnruéà"))}
    rows = []
    for k in range(150):
        lang = rng.choice(["en", "fr"])
        lines = [" ".join(rng.choices(lexicon[lang], k=rng.choice([8, 30]))) for _ in range(3)]
        rows.append((k, "\n".join([*lines, "the same on every site"] if k % 3 else lines), lang, f"s{k % 15}"))
    items = [" ".join(rng.choices(lexicon["en"], k=20)) for _ in range(3)]
    rows += [(200 + k, f"{items[k % 3]} {' '.join(rng.choices(lexicon['en'], k=n))}", "en", "s1") for k, n in enumerate((10, 40, 900, 5))]
    rows += [(300 + k, rows[k][1].replace(" ", "  ", 1), rows[k][2], "s3") for k in range(8)] + [(0, rows[0][1], rows[0][2], "s0")]
    rows += [(400 + k, " ".join([*rows[-20][1].split()[: 800 - k], "changed"]), "en", "s2") for k in range(3)]
    rows += [(500, None, "en", "s1"), (501, "", "en", "s1"), (502, "12 ½ ?", "en", None), (503, " ".join("".join(rng.choices("qxzjkwvy", k=9)) for _ in range(30)), None, "s1"), (504, rows[1][1].upper(), None, None)]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_equal_plain_versions_and_take_effect(spark, tables):
    path, rows, items = tables
    stage = dict(corpus_pipeline.STAGES)
    frame = lambda held: spark.createDataFrame(held, SCHEMA).repartition(3)
    known = lambda df: sorted(map(repr, map(tuple, df.collect())))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.fit(docs)
    held = []
    for row, (_, _, _, accepted) in zip(rows, language_id._judge(model, [r[1] for r in rows]), strict=True):
        line = language_id.normalise(row[1])
        best = model.cross_entropy([line])[0]
        if line and best.min() <= model.limits[best.argmin()] + language_id.SHORT / len(line) ** 0.5:
            held.append(row)
            assert accepted
    assert {r[0] for r in rows} - {r[0] for r in held} == {500, 501, 502, 503}
    assert known(stage["language_id"](spark, docs, path)) == sorted(map(repr, held))
    lines = plain_lines(held)
    assert known(stage["line_dedup"](spark, frame(held), path)) == sorted(map(repr, lines)) and any("the same" in (r[1] or "") for r in held)
    apart = plain_near(lines)
    assert known(stage["simhash_near_dedup"](spark, frame(lines), path)) == sorted(map(repr, apart)) and len(apart) < len(lines) - 8
    clean = plain_clean(apart, items)
    assert known(stage["benchmark_decontamination"](spark, frame(apart), path)) == sorted(map(repr, clean)) and len(clean) < len(apart)
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t, *_ in clean:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces += [(i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    mark = written(spark)
    found = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) == sorted(pieces)
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert written(spark) == mark


def test_empty_tables_make_an_empty_pipeline(spark, tables, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
