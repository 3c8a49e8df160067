"""The registered queries of the operators, as thin digests of their outputs, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspring.llm import chat_format, decontamination, hard_negatives, language_id, line_dedup, media, packing, periodic_runs, phrase_dedup, simhash, suffix_dedup, topk_search, warc
from wellspring.llm._common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica, read from its archives' bytes. Its records lost the case of one header letter where their SHA-256 starts with 00; in every third archive the first two
    records have changed places; and records whose SHA-256 starts with 01 come once more at their archive's end, which has no place in the primary."""
    made = warc.records(table(spark, sf_dir, "pages"))
    hashed = made.withColumn("sha", F.sha2("record", 256))
    damaged = F.overlay(F.col("record").cast("string"), F.lit("resourcE"), F.lit(22)).cast("binary")
    size = hashed.groupBy("archive").agg(F.max("seq").alias("last"), F.sum("length").alias("bytes"), F.sum(F.when(F.col("seq") == 0, F.col("length"))).alias("l0"), F.sum(F.when(F.col("seq") == 1, F.col("length"))).alias("l1"))
    wide = hashed.join(size, "archive").withColumn("swap", (F.col("archive") % 3 == 0) & (F.col("seq") < 2) & (F.col("last") > 0))
    placed = wide.withColumn("place", F.when(F.col("swap"), 1 - F.col("seq")).otherwise(F.col("seq"))).withColumn("at", F.when(F.col("swap"), F.when(F.col("seq") == 0, F.col("l1")).otherwise(0)).otherwise(F.col("offset")))
    order = Window.partitionBy("archive").orderBy("seq")
    again = wide.where(F.col("sha").startswith("01")).withColumn("place", F.col("last") + F.row_number().over(order)).withColumn("at", F.col("bytes") + F.sum("length").over(order) - F.col("length"))
    columns = ["archive", F.col("place").alias("seq"), F.col("at").alias("offset"), "length", "record"]
    sent = placed.withColumn("record", F.when(F.col("sha").startswith("00"), damaged).otherwise(F.col("record"))).select(*columns).unionByName(again.select(*columns))
    levels = warc.depth(made)
    own = warc.tree(made, levels=levels)
    other = warc.split_archives(warc.archives(sent)).withColumn("hash", F.sha2("record", 256)).drop("record")
    other = warc.tree(warc.aligned(other, own.where("level = 0").select("archive", F.col("node").alias("seq"))), levels=levels)
    found = warc.audit(own, other, levels).select("archive", "seq", "status", "first", "end")
    root = own.where(F.col("level") == levels).select("archive", F.col("hash").alias("root_sha256"))
    leaves = own.where("level = 0").select("archive", F.col("node").alias("seq"), F.col("first").alias("offset"), (F.col("end") - F.col("first")).alias("length"), F.col("hash").alias("record_sha256"))
    named = made.select("archive", "seq", F.col("id").alias("page_id"))
    mine = named.join(leaves, ["archive", "seq"]).join(found.drop("first", "end"), ["archive", "seq"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    none = F.lit(None)
    extra = found.where("status = 'extra'").select("archive", "seq", none.cast("bigint").alias("page_id"), F.col("first").alias("offset"), (F.col("end") - F.col("first")).alias("length"), none.cast("string").alias("record_sha256"), "status")
    return mine.unionByName(extra).join(root, "archive").select("page_id", "archive", "seq", "offset", "length", "record_sha256", "root_sha256", "status")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(extra)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.plant_tails(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.withColumn("longest", longest).withColumn("length", -F.col("longest.less"))
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("longest.start").alias("start"), "length", F.col("longest.period").alias("period"), F.expr("1000 * length div longest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_phrase_dedup, op2_suffix_dedup, op3_warc_fixity, op4_chat_format, op5_simhash, op6_packing, op7_language_id, op8_decontamination, op9_media, op10_line_dedup, op11_hard_negatives, op12_topk_search, op13_periodic_runs)}


ORACLE: dict[str, str] = {
    "op1_phrase_dedup": r"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        place AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)),
        twice AS (SELECT h FROM place GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM place JOIN twice USING (h)),
        word AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM doc),
        kept AS (SELECT r, count(gone.k) AS n, coalesce(string_agg(t, ' ' ORDER BY k) FILTER (WHERE gone.k IS NULL), '') AS s FROM word LEFT JOIN gone USING (r, k) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (r)""",
    "op3_warc_fixity": r"""
        WITH made AS (
            SELECT page_id, CAST(floor(page_id / 256) AS BIGINT) AS archive,
                row_number() OVER (PARTITION BY CAST(floor(page_id / 256) AS BIGINT) ORDER BY page_id) - 1 AS seq, md5(CAST(floor(page_id / 256) AS BIGINT) || ':' || seq) AS u,
                'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                || 'WARC-Record-ID: <urn:uuid:' || u[1:8] || '-' || u[9:12] || '-' || u[13:16] || '-' || u[17:20] || '-' || u[21:32] || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(replace(replace(url, chr(13), ''), chr(10), ''), '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
                || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
        leaf AS (
            SELECT page_id, archive, seq, CAST(coalesce(sum(strlen(record)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
                CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS record_sha256 FROM made WINDOW o AS (PARTITION BY archive ORDER BY page_id)),
        up1 AS (SELECT archive, seq // 16 AS node, min("offset") AS a, max("offset" + length) AS b, sha256(string_agg(record_sha256 || ':' || "offset" || '-' || "offset" + length || chr(10), '' ORDER BY seq)) AS h FROM leaf GROUP BY ALL),
        up2 AS (SELECT archive, node // 16 AS node, sha256(string_agg(h || ':' || a || '-' || b || chr(10), '' ORDER BY node)) AS h FROM up1 GROUP BY ALL),
        size AS (SELECT archive, max(seq) AS last, CAST(sum(length) AS BIGINT) AS bytes FROM leaf GROUP BY archive),
        again AS (SELECT archive, length, last + row_number() OVER w AS k, CAST(bytes + sum(length) OVER w - length AS BIGINT) AS begins, last FROM leaf JOIN size USING (archive) WHERE record_sha256 LIKE '01%' WINDOW w AS (PARTITION BY archive ORDER BY seq))
        SELECT page_id, archive, seq, "offset", length, record_sha256, up2.h AS root_sha256,
            CASE WHEN record_sha256 LIKE '00%' THEN 'corrupt' WHEN archive % 3 = 0 AND seq < 2 AND last > 0 THEN 'moved' ELSE 'intact' END AS status FROM leaf JOIN up2 USING (archive) JOIN size USING (archive)
        UNION ALL SELECT NULL, archive, last + 1 + k, begins, length, NULL, up2.h, 'extra' FROM again JOIN up2 USING (archive)""",
    "op8_decontamination": r"""
        WITH doc AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        item AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        pattern AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS win
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
        place AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)),
        found AS (SELECT r, i, p.n, item_id FROM place JOIN pattern p ON place.n = p.n AND place.win = p.win),
        hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
        ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM doc LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)""",
    "op10_line_dedup": r"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
        line AS (SELECT r, source, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM doc WHERE text IS NOT NULL),
        common AS (SELECT t FROM line WHERE trim(translate(t, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
        kept AS (
            SELECT r, count(*) FILTER (WHERE common.t IS NOT NULL) AS gone, coalesce(string_agg(line.t, chr(10) ORDER BY i) FILTER (WHERE common.t IS NULL), '') AS s
            FROM line LEFT JOIN common ON line.t = common.t GROUP BY r)
        SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (r)""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pair AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN pair USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op12_topk_search": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pair AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM pair WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
}
