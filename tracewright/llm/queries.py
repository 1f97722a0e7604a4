"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, embed_dedup, exact_dedup, langid, lattice_lm, line_dedup, packing, quality, resample, simhash, sketches, variants, wavelet
from tracewright.llm.shared import UPPER, held_out, table

#: Where the vocabularies are; a parameter of the operators.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), VOCABULARY)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5))
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Fitted on the labelled rows of docs outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5))
    return quality.fit(spark, docs, labels)


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, decoded=True)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = wavelet.write_shards(spark, table(spark, sf_dir, "documents"), BYTE_VOCABULARY)
    return wavelet.read_documents(spark, files).withColumnRenamed("id", "doc_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(spark, table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10), PIECES, word_pieces=True)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark, table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 5))
    model = language_model(docs)
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def language_model(docs: DataFrame) -> langid.Model:
    """Fitted on the rows of docs outside the held-out fold that have a language."""
    return langid.fit(docs.filter(~held_out(F.col("doc_id"), 5)).select("doc_id", "text", "lang"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(spark, variants.vocabulary(spark, table(spark, sf_dir, "documents"), drop_every=97))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketches.edited(spark, table(spark, sf_dir, "documents"))
    own, of_edited, of_next = F.col("own"), F.col("of_edited"), F.col("of_next")
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketches.fingerprint(own).alias("fingerprint"), sketches.fingerprint(of_edited).alias("edited_fingerprint"),
        sketches.likeness(own, of_edited).alias("near_edited"), sketches.likeness(own, of_next).alias("near_next"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_exact_dedup, op3_best_fit_packing, op4_quality_classifier, op5_bpe_encoding, op6_token_output, op7_lm_scoring, op8_embedding_dedup, op9_simhash_dedup, op10_language_id, op11_spelling_variants, op12_importance_resampling, op13_document_fingerprints, pipeline)}

_LOWER = f"'{UPPER}', '{UPPER.lower()}'"

#: The 256 entries of crc32's table, from its polynomial.
_CRC_TABLE = """crc_bits(i, c, k) AS (
            SELECT i, i, 0 FROM range(256) r(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
        crc_table AS (SELECT i, c FROM crc_bits WHERE k = 8)"""


def _crc(table: str, columns: str) -> str:
    """Common tables that add h, the crc32 of the bytes that column x of the table has in hex."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(x, {at}, 1)) - 1)"
    return f"""{table}_steps AS (
            SELECT {columns}, x, 4294967295 AS c, 0 AS p FROM {table}
            UNION ALL SELECT {columns}, x, xor(s.c >> 8, t.c), p + 1 FROM {table}_steps s
            JOIN crc_table t ON t.i = xor(s.c & 255, {digit("2 * p + 1")} * 16 + {digit("2 * p + 2")}) WHERE 2 * p < length(x)),
        {table}_crc AS (SELECT {columns}, xor(c, 4294967295) AS h FROM {table}_steps WHERE 2 * p = length(x))"""


def _likeness(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) WHEN len({a}) = len({b}) THEN 1.0 ELSE 0.0 END"


ORACLE_SQL = {
    "op1_line_dedup": f"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
        lines AS (
            SELECT doc_id, unnest(own) AS line, generate_subscripts(own, 1) AS i FROM split),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM lines),
        common AS (
            SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT k.doc_id, k.line, k.i, c.key IS NOT NULL AND k.doc_id <> c.largest AS dropped
            FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op2_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_LOWER})) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        own AS (
            SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
        {_crc("own", "doc_id, run, n")},
        slipped AS (
            SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM own_crc),
        words AS (
            SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        places AS (
            SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        short AS (
            SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS s FROM places),
        gaps AS (
            SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM places),
        links AS (
            SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT x.word, x.n, y.word, y.n FROM short x JOIN words y ON x.s = y.word
            UNION SELECT y.word, y.n, x.word, x.n FROM short x JOIN words y ON x.s = y.word),
        best AS (
            SELECT word, count(*) AS n_near, min({{'n': -near_n, 'w': near}}) AS b FROM links GROUP BY word),
        formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 2 * w.n THEN b.w END AS form, CASE WHEN -b.n >= 2 * w.n THEN -b.n END AS form_n
            FROM words w LEFT JOIN best USING (word)),
        chains AS (
            SELECT word, word AS at, form AS ahead FROM formed
            UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN formed f ON f.word = c.ahead)
        SELECT f.word, form, c.at AS root, n, n_near, form_n FROM formed f JOIN chains c ON c.word = f.word AND c.ahead IS NULL""",
    "op12_importance_resampling": f"""
        WITH RECURSIVE {_CRC_TABLE},
        sides AS (
            SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark),
        split AS (
            SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM sides),
        features AS (
            SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM split),
        counted AS (
            SELECT side, id, f, count(*) AS n FROM features GROUP BY ALL),
        own AS (
            SELECT f, hex(encode(f)) AS x FROM counted GROUP BY f),
        {_crc("own", "f")},
        placed AS (
            SELECT side, id, n, h % 10000 AS bucket FROM counted JOIN own_crc USING (f)),
        totals AS (
            SELECT bucket, sum(n) FILTER (WHERE side = 0) AS s, sum(n) FILTER (WHERE side = 1) AS t FROM placed GROUP BY bucket),
        sums AS (
            SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM totals),
        gains AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM totals, sums),
        weights AS (
            SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
            FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
        digits AS (
            SELECT id AS doc_id, len(w) AS n_words, sha256('7:' || id) AS x FROM split WHERE side = 0),
        noise AS (
            SELECT doc_id, n_words, list_reduce(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', x[i]) - 1)::BIGINT), lambda a, b: a * 16 + b) AS h FROM digits),
        scored AS (
            SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM noise LEFT JOIN weights ON weights.id = noise.doc_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS fit FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM ranked""",
    "op13_document_fingerprints": f"""
        WITH rows AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
        turned AS (
            SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM rows WINDOW o AS (ORDER BY doc_id DESC)),
        texts AS (
            SELECT *, left(text, n_chars - n_chars // 3) || left(next_text, n_chars // 3) AS edited FROM turned),
        each AS (
            SELECT DISTINCT t FROM (SELECT text AS t FROM texts UNION ALL SELECT edited FROM texts UNION ALL SELECT next_text FROM texts)),
        split AS (
            SELECT t, list_filter(regexp_split_to_array(translate(t, {_LOWER}), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w FROM each),
        hashed AS (
            SELECT t, CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda i: left(md5(array_to_string(w[i + 1:i + 5], ' ')), 16)) END AS h FROM split),
        low AS (
            SELECT t, h, list_sort(list_distinct(list_filter(h, lambda y: y < '2000000000000000'))) AS below FROM hashed),
        kept AS (
            SELECT t, CASE WHEN len(below) > 0 THEN below WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END AS k FROM low),
        all_three AS (
            SELECT d.doc_id, d.n_chars, d.edited, o.k AS own, e.k AS of_edited, n.k AS of_next
            FROM texts d JOIN kept o ON o.t = d.text JOIN kept e ON e.t = d.edited JOIN kept n ON n.t = d.next_text)
        SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(of_edited, '') AS edited_fingerprint,
               {_likeness("own", "of_edited")} AS near_edited, {_likeness("own", "of_next")} AS near_next
        FROM all_three""",
}
