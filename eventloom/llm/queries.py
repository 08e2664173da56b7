"""Queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bpe_codec, decontamination, embedding_dedup, licenses, minhash, personal_data, pitman_yor, quality, ranked_search, secrets, spelling, substring_dedup, token_counts
from eventloom.llm.text import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(read_table(spark, sf_dir, "documents"), width=13, digest=True)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(read_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(read_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(read_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), k=3, threshold=85)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(read_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_license_scan": op4_license_scan,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_minhash": op8_minhash,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_personal_data": op11_personal_data,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling": op13_spelling,
}

OP1_SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
    SELECT doc_id, p, sha256(array_to_string(w[p:p + 12], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words)
), least AS (
    SELECT s, min(doc_id) AS d FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT DISTINCT doc_id, p + k AS p FROM windows JOIN least USING (s), (SELECT unnest(range(13)) AS k) WHERE d < doc_id
), removed AS (
    SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), numbered AS (
    SELECT doc_id, len(w) AS n_words, w, coalesce(ps, []) AS ps FROM words LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, len(ps)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM numbered
"""

OP5_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v,
           label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
               AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
    FROM embeddings
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE CASE WHEN a.usable AND b.usable AND len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.98 ELSE false END
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT r.a AS vec_id, any_value(coalesce(n.n, 0))::BIGINT AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON r.a = n.a GROUP BY r.a
"""

OP8_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
    WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT a, b FROM pairs WHERE 100 * common >= 85 * (n + m - common)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""

OP12_SQL = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM documents WHERE text IS NOT NULL
), postings AS (
    SELECT doc_id, t, count(*) AS tf FROM terms GROUP BY doc_id, t
), lengths AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id
), totals AS (
    SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths
), weights AS (
    SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY t
), norms AS (
    SELECT doc_id, 50 + (50 * n * big_n) // big_l AS m FROM lengths, totals
), items AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark WHERE text IS NOT NULL
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM items JOIN postings USING (t) JOIN weights USING (t) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

#: Patterns of one position (a letter replaced, a letter gone) stand for the signatures.
OP13_SQL = """
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents WHERE text IS NOT NULL)
), hashes AS (
    SELECT id, run, xor(4294967295, list_reduce(
        list_transform(range(0, octet_length(encode(id || ':' || run))), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h
    FROM (SELECT DISTINCT id, run FROM runs), crc_table
), words AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
    FROM runs JOIN hashes USING (id, run)
), counts AS (
    SELECT word, count(*) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), spots AS (
    SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM counts
), cuts AS (
    SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM spots
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN counts b ON a.head || a.tail = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN counts b ON a.head || a.tail = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(other_n) AS top_n FROM near GROUP BY word
), firsts AS (
    SELECT near.word, min(other) AS form FROM near JOIN best ON near.word = best.word AND other_n = top_n GROUP BY near.word
), formed AS (
    SELECT counts.word, counts.n, coalesce(n_near, 0) AS n_near,
           CASE WHEN top_n >= 10 * counts.n THEN firsts.form END AS form, CASE WHEN top_n >= 10 * counts.n THEN top_n END AS form_n
    FROM counts LEFT JOIN best ON counts.word = best.word LEFT JOIN firsts ON counts.word = firsts.word
), chain AS (
    SELECT word, word AS root FROM formed
    UNION
    SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
), roots AS (
    SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL
)
SELECT formed.word, n, n_near, form, form_n, root FROM formed JOIN roots ON formed.word = roots.word
"""

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op5_embedding_dedup": OP5_SQL,
    "op8_minhash": OP8_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
