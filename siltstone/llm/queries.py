"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import centroids, classifier, decontaminate, html_text, lm, near_dups, quality, sentencepiece, shards, spelling, token_counts, token_files, warc
from siltstone.llm.shared import prepare, spread, work_dir

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(BYTE_BPE))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.duplicate_classes(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-files")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), folder)
    return token_files.read_token_files(spark, folder, manifest)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(spread(table(spark, sf_dir, "pages")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(PIECES))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.histogram_shards(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    return warc.read_archives(spark, folder, warc.write_archives(pages, folder), pages)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_documents(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spread(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_near_dups, op3_decontaminate, op4_quality_rules, op5_token_files, op6_html_text, op7_sentencepiece, op8_shards, op9_lm_scores, op10_warc, op11_quality_classifier, op12_centroids, op13_spelling)}


#: op10's rows from the pages alone: base32 of a SHA-1 is 32 digits of five bits.
WARC_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, size, array_to_string(list_transform(range(1, 41), lambda i: format('{:04b}', CAST('0x' || h[i:i] AS INTEGER))), '') AS bits FROM p),
d AS (SELECT page_id, size, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda k: CASE WHEN bits[5 * i + k : 5 * i + k] = '1' THEN CAST(pow(2, 5 - k) AS INTEGER) ELSE 0 END))::INTEGER, 1)), '') AS digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def centroids_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """op12's rounds, one after another: distances of all vectors to all centroids, the nearest, exact floors of the means."""
    steps = [
        "e AS MATERIALIZED (SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "v AS MATERIALIZED (SELECT r, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM e, range(1, 65) AS t(i))",
        f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS c FROM e WHERE vec_id IS NOT NULL QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x AS m FROM s JOIN v USING (r))",
    ]
    for j in range(rounds + 1):
        steps.append(f"d{j} AS (SELECT r, c, sum((x - m) * (x - m)) AS d FROM v JOIN c{j} USING (i) GROUP BY r, c)")
        steps.append(f"a{j} AS MATERIALIZED (SELECT r, c, d FROM d{j} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if j < rounds:
            steps.append(f"n{j} AS (SELECT c, i, sum(x) AS t, count(*) AS n FROM a{j} JOIN v USING (r) GROUP BY c, i)")
            steps.append(f"c{j + 1} AS MATERIALIZED (SELECT c{j}.c, c{j}.i, CAST(coalesce((t - ((t % n) + n) % n) // n, m) AS BIGINT) AS m FROM c{j} LEFT JOIN n{j} ON c{j}.c = n{j}.c AND c{j}.i = n{j}.i)")
    steps.append(f"h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)")
    out = "SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256"
    return f"WITH {', '.join(steps)} {out} FROM a{rounds} JOIN e USING (r) JOIN h USING (c)"


#: op13: crc32 by its table of 256 remainders, near words by their texts with one code point left out, forms followed up.
SPELLING_SQL = """WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) AS g(i)),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, c, xor(list_reduce(flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END)), lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h, doc_id FROM runs, crc),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN doc_id IS NOT NULL AND h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM words, unnest(range(1, length(word) + 1)) AS g(i)),
near AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM formed WHERE form IS NULL UNION ALL SELECT f.word, c.root FROM chain c JOIN formed f ON f.form = c.word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say what must come out; the other operators are held against libraries or brute force in the tests."""
    return {"op10_warc": WARC_SQL, "op12_centroids": centroids_sql(), "op13_spelling": SPELLING_SQL}
