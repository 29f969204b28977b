"""The registered queries: each applies one operator to its whole table under its fixed contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casestory.llm import alignment, exact_dedup, html_extract, knn_join, lattice, license_scan, mixing, ranked_search, repeats, secret_scan, simhash, toxicity, winnowing
from casestory.llm.common import held_out, table


def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text of ``documents`` under the subword lattice model."""
    found = lattice.document_scores(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of ``documents`` after removing white space; one row per document."""
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(F.col("id").alias("doc_id"), F.col("keep_id"), "group_size",
                       (F.col("kept") & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``: known forms and high-entropy strings."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = (F.size(secret_scan.of_kind(F.col("base"), k)).cast("long").alias(f"n_{name}")
              for k, name in enumerate(secret_scan.KINDS[:3]))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every row of ``documents``; labels outside the held-out fold are learnt from."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 4).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         F.size("segments").alias("n_passages"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of ``documents`` and their components within 4 bits."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` that a 400-byte string occurring elsewhere covers."""
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every text of ``documents``."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    top = F.when(F.size("matches") > 0, license_scan.best(F.col("matches")))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"),
                        top["license"].alias("best_license"), F.coalesce(top["coverage"], F.lit(0.0)).alias("coverage"), spans.alias("spans"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in ``documents``."""
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each row of ``documents``."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th row of ``embeddings`` with all other rows."""
    return knn_join.top_products(table(spark, sf_dir, "embeddings"), F.col("query_id") % 20 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best ``documents`` for each ``benchmark`` item."""
    found = ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two public tokenizers aligned over every text of ``documents``."""
    found = alignment.align(table(spark, sf_dir, "documents"), *alignment.tokenizer_files(spark))
    return found.withColumnRenamed("id", "doc_id").drop("th")


QUERIES = {f.__name__: f for f in (op1_lattice_likelihood, op2_exact_dedup, op3_secret_scan, op4_toxicity, op5_html_extract, op6_simhash, op7_repeats, op8_license_scan, op9_winnowing, op10_mixing,
                                  op11_knn_join, op12_ranked_search, op13_token_alignment)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: The operators that SQL expresses; the others are tested against brute-force versions.
ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)""",
    "op9_winnowing": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, s, k, item_id FROM dw JOIN bw USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS sha
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_knn_join": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(d.e)) + 1), lambda i: q.e[i] * d.e[i])), 0) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op12_ranked_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM b JOIN f USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 50""",
}
