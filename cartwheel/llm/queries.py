"""The ``opN_<name>`` queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm import (
    alignment, common, exact_dedup, language_id, line_dedup, mixing, packing, quality, ranked_search, simhash_dedup, suffix_dedup, token_files, tokens, topk, toxicity,
)
from cartwheel.session import checkpoint_dir


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return line_dedup.per_document(docs, line_dedup.line_dedup(docs))


#: candidate pairs share their first or last half, as one edit leaves one of them whole; then the edit distance decides
OP1_SQL = r"""
WITH piece AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no
  FROM documents
), n AS (
  SELECT doc_id, line_no, lower(trim(regexp_replace(raw, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS line FROM piece
), l AS (
  SELECT line, min(doc_id::HUGEINT * 2147483648 + line_no) AS pos, length(line) AS size FROM n WHERE line <> '' GROUP BY line
), long_ AS (SELECT * FROM l WHERE size >= 16),
pair AS (
  SELECT a.line AS x, a.pos AS xp, b.line AS y, b.pos AS yp FROM long_ a JOIN long_ b
    ON b.size = a.size AND left(a.line, a.size // 2) = left(b.line, a.size // 2) AND a.pos < b.pos
  UNION SELECT a.line, a.pos, b.line, b.pos FROM long_ a JOIN long_ b
    ON b.size = a.size AND right(a.line, a.size // 2) = right(b.line, a.size // 2) AND a.pos < b.pos
  UNION SELECT a.line, a.pos, b.line, b.pos FROM long_ a JOIN long_ b
    ON b.size = a.size + 1 AND left(a.line, a.size // 2) = left(b.line, a.size // 2)
  UNION SELECT a.line, a.pos, b.line, b.pos FROM long_ a JOIN long_ b
    ON b.size = a.size + 1 AND right(a.line, a.size // 2) = right(b.line, a.size // 2)
), gone AS (
  SELECT DISTINCT CASE WHEN xp < yp THEN y ELSE x END AS line FROM pair WHERE xp <> yp AND levenshtein(x, y) <= 1
), kept AS (
  SELECT (pos // 2147483648)::BIGINT AS doc_id, (pos % 2147483648)::BIGINT AS line_no, line
  FROM l WHERE line NOT IN (SELECT line FROM gone)
), sums AS (
  SELECT doc_id, count(*) AS n_kept, sum(('0x' || left(md5(line_no || ':' || line), 8))::BIGINT)::BIGINT AS kept_digest FROM kept GROUP BY doc_id
), counts AS (
  SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines FROM n GROUP BY doc_id
)
SELECT c.doc_id, c.n_lines, coalesce(s.n_kept, 0) AS n_kept, coalesce(s.kept_digest, 0) AS kept_digest
FROM counts c LEFT JOIN sums s USING (doc_id)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc_bucket("doc_id", 4) == 2
    model = language_id.fit(docs, ~held_out, tokens.vocabulary("piece_bpe_32k.model"))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.simhash_dedup(common.table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def quality_trees(docs: DataFrame, labels: DataFrame) -> quality.Trees:
    return quality.fit(docs, labels, lambda doc_id: common.crc_bucket(doc_id, 5) != 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_trees(docs, common.table(spark, sf_dir, "labels")))
    held_out = common.crc_bucket("doc_id", 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(common.table(spark, sf_dir, "documents"), entropy_share=0.95, max_passes=2.0)
    return drawn.select("doc_id", "source", "pass", "n_tokens", "start", "turn", "weight")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(common.table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"), end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    files = token_files.write(docs, folder, tokens.vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_files.read(files, files.keys).withColumnRenamed("key", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), lambda doc_id: common.crc_bucket(doc_id, 5) != 0)
    held_out = common.crc_bucket("doc_id", 5) == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(common.table(spark, sf_dir, "documents"), window=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = alignment.align(docs, tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), k=20)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), size AS (
  SELECT doc_id, len(words)::BIGINT AS n FROM d WHERE len(words) > 0
), totals AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS occurrences FROM size
), tf AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(words) AS term FROM d) GROUP BY doc_id, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), scored AS (
  SELECT a.item_id, tf.doc_id,
         sum(a.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * s.n * t.docs) // t.occurrences))))::BIGINT AS score
  FROM asked a JOIN weight w USING (term) JOIN tf USING (term) JOIN size s ON s.doc_id = tf.doc_id CROSS JOIN totals t
  GROUP BY a.item_id, tf.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_line_dedup, op2_language_id, op3_simhash_dedup, op4_quality, op5_mixing, op6_packing,
    op7_token_files, op8_top_k, op9_exact_dedup, op10_toxicity, op11_suffix_dedup, op12_alignment, op13_ranked_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.prepare(spark)
            return query(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op8_top_k": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op13_ranked_search": OP13_SQL}
