"""The queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fim, line_dedup, merkle, mixing, ngram_join, packing, quality, tokens, transducer, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokens.token_folder(spark, "token-files")
    tokens.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder)
    return tokens.token_file_checksums(tokens.read_token_files(spark, folder))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = quality.scored(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.fold(F.col("row.doc_id")) == 0, F.lit(False))
    return scores.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    decoded = transducer.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restored(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def embedding_groups_at_030(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 at a threshold that vectors without near copies have links at, too."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.3, cell_rows=64)


def queries() -> dict:
    every = (embedding_groups_at_030, op1_embedding_dedup, op2_ngram_join, op3_packing, op4_line_dedup, op5_token_files, op6_mixing, op7_token_counts, op8_quality, op9_chat, op10_nearest_neighbours, op11_merkle_manifest, op12_byte_bpe, op13_fill_in_middle)
    return {f.__name__: f for f in every}


LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < r.keeper, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""


#: All pairs of vectors of a label, and each vector's least reachable id.
VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT l.w, r.reached FROM r JOIN l ON l.u = r.vec_id),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

#: Documents as sets of five words in a row; pairs that share one, those of Jaccard 0.8, and least reachable ids.
NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS words FROM documents WHERE doc_id IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, hash(list_slice(words, i, i + least(5, len(words)) - 1)) AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN s x ON x.doc_id = u JOIN s y ON y.doc_id = v WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT l.v, r.reached FROM r JOIN l ON l.u = r.doc_id),
c AS (SELECT doc_id, min(reached) AS class_id FROM r GROUP BY doc_id),
n AS (SELECT u AS doc_id, count(*) AS n_links FROM l GROUP BY u)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": LINE_SQL, "op1_embedding_dedup": VECTOR_SQL.format(threshold=0.98), "embedding_groups_at_030": VECTOR_SQL.format(threshold=0.3), "op2_ngram_join": NGRAM_SQL, "op11_merkle_manifest": merkle.manifest_sql(),
        "op13_fill_in_middle": fim.FIM_SQL,
    }
