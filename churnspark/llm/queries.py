"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm.common import read_table


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.quality import apply_rules
    out = apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "first_step", "step")


def doc_fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.langid import identify
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), docs.filter(doc_fold(5) != 0))
    return out.select("doc_id", F.coalesce(doc_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op3_topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.topk import exact_top_k
    table = read_table(spark, sf_dir, "embeddings")
    return exact_top_k(table, table.filter(F.col("vec_id") % 100 == 0), 10)


def op4_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.toxicity import fit, score
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels").filter(doc_fold(4) != 2))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(doc_fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def source_domain():
    """A stand-in for a registry of sources: those numbered 0 to 4 in the last digit are forums, the others press."""
    return F.when(F.right(F.col("source"), F.lit(1)) < "5", "forum").otherwise("press")


#: Target weights of the mix: relative to their siblings, 1 for any other.
MIX_WEIGHTS = {"domain": {"forum": 2, "press": 3}, "language": {"en": 4, "de": 2, "fr": 2}, "source": {"src1": 3, "src5": 2}}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.mixing import mix
    docs = read_table(spark, sf_dir, "documents")
    out = mix(docs, domain=source_domain(), weights=MIX_WEIGHTS, max_epochs=3, seed=7)
    return out.select("doc_id", "domain", "lang", "source", "tokens", "copies")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.linededup import dedup_lines
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.neardup import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.packing import pack
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.substrdedup import drop_repeats
    out = drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_layout=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.sharding import shard
    out = shard(read_table(spark, sf_dir, "documents"), 40)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.lexical import rank_documents
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.hardneg import hard_negatives
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = read_table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(table, table.filter(F.col("vec_id") % 50 == 0))


def op13_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnspark.llm.simhash import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_topk_histogram, op4_toxicity_crf, op5_mixing, op6_line_dedup, op7_near_duplicates, op8_packing, op9_substring_dedup, op10_sharding, op11_lexical_search,
                          op12_hard_negatives, op13_simhash_duplicates, pipeline)
}
