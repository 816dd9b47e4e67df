"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumcast.llm import audio, block_anchors, boilerplate, byte_bpe, langid, mixing, positional_index, ppm, sharding, simhash_links, spelling, suffix_dedup, turn_repair
from quorumcast.shipping import ship
from quorumcast.staging import stage

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = stage(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("bigint").alias("text_crc32")), "op1")
    dealt = sharding.shuffle_into_shards(digest, SHARDS, key=["doc_id", "text_crc32", "size"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_anchors.remove_repeats(table(spark, sf_dir, "documents"))


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), positional_index.contaminated().alias("contaminated"))


def held_out(fold: int, folds: int):
    """Documents whose crc32 of the id as text leaves ``fold`` modulo ``folds``."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stage(audio.media_column(table(spark, sf_dir, "documents")), "op4-media", compression="zstd")
    stored = stage(audio.tensors(media), "op4-tensors", compression="zstd")
    return audio.features(stored, keep_tensors=False).withColumnRenamed("id", "doc_id")


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), ~held_out(2, 7))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(2, 4).alias("held_out"))
    profiles = langid.learn(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "op9")
    return mixing.copies(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_links.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", boilerplate.host(F.col("url")).alias("host"), boilerplate.page_text(F.col("html")).alias("text"))
    kept = boilerplate.drop_boilerplate(stage(pages, "op7-text", compression="zstd"), "host", "text")
    return kept.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    repaired, counts = turn_repair.repair(turn_repair.damaged(rows, F.crc32(F.encode(key, "UTF-8")) % 20))
    done = turn_repair.digests(repaired)
    every, of = rows.select("conv_id").distinct(), lambda df: df.withColumnRenamed("conv_id", "of")
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    wide = every.join(of(counts), same, "left").drop("of").join(of(done), same, "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return wide.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(stage(spelling.word_counts(table(spark, sf_dir, "documents")), "op12-words", compression="zstd"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, check=True)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    named = [op1_sharding, op2_block_anchors, op3_suffix_dedup, op4_audio, op5_ppm, op6_positional_index,
             op7_boilerplate, op8_language_id, op9_mixing, op10_simhash, op11_turn_repair, op12_spelling, op13_byte_bpe, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from quorumcast.llm import oracles

    return dict(oracles.SQL)
