"""The registered queries of the training-data operators and their DuckDB SQL, where there is any.

Each applies its operator with production parameters to the whole of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import ann, chat, exactdup, fim, langid, mixing, neardup, packing, pages, phrases, quality, sharding, substring
from tidewatch.llm.common import read

SEQUENCE_TOKENS = 2048
SHARDS = 16
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE_TOKENS)


def op2_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(read(spark, sf_dir, "documents"))
    return m.withColumn("weight", F.round("weight", 6)).withColumn("probability", F.round("probability", 6))


def op3_graph_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(read(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), with_text=False)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(turns.unionByName(chat.probe(spark)))


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), SHARDS)


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(read(spark, sf_dir, "documents")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_mix_to_targets, op3_graph_nearest, op4_language_id, op5_substring_dedup,
                                   op6_main_text, op7_quality_rules, op8_chat_format, op9_jump_shards, op10_dart_minhash,
                                   op11_fill_in_middle, op12_exact_dedup, op13_collocations)}
ORACLES = {"op2_mix_to_targets": mixing.mix_sql(), "op11_fill_in_middle": fim.fim_sql(), "op12_exact_dedup": exactdup.EXACT_SQL,
           "op13_collocations": phrases.PHRASES_SQL}
