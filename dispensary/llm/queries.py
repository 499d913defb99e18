"""The queries over the training-data tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensary.llm import oracle
from dispensary.llm._spark import table
from dispensary.llm.chat_format import link_tool_calls
from dispensary.llm.decontaminate import benchmark_matches, is_contaminated
from dispensary.llm.hard_negatives import hard_negatives
from dispensary.llm.license_scan import license_scan
from dispensary.llm.near_dedup import near_duplicates
from dispensary.llm.quality import classify
from dispensary.llm.sentencepiece_codec import encode_decode
from dispensary.llm.sharding import shard_documents
from dispensary.llm.spelling import spelling_groups
from dispensary.llm.substring_dedup import substring_dedup
from dispensary.llm.token_counts import token_counts
from dispensary.llm.url_filter import host_of, url_filter
from dispensary.llm.vector_topk import exact_top_k


def doc_id() -> Column:
    return F.col("id").alias("doc_id")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(doc_id(), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(doc_id(), "n_bytes", "n_tokens", "over_limit")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_matches(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_join("found.items", ",")
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"))
    return out.select(doc_id(), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(doc_id(), "n_shingles", "component_id", "kept")


def captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: the table has no fetch times, so they are derived from page_id, all within 2024."""
    seconds = (F.col("page_id") % 365) * 86400 + (F.col("page_id") * 37) % 86400
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + seconds).alias("fetched_at"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list of about half of the pages' hosts and of three domains, listed, lifted and listed again on days of 2024.

    The table has no list either; which host is listed when follows from the length of its name."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).distinct().filter("pattern <> ''")
    n, day = F.length("pattern"), lambda d: F.timestamp_seconds(F.lit(1704067200) + d * 86400)
    first = n * 7 % 200
    entries = F.array(
        F.struct(F.lit("block").alias("action"), day(first).alias("listed_at")),
        F.struct(F.lit("lift").alias("action"), day(first + 60).alias("listed_at")),
        F.struct(F.when(n % 4 == 0, "allow").otherwise("block").alias("action"), day(first + 90).alias("listed_at")),
    )
    listed = hosts.filter(n % 2 == 0).select("pattern", F.explode(entries).alias("e")).select("pattern", "e.*")
    domains = [("example.net", "block", 100), ("example.net", "lift", 130), ("example.org", "block", 200), ("example.org", "allow", 260), ("example.com", "allow", 10)]
    fixed = pages.sparkSession.createDataFrame(domains, "pattern string, action string, d int")
    return listed.unionByName(fixed.select("pattern", "action", day(F.col("d")).alias("listed_at")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = url_filter(captures(pages), dated_list(pages))
    return out.select(F.col("id").alias("page_id"), "host", F.unix_timestamp("fetched_at").alias("fetched_s"), "n_captures", "pattern", "action", F.unix_timestamp("listed_at").alias("listed_s"), "kept")


def op8_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


#: The tools that the conversations call.
TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 5}}},
    "lookup": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
}


def tool_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) derived from the turns, as the table has none: every assistant turn asks with its whole text,
    builds on the assistant turn before it, and is answered by the next user turn; some calls are broken on purpose."""
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    name = F.when(F.col("conv_id") % 13 == 0, "fetch").when(F.col("turn") % 4 == 1, "search").otherwise("lookup")
    arguments = F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit")))
    arguments = F.when(F.col("conv_id") % 17 == 0, F.concat(F.lit("{"), arguments)).otherwise(arguments)
    calls = conversations.filter("role = 'assistant'").select("conv_id", "turn", call_id(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.array(call_id(F.col("turn") - 2)).alias("needs"))
    results = conversations.filter("role = 'user'").select(call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return link_tool_calls(conversations, *tool_calls(conversations), TOOLS)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select(doc_id(), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, label)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(doc_id(), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_decontaminate, op4_license_scan, op5_quality, op6_near_dedup, op7_url_filter, op8_vector_topk, op9_chat_format, op10_substring_dedup, op11_hard_negatives, op12_sharding, op13_spelling)}

#: None for encodings, token counts, labels of edited templates, language models and canonical JSON; tests hold these against brute force.
ORACLE_SQL: dict[str, str] = oracle.SQL
