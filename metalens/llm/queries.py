"""Registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import centroids, decontaminate, merkle, neighbour_graph, packing, quality_model, quality_rules, simhash, substring, token_store, toxicity, url_rules, warc
from .common import scratch

WORD_TOKENIZER, WORD_END_ID = "word_bpe_49k.json", 1
BYTE_TOKENIZER, BYTE_END_ID = "byte_bpe_50k.json", 0


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of ``documents``: fingerprint and component of each."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from each of ``documents`` as repeats of earlier passages."""
    out = substring.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each of ``documents``, learned from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.train(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


URL_RULES = (
    url_rules.HostRule("block", "net", "/"),
    url_rules.HostRule("allow", "example.net", "/en/"),
    url_rules.HostRule("block", "example.com", "/de/"),
    url_rules.HostRule("allow", "org", "/fr/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of each of ``pages``."""
    pages = table(spark, sf_dir, "pages")
    labelled = url_rules.labelled_urls(pages, table(spark, sf_dir, "labels"))
    return url_rules.judge_urls(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the cascade's verdict on each of ``documents``."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all ``documents``, written as token files and read back."""
    path = scratch(spark, "token-store")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(WORD_TOKENIZER), WORD_END_ID)
    return token_store.with_crc32(token_store.read_tokens(spark, path))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` cut into pieces and packed into sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), BYTE_END_ID, packing.CAPACITY)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits in each of ``documents``."""
    out = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "items_sha256",
                      (F.col("n_hit") > 0).alias("contaminated"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC archives and read back; payloads of responses are measured again."""
    path = scratch(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), path)
    back = warc.read_warc(spark, path)
    full = F.col("record_type") == "response"
    return back.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each of ``documents`` by co-training; kept if good is at least as likely as not."""
    scored = quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("kept", F.col("score") >= 0.5)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of ``documents`` by source, and a check of a copy in which texts of some ids lack their line breaks."""
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(touched, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", changed={"text": tampered})
    found = merkle.folded(F.col("now"), F.col("path"))
    return rows.select(
        F.col("id").alias("doc_id"), *(merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.as_text(found).alias("folded_root"), (found == F.col("root")).alias("verified"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all ``embeddings`` to each whose vec_id is divisible by 20."""
    return neighbour_graph.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, 20)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of ``embeddings``: 40 centroids, 5 rounds."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings")).with_inertia()
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_substring, op3_toxicity, op4_url_filter, op5_quality_rules, op6_token_store, op7_packing, op8_decontaminate, op9_warc, op10_quality_model,
                                  op11_merkle, op12_neighbours, op13_centroids)}
