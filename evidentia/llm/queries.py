"""Queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

import corpus_pipeline
from evidentia.llm import collocations, decontam, html_extract, jaccard_join, line_dedup, mixing, mpegts, prefix_trie, quality_rules, secret_scan, toxicity, url_filter, warc
from evidentia.llm.common import stage, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "lines_in", "lines_out", "text")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs)
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in ("assign", "access", "hex")], F.sha2(secret_scan.digest(base).cast("binary"), 256).alias("base_sha256"), secret_scan.digest(F.col("secrets")).alias("spans"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.filter(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = stage(warc.write_warc(pages, warc.archive_folder(spark)), "archives")
    whole = F.when(F.col("intact"), F.col("record_type")).otherwise(F.raise_error(F.lit("a record was read damaged")))
    return warc.read_warc(archives).select("page_id", "payload_bytes", "payload_digest", whole.alias("record_type"), "refers_to")


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = mpegts.add_streams(docs).withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    r = F.col("read")
    points = F.array_join(F.transform(r["random_access"], lambda k: F.concat_ws("@", k["packet"], k["pts"])), "+")
    feature = F.concat_ws(";", F.concat(F.lit("streams="), r["streams"]), F.concat(F.lit("packets="), r["n_packets"]), F.concat(F.lit("pes="), r["n_pes"]), F.concat(F.lit("pts="), r["first_pts"], F.lit("-"), r["last_pts"]), F.concat(F.lit("rap="), points), F.concat(F.lit("lost="), r["lost"]))
    return made.select("doc_id", "n_bytes", r["payload_bytes"].alias("payload_bytes"), r["payload_sha256"].alias("payload_sha256"), r["tail_crc32"].alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard_join.jaccard_components(docs, width=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = prefix_trie.prefix_trie(turns, prefix_trie.base_rule(), prefix_trie.head_rule())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = quality_rules.judge(docs, ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_line_dedup, op3_secret_scan, op4_source_mix, op5_html_text, op6_toxicity, op7_warc, op8_transport_stream, op9_decontaminate, op10_jaccard_join, op11_prefix_trie, op12_collocations, op13_quality_rules)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {"op4_source_mix": mixing.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_collocations": collocations.ORACLE}
