"""Queries of the corpus operators over a data folder: each over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import boilerplate, charforms, chunking, markup, mixture, scan_noise, sentences, tokens
from quire.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.found_kinds(table(spark, folder, "sections"))


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_text(table(spark, folder, "sections"), table(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.found_lines(table(spark, folder, "sections"))


def p3_text(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.repaired(table(spark, folder, "sections"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.found_lines(table(spark, folder, "sections"), table(spark, folder, "documents"))


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    sections = table(spark, folder, "sections").select("section_key", "doc_id", "source_page", "raw_text", "loaded_at")
    return boilerplate.without_lines(sections, table(spark, folder, "documents")).select("section_key", "own_text", "n_site_lines")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return charforms.changed_lines(table(spark, folder, "sections").select("section_key", "raw_text")).select("section_key", "line_no")


def p5_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of source_lines with its one form and that form's hash, by which equal-looking lines meet."""
    sections = table(spark, folder, "sections").select("section_key", "source_lines")
    lines = sections.select("section_key", F.posexplode("source_lines").alias("_n", "x")).where(F.col("x").isNotNull()).select("section_key", (F.col("_n") + 1).alias("line_no"), F.col("x.text").alias("text"))
    return charforms.with_canonical(lines.dropDuplicates(["section_key", "line_no"]), "text", "one_form").withColumn("form_hash", F.xxhash64("one_form")).select("section_key", "line_no", "one_form", "form_hash")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.oversized(table(spark, folder, "sections"))


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.pieces(table(spark, folder, "sections").select("section_key", "content", "layout_text"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.with_ids(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "feeds"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(table(spark, folder, "documents"), table(spark, folder, "feeds"))


def p8_corpus_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of a mixture of as many tokens as the sources have."""
    return mixture.shares(table(spark, folder, "documents"), table(spark, folder, "feeds"), total="corpus")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, folder, "documents"))


def p9_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_clean, p3_found, p3_text, p4_found, p4_text, p5_found, p5_lines, p6_found, p6_pieces, p7_ids, p8_mixture, p8_shares, p8_corpus_shares, p9_found, p9_sentences)}
