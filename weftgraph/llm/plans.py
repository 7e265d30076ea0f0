"""Queries p1-p3 and p6-p8 over the text and source tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.llm import credentials, leaks, mixing, oracle, origin, parsing, spans
from weftgraph.session import table


def _contents(spark, sf_dir):
    return table(spark, sf_dir, "file_content").select("id", "content")


def p1_origins(spark, sf_dir):
    return origin.origins(table(spark, sf_dir, "files").select("id", "ext", "size", "loc", "last_seen"), _contents(spark, sf_dir))


def p1_found(spark, sf_dir):
    return p1_origins(spark, sf_dir).where(~F.col("kind").isin("hand", "own")).select("id")


def p2_files(spark, sf_dir):
    return parsing.unparsed(_contents(spark, sf_dir))


def p2_found(spark, sf_dir):
    return p2_files(spark, sf_dir).where(~F.col("ok")).select("id").distinct()


def p2_rates(spark, sf_dir):
    """Judged and invalid files of each repository and language, with the repository's main language where it is listed."""
    listed = table(spark, sf_dir, "corpus_manifest").groupBy(F.col("name").alias("repository")).agg(F.lower(F.min("lang")).alias("main_lang"))
    return (
        p2_files(spark, sf_dir)
        .groupBy(F.substring_index("id", "/", 1).alias("repository"), "lang")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum((~F.col("ok")).cast("long")).alias("n_invalid"))
        .join(F.broadcast(listed), "repository", "left")
        .select("repository", "lang", "main_lang", "n_files", "n_invalid", F.round(F.col("n_invalid") / F.col("n_files"), 6).alias("rate"))
    )


def p3_found(spark, sf_dir):
    return credentials.credentials(_contents(spark, sf_dir)).select("id", "line").distinct()


def p3_credentials(spark, sf_dir):
    return credentials.credentials(_contents(spark, sf_dir))


def p3_redacted(spark, sf_dir):
    return credentials.redacted(_contents(spark, sf_dir))


#: An alignment counts as an edited copy from this share of a perfect copy's score.
IDENTITY = 0.5


def _leaks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.leaks(docs, table(spark, sf_dir, "eval_items").select("item_id", "text"))


def p6_found(spark, sf_dir):
    return _leaks(spark, sf_dir).where(F.col("run") >= leaks.RUN).select("item_id", "doc_id")


def p6_alignments(spark, sf_dir):
    """Copies and edited copies with their scores."""
    found = _leaks(spark, sf_dir).where((F.col("run") >= leaks.RUN) | (F.col("identity") >= IDENTITY))
    return found.select("item_id", "doc_id", "run", "score", F.round("identity", 6).alias("identity"))


def p6_leaked_items(spark, sf_dir):
    """For each item that leaked, in how many documents and how much of it at most."""
    got = p6_alignments(spark, sf_dir)
    return got.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("run").alias("longest_run"), F.max("identity").alias("best_identity"))


def _mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.Mix(docs, table(spark, sf_dir, "mix_targets"))


def p7_found(spark, sf_dir):
    return _mix(spark, sf_dir).report().where(~F.col("reachable")).select("source")


def p7_shares(spark, sf_dir):
    """The shares of tokens that the chosen documents reach, beside the targets."""
    got = _mix(spark, sf_dir).reached()
    return got.withColumn("share", F.round("share", 6)).withColumn("passes", F.round("passes", 6))


def p7_selection(spark, sf_dir):
    return _mix(spark, sf_dir).documents()


def p8_found(spark, sf_dir):
    return spans.shared_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_coverage(spark, sf_dir):
    return spans.shared_coverage(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_unitigs(spark, sf_dir):
    return spans.unitigs(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_origins, p2_found, p2_files, p2_rates, p3_found, p3_credentials, p3_redacted, p6_found, p6_alignments, p6_leaked_items, p7_found, p7_shares, p7_selection, p8_found, p8_coverage, p8_unitigs)}

SQL = oracle.SQL
