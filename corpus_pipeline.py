"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokens; each stage is written and reread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm import decontam, langid, linededup, pieces, simhash
from attestor.llm.common import bounded_batches, read_table, write_table

#: Share of its characters that a text may lose to line dedup: all, so repeated chunks go from every text.
MOST_REMOVED = 1.0

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null, empty and letterless texts. Profiles come from the docs given."""
    bounded_batches(spark)
    named = langid.predict(docs, langid.learn(docs))
    return named.where("lang_pred <> 'und'").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated chunks of lines, those of copies too; n_chars follows the text, and documents of which nothing is left go."""
    out = linededup.dedup_lines(docs, most_removed=MOST_REMOVED, count_copies=True).where("lines_removed = 0 or trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def _whole(docs: DataFrame, key: list[Column]) -> DataFrame:
    """Key columns and ``doc``, the whole row: no name of the documents can clash with those of the key."""
    return docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts whose five-word shingles are similar by 0.8 or more, as their wide
    fingerprints tell: that with the least doc_id, nulls last. Different texts that share a doc_id,
    or have none, are different documents; of rows with the same text and doc_id one stays.

    What goes is settled on hashes. The texts then move once: the choice among repeated rows and the join with what goes
    have the same keys. What goes grows with the documents, so it is merged at every size and not broadcast."""
    bounded_batches(spark)
    gone = simhash.repeated_keys(docs)
    ties = [F.col(f"doc.`{c}`") for c, kind in docs.dtypes if c != "text" and "map<" not in kind and kind != "variant"]
    one = F.row_number().over(Window.partitionBy(*simhash.KEY).orderBy(F.xxhash64(*ties)))
    rows = _whole(docs, simhash.row_key()).withColumn("one", one).where("one = 1")
    return rows.join(gone.hint("merge"), simhash.KEY, "left_anti").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Texts are told apart by two hashes, not by doc_id."""
    bounded_batches(spark)
    key = simhash.row_key()[:2]
    hit = decontam.contamination(docs.select(F.struct(*key).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    gone = write_table(hit.where("contaminated").select("doc_id.*").distinct(), "contaminated")
    return _whole(docs, key).join(gone, simhash.KEY[:2], "left_anti").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the number and digest of their token ids and the digest of the decoded text."""
    bounded_batches(spark)
    fields = [x for x in docs.columns if x not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return pieces.with_digests(docs.select(fields))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
