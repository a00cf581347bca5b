"""Readers of corpora, caches and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.keys import narrator, record_number, record_url
from attestor.functions.text import extract_body, normalize_ar, normalize_en
from attestor.operators.select import first_of

VERSES = "_index INT, aya ARRAY<STRUCT<_index INT, _text STRING, _bismillah STRING>>"
SECTIONS = "MAP<STRING, STRING>"
NARRATIONS_A = (
    f"metadata STRUCT<sections {SECTIONS}, section {SECTIONS}>, hadiths ARRAY<STRUCT<hadithnumber DOUBLE, arabicnumber DOUBLE, text STRING, "
    "reference STRUCT<book STRING>, grades ARRAY<STRUCT<name STRING, grade STRING>>>>"
)
NARRATIONS_B = (
    "chapters ARRAY<STRUCT<id STRING, arabic STRING>>, hadiths ARRAY<STRUCT<id STRING, idInBook STRING, chapterId STRING, arabic STRING, "
    "english STRUCT<narrator STRING, text STRING>>>"
)
RECORD = "text STRING, rawi STRING, mohdith STRING, book STRING, number_or_page STRING, grade STRING, takhrij STRING, hadith_id STRING, has_alternate BOOLEAN, has_similar BOOLEAN"
FIELDS = RECORD.replace(" STRING", ": STRING").replace(" BOOLEAN", ": BOOLEAN")
CACHE = f"key STRING, endpoint STRING, response ARRAY<STRUCT<{FIELDS}, grade_class: STRING, url: STRING, text_norm: STRING>>, fetched_at STRING"


def verses_xml(spark: SparkSession, path: str) -> DataFrame:
    """chapter, verse, text, opening (kept apart from the text)."""
    rows = spark.read.format("xml").option("rowTag", "sura").option("attributePrefix", "_").schema(VERSES).load(path)
    return rows.select(F.col("_index").alias("chapter"), F.explode("aya").alias("a")).select("chapter", F.col("a._index").alias("verse"), F.col("a._text").alias("text"), F.col("a._bismillah").alias("opening"))


def chapter_names_xml(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "sura").option("attributePrefix", "_").schema("_index INT, _name STRING, _tname STRING").load(path)
    return rows.select(F.col("_index").alias("chapter"), F.col("_name").alias("name_ar"), F.col("_tname").alias("name_en"))


def verses_text(spark: SparkSession, path: str) -> DataFrame:
    """chapter|verse|text lines; blank lines and # comments are skipped, bars in the text stay."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    p = F.split("value", r"\|", 3)
    return lines.select(F.get(p, 0).cast("int").alias("chapter"), F.get(p, 1).cast("int").alias("verse"), F.get(p, 2).alias("text"))


def passages(clean: DataFrame, marked: DataFrame, names: DataFrame, translation: DataFrame) -> DataFrame:
    """The verse table: both spellings and the names must be there, translation and opening may be missing. Ids count
    from 1 in order of chapter and verse, from the chapters' sizes, without one task sorting all."""
    from pyspark.sql import Window

    key = ["chapter", "verse"]
    sizes = clean.groupBy("chapter").agg(F.count(F.lit(1)).alias("size"))
    base = sizes.select("chapter", F.coalesce(F.sum("size").over(Window.orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy("chapter").orderBy("verse"))
    return (
        marked.select(*key, F.col("text").alias("text_marked"), "opening")
        .join(clean.select(*key, F.col("text").alias("text_clean")), key).join(F.broadcast(names), "chapter")
        .join(translation.select(*key, F.col("text").alias("text_en")), key, "left").join(base, "chapter")
        .withColumn("id", (F.col("base") + at).cast("int")).drop("base")
        .withColumn("text_norm", normalize_ar(F.col("text_clean"), honorifics=False))
    )


def _sections(c: str) -> F.Column:
    return F.coalesce(F.col(f"{c}.sections"), F.col(f"{c}.section"))


def narrations_a(spark: SparkSession, ar_path: str, en_path: str | None, collection: str, url_base: str, included: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(narrations, ratings) of a dataset with one file for each language. Of repeated numbers the last English and the
    first Arabic text count. ``included``: rater of a collection all of whose texts count as rated by inclusion."""
    book = spark.read.option("multiLine", True).schema(NARRATIONS_A).json(ar_path)
    rows = book.select(_sections("metadata").alias("s"), F.posexplode("hadiths").alias("at", "h")).select("s", "at", "h.*").where("trim(coalesce(text, '')) <> ''")
    rows = first_of(rows.withColumn("number", record_number(F.col("arabicnumber"), F.col("hadithnumber"))), ["number"], [F.col("at")])
    if en_path:
        en = spark.read.option("multiLine", True).schema(NARRATIONS_A).json(en_path).select(F.posexplode("hadiths").alias("at", "h"))
        en = first_of(en.select("at", F.col("h.hadithnumber").alias("hadithnumber"), F.col("h.text").alias("text_en")), ["hadithnumber"], [F.desc("at")]).drop("at")
        rows = rows.join(en, "hadithnumber", "left")
    else:
        rows = rows.withColumn("text_en", F.lit(None).cast("string"))
    out = rows.select(
        F.lit(collection).alias("collection"), "number", F.nullif(F.element_at("s", F.col("reference.book")), F.lit("")).alias("book"),
        F.col("text").alias("text_ar"), extract_body(F.col("text")).alias("body_ar"), F.nullif(F.trim("text_en"), F.lit("")).alias("text_en"),
        narrator(F.col("text_en")).alias("narrator"), record_url(url_base, F.lit(collection), F.col("number")).alias("url"), "grades", "at",
    )
    out = out.withColumns({"text_norm": normalize_ar(F.col("text_ar")), "body_norm": normalize_ar(F.col("body_ar")), "text_en_norm": normalize_en(F.col("text_en"))})
    ratings = out.select("collection", "number", F.inline("grades")).select("collection", "number", F.col("name").alias("rater"), F.trim("grade").alias("label"), F.lit("dataset").alias("origin"))
    ratings = ratings.where("coalesce(label, '') not in ('', '-')").withColumn("rater", F.coalesce("rater", F.lit("unknown")))
    if included:
        ratings = ratings.unionByName(out.select("collection", "number", F.lit(included).alias("rater"), F.lit("sahih").alias("label"), F.lit("collection_inclusion").alias("origin")))
    return out.drop("grades", "at"), ratings


def narrations_b(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Narrations of a dataset with both languages in one file."""
    book = spark.read.option("multiLine", True).schema(NARRATIONS_B).json(path)
    names = F.map_from_entries(F.transform("chapters", lambda c: F.struct(c["id"], c["arabic"])))
    rows = book.select(names.alias("names"), F.posexplode("hadiths").alias("at", "h")).select("names", "at", "h.*").where("trim(coalesce(arabic, '')) <> ''")
    rows = first_of(rows, ["idInBook"], [F.col("at")])
    out = rows.select(
        F.lit(collection).alias("collection"), F.col("idInBook").alias("number"), F.nullif(F.element_at("names", F.col("chapterId")), F.lit("")).alias("book"),
        F.col("arabic").alias("text_ar"), extract_body(F.col("arabic")).alias("body_ar"), F.nullif(F.trim("english.text"), F.lit("")).alias("text_en"),
        F.nullif(F.trim("english.narrator"), F.lit("")).alias("narrator"),
    )
    return out.withColumns({"text_norm": normalize_ar(F.col("text_ar")), "body_norm": normalize_ar(F.col("body_ar")), "text_en_norm": normalize_en(F.col("text_en"))})


def cache_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE).json(path)


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """query and review status (needs_review where there is none) of tab-separated lines; # comments are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    p = F.split("value", "\t", 2)
    return lines.select(F.trim(F.get(p, 0)).alias("query"), F.coalesce(F.nullif(F.trim(F.get(p, 1)), F.lit("")), F.lit("needs_review")).alias("review_status"))


ITEM = (
    "id STRING, category STRING, variant STRING, input STRING, lang STRING, expected_type STRING, expected_status STRING, expected_match STRING, expected_source_id STRING, "
    "expected_source_ids ARRAY<STRING>, status_basis STRING, label_basis STRING, review_status STRING"
)
PREDICTION = (
    "id STRING, category STRING, variant STRING, expected_status STRING, expected_match STRING, expected_source_ids ARRAY<STRING>, extracted BOOLEAN, n_claims INT, ms BIGINT, "
    "status STRING, match_type STRING, claim_type STRING, score INT, pred_source STRING, top1 BOOLEAN, top5 BOOLEAN, summary STRING"
)
TOP = f"STRUCT<{FIELDS}, grade_class: STRING, url: STRING>"
SEED_REPORT = f"query STRING, review_status STRING, n_results INT, top {TOP}, top_similarity DOUBLE, alternate {TOP}, error STRING"


def test_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items, one JSON object a line."""
    return spark.read.schema(ITEM).json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def seed_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEED_REPORT).json(path)


def results_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def by_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of these ids; ids that are missing give none."""
    return table.join(ids, key)


def id_range(table: DataFrame, first: int, last: int, key: str = "id") -> DataFrame:
    return table.where(F.col(key).between(first, last)).orderBy(key)


def index_rows(narrations: DataFrame, kind: str, collections: list[str] | None = None) -> DataFrame:
    """id and text of what a vector index of this kind holds; blank texts are left out."""
    text = F.col("text_en") if kind.endswith("_en") else F.coalesce("body_norm", "text_norm")
    rows = narrations if collections is None else narrations.where(F.col("collection").isin(*collections))
    return rows.select(F.concat_ws(":", "collection", "number").alias("doc_id"), text.alias("text")).where("trim(coalesce(text, '')) <> ''")
