"""Entry points: verify, prepare, lookup, health, evaluate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.config import Settings
from attestor.functions import text
from attestor.functions.keys import passage_ref
from attestor.operators import claims, metrics
from attestor.operators import prepare as prep
from attestor.plans.verify import Corpus
from attestor.plans.verify import verify as _verify


def verify(posts: DataFrame, corpus: Corpus, settings: Settings = Settings(), **kw) -> tuple[DataFrame, DataFrame]:
    """(results, rejected): rejected posts carry a reason (empty_input, text_too_long, bad_base64, ...); none is cut. What
    else verify() of the plan takes (extractor, dense, scorer) can be given by name."""
    valid, rejected = claims.validate(posts, settings)
    return _verify(valid, corpus, settings, **kw), rejected


def _verse_originals(results: DataFrame, corpus: Corpus, out: str) -> DataFrame:
    """post_id, idx and what stands for a claim found among the verses: each verse with its number, from the marked
    spelling if there is one; the translation where all verses have one; name, reference and address."""
    v = corpus.verse_texts()
    have = lambda c: F.col(c) if c in v.columns else F.lit(None).cast("string")
    name = F.coalesce(have("name_ar" if out == "ar" else "name_en"), F.lit(""))
    v = v.select("part", "id", "ref_chapter" if "ref_chapter" in v.columns else F.lit(0).alias("ref_chapter"), "ref_verse" if "ref_verse" in v.columns else F.col("id").alias("ref_verse"),
                 F.coalesce("text_marked", "text").alias("t"), F.col("text_en").alias("en"), name.alias("name"), have("url").alias("url"))
    asked = results.where("start_id is not null").select("post_id", "idx", "part", F.explode(F.sequence("start_id", "end_id")).alias("id"))
    rows = F.array_sort(F.collect_list(F.struct("id", "ref_chapter", "ref_verse", "t", "en", "name", "url")))
    by = asked.join(v, ["part", "id"]).groupBy("post_id", "idx").agg(rows.alias("r"))
    first, last = F.get("r", 0), F.element_at("r", -1)
    translated = F.forall("r", lambda x: x["en"].isNotNull())
    ref = passage_ref(first["ref_chapter"], first["ref_verse"], last["ref_chapter"], last["ref_verse"])
    head = F.concat_ws(" ", F.lit(f"{prep.WORDING[out]['verses']} —"), F.nullif(first["name"], F.lit("")), ref)
    texts, en = F.transform("r", lambda x: x["t"]), F.transform("r", lambda x: x["en"])
    return by.select(
        "post_id", "idx", F.array_join(texts, " ").alias("v_original"),
        prep.quoted(F.array_join(F.transform("r", lambda x: F.concat(x["t"], F.lit(" ("), x["ref_verse"].cast("string"), F.lit(")"))), " "), F.lit(True)).alias("v_inline"),
        F.when(translated, F.array_join(en, " ")).alias("v_translation"), prep.source_line(head, F.lit(None).cast("array<struct<rater: string, label: string>>"), first["url"], out).alias("v_source"),
        (F.when(translated, F.concat(texts, en)).otherwise(texts) if out == "en" else texts).alias("v_segments"),
    )


def prepare(posts: DataFrame, results: DataFrame, corpus: Corpus, out: str = "ar") -> DataFrame:
    """Posts rewritten with verbatim originals, validated against the corpus: verses, narrations (an excerpt where the
    claim is a part of one), provider's texts, or an alternative where nothing that may be kept was found."""
    out = "en" if out == "en" else "ar"
    n = corpus.narrations
    body = F.col("body_ar") if "body_ar" in n.columns else F.lit(None).cast("string")
    n = n.select("doc_id", F.coalesce(body, F.col("text_ar")).alias("n_text"), F.col("text_ar").alias("n_full"), F.concat_ws(" ", "collection", "number").alias("n_name"), F.col("text_en").alias("n_en"), F.col("url").alias("n_url"), "body_norm", "text_norm")
    c = results.withColumnRenamed("claim_text", "text").join(n, "doc_id", "left")
    words = text.tokens(F.when(F.col("reference") == "body", F.col("body_norm")).when(F.col("reference") == "full", F.col("text_norm")))
    part = F.when((F.col("match_type") == "partial") & words.isNotNull(), F.slice(words, F.col("ref_start") + 1, F.greatest(F.col("ref_end") - F.col("ref_start"), F.lit(0))))
    c = c.withColumn("n_text", F.coalesce(text.excerpt(F.col("n_text"), part), text.excerpt(F.col("n_full"), part), F.col("n_text")))
    named = {"rater", "label"} <= set(corpus.ratings.columns)
    if named:
        by = corpus.ratings.join(results.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("rater", "label"))).alias("n_ratings"))
        c = c.join(by, "doc_id", "left")
    else:
        c = c.withColumn("n_ratings", F.lit(None).cast("array<struct<rater: string, label: string>>"))
    if corpus.verses is not None:
        c = c.join(_verse_originals(results, corpus, out), ["post_id", "idx"], "left")
    else:
        c = c.withColumns({"v_original": F.lit(None).cast("string"), "v_inline": F.lit(None).cast("string"), "v_translation": F.lit(None).cast("string"), "v_source": F.lit(None).cast("string"), "v_segments": F.lit(None).cast("array<string>")})
    instead = F.get("alternatives", 0)
    verse, provided = F.col("v_original").isNotNull(), F.col("provider_text").isNotNull()
    source = verse | provided | F.col("doc_id").isNotNull()
    c = c.withColumn("action", prep.decide(F.col("match_type"), F.col("grade_class"), source, F.coalesce(F.size("alternatives"), F.lit(0))))
    kept = lambda v, p, d, alt: F.when(F.col("action") == "replace", alt).when(F.col("action") == "keep", F.when(verse, v).when(provided, p).otherwise(d))
    none = F.lit(None).cast("string")
    c = c.withColumns({
        "original": kept(F.col("v_original"), F.col("provider_text"), F.col("n_text"), instead["text"]), "inline": kept(F.col("v_inline"), none, none, none),
        "source": kept(F.col("v_source"), F.col("provider_source"), prep.source_line(F.col("n_name"), F.col("n_ratings"), F.col("n_url"), out), F.coalesce(instead["source"], F.lit(""))),
        "translation": kept(F.col("v_translation"), none, F.col("n_en"), none), "segments": kept(F.col("v_segments"), F.lit(None), F.lit(None), F.lit(None)),
    })
    tables = [(corpus.narrations, ["text_ar", "text_en"]), (corpus.alternates, ["text"]), (corpus.verse_texts() if corpus.verses is not None else None, ["text", "text_marked", "text_en"])]
    sources = [df.select(F.col(x).alias("text")) for df, columns in tables if df is not None for x in columns]
    if corpus.cache is not None:
        sources.append(corpus.cache.select(F.explode("response.text").alias("text")))
    return prep.validate(prep.prepare(posts, c, out), reduce(DataFrame.unionByName, sources))


def search(queries: DataFrame, corpus: Corpus, k: int = 5, kind: str = "narration", settings: Settings = Settings(), **kw) -> DataFrame:
    """query_id, doc_id, rank, confidence, rerank of texts (query_id, text), and weak where nothing certain was found."""
    from attestor.operators.fusion import weak
    from attestor.plans.verify import candidates

    lang = text.detect_lang(F.col("text"))
    asked = queries.select(F.col("query_id").alias("claim_id"), "text", lang.alias("lang"), text.normalize(F.col("text"), lang).alias("norm"), text.normalize(F.col("text"), lang, honorifics=False).alias("verse_norm"))
    found = candidates(asked, corpus, k, settings, kw.get("dense"), kind, kw.get("scorer")).withColumnRenamed("claim_id", "query_id")
    return found.join(weak(found, queries, settings.low_confidence), "query_id")


def lookup(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the ids asked for; ``found`` is false for those that aren't there."""
    return ids.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """name and rows of each table."""
    counts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def evaluate(predictions: DataFrame) -> dict[str, DataFrame]:
    return {
        "overall": metrics.rates(predictions), "per_category": metrics.rates(predictions, ["category"]),
        "confusion": metrics.confusion(predictions), "latency": metrics.latency(predictions),
    }
