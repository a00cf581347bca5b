"""The verification plan: posts -> claims -> matches -> ratings -> score -> alternatives, in one plan for all claims."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.config import Settings
from attestor.functions import labels, text
from attestor.operators import alternatives as alt
from attestor.operators import claims as cl
from attestor.operators import fusion, lexical, score, stream_match
from attestor.operators.align import RANK, classify, rank_of
from attestor.operators.dense import dense_topk
from attestor.operators.select import best_class, distinct_ratings, first_of, primary_over_secondary
from attestor.operators.staging import staged


@dataclass
class Corpus:
    """Tables to verify against.

    narrations: doc_id, collection, number, text_ar, text_norm, body_norm, text_en, text_en_norm, url.
    ratings: doc_id, grade_class, origin, and rater and label if they are to be named. verses: part, id, ref_chapter,
    ref_verse, text, text_norm (may be missing), and if there are such text_marked and marked_norm (a second spelling and
    its normalised form), text_en and en_norm (a translation). cache: key, response (array of provider records with
    text_norm). alternates: record_id, text, grade_class. vectors, verse_vectors: doc_id (of verses: id), vec.

    Each lexical index is built when it is first asked for, stored, and used by all calls with the same corpus."""

    narrations: DataFrame
    ratings: DataFrame
    verses: DataFrame | None = None
    cache: DataFrame | None = None
    alternates: DataFrame | None = None
    secondary: tuple[str, ...] = ()
    index: dict[str, lexical.LexicalIndex] = field(default_factory=dict)
    vectors: DataFrame | None = None
    verse_vectors: DataFrame | None = None

    def verse_texts(self) -> DataFrame:
        """The verses with all spellings: missing normalised forms are made, missing texts are null."""
        v = self.verses
        have = lambda c: F.col(c) if c in v.columns else F.lit(None).cast("string")
        marked = have("marked_norm") if "marked_norm" in v.columns else text.normalize_ar(have("text_marked"), honorifics=False)
        en = have("en_norm") if "en_norm" in v.columns else text.normalize_en(have("text_en"))
        return v.withColumns({"text_marked": have("text_marked"), "marked_norm": marked, "text_en": have("text_en"), "en_norm": en})

    def lexical(self, kind: str, lang: str) -> lexical.LexicalIndex:
        """Index of ``narration`` or ``verse`` texts in a language."""
        name = f"{kind}-{lang}"
        if name not in self.index:
            table, key = (self.narrations, "doc_id") if kind == "narration" else (self.verse_texts(), "id")
            column = {"narration-ar": "text_norm", "narration-en": "text_en_norm", "verse-ar": "text_norm", "verse-en": "en_norm"}[name]
            self.index[name] = lexical.LexicalIndex.stored(table.where(F.col(column) != ""), key, text.tokens(F.col(column)))
        return self.index[name]


#: Scores pairs (queries, texts) with logits; see fusion.rerank().
Scorer = Callable[[list[str], list[str]], list[float]]


def normal_claims(claims: DataFrame) -> DataFrame:
    """claim_id and the normalised claim, with honorifics (for verses) and without (for narrations)."""
    key = F.xxhash64(F.col("post_id").cast("string"), "idx")
    return claims.withColumn("claim_id", key).withColumns(
        {"norm": text.normalize(F.col("text"), F.col("lang")), "verse_norm": text.normalize(F.col("text"), F.col("lang"), honorifics=False)}
    )


def exact_verses(claims: DataFrame, corpus: Corpus) -> DataFrame:
    """claim_id and the exact place of Arabic claims in the verse stream: in the plain spelling, else in the marked one.
    Claims that aren't said to be verses must have three words at least."""
    asked = claims.where("lang = 'ar'").select("claim_id", "claim_type", text.tokens(F.col("verse_norm")).alias("words"))
    asked = staged(asked.where("size(words) >= if(claim_type = 'quran', 1, 3)").drop("claim_type"), "verse-claims")
    verses, found = corpus.verse_texts(), None
    for spelling in ("text_norm", "marked_norm"):
        if spelling == "marked_norm" and not {"text_marked", "marked_norm"} & set(corpus.verses.columns):
            continue
        words = staged(stream_match.token_stream(verses.where(F.col(spelling) != ""), "part", "id", text.tokens(F.col(spelling))), "verse-words")
        got = staged(stream_match.pick_occurrence(stream_match.exact_matches(asked, words)), "verse-places")
        found = got if found is None else found.unionByName(got.join(found.select("claim_id"), "claim_id", "left_anti"))
    return found.select("claim_id", "part", "start_id", "end_id", F.when(F.col("whole"), "identical").otherwise("partial").alias("match_type"), "others", F.lit(1.0).alias("confidence"), F.array().cast(DIFF).alias("diff"))


DIFF = "array<struct<op: string, text: string, source: string>>"


def fuzzy_verses(claims: DataFrame, corpus: Corpus, s: Settings, dense: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Best stretch of verses for claims that are said to be verses and stand nowhere word for word, as exact_verses().

    Each of the first candidates grows to a window of verses in both spellings, which is aligned strictly; the verses
    that the aligned words cover are the match. Claims in English are compared with translations of single verses."""
    verses = corpus.verse_texts()
    cands = staged(candidates(claims, corpus, s.keep_top, s, dense, "verse", scorer).withColumnRenamed("doc_id", "id"), "verse-candidates")
    asked = cands.join(claims.select("claim_id", "lang", F.col("verse_norm").alias("claim")), "claim_id").join(verses.select("id", "part"), "id")
    ar = asked.where("lang = 'ar'").withColumn("n_words", F.size(text.tokens(F.col("claim"))))
    grown = staged(stream_match.windows(ar, verses, "part", "id", "text_norm", also={"marked": "marked_norm"}), "verse-windows")
    both = F.array(
        F.struct(F.lit("clean").alias("reference"), F.col("window_text").alias("ref_text"), F.col("rows").alias("rows")),
        F.struct(F.lit("marked").alias("reference"), F.col("window_marked").alias("ref_text"), F.col("rows_marked").alias("rows")),
    )
    pairs = ar.join(grown.select("claim_id", "part", "id", F.inline(both)), ["claim_id", "part", "id"])
    en = asked.where("lang = 'en'").join(verses.select("id", "en_norm"), "id").withColumn("rows", F.array(F.struct(F.col("id").cast("long").alias("id"), F.size(text.tokens(F.col("en_norm"))).alias("n"))))
    fields = ["claim_id", "part", "id", "lang", "claim", "reference", "ref_text", "rerank", "rows"]
    pairs = pairs.select(*fields).unionByName(en.withColumns({"reference": F.lit("en"), "ref_text": F.col("en_norm")}).select(*fields))
    pairs = staged(pairs.where("coalesce(ref_text, '') <> ''"), "verse-pairs")
    keys = ["claim_id", "part", "id"]
    got = classify(pairs.drop("rows"), keys, s, strict=True, cross_lang=F.col("lang") == "en")
    got = got.join(pairs.select(*keys, "reference", "rows"), [*keys, "reference"]).join(cands.select("claim_id", "id", "rank", "confidence"), ["claim_id", "id"])
    worded = F.col("match_type").isin("identical", "partial", "altered") | F.col("translation_quote")
    got = got.where("match_type <> 'not_found'").withColumn("confidence", F.when(worded, F.greatest("confidence", "span_sim")).otherwise(F.col("confidence")))
    span = stream_match.shrink(F.col("rows"), F.col("start"), F.col("end"))
    got = got.withColumn("span", F.when(F.col("reference") == "en", F.struct(F.col("id").cast("long").alias("start_id"), F.col("id").cast("long").alias("end_id"))).otherwise(span))
    best = stream_match.best_match(got, ["claim_id"])
    none = F.array().cast("array<struct<part: string, start_id: bigint, end_id: bigint>>")
    return best.select("claim_id", "part", F.coalesce("span.start_id", "id").alias("start_id"), F.coalesce("span.end_id", "id").alias("end_id"), "match_type", none.alias("others"), "confidence", "diff")


def match_verses(claims: DataFrame, corpus: Corpus, s: Settings, dense: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """claim_id, part, start_id, end_id, match_type, n_others, confidence, diff of the claims found among the verses."""
    exact = staged(exact_verses(claims, corpus), "exact-verses")
    rest = staged(claims.where("claim_type = 'quran'").join(exact.select("claim_id"), "claim_id", "left_anti"), "verse-rest")
    fuzzy = fuzzy_verses(rest, corpus, s, dense, scorer)
    fields = ["claim_id", "part", F.col("start_id").cast("long").alias("start_id"), F.col("end_id").cast("long").alias("end_id"), "match_type", F.size("others").alias("n_others"), "confidence", "diff"]
    return staged(exact.select(*fields).unionByName(fuzzy.select(*fields)), "verses")


def candidates(claims: DataFrame, corpus: Corpus, k: int, s: Settings, dense: DataFrame | None = None, kind: str = "narration", scorer: Scorer | None = None) -> DataFrame:
    """claim_id, doc_id, rank, confidence, rerank: lexical candidates of each claim's language, fused with dense ones if
    there are vectors, and the first of them put in order by the scorer if there is one."""
    lists, norm = {}, "norm" if kind == "narration" else "verse_norm"
    for lang in ("ar", "en"):
        if kind == "verse" and lang == "en" and not {"text_en", "en_norm"} & set(corpus.verses.columns):
            continue
        mine = claims.where(F.col("lang") == lang)
        lists[f"bm25_{lang}"] = lexical.bm25(corpus.lexical(kind, lang), mine, "claim_id", text.tokens(F.col(norm)), s.lexical_k, most_terms=s.query_terms)
    vectors = corpus.vectors if kind == "narration" else corpus.verse_vectors
    if dense is not None and vectors is not None:
        own = dense.withColumnRenamed("claim_id", "query_id") if "claim_id" in dense.columns else dense
        lists["dense"] = dense_topk(own.join(claims.select(F.col("claim_id").alias("query_id")), "query_id", "left_semi"), vectors, s.dense_k)
    fused = fusion.rrf_fuse(lists, s.rrf_k, s.fuse_top).withColumn("rerank", F.lit(None).cast("double"))
    if scorer is not None:
        table, key = (corpus.narrations, "doc_id") if kind == "narration" else (corpus.verse_texts(), "id")
        ar = F.coalesce(F.nullif(F.col("body_norm"), F.lit("")), F.col("text_ar")) if kind == "narration" else F.col("text")
        texts = table.select(F.col(key).alias("doc_id"), text.strip_marks(ar).alias("t_ar"), F.col("text_en").alias("t_en")) if kind == "narration" else table.select(F.col(key).alias("doc_id"), ar.alias("t_ar"), F.col("text_en").alias("t_en"))
        asked = claims.select(F.col("claim_id").alias("query_id"), "lang", text.strip_marks(F.col("text")).alias("q"))
        pairs = fused.drop("rerank").join(asked, "query_id").join(texts, "doc_id").withColumn("d", F.when((F.col("lang") == "en") & (F.coalesce("t_en", F.lit("")) != ""), F.col("t_en")).otherwise(F.col("t_ar")))
        fused = fusion.rerank(pairs, "q", "d", scorer, s.rerank_top, None)
    fused = fused.where(F.col("rank") <= k)
    return fused.select(F.col("query_id").alias("claim_id"), "doc_id", "rank", fusion.confidence(F.col("rerank"), F.col("rrf"), s.rrf_k).alias("confidence"), "rerank")


def match_narrations(claims: DataFrame, cands: DataFrame, corpus: Corpus, s: Settings) -> DataFrame:
    """Best narration of each claim; English claims are matched with translations, at best as a paraphrase."""
    refs = F.array(
        *(F.struct(F.lit(n).alias("reference"), F.col(c).alias("ref_text"), F.lit(x).alias("l")) for n, c, x in (("body", "body_norm", "ar"), ("full", "text_norm", "ar"), ("en", "text_en_norm", "en")))
    )
    pairs = (
        cands.drop("confidence").join(claims.select("claim_id", F.col("norm").alias("claim"), "lang"), "claim_id")
        .join(corpus.narrations.select("doc_id", "collection", "body_norm", "text_norm", "text_en_norm"), "doc_id")
        .select("claim_id", "doc_id", "claim", "lang", "rerank", F.inline(refs)).where("l = lang and coalesce(ref_text, '') <> ''")
    )
    got = classify(pairs, ["claim_id", "doc_id"], s, cross_lang=F.col("lang") == "en", overlap=s.same_overlap)
    got = got.join(cands.select("claim_id", "doc_id", "rank"), ["claim_id", "doc_id"]).join(corpus.narrations.select("doc_id", "collection"), "doc_id")
    worded = F.col("match_type").isin("identical", "partial", "altered") | F.col("translation_quote")
    got = got.withColumn("confidence", F.when(F.col("rerank").isNotNull(), F.greatest("rerank", F.when(worded, F.col("span_sim")).otherwise(0.0))).otherwise(F.when(worded, F.col("span_sim")).otherwise(0.0)))
    return primary_over_secondary(got, ["claim_id"], F.col("collection").isin(*corpus.secondary) if corpus.secondary else F.lit(False))


def match_provider(claims: DataFrame, corpus: Corpus, s: Settings) -> DataFrame:
    """All provider hits of a claim's best class, best first, through the cache's key of the claim."""
    from attestor.functions.keys import search_key

    keyed = claims.where("lang = 'ar'").select("claim_id", F.col("norm").alias("claim"), search_key(F.col("text")).alias("key"))
    hits = keyed.join(corpus.cache.select("key", "response"), "key").select("claim_id", "claim", F.posexplode("response").alias("rank", "r"))
    pairs = hits.select("claim_id", "rank", "claim", F.lit("provider").alias("reference"), F.coalesce("r.text_norm", text.normalize_ar(F.col("r.text"))).alias("ref_text"), F.lit(None).cast("double").alias("rerank"))
    got = classify(pairs, ["claim_id", "rank"], s, overlap=s.same_overlap).join(hits.select("claim_id", "rank", "r.*"), ["claim_id", "rank"])
    return best_class(got, ["claim_id"])


def claims_table(posts: DataFrame, extractor: Callable[[str], list[dict]] = cl.claims_of) -> DataFrame:
    """The claims of whole posts (post_id, text) with their ids, as verify() takes them: the ids are what the vectors
    that are given to it as ``dense`` (claim_id, vec) go by."""
    whole = posts.select("post_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    return normal_claims(cl.extract(whole, extractor=extractor)[0])


def verify(posts: DataFrame, corpus: Corpus, s: Settings = Settings(), extractor: Callable[[str], list[dict]] = cl.claims_of, dense: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """One row for each claim of posts (post_id, text): claim, match, source, grade, score, status, reasons, alternatives.

    Whole posts are read, however long (the entry point of the API rejects those over its limit with a reason). Cheap
    steps come first: claims that the verse stream holds word for word leave before retrieval, and the wider retrieval,
    with vectors and the scorer if there are any, serves only claims that the first 8 candidates don't settle. Without a
    scorer no claim is a paraphrase by meaning alone, which the notes of claims not found say."""
    claims = staged(claims_table(posts, extractor), "claims")
    verse = match_verses(claims, corpus, s, dense, scorer) if corpus.verses is not None else None
    open_claims = claims if verse is None else claims.join(verse.select("claim_id"), "claim_id", "left_anti")
    open_claims = staged(open_claims.where("claim_type <> 'quran'"), "open-claims")
    # What several later steps read is a table, which keeps the plan short.
    first = staged(match_narrations(open_claims, staged(candidates(open_claims, corpus, 8, s), "candidates"), corpus, s), "matches")
    done = first.where(F.col("match_type").isin("identical", "partial") | F.col("translation_quote"))
    rest = open_claims.join(done.select("claim_id"), "claim_id", "left_anti")
    rest = staged(rest, "rest")
    cands = staged(candidates(rest, corpus, s.rerank_top, s, dense, scorer=scorer), "wide-candidates")
    second = staged(match_narrations(rest, cands.where(F.col("rank") <= s.keep_top), corpus, s), "wide-matches")
    both = first.withColumn("pass", F.lit(0)).unionByName(second.withColumn("pass", F.lit(1)))
    local = first_of(both, ["claim_id"], [F.desc(rank_of(F.col("match_type"))), F.desc(F.bround("coverage", 2)), F.desc(F.bround("span_sim", 3)), F.desc("confidence"), F.col("pass")])
    good = F.col("match_type").isin("identical", "partial") | ((F.col("match_type") != "not_found") & (F.col("confidence") >= s.low_confidence))
    local = staged(local.where(good).select("claim_id", "doc_id", "match_type", "confidence", "diff", "translation_quote", "reference", "start", "end"), "local")
    grades = score.aggregate_grade(local.join(corpus.ratings, "doc_id"), ["claim_id"], included=F.col("origin") == "collection_inclusion")
    out = claims.join(local, "claim_id", "left").join(grades, "claim_id", "left").withColumn("grade_class", F.coalesce("grade_class", F.lit("unknown")))
    if corpus.cache is not None:
        hits = staged(match_provider(open_claims, corpus, s), "provider")
        rated = hits.select("claim_id", F.col("mohdith").alias("rater"), F.col("grade").alias("label"), F.col("book").alias("work"), "rank")
        rated = distinct_ratings(rated, ["claim_id"], F.col("rank")).withColumn("grade_class", labels.bucket_ar(F.col("label")))
        best = first_of(hits, ["claim_id"], [F.desc(F.bround("coverage", 2)), F.desc("span_sim"), F.col("rank")])
        best = best.join(score.aggregate_grade(rated, ["claim_id"]).withColumnRenamed("grade_class", "p_grade"), "claim_id", "left")
        best = best.select("claim_id", F.col("match_type").alias("p_match"), F.col("span_sim").alias("p_conf"), F.col("diff").alias("p_diff"), "p_grade", F.coalesce("hadith_id", F.lit("")).alias("provider_id"), F.col("text").alias("provider_text"), F.concat_ws(" ", "book", "number_or_page").alias("provider_source"))
        out = out.join(best, "claim_id", "left")
        ask = F.col("match_type").isNull() | ~F.col("match_type").isin("identical", "partial") | (F.col("grade_class") == "unknown")
        better = ask & F.col("p_match").isNotNull() & (F.col("match_type").isNull() | (rank_of(F.col("p_match")) > rank_of(F.col("match_type"))))
        added = ask & F.col("p_match").isNotNull() & ~better & (rank_of(F.col("p_match")) >= rank_of(F.col("match_type"))) & (F.col("grade_class") == "unknown")
        out = out.withColumn("better", F.coalesce(better, F.lit(False))).withColumns({
            "grade_class": F.when(F.col("better") | F.coalesce(added, F.lit(False)), F.coalesce("p_grade", F.lit("unknown"))).otherwise(F.col("grade_class")),
            "confidence": F.when(F.col("better"), F.col("p_conf")).otherwise(F.col("confidence")),
            "diff": F.when(F.col("better"), F.col("p_diff")).otherwise(F.col("diff")),
            "doc_id": F.when(F.col("better"), F.lit(None)).otherwise(F.col("doc_id")),
            **{c: F.when(F.col("better"), F.col(c)) for c in ("provider_id", "provider_text", "provider_source")},
            "match_type": F.when(F.col("better"), F.col("p_match")).otherwise(F.col("match_type")),
        }).drop("better", "p_match", "p_conf", "p_diff", "p_grade")
    else:
        hits = None
        out = out.withColumns({c: F.lit(None).cast("string") for c in ("provider_id", "provider_text", "provider_source")})
    if verse is not None:
        v = verse.select("claim_id", F.col("match_type").alias("v_match"), "part", "start_id", "end_id", F.col("confidence").alias("v_conf"), F.col("diff").alias("v_diff"))
        out = out.join(v, "claim_id", "left")
    else:
        out = out.withColumns({"v_match": F.lit(None).cast("string"), "part": F.lit(None).cast("string"), "start_id": F.lit(None).cast("long"), "end_id": F.lit(None).cast("long"), "v_conf": F.lit(None).cast("double"), "v_diff": F.lit(None).cast(DIFF)})
    is_verse = F.col("v_match").isNotNull()
    kind = F.when(is_verse, "quran").when((F.col("claim_type") == "saying") & F.col("match_type").isNotNull() & (F.col("match_type") != "not_found"), "hadith").otherwise(F.col("claim_type"))
    out = out.withColumns({
        "notes": F.filter(F.array(F.when(is_verse & (F.col("claim_type") != "quran"), "retyped_as_quran"), F.when(~is_verse & (kind == "hadith") & (F.col("claim_type") == "saying"), "retyped_as_hadith"),
            F.when((F.col("v_match") == "paraphrase") & (F.col("lang") == "en"), "matched_translation_meaning"), F.when(F.coalesce("v_match", "match_type", F.lit("not_found")) == "not_found", None if scorer else "searched_without_reranker")), lambda x: x.isNotNull()),
        "claim_type": kind, "match_type": F.coalesce("v_match", "match_type", F.lit("not_found")), "confidence": F.when(is_verse, F.col("v_conf")).otherwise(F.coalesce("confidence", F.lit(0.0))),
        "diff": F.when(is_verse, F.col("v_diff")).otherwise(F.col("diff")),
    })
    out = out.withColumn("s", score.score(F.col("claim_type"), F.col("match_type"), F.col("confidence"), F.col("grade_class"), F.col("claim_type") == "hadith", F.col("lang") == "en", s))
    out = out.select(
        "post_id", "idx", "claim_id", F.col("text").alias("claim_text"), "claim_type", "attributed_to", "lang", "match_type", F.bround("confidence", 3).alias("confidence"),
        "doc_id", "reference", F.col("start").alias("ref_start"), F.col("end").alias("ref_end"), "provider_id", "provider_text", "provider_source", "part", "start_id", "end_id", F.when(F.col("match_type").isin("altered", "partial"), F.col("diff")).alias("diff"), "s.score", "s.status", "s.grade_class", "s.reasons", "notes",
        *(score.summary(F.col("s.status"), F.col("match_type"), F.lit(""), lang).alias(f"summary_{lang}") for lang in ("ar", "en")),
    )
    return _with_alternatives(staged(out, "results"), cands, hits, corpus, s)


def _with_alternatives(out: DataFrame, cands: DataFrame, hits: DataFrame | None, corpus: Corpus, s: Settings) -> DataFrame:
    """Adds alternatives to claims that are neither green nor verses."""
    asked = out.where("status <> 'green' and claim_type <> 'quran'").select("claim_id")
    grades = score.aggregate_grade(corpus.ratings.join(cands.select("doc_id").distinct(), "doc_id", "left_semi"), ["doc_id"], included=F.col("origin") == "collection_inclusion")
    named = corpus.narrations.select("doc_id", F.col("text_ar").alias("text"), F.concat_ws(" ", "collection", "number").alias("source"))
    near = cands.join(asked, "claim_id", "left_semi").join(grades, "doc_id").join(named, "doc_id")
    local = alt.local_alternatives(near, out.where("doc_id is not null").select("claim_id", "doc_id"), s)
    if hits is not None and corpus.alternates is not None:
        offered = hits.join(asked, "claim_id", "left_semi").select("claim_id", "rank", "has_alternate", F.col("hadith_id").alias("record_id"))
        local = alt.suggest(alt.provider_alternatives(offered, corpus.alternates, s), local, s)
    by = local.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("place", "text", "origin", "source"))).alias("alternatives"))
    return out.join(by, "claim_id", "left").drop("claim_id")


__all__ = ["Corpus", "RANK", "verify"]
