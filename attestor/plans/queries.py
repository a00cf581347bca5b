"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import keys, labels, porter, text
from attestor.operators import align, claims, dense, fusion, lexical, limits, lookup, metrics, prepare, score, select, stream_match, testset
from attestor.operators.staging import spread, staged
from attestor.plans.verify import Corpus, verify
from attestor.sources import ingest, provider

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: SQL of the normalisation, for text that is stable under NFKC and in Latin letters.
NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
DOC_TERMS = f"d AS (SELECT doc_id, source, string_split({NORM.format('text')}, ' ') AS w FROM documents)"
BM25 = DOC_TERMS + f""", s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM d),
p AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY term, doc_id),
f AS (SELECT term, count(*) AS n FROM p GROUP BY term),
b AS (SELECT item_id, list_distinct(string_split({NORM.format('text')}, ' ')) AS w, string_split({NORM.format('text')}, ' ') AS a FROM benchmark),
q AS (SELECT item_id, unnest(list_slice(list_sort(w, 'ASC'), 1, 1000)) AS term, a FROM b),
q40 AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY list_position(a, term)) AS r FROM q) WHERE r <= 40),
h AS (SELECT item_id, p.doc_id, -sum(greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q40 JOIN p USING (term) JOIN f USING (term) CROSS JOIN s {{where}} GROUP BY item_id, p.doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9), doc_id) AS rank FROM h)"""
FIRST = "WHERE p.doc_id IN (SELECT doc_id FROM documents WHERE source = 'src1')"


_stored: dict[tuple, lexical.LexicalIndex] = {}


class Tables:
    """The tables of a folder, by name, and the lexical index of its documents."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def index(self) -> lexical.LexicalIndex:
        """Stored once for each session and table, and made anew when the table's files have changed."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/documents.parquet")
        status = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, status.getModificationTime(), status.getLen())
        if key not in _stored:
            _stored[key] = lexical.LexicalIndex.stored(self("documents"), "doc_id", text.tokens(norm()))
        return _stored[key]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def norm(c: str = "text"):
    return text.normalize_en(F.col(c), compat=False)


@query(f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def norm_text(t):
    return spread(t("documents")).select("doc_id", norm().alias("norm"))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^؀-ۿ]', '', 'g')) >= length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'ar' ELSE 'en' END AS script FROM documents")
def detect_lang(t):
    return t("documents").select("doc_id", text.detect_lang(F.col("text")).alias("script"))


@query(f"SELECT r_regionkey, r_name || translate(' أإآ ىة ؤک ٣۴', '{text.LETTERS_FROM}', '{text.LETTERS_TO}') AS unified FROM region")
def letter_unify(t):
    return t("region").select("r_regionkey", text.unify_letters(F.concat("r_name", F.lit(" أإآ ىة ؤک ٣۴"))).alias("unified"))


@query("SELECT n_nationkey, trim(regexp_replace(replace(' ' || lower(n_name) || ' رضي الله عنه قال ', ' رضي الله عنه ', ' '), '\\s+', ' ', 'g')) AS stripped FROM nation")
def phrase_strip(t):
    return t("nation").select("n_nationkey", text.strip_honorifics(F.concat(F.lower("n_name"), F.lit(" رضي الله عنه قال"))).alias("stripped"))


@query(f"WITH {DOC_TERMS} SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_total FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY term")
def term_freq(t):
    return t.index().postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_total"))


@query(f"WITH {DOC_TERMS} SELECT doc_id, CAST(len(w) AS BIGINT) AS dl, CAST(len(list_distinct(w)) AS BIGINT) AS n_terms FROM d")
def doc_len(t):
    return t.index().words.select("doc_id", F.size("words").cast("long").alias("dl"), F.size(F.array_distinct("words")).cast("long").alias("n_terms"))


@query(f"WITH {DOC_TERMS} SELECT count(*) AS n_docs, round(avg(len(w)), 6) AS avgdl FROM d")
def corpus_stats(t):
    return t.index().stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def _bm25(t, k=10, allowed=None):
    return lexical.bm25(t.index(), t("benchmark"), "item_id", text.tokens(norm()), k, allowed)


@query(f"WITH {BM25.replace('{where}', '')} SELECT item_id, doc_id, rank, round(score, 5) + 0 AS score FROM r WHERE rank <= 10")
def bm25_topk(t):
    return _bm25(t).select(F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("long").alias("rank"), (F.round("score", 5) + 0).alias("score"))


@query(f"WITH {BM25.replace('{where}', FIRST)} SELECT item_id, doc_id, rank, round(score, 5) + 0 AS score FROM r WHERE rank <= 10")
def bm25_topk_filtered(t):
    allowed = t("documents").where("source = 'src1'").select("doc_id")
    return _bm25(t, 10, allowed).select(F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("long").alias("rank"), (F.round("score", 5) + 0).alias("score"))


CENTRES = """c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


@query(f"""WITH {CENTRES}, s AS (SELECT c.label AS query_id, vec_id, list_cosine_similarity(c.v, CAST(embedding AS DOUBLE[])) AS sim FROM c CROSS JOIN embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank, round(sim, 5) AS sim FROM r WHERE rank <= 50""")
def dense_topk(t):
    e = t("embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(F.col("label").alias("query_id"), F.transform("v", lambda x: x["m"]).alias("vec"))
    got = dense.dense_topk(centres, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")))
    return got.select("query_id", F.col("doc_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("sim", 5).alias("sim"))


_LISTS = f"""WITH {BM25.replace('{where}', '')}, a AS (SELECT * FROM r WHERE rank <= 10),
b1 AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9), doc_id) AS rank FROM h WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src1')),
u AS (SELECT item_id, doc_id, rank, 0 AS p FROM a UNION ALL SELECT item_id, doc_id, rank, 1 FROM b1 WHERE rank <= 10),
z AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(p * 1000 + rank) AS o FROM u GROUP BY item_id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, o, doc_id) AS rank FROM z)"""


def _fused(t):
    allowed = t("documents").where("source = 'src1'").select("doc_id")  # two lists over one stored index
    return fusion.rrf_fuse({"all": _bm25(t), "src1": _bm25(t, 10, allowed)})


@query(f"{_LISTS} SELECT item_id, doc_id, rank, round(rrf, 8) AS rrf FROM k WHERE rank <= 20")
def rrf_fuse(t):
    return _fused(t).select(F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("long").alias("rank"), F.round("rrf", 8).alias("rrf"))


@query(f"{_LISTS} SELECT item_id, round(max(least(1.0, rrf * 30)), 6) AS confidence, max(least(1.0, rrf * 30)) < 0.5 AS weak FROM k GROUP BY item_id")
def rrf_confidence(t):
    c = _fused(t).withColumn("confidence", fusion.confidence(F.lit(None).cast("double"), F.col("rrf")))
    w = fusion.weak(c, c.select("query_id").distinct())
    best = c.where("rank = 1").select("query_id", F.round("confidence", 6).alias("confidence"))
    return best.join(w, "query_id").select(F.col("query_id").alias("item_id"), "confidence", "weak")


def _phrases(t):
    return t("benchmark").select(F.col("item_id").alias("claim_id"), text.tokens(norm()).alias("words"))


@query(f"SELECT item_id, doc_id FROM (SELECT item_id, ' ' || {NORM.format('text')} || ' ' AS b FROM benchmark) JOIN (SELECT doc_id, ' ' || {NORM.format('text')} || ' ' AS d FROM documents) ON contains(d, b)")
def phrase_exact(t):
    stream = staged(stream_match.token_stream(t.index().words.withColumn("zero", F.lit(0)), "doc_id", "zero", F.col("words")), "stream")
    return stream_match.exact_matches(_phrases(t), stream, None).select(F.col("claim_id").alias("item_id"), F.col("part").alias("doc_id")).distinct()


@query(f"SELECT item_id, conv_id FROM (SELECT item_id, ' ' || {NORM.format('text')} || ' ' AS b FROM benchmark) JOIN (SELECT conv_id, ' ' || string_agg({NORM.format('text')}, ' ' ORDER BY turn) || ' ' AS d FROM conversations GROUP BY conv_id) ON contains(d, b)")
def stream_matches(t):
    stream = staged(stream_match.token_stream(t("conversations"), "conv_id", "turn", text.tokens(norm())), "stream")
    return stream_match.exact_matches(_phrases(t), stream, None).select(F.col("claim_id").alias("item_id"), F.col("part").alias("conv_id")).distinct()


@query(f"""WITH s AS (SELECT conv_id, turn, {NORM.format('text')} AS t FROM conversations),
m AS (SELECT a.conv_id AS c1, a.turn AS t1, a.t, b.conv_id AS c2, b.turn AS t2 FROM s a JOIN s b ON a.t = b.t AND (a.conv_id, a.turn) <> (b.conv_id, b.turn) WHERE a.t <> '')
SELECT c1 AS conv_id, t1 AS turn, count(*) AS others FROM m GROUP BY c1, t1""")
def repeated_turns(t):
    c = t("conversations").select("conv_id", "turn", norm().alias("t")).where("t <> ''")
    n = c.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return c.join(n, "t").select("conv_id", "turn", (F.col("n") - 1).alias("others"))


@query(f"""WITH s AS (SELECT conv_id, turn, string_split({NORM.format('text')}, ' ') AS w, lag(string_split({NORM.format('text')}, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, round(len(list_intersect(list_distinct(w), list_distinct(p))) / greatest(1, len(list_distinct(p)))::DOUBLE, 6) AS overlap FROM s WHERE p IS NOT NULL""")
def token_overlap(t):
    from pyspark.sql import Window

    c = t("conversations").select("conv_id", "turn", F.split(norm(), " ").alias("w"))
    c = c.withColumn("p", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p is not null")
    return c.select("conv_id", "turn", F.round(metrics.token_overlap(F.col("w"), F.col("p")), 6).alias("overlap"))


LABELS = ("Sahih", "Hasan Sahih", "Daif Isnaad", "Isnaad Sahih", "Mawdu' (Da'if)", "a good one", "-", "other")
_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in LABELS) + "]"


@query(f"""WITH l AS (SELECT p_partkey, lower({_LIST}[1 + p_size % 8]) AS low FROM part),
h AS (SELECT *, regexp_matches(low, '\\b(mawdu|maudu|fabricated)') AS m, CASE WHEN regexp_matches(low, '\\b(da''?if|weak)\\b') THEN strpos(low, regexp_extract(low, '\\b(da''?if|weak)\\b')) END AS d,
CASE WHEN regexp_matches(low, '\\b(sahih|authentic)\\b') THEN strpos(low, regexp_extract(low, '\\b(sahih|authentic)\\b')) END AS s, CASE WHEN regexp_matches(low, '\\b(hasan|good)\\b') THEN strpos(low, regexp_extract(low, '\\b(hasan|good)\\b')) END AS g FROM l)
SELECT p_partkey, CASE WHEN contains(low, 'hasan sahih') THEN 'sahih' WHEN m THEN 'mawdu' WHEN d IS NOT NULL AND d < coalesce(s, 999) AND d < coalesce(g, 999) THEN 'daif' WHEN s IS NOT NULL AND s < coalesce(g, 999) THEN 'sahih' WHEN g IS NOT NULL THEN 'hasan' ELSE 'unknown' END AS grade FROM h""")
def grade_bucket(t):
    label = F.element_at(F.array(*(F.lit(x) for x in LABELS)), 1 + F.col("p_size") % 8)
    return t("part").select("p_partkey", labels.bucket_en(label).alias("grade"))


CLASS = "CASE abs(hash_) WHEN 0 THEN 'sahih' WHEN 1 THEN 'hasan' WHEN 2 THEN 'daif' WHEN 3 THEN 'mawdu' ELSE 'unknown' END"


@query(f"""WITH e AS (SELECT user_id, {CLASS} AS g FROM (SELECT user_id, event_id % 5 AS hash_ FROM events)),
c AS (SELECT user_id, count(*) FILTER (g = 'sahih') AS s, count(*) FILTER (g = 'hasan') AS h, count(*) FILTER (g = 'daif') AS d, count(*) FILTER (g = 'mawdu') AS m FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN s + h + d + m = 0 THEN 'unknown' WHEN m > 0 AND s + h = 0 THEN 'mawdu' WHEN m * 2 >= s + h + d + m AND m > 0 THEN 'mawdu'
WHEN m >= greatest(s, h, d) THEN 'mawdu' WHEN d >= greatest(s, h) THEN 'daif' WHEN h >= s THEN 'hasan' ELSE 'sahih' END AS grade_class FROM c""")
def grade_aggregate(t):
    g = F.element_at(F.array(*(F.lit(x) for x in ("sahih", "hasan", "daif", "mawdu", "unknown"))), (F.col("event_id") % 5 + 1).cast("int"))
    return score.aggregate_grade(t("events").select("user_id", g.alias("grade_class")), ["user_id"])


@query("""WITH g AS (SELECT claim_type, match, conf, grade, cross_ FROM (SELECT unnest(['quran', 'hadith', 'saying']) AS claim_type) CROSS JOIN (SELECT unnest(['identical', 'partial', 'altered', 'paraphrase', 'not_found']) AS match)
CROSS JOIN (SELECT unnest([0.0, 0.3, 0.5, 0.7875, 1.0])::DOUBLE AS conf) CROSS JOIN (SELECT unnest(['sahih', 'hasan', 'daif', 'mawdu', 'unknown']) AS grade) CROSS JOIN (SELECT unnest([true, false]) AS cross_)),
p AS (SELECT *, CASE WHEN match = 'not_found' THEN 0 ELSE least(100, greatest(0, round_even(40 * conf + CASE match WHEN 'identical' THEN 30 WHEN 'partial' THEN 20 WHEN 'paraphrase' THEN 15 ELSE 5 END
 + CASE WHEN claim_type = 'quran' THEN 30 ELSE CASE grade WHEN 'sahih' THEN 30 WHEN 'hasan' THEN 25 WHEN 'daif' THEN 5 WHEN 'mawdu' THEN 0 ELSE 10 END END, 0))) END AS pts,
CASE WHEN match = 'not_found' THEN CASE WHEN claim_type IN ('quran', 'hadith') THEN 'red' ELSE 'amber' END
 WHEN claim_type = 'quran' THEN CASE WHEN match = 'altered' OR (match = 'paraphrase' AND (NOT cross_ OR conf < 0.5)) THEN 'amber' ELSE 'green' END
 WHEN grade = 'mawdu' THEN 'red' WHEN match = 'altered' OR (match = 'paraphrase' AND NOT cross_) OR grade IN ('daif', 'unknown') OR conf < 0.5 THEN 'amber' ELSE 'green' END AS status FROM g)
SELECT claim_type, match, conf, grade, cross_, CAST(CASE WHEN status = 'red' THEN least(pts, 30) ELSE pts END AS INTEGER) AS score, status FROM p""")
def score_grid(t):
    r = t("region").limit(1)
    for name, values in (("claim_type", ["quran", "hadith", "saying"]), ("match", list(align.RANK)), ("conf", [0.0, 0.3, 0.5, 0.7875, 1.0]), ("grade", ["sahih", "hasan", "daif", "mawdu", "unknown"]), ("cross_", [True, False])):
        r = r.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    s = score.score(F.col("claim_type"), F.col("match"), F.col("conf"), F.col("grade"), F.col("claim_type") == "hadith", F.col("cross_"))
    return r.select("claim_type", "match", "conf", "grade", "cross_", s["score"].alias("score"), s["status"].alias("status"))


@query(f"""WITH {BM25.replace('{where}', '')}, g AS (SELECT item_id, r.doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM r JOIN labels USING (doc_id) WHERE rank <= 10 AND quality = 1)
SELECT item_id, doc_id, place FROM g WHERE place <= 2""")
def alternatives_top2(t):
    from attestor.operators import alternatives

    good = t("labels").where("quality = 1").select("doc_id", F.lit("sahih").alias("grade_class"))
    c = _bm25(t).withColumnRenamed("query_id", "claim_id").join(good, "doc_id").withColumns({"rerank": F.lit(None).cast("double"), "confidence": F.lit(1.0), "text": F.col("doc_id").cast("string")})
    return alternatives.local_alternatives(c).select(F.col("claim_id").alias("item_id"), F.col("text").cast("long").alias("doc_id"), F.col("place").cast("long").alias("place"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(html, '<h1>([^<]*)', 1) AS h1, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS links FROM pages")
def html_blocks(t):
    links = F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long")
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)", 1).alias("h1"), links.alias("links"))


@query("SELECT page_id, CAST(len(q) AS BIGINT) AS n, list_aggregate(q, 'string_agg', '|') AS spans FROM (SELECT page_id, regexp_extract_all(html, '\"([^\"]+)\"', 1) AS q FROM pages) WHERE len(q) > 0")
def quoted_spans(t):
    q = t("pages").select("page_id", F.regexp_extract_all("html", F.lit('"([^"]+)"'), F.lit(1)).alias("q")).where("size(q) > 0")
    return q.select("page_id", F.size("q").cast("long").alias("n"), F.array_join("q", "|").alias("spans"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_first(t):
    return select.first_of(t("documents").select("text", "doc_id"), ["text"], [F.col("doc_id")])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(t):
    e = t("events").select("user_id", "event_type", "event_id", "value", "ts")
    return select.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'click', event_id) AS r FROM events) WHERE r = 1 OR event_type = 'click'")
def insert_ignore(t):
    e = t("events").select("user_id", "event_id", "event_type")
    return select.insert_ignore(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), ["user_id"], [F.col("event_id")]).select("user_id", "event_id")


@query("SELECT o_orderkey, c_custkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def pk_lookup(t):
    c = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return ingest.by_ids(c, t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "c_custkey").select("o_orderkey", "c_custkey", "c_name", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900")
def range_lookup(t):
    return ingest.id_range(t("lineitem"), 100, 900, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def fk_collect(t):
    by = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("orders"))
    return t("customer").select("c_custkey").join(by, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit("")).alias("orders"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <= b.n_nationkey AND b.n_nationkey + 2 <= a.n_nationkey + 9")
def range_containment(t):
    n = t("nation")
    ref = lambda c, w: keys.passage_ref(F.col("n_regionkey"), F.col(c), F.col("n_regionkey"), F.col(c) + w)
    a = n.select("n_regionkey", F.col("n_nationkey").alias("a")).withColumn("n_nationkey", F.col("a")).select("n_regionkey", "a", F.concat(F.lit("ayah:"), ref("n_nationkey", 9)).alias("pred"))
    b = n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.concat(F.lit("ayah:"), ref("n_nationkey", 2)).alias("want"))
    return a.join(b, "n_regionkey").where(metrics.same_source(F.col("pred"), F.array("want"))).select("a", "b")


@query("SELECT doc_id, left(sha1(text), 20) AS k, sha256(text) AS h FROM documents")
def hash_keys(t):
    return t("documents").select("doc_id", keys.text_key(F.col("text")).alias("k"), keys.input_hash(F.col("text")).alias("h"))


@query("SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS found FROM benchmark b")
def verbatim_exists(t):
    return select.verbatim_exists(t("benchmark").select("item_id", "text"), t("documents")).select("item_id", F.col("exists").alias("found"))


@query("SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text) AS found FROM benchmark b")
def equal_exists(t):
    return select.equal_exists(t("benchmark").select("item_id", "text"), t("documents")).select("item_id", F.col("exists").alias("found"))


def _preds(t):
    s = F.element_at(F.array(*(F.lit(x) for x in metrics.STATUSES)), (F.col("doc_id") % 3 + 1).cast("int"))
    p = F.when(F.col("toxic") == 1, "red").when(F.col("quality") == 1, "green")
    return t("documents").join(t("labels"), "doc_id").select(
        F.col("source").alias("category"), s.alias("expected_status"), p.alias("status"), F.when(F.col("doc_id") % 4 > 0, "identical").alias("expected_match"),
        F.when(F.col("quality") == 1, "identical").otherwise("partial").alias("match_type"), (F.col("n_chars") > 1000).alias("extracted"), (F.col("quality") == 1).alias("top1"), (F.col("doc_id") % 2 == 0).alias("top5"),
        F.when(F.col("doc_id") % 5 > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("expected_source_ids"), F.col("n_chars").alias("ms"),
    )


PREDS = """WITH p AS (SELECT source AS category, ['green', 'amber', 'red'][1 + doc_id % 3] AS expected_status, CASE WHEN toxic = 1 THEN 'red' WHEN quality = 1 THEN 'green' END AS status,
CASE WHEN doc_id % 4 > 0 THEN 'identical' END AS expected_match, CASE WHEN quality = 1 THEN 'identical' ELSE 'partial' END AS match_type, n_chars > 1000 AS extracted, quality = 1 AS top1, doc_id % 2 = 0 AS top5, doc_id % 5 > 0 AS src, n_chars AS ms FROM documents JOIN labels USING (doc_id))"""
RATES = """count(*) AS n, round_even(avg(extracted::INT), 4) AS extraction_recall, round_even(avg(top1::INT) FILTER (src), 4) AS top1, round_even(avg(top5::INT) FILTER (src), 4) AS top5,
round_even(avg(coalesce(status = expected_status, false)::INT), 4) AS status_acc, round_even(avg((match_type = expected_match)::INT) FILTER (expected_match IS NOT NULL), 4) AS match_acc"""


@query(f"{PREDS} SELECT {RATES} FROM p")
def eval_rates(t):
    return metrics.rates(_preds(t))


@query(f"{PREDS} SELECT category, {RATES} FROM p GROUP BY category")
def eval_by_category(t):
    return metrics.rates(_preds(t), ["category"])


@query(f"{PREDS} SELECT expected_status, count(*) FILTER (status = 'green') AS green, count(*) FILTER (status = 'amber') AS amber, count(*) FILTER (status = 'red') AS red, count(*) FILTER (status IS NULL) AS none FROM p GROUP BY expected_status")
def confusion_matrix(t):
    return metrics.confusion(_preds(t))


@query(f"{PREDS}, l AS (SELECT list_sort(list(ms)) AS a FROM p) SELECT (SELECT median(ms) FROM p) AS median, CAST(a[CAST(floor(len(a) * 0.9) AS BIGINT)] AS DOUBLE) AS p90, CAST(a[len(a)] AS DOUBLE) AS max FROM l")
def latency_stats(t):
    return metrics.latency(_preds(t))


@query("SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def health_counts(t):
    from attestor.api import health

    return health({n: t(n) for n in ("documents", "benchmark", "pages", "embeddings")})


@query("SELECT source, count(*) AS n, count(DISTINCT text) AS n_texts, round(avg((n_chars > 1000)::INT), 6) AS long_share FROM documents GROUP BY source")
def build_stats(t):
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_texts"), F.round(F.avg((F.col("n_chars") > 1000).cast("int")), 6).alias("long_share"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 5")
def testset_sample(t):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return t("documents").select("source", "doc_id", F.row_number().over(w).alias("r")).where("r <= 5").drop("r")


@query("SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value FROM events")
def json_props(t):
    key = F.get(F.json_object_keys("props"), 0)
    return t("events").select("event_id", F.element_at(F.from_json("props", "map<string, string>"), key).alias("first_value"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def status_counter(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def _corpus(t) -> Corpus:
    n = spread(t("documents")).select("doc_id", F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("number"), F.col("text").alias("text_ar"), F.lit("").alias("text_norm"), F.lit("").alias("body_norm"), F.col("text").alias("text_en"), norm().alias("text_en_norm"), F.lit(None).cast("string").alias("url"))
    r = t("labels").select("doc_id", F.when(F.col("quality") == 1, "sahih").otherwise("daif").alias("grade_class"), F.lit("dataset").alias("origin"))
    return Corpus(n, r, index={"narration-en": t.index()})


def _results(t) -> DataFrame:
    return verify(t("benchmark").select(F.col("item_id").alias("post_id"), "text"), _corpus(t))


@query()
def verify_e2e(t):
    out = _results(t)
    return out.select("post_id", "idx", "claim_type", "match_type", "confidence", "doc_id", "score", "status", "grade_class", F.array_join("reasons", ",").alias("reasons"), F.coalesce(F.size("alternatives"), F.lit(0)).alias("n_alternatives"))


@query()
def prepare_post(t):
    from attestor.api import prepare as run

    out = run(t("benchmark").select(F.col("item_id").alias("post_id"), "text"), _results(t), _corpus(t), "en")
    return out.select("post_id", "text", F.array_join("actions", ",").alias("actions"), "validated")


@query()
def classify_pairs(t):
    c = _bm25(t, 8).join(t("benchmark").select(F.col("item_id").alias("query_id"), norm().alias("claim")), "query_id").join(t("documents").select("doc_id", norm().alias("ref_text")), "doc_id")
    got = align.classify(c.withColumns({"reference": F.lit("full"), "rerank": F.lit(None).cast("double")}), ["query_id", "doc_id"])
    return got.select("query_id", "doc_id", "match_type", F.round("span_sim", 6).alias("span_sim"), F.round("coverage", 6).alias("coverage"), "start", "end", F.size("diff").alias("n_diff"))


@query()
def cue_extract(t):
    kept, _ = claims.extract(t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("post_id"), "text"))
    return kept


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT user_id, event_id, r, true AS admitted, [s] AS held FROM o WHERE r = 1
UNION ALL SELECT user_id, event_id, r, len(f) < 5, CASE WHEN len(f) < 5 THEN list_append(f, s) ELSE f END
FROM (SELECT o.user_id, o.event_id, o.r, o.s, list_filter(w.held, lambda x: o.s - x <= 86400.0) AS f FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1))
SELECT user_id, event_id, admitted FROM w""")
def rate_limit_admit(t):
    e = t("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).withColumn("s", F.col("us") / 1e6)
    return limits.admit(e, "user_id", "s", "event_id", 5, 86400.0).select("user_id", "event_id", "admitted")


@query()
def html_parse_full(t):
    return t("pages").select("page_id", F.size(provider.records(F.col("html"))).alias("n"))


@query()
def stemmed_terms(t):
    return t("benchmark").select("item_id", F.array_join(porter.stem_all(text.tokens(norm())), " ").alias("stems"))


TURNS = f"""t0 AS (SELECT conv_id, turn, string_split({NORM.format('text')}, ' ') AS w FROM conversations WHERE {NORM.format('text')} <> ''),
k AS (SELECT conv_id, turn, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS nr FROM t0),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, nr) AS pos FROM k),
l AS (SELECT conv_id, list(word ORDER BY pos) AS words FROM s GROUP BY conv_id)"""


@query(f"""WITH {TURNS}, c AS (SELECT conv_id * 1000 + turn AS claim_id, w FROM t0 WHERE len(w) BETWEEN 3 AND 12),
m AS (SELECT claim_id, s.conv_id AS part, s.pos, s.turn AS start_id, s.nr AS a1, len(c.w) AS n FROM c JOIN s ON s.word = c.w[1] JOIN l USING (conv_id) WHERE list_slice(l.words, s.pos, s.pos + len(c.w) - 1) = c.w),
e AS (SELECT m.*, z.turn AS end_id, a1 = 0 AND z.nr = z.n - 1 AS whole, row_number() OVER (PARTITION BY claim_id ORDER BY part, m.pos) AS nth FROM m JOIN s z ON z.conv_id = part AND z.pos = m.pos + m.n - 1),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY whole DESC, part, start_id, pos) AS best, count(*) OVER (PARTITION BY claim_id) - 1 AS n_others FROM e WHERE nth <= 50)
SELECT claim_id, part, start_id, end_id, whole, CAST(n_others AS INTEGER) AS n_others FROM r WHERE best = 1""")
def occurrence_pick(t):
    stream = staged(stream_match.token_stream(t("conversations").where(norm() != ""), "conv_id", "turn", text.tokens(norm())), "stream")
    asked = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), text.tokens(norm()).alias("words")).where("size(words) between 3 and 12")
    return stream_match.pick_occurrence(stream_match.exact_matches(asked, stream)).select("claim_id", "part", "start_id", "end_id", "whole", F.size("others").alias("n_others"))


@query(f"""WITH {TURNS}, b AS (SELECT conv_id * 1000 + turn AS claim_id, list_slice(w, -3, -1) || list_slice(lead(w) OVER (PARTITION BY conv_id ORDER BY turn), 1, 3) AS w FROM t0),
f AS (SELECT conv_id, ' ' || array_to_string(words, ' ') || ' ' AS d FROM l)
SELECT DISTINCT claim_id, conv_id FROM b JOIN f ON contains(d, ' ' || array_to_string(w, ' ') || ' ') WHERE w IS NOT NULL""")
def stream_border_matches(t):
    """Phrases that run from the end of a turn into the next, found across the border."""
    from pyspark.sql import Window

    c = t("conversations").select("conv_id", "turn", text.tokens(norm()).alias("w")).where("size(w) > 0")
    ends = F.slice("w", F.greatest(F.size("w") - 2, F.lit(1)), 3)
    after = F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = c.withColumn("words", F.concat(ends, F.slice(after, 1, 3))).where("words is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), "words")
    stream = staged(stream_match.token_stream(c, "conv_id", "turn", F.col("w")), "stream")
    return stream_match.exact_matches(asked, stream, None).select("claim_id", F.col("part").alias("conv_id")).distinct()


@query(f"""WITH o AS (SELECT conv_id, turn, array_to_string(list_slice(string_split({NORM.format('text')}, ' '), 1, 1), ' ') AS t FROM conversations)
SELECT conv_id, turn, count(*) OVER (PARTITION BY t) - 1 AS others FROM o WHERE t <> '' QUALIFY count(*) OVER (PARTITION BY t) > 1""")
def repeated_openings(t):
    c = t("conversations").select("conv_id", "turn", F.get(text.tokens(norm()), 0).alias("t")).where("t <> ''")
    n = c.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return c.join(n, "t").select("conv_id", "turn", (F.col("n") - 1).alias("others"))


#: Latin letters as Arabic ones, so that the Arabic path meets whole texts: variants, marks and digits among them.
TO_ARABIC = ("abcdefghijklmnopqrstuvwxyz,.'", "أبجدةوزحطيكلمنىعفصقرشتثخذض،؟َ")
ARABIC = f"translate(lower(text), '{TO_ARABIC[0].replace(chr(39), chr(39) * 2)}', '{TO_ARABIC[1]}')"
NORM_AR = f"trim(regexp_replace(regexp_replace(translate(regexp_replace({ARABIC}, '{text.MARKS}', '', 'g'), '{text.LETTERS_FROM}', '{text.LETTERS_TO}'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))".replace("\\\\", "\\")


def arabic(c: str = "text"):
    return F.translate(F.lower(c), *TO_ARABIC)


@query(f"SELECT doc_id, {NORM_AR} AS norm, CASE WHEN length(regexp_replace({ARABIC}, '[^؀-ۿ]', '', 'g')) >= length(regexp_replace({ARABIC}, '[^A-Za-z]', '', 'g')) THEN 'ar' ELSE 'en' END AS lang FROM documents")
def norm_arabic(t):
    d = spread(t("documents"))
    return d.select("doc_id", text.normalize_ar(arabic(), honorifics=False, compat=False).alias("norm"), text.detect_lang(arabic()).alias("lang"))


NAMES = "n AS (SELECT p_partkey, string_split(p_name || ' of ' || lower(p_brand) || ' ' || p_partkey, ' ') AS w FROM part), u AS (SELECT * FROM n WHERE len(list_distinct(w)) = len(w) AND len(w) >= 4)"


def _names(t):
    w = F.split(F.concat_ws(" ", "p_name", F.lit("of"), F.lower("p_brand"), F.col("p_partkey").cast("string")), " ")
    return t("part").select("p_partkey", w.alias("w")).where("size(array_distinct(w)) = size(w) and size(w) >= 4")


def _aligned(t, claim, ref):
    """A pair of texts for each part, and their alignment."""
    return _names(t).select("p_partkey", align.alignment(F.array_join(claim, " "), F.array_join(ref, " ")).alias("a"))


@query(f"WITH {NAMES} SELECT p_partkey, CAST(2 AS INTEGER) AS \"start\", CAST(2 + len(w) AS INTEGER) AS \"end\" FROM u")
def best_window(t):
    around = F.concat(F.array(F.lit("zz"), F.lit("yy")), F.col("w"), F.array(*(F.lit(f"x{i}") for i in range(9))))
    return _aligned(t, F.col("w"), around).select("p_partkey", F.col("a.start").alias("start"), F.col("a.end").alias("end"))


@query(f"WITH {NAMES} SELECT p_partkey, round((len(w) - 1) / len(w)::DOUBLE, 9) AS coverage FROM u")
def token_coverage(t):
    changed = F.transform("w", lambda x, i: F.when(i == 1, "zz").otherwise(x))
    return _aligned(t, changed, F.col("w")).select("p_partkey", F.round("a.coverage", 9).alias("coverage"))


@query(f"WITH {NAMES} SELECT p_partkey, 'equal:' || w[1] || '|replace:zz<' || w[2] || '|equal:' || array_to_string(list_slice(w, 3, len(w) - 1), ' ') || '|delete:' || w[len(w)] AS diff FROM u")
def word_diff(t):
    changed = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.when(i == 1, "zz").otherwise(x))
    whole = _names(t).select("p_partkey", F.array_join(changed, " ").alias("c"), F.array_join("w", " ").alias("r"))

    @F.pandas_udf("string")
    def run(c, r):
        return pd.Series(["|".join(f"{o['op']}:{o['text']}" + (f"<{o['source']}" if o["source"] else "") for o in align.word_diff(x.split(), y.split())) for x, y in zip(c, r)])

    return whole.select("p_partkey", run("c", "r").alias("diff"))


@query("SELECT p_partkey, round(2.0 * greatest(1, length(p_name) // 2) / (length(p_name) + greatest(1, length(p_name) // 2)), 9) AS ratio FROM part WHERE length(p_name) > 0")
def align_ratio(t):
    half = F.expr("left(p_name, greatest(1, length(p_name) div 2))")
    return t("part").where("length(p_name) > 0").select("p_partkey", F.round(align.char_ratio(half, F.col("p_name")), 9).alias("ratio"))


@query(f"""WITH b AS (SELECT item_id, {NORM.format('text')} AS b FROM benchmark), d AS (SELECT doc_id, {NORM.format('text')} AS d FROM documents),
m AS (SELECT item_id, doc_id, b, d, len(string_split(b, ' ')) AS nb, len(string_split(d, ' ')) AS nd FROM b JOIN d ON contains(' ' || d || ' ', ' ' || b || ' '))
SELECT item_id, doc_id, CASE WHEN nb >= 0.95 * nd OR 2.0 * length(b) / (length(b) + length(d)) >= 0.95 THEN 'identical' ELSE 'partial' END AS match_type, 1.0::DOUBLE AS coverage, 1.0::DOUBLE AS span_sim FROM m WHERE nb >= 2""")
def classify_exact_claims(t):
    met = phrase_exact(t).join(t("benchmark").select("item_id", norm().alias("claim")), "item_id").join(spread(t("documents")).select("doc_id", norm().alias("ref_text")), "doc_id")
    got = align.classify(met.withColumns({"reference": F.lit("full"), "rerank": F.lit(None).cast("double")}), ["item_id", "doc_id"])
    return got.where("size(diff) > 0 or match_type <> 'not_found'").select("item_id", "doc_id", "match_type", "coverage", "span_sim")


MATCHES = """m AS (SELECT user_id, event_id, ['identical', 'partial', 'altered', 'paraphrase', 'not_found'][1 + event_id % 5] AS match_type, 4 - event_id % 5 AS r,
event_id % 100 / 100.0::DOUBLE AS coverage, event_id % 8 / 8.0::DOUBLE AS span_sim, event_id % 3 / 4.0::DOUBLE AS confidence, event_id % 11 AS rank, event_id % 4 = 1 AS second FROM events)"""
BEST = "round_even(coverage, 2) DESC, round_even(span_sim, 3) DESC, confidence DESC, rank, event_id"


def _matches(t):
    e = F.col("event_id")
    kinds = F.array(*(F.lit(x) for x in align.RANK))
    return t("events").select("user_id", "event_id", e.alias("doc_id"), F.element_at(kinds, (e % 5 + 1).cast("int")).alias("match_type"), (e % 100 / 100.0).alias("coverage"),
                              (e % 8 / 8.0).alias("span_sim"), (e % 3 / 4.0).alias("confidence"), (e % 11).alias("rank"), (e % 4 == 1).alias("second"))


@query(f"WITH {MATCHES} SELECT user_id, match_type, coverage, span_sim, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, {BEST}) AS n FROM m) WHERE n = 1")
def best_per_claim(t):
    return stream_match.best_match(_matches(t), ["user_id"]).select("user_id", "match_type", "coverage", "span_sim", "confidence", "rank")


@query(f"WITH {MATCHES} SELECT user_id, event_id, match_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (NOT second AND r >= 3) DESC, r DESC, {BEST}) AS n FROM m) WHERE n = 1")
def primary_preference(t):
    return select.primary_over_secondary(_matches(t), ["user_id"], F.col("second")).select("user_id", "event_id", "match_type")


@query("SELECT p_partkey, p_name AS text, p_brand AS rawi, p_type AS grade, 'h' || p_partkey AS hadith_id, p_size % 2 = 0 AS has_alternate FROM part")
def provider_records(t):
    """Pages in the provider's form, made from a table and parsed back into its columns."""
    f = provider.LABELS
    parts = [
        F.lit(f'<html><div class="{provider.BLOCK_CLASS}">out of scope</div><div id="{provider.SCOPE_ID}"><div class="x {provider.BLOCK_CLASS}"><article>1 - : '), F.col("p_name"),
        F.lit(f"</article><strong>{f['rawi']}: <span>"), F.col("p_brand"), F.lit(f"</span></strong><strong>| {f['grade']}: <span> "), F.col("p_type"),
        F.lit('</span></strong><a href="/h/h'), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, "?alts=1").otherwise("?sims=1"), F.lit('">x</a></div></div></html>'),
    ]
    got = t("part").select("p_partkey", F.inline(provider.records(F.concat(*parts))))
    return got.select("p_partkey", "text", "rawi", "grade", "hadith_id", "has_alternate")


@query("""SELECT p_partkey AS post_id, c.idx AS idx, c.text AS text, c.kind AS claim_type, c.who AS attributed_to, 'en' AS lang FROM (SELECT p_partkey,
unnest([{'idx': 0, 'text': p_name || ' of ' || p_brand, 'kind': 'saying', 'who': NULL}, {'idx': 1, 'text': p_type || ' or ' || p_brand, 'kind': 'hadith', 'who': 'the Prophet ﷺ'}]) AS c FROM part)""")
def cue_claims(t):
    """Posts with two quotations, one of them after a cue."""
    post = F.concat(F.lit("He wrote «"), F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit('» and the Prophet said: "'), F.col("p_type"), F.lit(" or "), F.col("p_brand"), F.lit('" today'))
    return claims.extract(t("part").select(F.col("p_partkey").alias("post_id"), post.alias("text")))[0]


@query("""WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part), o AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY md5('7:' || p_partkey), p_partkey) AS nr FROM r WHERE n = 1)
SELECT p_partkey, CASE WHEN nr <= 12 THEN 'identical' WHEN nr <= 18 THEN 'partial' ELSE 'altered' END AS variant, CAST(CASE WHEN nr <= 12 THEN nr WHEN nr <= 18 THEN nr - 12 ELSE nr - 18 END AS INTEGER) AS nr FROM o WHERE nr <= 22""")
def testset_quotas(t):
    return testset.quotas(t("part").select("p_partkey", "p_name"), [("identical", 12), ("partial", 6), ("altered", 4)], "p_partkey", "p_name").select("p_partkey", "variant", "nr")


@query("""WITH h AS (SELECT user_id, ['sahih', 'hasan', 'daif', 'mawdu', 'unknown'][1 + event_id % 5] AS g FROM events WHERE event_id % 3 = 0),
s AS (SELECT c_custkey, ['daif', 'mawdu'][1 + c_custkey % 2] AS top FROM customer)
SELECT c_custkey, CASE WHEN (coalesce(bool_or(g = 'mawdu'), false) OR top = 'mawdu') AND NOT coalesce(bool_or(g IN ('sahih', 'hasan')), false) THEN 'red' ELSE 'amber' END AS status, count(g) AS n_same
FROM s LEFT JOIN h ON user_id = c_custkey GROUP BY c_custkey, top""")
def policy_labels(t):
    e, c = F.col("event_id"), F.col("c_custkey")
    same = F.concat(F.lit("wording "), F.col("query"))
    grade = F.element_at(F.array(*(F.lit(x) for x in ("sahih", "hasan", "daif", "mawdu", "unknown"))), (e % 5 + 1).cast("int"))
    hits = t("events").select(F.col("user_id").cast("string").alias("query"), F.when(e % 3 == 0, F.concat(F.lit("wording "), F.col("user_id").cast("string"))).otherwise("a text of quite other words").alias("norm"), grade.alias("grade_class"))
    seeds = t("customer").select(c.cast("string").alias("query"), F.when(c % 2 == 0, "daif").otherwise("mawdu").alias("top_class")).withColumn("norm", same)
    return testset.policy_label(seeds, hits).select(F.col("query").cast("long").alias("c_custkey"), "status", "n_same")


@query("SELECT c_custkey, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def cached_lookup(t):
    """Texts that are looked up among the items of cached responses."""
    key = F.concat(F.lit("search:"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    item = F.struct(F.concat(F.lit("text "), F.col("o_custkey").cast("string")).alias("text"))
    found = lookup.cached_response(t("customer").select("c_custkey", F.concat(F.lit("text "), F.col("c_custkey").cast("string")).alias("text")), t("orders").select(key.alias("key"), F.array(item).alias("response")))
    return found.select("c_custkey", F.substring("key", 8, 12).cast("long").alias("first_order"))


@query("""SELECT event_id, CASE WHEN m <> 'not_found' AND g <> 'mawdu' AND h THEN 'keep' WHEN n > 0 THEN 'replace' ELSE 'remove' END AS action
FROM (SELECT event_id, ['identical', 'altered', 'not_found'][1 + event_id % 3] AS m, ['sahih', 'mawdu'][1 + event_id // 3 % 2] AS g, event_id % 5 > 0 AS h, event_id % 7 % 3 AS n FROM events)""")
def decide_grid(t):
    e, pick = F.col("event_id"), lambda names, i: F.element_at(F.array(*(F.lit(x) for x in names)), (i + 1).cast("int"))
    return t("events").select("event_id", prepare.decide(pick(("identical", "altered", "not_found"), e % 3), pick(("sahih", "mawdu"), F.floor(e / 3) % 2), e % 5 > 0, e % 7 % 3).alias("action"))


#: Labels, images and requests that meet each rule once; the SQL has what the rules give, in the same order.
AR_LABELS = {"صحيح": "sahih", "حسن صحيح": "sahih", "ضعيفٌ جدًّا": "daif", "موضوع": "mawdu", "لا أصل له": "mawdu", "إسناده حسن": "hasan", "مرسل صحيح": "daif", "غير ذلك": "unknown"}
IMAGES = {"iVBORw0KGgoAAAAA": "image/png", "data:image/jpeg;base64,/9j/4AAQSkZJRg==": "image/jpeg", "R0lGODlhAQABAAAA": "image/gif", "UklGRgAAAABXRUJQ": "image/webp", "AAAAAAAAAAAAAAAA": None, "no base64 !": None}
FORWARDED = {" 10.0.0.1 , 10.0.0.2": "10.0.0.1", "": "peer", ",x": "peer", "h": "h"}


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _cycle(values, by: str):
    """One of some values for each row, in turn."""
    values = list(values)
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(by) % len(values) + 1).cast("int"))


@query(f"SELECT p_partkey, {_sql_list(AR_LABELS.values())}[1 + p_partkey % {len(AR_LABELS)}] AS grade FROM part")
def grade_bucket_ar(t):
    return t("part").select("p_partkey", labels.bucket_ar(_cycle(AR_LABELS, "p_partkey"), compat=False).alias("grade"))


@query(f"SELECT p_partkey, {_sql_list(labels.LABEL_AR.values())}[1 + p_partkey % {len(labels.LABEL_AR)}] AS name FROM part")
def label_names(t):
    return t("part").select("p_partkey", labels.label_to_ar(F.initcap(_cycle(labels.LABEL_AR, "p_partkey"))).alias("name"))


@query(f"SELECT event_id, {_sql_list(IMAGES.values())}[1 + event_id % {len(IMAGES)}] AS kind, {_sql_list(FORWARDED.values())}[1 + event_id % {len(FORWARDED)}] AS client FROM events")
def media_and_clients(t):
    return t("events").select("event_id", keys.media_type(keys.image_bytes(_cycle(IMAGES, "event_id"))).alias("kind"), keys.client_key(_cycle(FORWARDED, "event_id"), F.lit("peer")).alias("client"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey + 0.5::DOUBLE AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS number,
'base/c:' || CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey END AS url FROM orders""")
def record_keys(t):
    first = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 1, 0.5).otherwise(0.0))
    n = keys.record_number(first, F.col("o_custkey").cast("double"))
    return t("orders").select("o_orderkey", n.alias("number"), keys.record_url("base/", F.lit("c"), n).alias("url"))


@query(f"SELECT doc_id, 'search:' || {NORM.format('left(trim(regexp_replace(text, ' + chr(39) + '\\s+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')), 200)')} AS key FROM documents")
def search_keys(t):
    return spread(t("documents")).select("doc_id", keys.search_key(F.col("text"), compat=False).alias("key"))


@query("SELECT p_partkey, p_name || ' of ' || p_brand || ' and all' AS body, 'N' || p_partkey || ' son of X' AS narrator, p_name AS excerpt FROM part")
def bodies_and_excerpts(t):
    said = F.concat(F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(" and all"))
    text_en = F.concat(F.lit("Narrated N"), F.col("p_partkey").cast("string"), F.lit(" son of X: "), said)
    inner = F.concat(F.lit("He spoke: "), F.initcap("p_name"), F.lit("; then he left"))
    return t("part").select(
        "p_partkey", text.extract_body(F.concat(F.lit("حدثنا فلان: «"), said, F.lit(".»"))).alias("body"), keys.narrator(text_en).alias("narrator"),
        F.lower(text.excerpt(inner, F.split("p_name", " "))).alias("excerpt"),
    )


@query("""SELECT event_id, CASE WHEN m = 'not_found' THEN 'Not found in the approved sources.' ELSE CASE s WHEN 'green' THEN 'verified' WHEN 'amber' THEN 'needs review' ELSE 'misattributed / no basis' END || ': found '
|| CASE m WHEN 'identical' THEN 'identical' WHEN 'partial' THEN 'an excerpt' WHEN 'altered' THEN 'with altered wording' ELSE 'by meaning' END || CASE WHEN event_id % 2 = 0 THEN ' — place ' || event_id ELSE '' END || '.' END AS summary
FROM (SELECT event_id, ['identical', 'partial', 'altered', 'paraphrase', 'not_found'][1 + event_id % 5] AS m, ['green', 'amber', 'red'][1 + event_id % 3] AS s FROM events)""")
def summaries(t):
    place = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("place "), F.col("event_id").cast("string")))
    return t("events").select("event_id", score.summary(_cycle(metrics.STATUSES, "event_id"), _cycle(align.RANK, "event_id"), place).alias("summary"))


@query()
def decide_actions(t):
    return _results(t).select("post_id", "idx", prepare.decide(F.col("match_type"), F.col("grade_class"), F.col("doc_id").isNotNull(), F.coalesce(F.size("alternatives"), F.lit(0))).alias("action"))
