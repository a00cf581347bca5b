"""Evaluation sets: seeded choice, variants of passages, quotas, labels by policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.align import char_ratio
from attestor.operators.select import first_of

# What the input of an item starts and ends with; share of the words of an excerpt; similarity from which
# a verdict is on the same wording.
SAID = {"ar": ("قال رسول الله ﷺ: «", "»"), "en": ('The Prophet ﷺ said: "', '"')}
EXCERPT, LEAST_WORDS, SAME = 0.6, 5, 0.9


def seeded(seed: int, *keys: str) -> Column:
    """Order of a shuffle that depends on the keys and the seed alone, however the rows are dealt out."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def quotas(rows: DataFrame, plan: list[tuple[str, int]], key: str, text: str, seed: int = 7) -> DataFrame:
    """Adds variant and nr: rows with the same text count once; the others are put in seeded order and dealt to the
    variants of the plan (name, number) one after the other. Rows beyond the plan are left out, as that is the plan."""
    one = first_of(rows.where(F.col(text).isNotNull()), [text], [F.col(key)])
    total = sum(n for _, n in plan)
    # only the first of the order are needed, so no task sorts all rows
    first = one.withColumn("__o", seeded(seed, key)).orderBy("__o", key).limit(total)
    at = F.row_number().over(Window.orderBy("__o", key))
    edges, upto = [], 0
    for name, n in plan:
        edges.append((name, upto, upto + n))
        upto += n
    pick = F.coalesce(*(F.when(F.col("__at") <= b, F.struct(F.lit(name).alias("variant"), (F.col("__at") - a).alias("nr"))) for name, a, b in edges))
    return first.withColumn("__at", at).withColumn("__v", pick).select(*rows.columns, "__v.*")


def variant_text(text: Column, variant: Column, lang: str = "ar") -> Column:
    """Input of an item: the text whole, its first words (``partial``), or without its middle word (``altered``), in the
    words of an attribution."""
    w = F.split(F.trim(text), r"\s+")
    cut = F.greatest(F.lit(LEAST_WORDS), F.floor(F.size(w) * EXCERPT).cast("int"))
    middle = F.floor(F.size(w) / 2).cast("int")
    part = F.rtrim(F.array_join(F.slice(w, 1, cut), " "), F.lit("،,"))
    less = F.array_join(F.concat(F.slice(w, 1, middle), F.slice(w, middle + 2, F.size(w))), " ")
    body = F.when(variant == "partial", part).when(variant == "altered", less).otherwise(text)
    before, after = SAID[lang]
    return F.concat(F.lit(before), body, F.lit(after))


EXPECTED = {"identical": ("green", "identical"), "partial": ("green", "partial"), "altered": ("amber", "altered")}


def build(rows: DataFrame, plan: list[tuple[str, int]], key: str, text: str, category: str, lang: str = "ar", seed: int = 7) -> DataFrame:
    """Items of a category: id, category, variant, input, lang, expected_status, expected_match, expected_source_id."""
    dealt = quotas(rows, plan, key, text, seed)
    label = lambda i: F.create_map(*(F.lit(x) for k, v in EXPECTED.items() for x in (k, v[i])))[F.col("variant")]
    return dealt.select(
        F.concat_ws("-", F.lit(category), "variant", F.lpad(F.col("nr").cast("string"), 2, "0")).alias("id"), F.lit(category).alias("category"), "variant",
        variant_text(F.col(text), F.col("variant"), lang).alias("input"), F.lit(lang).alias("lang"), label(0).alias("expected_status"), label(1).alias("expected_match"),
        F.concat_ws(":", F.lit("hadith"), F.col(key).cast("string")).alias("expected_source_id"),
    )


def policy_label(seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """query, status, n_same: ``red`` where a verdict on the same wording calls it fabricated and none authentic, else
    ``amber``. seeds: query, norm, top_class; hits: query, norm (of the hit), grade_class."""
    same = hits.select("query", F.col("norm").alias("hit"), "grade_class").join(seeds.select("query", "norm"), "query")
    same = same.where(char_ratio(F.col("norm"), F.col("hit")) >= SAME)
    marks = lambda c: F.max(F.col("grade_class").isin(*c))
    by = same.groupBy("query").agg(F.count(F.lit(1)).alias("n_same"), marks(("mawdu",)).alias("bad"), marks(("sahih", "hasan")).alias("good"))
    out = seeds.join(by, "query", "left")
    bad = F.coalesce("bad", F.lit(False)) | (F.col("top_class") == "mawdu")
    good = F.coalesce("good", F.lit(False)) | F.col("top_class").isin("sahih", "hasan")
    return out.select("query", F.when(bad & ~good, "red").otherwise("amber").alias("status"), F.coalesce("n_same", F.lit(0)).cast("long").alias("n_same"))


def chosen(items: DataFrame, category: str | None = None, limit: int | None = None) -> DataFrame:
    """The items of a category, the first of them by id."""
    rows = items if category is None else items.where(F.col("category") == category)
    return rows.orderBy("id") if limit is None else rows.orderBy("id").limit(limit)


def first_quoted(text: Column) -> Column:
    """What stands in the first pair of quotation marks of an input, else the input."""
    found = F.regexp_extract(text, '[«﴿“"](.*?)[»﴾”"]', 1)
    return F.when(found != "", found).otherwise(text)
