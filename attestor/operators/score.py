"""Aggregate rating, score, status and summaries: conditional expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.config import Settings
from attestor.functions.labels import CLASSES

# Points of a match and of a rating, cap of a red score, reasons in their order.
TYPE_POINTS = {"identical": 30, "partial": 20, "paraphrase": 15, "altered": 5, "not_found": 0}
GRADE_POINTS = {"sahih": 30, "hasan": 25, "daif": 5, "mawdu": 0, "unknown": 10, "quran": 30}
RED_CAP = 30


def _points(table: dict[str, int], c: Column, default: int) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], F.lit(default))


def aggregate_grade(ratings: DataFrame, keys: list[str], grade: str = "grade_class", included: Column | None = None) -> DataFrame:
    """One class for each key: an inclusion decides; fabricated wins without an authentic rating or with half of the
    known ones; else the majority, ties to the more cautious. Counts are partial sums, so hot keys cost nothing."""
    known = [c for c in CLASSES if c != "unknown"]
    n = {c: F.count(F.when(F.col(grade) == c, 1)) for c in known}
    sums = ratings.groupBy(*keys).agg(F.max(F.lit(False) if included is None else F.coalesce(included, F.lit(False))).alias("__in"), *(x.alias(f"__{c}") for c, x in n.items()))
    col = {c: F.col(f"__{c}") for c in known}
    total = sum(col.values(), F.lit(0))
    top = F.array_min(F.array(*(F.struct((-col[c]).alias("n"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(CLASSES) if c in col)))["c"]
    out = (
        F.when(F.col("__in"), "sahih").when(total == 0, "unknown")
        .when((col["mawdu"] > 0) & (col["sahih"] + col["hasan"] == 0), "mawdu")
        .when((col["mawdu"] > 0) & (col["mawdu"] * 2 >= total), "mawdu").otherwise(top)
    )
    return sums.select(*keys, out.alias(grade))


def score(claim_type: Column, match: Column, conf: Column, grade: Column, attributed: Column, cross: Column, s: Settings = Settings()) -> Column:
    """Struct (score, status, grade_class, reasons)."""
    conf = F.when(match == "not_found", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(conf, F.lit(0.0)))))
    verse, missing = claim_type == "quran", match == "not_found"
    points = F.bround(40 * conf + _points(TYPE_POINTS, match, 0) + _points(GRADE_POINTS, F.when(verse & ~missing, "quran").otherwise(grade), 10)).cast("int")
    points = F.when(missing, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points)))
    meaning, low = (match == "paraphrase") & ~cross, conf < s.low_confidence
    found = F.filter(
        F.array(
            F.when(meaning, "meaning_only"), F.when(match == "altered", "wording_altered"),
            F.when(grade == "daif", "graded_weak").when(grade == "unknown", "grade_unknown"), F.when(low, "low_confidence"),
        ),
        lambda r: r.isNotNull(),
    )
    no_basis = missing & (verse | ((claim_type == "hadith") & attributed))
    reasons = (
        F.when(no_basis, F.array(F.lit("not_found"), F.lit("no_basis_in_sources"))).when(missing, F.array(F.lit("not_found")))
        .when(verse & (match == "altered"), F.array(F.lit("quran_wording_altered"))).when(verse & meaning, F.array(F.lit("meaning_only")))
        .when(verse & low & (match == "paraphrase"), F.array(F.lit("low_confidence"))).when(verse, F.array(F.lit("quran_verified")))
        .when(grade == "mawdu", F.array(F.lit("graded_fabricated"))).when(F.size(found) > 0, found).otherwise(F.array(F.lit("verified")))
    )
    status = (
        F.when(no_basis, "red").when(missing, "amber")
        .when(verse, F.when(F.get(reasons, 0) == "quran_verified", "green").otherwise("amber"))
        .when(grade == "mawdu", "red").when(F.size(found) > 0, "amber").otherwise("green")
    )
    return F.struct(
        F.when(status == "red", F.least(points, F.lit(RED_CAP))).otherwise(points).alias("score"), status.alias("status"),
        F.when(verse & ~missing, "quran").otherwise(grade).alias("grade_class"), reasons.alias("reasons"),
    )


# Wording of a summary in both languages.
SUMMARY = {
    "ar": {
        "not_found": "لم يُعثر عليه في المصادر المعتمدة.", "identical": "مطابق", "partial": "جزء من النص", "altered": "مع تغيير في الألفاظ",
        "paraphrase": "بالمعنى", "green": "موثّق", "amber": "يحتاج مراجعة", "red": "منسوب خطأً أو لا أصل له", "found": "وُجد",
    },
    "en": {
        "not_found": "Not found in the approved sources.", "identical": "identical", "partial": "an excerpt", "altered": "with altered wording",
        "paraphrase": "by meaning", "green": "verified", "amber": "needs review", "red": "misattributed / no basis", "found": "found",
    },
}


def summary(status: Column, match: Column, place: Column, lang: str = "en") -> Column:
    """One deterministic sentence for status, match and place."""
    words = SUMMARY[lang]
    word = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    at = F.coalesce(F.concat(F.lit(" — "), F.nullif(place, F.lit(""))), F.lit(""))
    return F.when(match == "not_found", words["not_found"]).otherwise(F.concat(word[status], F.lit(f": {words['found']} "), word[match], at, F.lit(".")))
