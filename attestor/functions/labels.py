"""Buckets of rating labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import normalize_ar

# Classes in order of caution, patterns of English labels, phrases of Arabic labels (normalised), Arabic
# names of English labels.
CLASSES = ("mawdu", "daif", "unknown", "hasan", "sahih")
EN_PATTERNS = {
    "mawdu": r"(?i)\b(mawdu|maudu|mawdoo|fabricated|mawḍūʿ)\w*",
    "daif": r"(?i)\b(da'?if|daeef|weak|munkar|shadh|matruk)\b",
    "sahih": r"(?i)\b(sahih|saheeh|authentic|agreed upon)\b",
    "hasan": r"(?i)\b(hasan|good)\b",
}
AR_PHRASES = {
    "mawdu": ("موضوع", "مكذوب", "كذب", "كذاب", "باطل", "لا اصل له", "ليس له اصل", "ليس بحديث", "لا اصل له مرفوعا"),
    "daif": ("ضعيف", "ضعيف جدا", "منكر", "شاذ", "واه", "متروك", "مرسل", "منقطع", "فيه ضعف", "لين", "لا يصح", "لا يثبت", "اسناده ضعيف"),
    "sahih": ("صحيح", "اسناده صحيح", "رجاله ثقات", "متفق عليه", "اخرجه البخاري", "اخرجه مسلم"),
    "hasan": ("حسن",),
}
AR_BOTH = "حسن صحيح"
LABEL_AR = {
    "sahih": "صحيح", "hasan": "حسن", "daif": "ضعيف", "very daif": "ضعيف جدا", "mawdu": "موضوع", "maudu": "موضوع",
    "hasan sahih": "حسن صحيح", "sahih lighairihi": "صحيح لغيره", "hasan lighairihi": "حسن لغيره",
    "isnaad sahih": "إسناده صحيح", "sahih isnaad": "إسناده صحيح", "isnaad hasan": "إسناده حسن",
    "hasan isnaad": "إسناده حسن", "daif isnaad": "إسناده ضعيف", "isnaad daif": "إسناده ضعيف", "munkar": "منكر", "shadh": "شاذ",
}


def _earliest(hits: list[tuple[Column, str]]) -> Column:
    """Class of the hit that stands first (positions from 1; 0 is no hit), ties to the first class name."""
    found = F.filter(F.array(*(F.when(p > 0, F.struct(p.alias("p"), F.lit(c).alias("c"))) for p, c in hits)), lambda x: x.isNotNull())
    return F.coalesce(F.get(F.array_sort(found), 0)["c"], F.lit("unknown"))


def bucket_en(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    at = {c: F.when(F.regexp_like(low, F.lit(p)), F.length(F.element_at(F.split(low, p, 2), 1)) + 1).otherwise(0) for c, p in EN_PATTERNS.items()}
    return (
        F.when(F.regexp_replace(low, "[ -]", "") == "", "unknown")
        .when(low.contains("hasan sahih"), "sahih")
        .when(at["mawdu"] > 0, "mawdu")
        .otherwise(_earliest([(p, c) for c, p in at.items()]))
    )


def _first_phrase(padded: Column, phrases: tuple[str, ...]) -> Column:
    none = F.lit(2**30)
    at = [F.locate(f" {p} ", padded) for p in phrases]
    first = F.array_min(F.array(*(F.when(x > 0, x).otherwise(none) for x in at)))
    return F.when(first < none, first).otherwise(0)


def bucket_ar(label: Column, compat: bool = True) -> Column:
    text = normalize_ar(F.coalesce(label, F.lit("")), compat=compat)
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return (
        F.when(text == "", "unknown")
        .when(_first_phrase(padded, AR_PHRASES["mawdu"]) > 0, "mawdu")
        .when(padded.contains(f" {AR_BOTH} "), "sahih")
        .otherwise(_earliest([(_first_phrase(padded, AR_PHRASES[c]), c) for c in ("daif", "sahih", "hasan")]))
    )


def label_to_ar(label: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in LABEL_AR.items() for x in kv))
    return names[F.lower(F.trim(F.coalesce(label, F.lit(""))))]
