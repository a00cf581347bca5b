"""Porter's stemmer (1980), for English index terms."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the published algorithm: suffix and replacement, for a stem of measure over 0 (steps 2, 3) and over 1.
STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """Words of fewer than 3 or more than 60 letters, and words with other signs than a-z, stay."""
    w = word
    if not 3 <= len(w) <= 60 or not (w.isascii() and w.isalpha() and w.islower()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _has_vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (dict(zip(STEP2[::2], STEP2[1::2])), STEP3):
        suffix = max((s for s in table if w.endswith(s)), key=len, default=None)
        if suffix and _measure(w[: -len(suffix)]) > 0:
            w = w[: -len(suffix)] + table[suffix]
    suffix = max((s for s in STEP4 if w.endswith(s)), key=len, default=None)
    if suffix:
        base = w[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def stem_all(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])
