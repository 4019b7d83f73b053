"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) for English index words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_C, _V = "[^aeiou](?:[^aeiouy])*", "[aeiouy](?:[aeiou])*"
_M0 = re.compile(f"^(?:{_C})?{_V}{_C}")
_M1 = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_M2 = re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")
_VOWEL = re.compile(f"^(?:{_C})?[aeiouy]")
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
#: The suffixes of the paper's steps 2 and 3 with what replaces them, and those of step 4.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    first_y = w[0] == "y"
    if first_y:
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M0.search(w[:-3]):
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _VOWEL.search(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _DOUBLE.search(w):
                w = w[:-1]
            elif _CVC.search(w):
                w += "e"
    if w.endswith("y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((s for s in table if w.endswith(s)), key=len, default=None)
        if end and _M0.search(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = max((s for s in (*_STEP4, "sion", "tion") if w.endswith(s)), key=len, default=None)
    if end in ("sion", "tion"):
        end = "ion"
    if end and _M2.search(w[: -len(end)]):
        w = w[: -len(end)]
    if w.endswith("e") and (_M2.search(w[:-1]) or (_M1.search(w[:-1]) and not _CVC.search(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _M2.search(w):
        w = w[:-1]
    return w.lower()


#: A worker's memory of words that it has stemmed.
_known = lru_cache(1 << 18)(stem)


@F.pandas_udf(ArrayType(StringType()))
def stem_lists(lists: pd.Series) -> pd.Series:
    """Each list of words as the list of their stems."""
    from marginalia.functions.stem import _known  # the worker's own, which stays from batch to batch

    return lists.map(lambda words: [_known(w) for w in words], na_action="ignore")
