"""The Porter stemmer (M. F. Porter, 1980), with the later rules for -bli and -logi."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm: suffix -> what replaces it, where the stem has m > 0.
DOUBLE = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
SINGLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Dropped where the stem has m > 1.
LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """The word as c (consonant) and v (vowel); y is a vowel behind a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _m(stem: str) -> int:
    """Vowel runs that a consonant follows."""
    return _shape(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    """The longest suffix in the table decides, whether its stem is long enough or not."""
    for n in range(min(7, len(word) - 1), 0, -1):
        if (end := word[-n:]) in table:
            return word[:-n] + table[end] if _m(word[:-n]) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem_word(word: str) -> str:
    """The stem of one word; words of one or two characters stay."""
    if len(word) < 3:
        return word
    if word.endswith("s"):
        if word.endswith(("sses", "ies")):
            word = word[:-2]
        elif word[-2] != "s":
            word = word[:-1]
    if word.endswith("eed"):
        if _m(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word):
                word = word if word[-1] in "lsz" else word[:-1]
            elif _m(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, DOUBLE), SINGLE)
    for end in sorted(LAST, key=len, reverse=True):
        if word.endswith(end) and len(word) > len(end):
            left = word[: -len(end)]
            if _m(left) > 1 and (end != "ion" or left[-1] in "st"):
                word = left
            break
    if word.endswith("e") and ((m := _m(word[:-1])) > 1 or (m == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _m(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_term(term: str) -> str:
    """Each blank-separated word of a term."""
    return " ".join(map(stem_word, term.split(" ")))


@F.pandas_udf(T.StringType())
def porter_stem(terms: pd.Series) -> pd.Series:
    """Arrow-batched; apply it to distinct terms and join back."""
    return terms.map(lambda t: None if t is None else stem_term(t))
