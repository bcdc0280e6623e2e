"""Porter's stemmer (1980) for ASCII words, applied to a vocabulary in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffix rules of the published algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and (c != "y" or i == 0 or not out[i - 1]))
    return out


def _measure(stem: str) -> int:
    cons = _consonants(stem)
    return sum(1 for a, b in zip(cons, cons[1:], strict=False) if not a and b)


def _vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _short(stem: str) -> bool:
    cons = _consonants(stem)
    return len(stem) >= 3 and cons[-1] and not cons[-2] and cons[-3] and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _consonants(word)[-1]


def _swap(word: str, rules: dict[str, str]) -> str:
    """The longest suffix that fits decides, whether or not its condition holds."""
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word. Words under 3 or over 64 bytes, or with other letters, stay."""
    size = len(word.encode("utf-8", "surrogatepass"))
    if size < 3 or size > 64:
        return word
    if word.endswith("s"):
        if (word.endswith("sses") and size > 4) or (word.endswith("ies") and size > 3):
            word = word[:-2]
        elif not word.endswith("ss"):
            word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and _vowel(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for suffix in _STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(stem=b["term"].map(porter))


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """(term, stem) of a DataFrame of distinct terms."""
    return terms.select(F.col("term")).mapInPandas(_stems, "term string, stem string")
