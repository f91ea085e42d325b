"""Stemmers for vocabularies: Porter's first and his second, which is known as English."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The published suffixes of steps 2 to 4.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), "")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix of the rules, replaced if what is before it has the measure."""
    for size in range(min(7, len(word)), 1, -1):
        if (new := rules.get(word[-size:])) is not None:
            stem = word[:-size]
            fits = _measure(stem) >= least and (word[-size:] != "ion" or stem.endswith(("s", "t")))
            return stem + new if fits else word
    return word


def porter(word: str) -> str:
    """The stem of a word of lower-case letters a to z; any other word is its own."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        stem = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else ""
        if "v" in _shape(stem):
            word = stem
            if word.endswith(("at", "bl", "iz")) or (not _double(word) and _measure(word) == 1 and _short(word)):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(_replaced(word, _STEP2, 1), _STEP3, 1), _STEP4, 2)
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or (m == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


# The published suffixes, exceptions and prefixes of the second stemmer.
_EN_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_FINAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_EN_PREFIX = ("gener", "commun", "arsen")
_EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_EN_REGION = re.compile("[aeiouy][^aeiouy]")
_EN_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_EN_VOWEL = re.compile("[aeiouy]")


def _longest(word: str, suffixes) -> str:
    """The longest of the suffixes that the word has, or nothing."""
    return next((word[-k:] for k in range(min(7, len(word)), 0, -1) if word[-k:] in suffixes), "")


def english(word: str) -> str:
    """The stem of a word of lower-case letters a to z by the second stemmer; any other word is its own. Y is a y that is no vowel."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word in _EN_WORDS:
        return _EN_WORDS[word]
    word = re.sub("(?:^|(?<=[aeiouy]))y", "Y", word)
    prefix = next((p for p in _EN_PREFIX if word.startswith(p)), "")
    first = _EN_REGION.search(word)
    r1 = len(prefix) if prefix else first.end() if first else len(word)
    second = _EN_REGION.search(word, r1)
    r2 = second.end() if second else len(word)

    def short(x: str) -> bool:
        return bool(_EN_SHORT.search(x))

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _EN_VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _EN_FINAL:
        return word
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    stem = word[: len(word) - len(end)]
    if end.startswith("eed"):
        word = stem + "ee" if len(stem) >= r1 else word
    elif end and _EN_VOWEL.search(stem):
        if stem.endswith(("at", "bl", "iz")):
            word = stem + "e"
        elif len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] in "bdfgmnprt":
            word = stem[:-1]
        else:
            word = stem + "e" if short(stem) and r1 >= len(stem) else stem
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    end = _longest(word, _EN_STEP2)
    stem = word[: len(word) - len(end)]
    if end and len(stem) >= r1 and (end != "ogi" or stem.endswith("l")) and (end != "li" or stem[-1:] in tuple("cdeghkmnrt")):
        word = stem + _EN_STEP2[end]
    end = _longest(word, _EN_STEP3)
    stem = word[: len(word) - len(end)]
    if end and len(stem) >= (r2 if end == "ative" else r1):
        word = stem + _EN_STEP3[end]
    end = _longest(word, _EN_STEP4)
    stem = word[: len(word) - len(end)]
    if end and len(stem) >= r2 and (end != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("e") and (len(word) > r2 or (len(word) > r1 and not short(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(StringType())
def english_stem(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in words:
        yield x.map(english, na_action="ignore")


@F.pandas_udf(StringType())
def porter_stem(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in words:
        yield x.map(porter, na_action="ignore")
