"""Stems, and the language of a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions.text import tokens

_HEAD, _TAIL = r"[^aeiou][^aeiouy]*", r"[aeiouy][aeiou]*"
_VOWEL = re.compile(rf"^({_HEAD})?[aeiouy]")
_SHORT = re.compile(rf"^{_HEAD}[aeiouy][^aeiouwxy]$")
_ONE = re.compile(rf"^({_HEAD})?{_TAIL}{_HEAD}({_TAIL})?$")
_SOME = re.compile(rf"^({_HEAD})?{_TAIL}{_HEAD}")
_TWO = re.compile(rf"^({_HEAD})?{_TAIL}{_HEAD}{_TAIL}{_HEAD}")
#: The suffixes of the second, third and fourth step of Porter's algorithm (1980).
STEP_2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Frequent function words by language code.
WORDS = {
    "de": ["der", "die", "das", "und", "den", "ist", "ein", "mit", "nicht", "von"],
    "en": ["the", "and", "of", "to", "that", "with", "is", "was", "for", "it"],
    "es": ["el", "los", "las", "que", "por", "con", "del", "una", "y", "su"],
    "fr": ["le", "les", "et", "des", "dans", "est", "une", "pour", "qui", "du"],
    "it": ["il", "che", "di", "per", "non", "gli", "della", "sono", "con", "una"],
    "nl": ["het", "een", "van", "en", "niet", "zijn", "op", "dat", "met", "voor"],
    "pt": ["o", "os", "que", "não", "uma", "para", "com", "do", "da", "em"],
    "sv": ["och", "att", "det", "som", "en", "inte", "är", "på", "för", "med"],
}
STEMMABLE = ("en",)
#: The languages that queries may name, and their codes.
NAMES = {"Unknown": "", "Danish": "da", "Dutch": "nl", "English": "en", "Finnish": "fi", "French": "fr", "German": "de", "Hungarian": "hu", "Italian": "it", "Norwegian": "nn", "Portuguese": "pt", "Romanian": "ro", "Russian": "ru", "Spanish": "es", "Swedish": "sv", "Turkish": "tr"}


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem_word(word: str) -> str:
    """Porter's stem of a lower-case English word; what isn't all ASCII letters, or is shorter than three, stays."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = re.match(r"^(.+?)(ed|ing)$", w)
    if w.endswith("eed"):
        w = w[:-1] if _SOME.match(w[:-3]) else w
    elif cut and _VOWEL.match(cut[1]):
        w = cut[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"([^aeiouylsz])\1$", w):
            w = w[:-1]
        elif _ONE.match(w) and _SHORT.match(w):
            w += "e"
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for step in (STEP_2, STEP_3):
        s = _longest(w, step)
        if s and _SOME.match(w[: -len(s)]):
            w = w[: -len(s)] + step[s]
    s = _longest(w, STEP_4)
    if s and _TWO.match(w[: -len(s)]) and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w.endswith("e") and (_TWO.match(w[:-1]) or (_ONE.match(w[:-1]) and not _SHORT.match(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _TWO.match(w):
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Apply it to distinct terms, not to every occurrence."""
    return words.map(stem_word, na_action="ignore")


def stems(terms: DataFrame) -> DataFrame:
    """term to stem, once a distinct term; terms that begin with a digit have none."""
    return terms.select("term").distinct().filter(~F.col("term").rlike("^[0-9]")).withColumn("stem", stem("term"))


def _count(terms: Column, words: list[str]) -> Column:
    return F.size(F.filter(terms, lambda x: x.isin(words)))


def languages(text: Column) -> Column:
    """Up to ten codes, likeliest first, by function words among the first 1,000 characters; none: `unknown`."""
    t = tokens(F.substring(text, 1, 1000))
    found = F.array(*[F.struct((-_count(t, w)).alias("n"), F.lit(c).alias("c")) for c, w in WORDS.items()])
    best = F.slice(F.transform(F.filter(F.array_sort(found), lambda x: x["n"] < 0), lambda x: x["c"]), 1, 10)
    return F.when(F.size(best) > 0, best).otherwise(F.array(F.lit("unknown")))


def stem_language(supplied: Column, candidates: Column) -> Column:
    """A supplied language wins; else the first candidate that has a stemmer; else `unknown`."""
    able = F.filter(candidates, lambda c: c.isin(*STEMMABLE))
    return F.coalesce(F.when(supplied != "", supplied), F.try_element_at(able, F.lit(1)), F.lit("unknown"))


def language_code(name: Column) -> Column:
    """The code of the first language of which the name, or its beginning, is given in any case; else what was given."""
    low = F.lower(name)
    found = [F.when((name != "") & (low.startswith(n.lower()) | F.lit(n.lower()).startswith(low)), F.lit(code)) for n, code in NAMES.items()]
    return F.coalesce(*found, name)


def language_name(code: Column) -> Column:
    """The name of a code; Unknown for any other."""
    return F.coalesce(*[F.when(code == c, F.lit(n)) for n, c in NAMES.items()], F.lit("Unknown"))


def stopwords(lines: DataFrame) -> frozenset:
    """The words of a stopword file, one a line; lines that begin with # are none. A file of a language is a short list."""
    rows = lines.select(F.lower(F.trim("value")).alias("w")).filter("w != '' AND NOT startswith(w, '#')").distinct()
    return frozenset(r["w"] for r in rows.collect())
