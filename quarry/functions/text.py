"""Tokenization as Column expressions: split on spaces, punctuation and symbols, dots kept inside terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A private-use character, neither punctuation nor symbol, that stands for a dot while the text is split.
DOT = "\ue000"
BREAKS = r"[\p{P}\p{S}\p{Z}\s]+"
#: Scripts written without spaces, as ranges of code points.
CJKV = r"[ᄀ-ᇿ⺀-⿟⿰-⿿　-ヿ㄀-ㄯ㄰-㆏㆐-ㇿ㈀-䶿一-鿿꜀-ꜟ가-힯豈-﫿︰-﹏＀-￯]"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Lower-cased terms in order. Trailing dots go unless the term has others (an acronym); dots alone are no term."""
    words = F.split(F.regexp_replace(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("."), F.lit(DOT))), BREAKS, " "), " ")

    def term(w: Column) -> Column:
        t = F.replace(w, F.lit(DOT), F.lit("."))
        bare = F.regexp_replace(t, r"\.+$", "")
        return F.when(F.contains(bare, F.lit(".")), t).otherwise(bare)

    return F.filter(F.transform(words, term), lambda t: t != "")


def cjkv_grams(text: Column) -> Column:
    """For a run without spaces: each character, then the pair that it begins."""
    n = F.length(text)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    pairs = F.transform(at, lambda i: F.when(i < n, F.array(F.substr(text, i, F.lit(1)), F.substr(text, i, F.lit(2)))).otherwise(F.array(F.substr(text, i, F.lit(1)))))
    return F.filter(F.flatten(pairs), lambda g: g != "")


def has_cjkv(text: Column) -> Column:
    return F.coalesce(text.rlike(CJKV), F.lit(False))


def has_only_cjkv(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^({CJKV}|\\s)+$"), F.lit(False))


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)
