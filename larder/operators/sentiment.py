"""Lexicon sentiment of texts, inside the JVM: valences, negation, boosters, exclamation marks, s / sqrt(s^2 + 15)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of kitchen reviews with valences on the -4..4 scale of the published VADER lexicon (Hutto and
# Gilbert, 2014), a short default. ``read_lexicon`` reads the whole published file; the lexicon is a parameter.
LEXICON = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "amazing": 2.8, "love": 3.2, "loved": 2.9, "lovely": 2.8, "perfect": 2.7,
    "delicious": 2.7, "tasty": 2.3, "easy": 1.9, "nice": 1.8, "best": 3.2, "better": 1.9, "enjoyed": 2.3, "wonderful": 2.7,
    "fantastic": 2.6, "favorite": 2.0, "happy": 2.7, "worth": 0.9, "works": 0.8, "surprised": 0.9, "tender": 1.0, "creamy": 0.8,
    "bad": -2.5, "terrible": -2.1, "awful": -2.0, "horrible": -2.5, "worst": -3.1, "hate": -2.7, "hated": -3.2, "bland": -1.1,
    "dry": -0.7, "burned": -1.6, "burnt": -1.6, "disappointed": -1.9, "disappointing": -2.2, "waste": -1.8, "wrong": -2.1,
    "soggy": -1.2, "tasteless": -1.6, "never": -0.6, "fewer": -0.4, "poor": -2.1, "problem": -1.7, "sorry": -0.3, "salty": -0.4,
}
NEGATIONS = ("not", "no", "never", "none", "nothing", "without", "hardly", "cannot", "dont", "didnt", "wasnt", "isnt")
BOOSTERS = {
    "very": 0.293, "really": 0.293, "so": 0.293, "too": 0.293, "extremely": 0.293, "absolutely": 0.293,
    "slightly": -0.293, "somewhat": -0.293
}
# Published constants of the rule-based scorer.
NEGATE, EXCLAIM, MOST_EXCLAIM, ALPHA = -0.74, 0.292, 4, 15


def read_lexicon(path: str) -> dict[str, float]:
    """A lexicon file in the published form: word, tab, mean valence, further columns. Single lower-case words are kept,
    as texts are scored word by word; the file is a fixed resource of some thousand lines."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            word, _, rest = line.rstrip("\n").partition("\t")
            if word.isalpha() and word.isascii():
                out[word.lower()] = float(rest.split("\t")[0])
    return out


def lexicon_score(text: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """Compound score between -1 and 1; null for null or blank text, 0 where no word is known."""
    found = F.regexp_extract_all(F.lower(F.replace(text, F.lit("'"), F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    table = F.create_map(*[x for w, v in lexicon.items() for x in (F.lit(w), F.lit(float(v)))])
    boost = F.create_map(*[x for w, v in BOOSTERS.items() for x in (F.lit(w), F.lit(float(v)))])
    null = F.lit(None).cast("string")

    def valence(x: Column) -> Column:
        v = table[x["w"]]
        v = v + F.signum(v) * F.coalesce(boost[x["a"]], F.lit(0.0))
        no = [F.coalesce(x[k].isin(*NEGATIONS), F.lit(False)) for k in ("a", "b", "c")]
        return F.coalesce(F.when(no[0] | no[1] | no[2], v * NEGATE).otherwise(v), F.lit(0.0))

    def total(words: Column) -> Column:
        before = lambda k: F.slice(F.concat(F.array(*[null] * k), words), 1, F.size(words))
        window = F.arrays_zip(words.alias("w"), before(1).alias("a"), before(2).alias("b"), before(3).alias("c"))
        known = F.filter(window, lambda x: x["w"].isin(*lexicon))
        return F.aggregate(F.transform(known, valence), F.lit(0.0), lambda a, v: a + v)

    # inside a lambda the word list of a text is built once, however often it is used
    marks = F.least(F.regexp_count(text, F.lit("!")), F.lit(MOST_EXCLAIM)) * EXCLAIM

    def compound(t: Column) -> Column:
        return t / F.sqrt(t * t + ALPHA)

    def emphasised(t: Column) -> Column:
        return t + F.signum(t) * marks

    once = F.transform(F.transform(F.transform(F.array(found), total), emphasised), compound)
    return F.when(F.trim(text) != "", F.get(once, F.lit(0)))


def model_score(text: Column, scorer: Callable[[list[str]], list[float]]) -> Column:
    """A scorer plugged in from outside, in Arrow batches; blank text is null."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        ok = x.notna() & (x.fillna("").str.strip() != "")
        out = pd.Series([None] * len(x), index=x.index, dtype="float64")
        if ok.any():
            out[ok] = scorer(x[ok].tolist())
        return out

    return run(text)
