"""Text functions: Column -> Column, all built in, ASCII word classes unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import vocabulary as V


def words_in(words: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_text(x: Column) -> Column:
    """Lower case, slashes and hyphens as blanks, other punctuation dropped, blanks collapsed; null as empty."""
    t = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[/-]", " ")
    return collapse(F.regexp_replace(t, r"[^\w\s]", ""))


def canonical_strict(x: Column) -> Column:
    """Drops recipe words, then modifiers word by word; ways of cooking stay."""
    t = F.regexp_replace(normalize_text(x), rf"\b({'|'.join(V.RECIPE_WORDS)})\b", "")
    drop = [w for w in V.MODIFIERS if w not in V.COOKING]
    kept = F.filter(F.split(collapse(t), " "), lambda w: ~w.isin(*drop))
    return F.trim(F.array_join(kept, " "))


def normalize_for_tags(x: Column) -> Column:
    """Deletes the marketing phrases in order, then all but word characters, blanks, slashes and hyphens."""
    t = F.trim(F.lower(F.coalesce(x, F.lit(""))))
    t = reduce(lambda c, p: F.regexp_replace(c, p, ""), V.DELETED, t)
    return collapse(F.regexp_replace(t, r"[^\w\s/-]", " "))


def _edges(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" -/"))


def normalize_term(x: Column) -> Column:
    return _edges(F.regexp_replace(normalize_for_tags(x), r"\b(and|with|style)\b", " "))


def canonical_loose(x: Column) -> Column:
    return _edges(F.regexp_replace(normalize_term(x), r"\b(dinner|lunch|breakfast|meal|ideas|idea)\b", " "))


def strip_html(x: Column, strict: bool = False) -> Column:
    """Tags as blanks. By default the closing bracket stays, as the published rule has it; ``strict`` takes it too."""
    return F.regexp_replace(x, "<[^>]+>" if strict else "<[^>]+", " ")


@F.pandas_udf(T.StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Unicode NFC; the one text step without a built-in."""
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def clean_review(x: Column, strict_html: bool = False) -> Column:
    """NUL and tags out, blanks collapsed; null as empty. Wrap in ``nfc`` where composed forms matter."""
    return collapse(strip_html(F.regexp_replace(F.coalesce(x, F.lit("")), "\\x00", ""), strict_html))


def short_as_null(x: Column, least: int = 2) -> Column:
    return F.when(F.length(x) >= least, x)


def ingredient_text(x: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\s]", " "))


def match_tokens(x: Column) -> Column:
    """Alphabetic tokens of more than one letter, stop words out."""
    t = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.filter(t, lambda w: (F.length(w) > 1) & ~w.isin(*V.MATCH_STOPWORDS))


def split_alnum(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def phrase_parts(x: Column) -> Column:
    """The items of a listing: split at commas, lines, semicolons, bars and bullets."""
    return F.split(x, "[,\\n;|•]")


def clean_phrase(x: Column) -> Column:
    t = F.lower(F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    t = F.regexp_replace(t, "^\\s*([0-9]+[.)]\\s*|[-•*]\\s*)", "")
    t = F.regexp_replace(t, "[“”\"']", "")
    return F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" ,;:-"))


def is_dish_phrase(t: Column) -> Column:
    """At least 3 letters and two meaningful words, no generic phrase."""
    ws = F.split(t, " ")
    meaningful = F.filter(ws, lambda w: (F.length(w) > 2) & ~w.isin(*V.PHRASE_STOPWORDS))
    return (
        (F.length(t) >= 3)
        & ~t.isin(*V.GENERIC_PHRASES)
        & (F.length(F.regexp_replace(t, "[^a-z]", "")) >= 3)
        & (F.size(meaningful) >= 2)
        & ~F.forall(ws, lambda w: w.isin(*V.GENERIC_WORDS))
    )


def is_external_term(t: Column) -> Column:
    """3 to 60 characters, no conversation, at least 60 % letters."""
    letters = F.length(F.regexp_replace(t, "[^a-zA-Z]", ""))
    return F.length(t).between(3, 60) & ~t.rlike("(?i)" + "|".join(V.RESIDUE)) & (letters >= 0.6 * F.length(t))


def keyword_pattern(keys: list[str] | None = None) -> str:
    keys = keys or [k for _, _, ks in V.TAXONOMY for k in ks]
    return r"\b(" + "|".join(keys) + r")\b"


def has_food_intent(t: Column) -> Column:
    return t.rlike(r"(?i)\brecipes?\b") | F.lower(t).rlike(keyword_pattern())


def is_blocked_topic(t: Column) -> Column:
    return t.rlike(rf"(?i)\b({V.BLOCKED_TOPICS})\b")


def is_useful_tag(t: Column) -> Column:
    return ~(t.isin(*V.TAG_BLOCKLIST) | t.startswith("for-") | t.contains("-servings") | t.rlike(r"^\d+$"))


def strip_trailing_recipe(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(t)), r"\brecipes?\s*$", ""))


def restore_possessive(t: Column) -> Column:
    """``mom s pie`` -> ``mom's pie``, after a word of two letters or more; a lone s at the end too."""
    inner = F.regexp_replace(t, r"\b([a-zA-Z]{2,}) s ([a-zA-Z])", "$1's $2")
    return F.regexp_replace(inner, r"\b([a-zA-Z]{2,}) s$", "$1's")


def unescape_markdown(t: Column) -> Column:
    return F.regexp_replace(t, r"\\(.)", "$1")


def list_literal(x: Column, kind: str = "string") -> Column:
    """An array from a list literal with single or double quotes; bare None becomes null; unreadable text is null."""
    ready = F.regexp_replace(x, r"\bNone\b", "null")
    ready = F.regexp_replace(ready, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    return F.from_json(ready, f"array<{kind}>", {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"})


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length, over sorted words."""
    s = lambda x: F.array_join(F.array_sort(F.split(x, " ")), " ")
    a, b = s(a), s(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def title_case(x: Column) -> Column:
    """Every run of letters with a capital first letter and small ones after it, whatever stands before the run."""
    runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def _indel(a: str, b: str) -> float:
    """Twice the longest common subsequence over the summed lengths, with a bit per character of ``a``."""
    if not a and not b:
        return 1.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & at.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return 2 * (len(a) - open_.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insert/delete similarity of sorted words (twice the longest common subsequence over the summed lengths)."""
    s = lambda x: " ".join(sorted((x or "").split()))
    return pd.Series([_indel(s(x), s(y)) for x, y in zip(a, b, strict=True)])
