"""Several values packed in one field: one row per value, with its place.

Ordinary characters and separators are masked and repeats of a value with its separator are folded, so that strings
written in the same way share a delimiter skeleton whatever their length. The splitting rule of each distinct skeleton
is resolved once, broadcast, and applied to the string by position; the per-row work stays inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.skew import sized_join
from larder.session import BROADCAST_BYTES, materialize

_ORD = r"\p{L}\p{M}\p{N}\-&%."
#: A token: a run of ordinary characters with blanks, a run of separators with blanks, blanks, or a quote or backslash.
TOKEN = rf"""(?s) *[{_ORD}][{_ORD} ]*| *[^{_ORD} '"\\][^{_ORD}'"\\]*| +|['"\\]"""
#: A value with its separator in the mask: plain (apostrophes inside), or simply quoted with at most one separator inside.
UNIT = r"""(a(?:'a)*,|"a(?:,a)?",|'a(?:,a)?',)"""
FOLDED = UNIT + r"\1*"
VALUE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("first", "hop", "n", "span", "grp", "step")]).add("quote", "string")
RULE = T.StructType().add("units", T.ArrayType(T.IntegerType())).add("vals", T.ArrayType(VALUE))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def mask(text: Column) -> Column:
    """Each token as one character: ``a`` ordinary, ``,`` separators, ``s`` blanks, quotes and backslashes themselves."""
    runs = F.regexp_replace(text, rf" *[{_ORD}][{_ORD} ]*", "a")
    return F.regexp_replace(F.regexp_replace(runs, r""" *[^a '"\\][^a'"\\]*""", ","), " +", "s")


def skeleton(masked: Column) -> Column:
    """The mask with every run of an equal unit, of one or more, as the unit in braces."""
    return F.regexp_replace(masked, FOLDED, "{$1}")


@dataclass
class _Found:
    """A value: first token from 1, tokens, quote or '', and where it starts and ends with its quotes (from 0, end open)."""

    first: int
    n: int
    quote: str
    start: int
    end: int


def _parse(masked: str) -> list[_Found]:
    """The values of a mask. A quote at the start of a value that is never closed encloses the rest."""
    out, i, n = [], 0, len(masked)
    while i < n:
        c = masked[i]
        if c in "'\"":
            j = i + 1
            while j < n:
                if masked[j] == "\\" and j + 1 < n and masked[j + 1] in "'\"":
                    j += 2
                elif masked[j] == c:
                    if j + 1 < n and masked[j + 1] == c:
                        j += 2
                    else:
                        break
                else:
                    j += 1
            j = min(j, n)
            if j > i + 1:
                out.append(_Found(i + 2, j - i - 1, c, i, j + 1))
            i = j + 1
        elif c == "a":
            j = i + 1
            while j < n and masked[j] in "as'":
                j += 1
            out.append(_Found(i + 1, j - i, "", i, j))
            i = j
        else:
            i += 1
    return out


def split_rule(masked: str) -> list[tuple[int, int, str]]:
    """The values of an unfolded mask as (first token from 1, number of tokens, enclosing quote or '')."""
    return [(v.first, v.n, v.quote) for v in _parse(masked)]


@dataclass
class Rule:
    """How to split all strings of one skeleton. ``units`` has the tokens of each folded unit; a value starts at token
    ``first`` (every fold counted once) behind ``hop`` folds and has ``n`` tokens and ``span`` folds inside it; a value of
    fold ``grp`` (from 1) comes once per repeat, ``step`` tokens apart."""

    units: list[int] = field(default_factory=list)
    vals: list[tuple[int, int, int, int, int, int, str]] = field(default_factory=list)


def fold_rule(skel: str) -> Rule | None:
    """The rule of a skeleton, or None if the values hang on how often a fold repeats.

    With each fold once, a fold repeats as it stands if it starts outside all values and holds one value, or if it lies
    inside a quoted value whose quote its unit does not hold.
    """
    flat, folds = "", []
    for part in re.split(r"(\{[^{}]*\})", skel):
        if part.startswith("{"):
            folds.append((len(flat), len(flat) + len(part) - 2))
            flat += part[1:-1]
        else:
            flat += part
    vals, rule = _parse(flat), Rule([e - b for b, e in folds])
    for b, e in folds:
        own = [v for v in vals if b <= v.start and v.end <= e]
        around = [v for v in vals if v.start < b and (v.end > e or v.end == e == len(flat))]
        crossing = [v for v in vals if v not in own and v not in around and v.start < e and v.end > b]
        if crossing or len(own) + len(around) != 1:
            return None
        if around and (around[0].quote == "" or around[0].quote in flat[b:e] or flat[b - 1] == "\\"):
            return None
        if own and own[0].start != b:
            return None
    for v in vals:
        hop = sum(1 for _, e in folds if e < v.first)
        grp = next((k + 1 for k, (b, e) in enumerate(folds) if b <= v.start and v.end <= e), 0)
        span = 0 if grp else sum(1 for b, e in folds if v.start < b and e <= v.first - 1 + v.n)
        rule.vals.append((v.first, hop, v.n, span, grp, rule.units[grp - 1] if grp else 0, v.quote))
    return rule


def _row(rule: Rule) -> dict:
    return {"units": rule.units, "vals": [dict(zip(VALUE.names, v, strict=True)) for v in rule.vals]}


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rules = [fold_rule(s) for s in b["_skel"]]
        b["_rule"] = [_row(r) if r else None for r in rules]
        yield b


@F.pandas_udf(RULE)
def _own_rule(masked: pd.Series) -> pd.DataFrame:
    """The rule of single masks, nothing folded."""
    return pd.DataFrame([_row(Rule([], [(f, 0, n, 0, 0, 0, q) for f, n, q in split_rule(m)])) for m in masked], columns=["units", "vals"])


def _unescape(text: Column, quote: Column) -> Column:
    return F.when(quote == "'", F.regexp_replace(text, r"""\\(['"])|'(')""", "$1$2")).when(
        quote == '"', F.regexp_replace(text, r"""\\(['"])|"(")""", "$1$2")
    ).otherwise(text)


def _apply(text: Column, masked: Column, rule: Column) -> Column:
    """The values of a text by its rule, trimmed and without empty ones."""
    folds = F.regexp_extract_all(masked, F.lit(FOLDED), F.lit(0))

    def pick(x: Column) -> Column:
        toks, extra, r = x["toks"], x["extra"], x["rule"]
        more = lambda a, k: F.aggregate(F.slice(extra, a, k), F.lit(0), lambda s, v: s + v)

        def of(v: Column) -> Column:
            start, n = v["first"] + more(F.lit(1), v["hop"]), v["n"] + more(v["hop"] + 1, v["span"])
            times = F.when(v["grp"] == 0, 0).otherwise(F.get(extra, v["grp"] - 1) / F.greatest(v["step"], F.lit(1))).cast("int")
            one = lambda k: F.btrim(_unescape(F.array_join(F.slice(toks, start + k * v["step"], n), ""), v["quote"]), F.lit(" \t\r\n"))
            return F.transform(F.sequence(F.lit(0), times), one)

        return F.filter(F.flatten(F.transform(r["vals"], of)), lambda v: v != "")

    extra = F.when(F.size(rule["units"]) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.arrays_zip(folds.alias("f"), rule["units"].alias("u")), lambda z: F.length(z["f"]) - z["u"])
    )
    # inside a lambda the tokens of a text are built once, however many values it has
    whole = F.struct(tokens(text).alias("toks"), extra.alias("extra"), rule.alias("rule"))
    return F.get(F.transform(F.array(whole), pick), F.lit(0))


def split_packed(
    df: DataFrame, id_col: str, fields: list[str], id_name: str | None = None, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows (id, field_name, item_pos, item_value) for each value packed in ``fields``.

    Null, empty and value-free strings give no rows; repeated values are kept, each with its place; a null id is
    kept as null; other columns of ``df`` are ignored, whatever their names. Skeletons do not grow with the number of
    values, so their rules are few; they are broadcast where their measured bytes stay within ``limit``, else hot
    skeletons are split off. Strings whose values hang on how often a fold repeats (a fold cut by a quote) get a rule of
    their own.
    """
    out_id = id_name or id_col
    spec = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").alias("s")) for f in fields])
    long = (
        df.select(F.col(f"`{id_col}`").alias("_id"), F.explode(spec).alias("_x"))
        .select("_id", F.col("_x.f").alias("_field"), F.col("_x.s").alias("_text"))
        .filter(F.length("_text") > 0)
        .withColumn("_mask", mask(F.col("_text")))
        .withColumn("_skel", skeleton(F.col("_mask")))
    )
    rules = long.select("_skel").distinct().mapInPandas(_resolve, T.StructType().add("_skel", "string").add("_rule", RULE))
    rules = materialize(rules, "skeletons")
    joined = sized_join(long, rules, ["_skel"], "inner", limit)
    shared = joined.filter("_rule is not null")
    alone = joined.filter("_rule is null").drop("_rule").withColumn("_rule", _own_rule("_mask"))
    rows = shared.unionByName(alone) if not rules.filter("_rule is null").isEmpty() else shared
    values = _apply(F.col("_text"), F.col("_mask"), F.col("_rule"))
    kept = rows.select("_id", "_field", F.posexplode(values).alias("_p", "_v"))
    return kept.select(
        F.col("_id").alias(out_id),
        F.col("_field").alias("field_name"),
        (F.col("_p") + 1).cast("int").alias("item_pos"),
        F.col("_v").alias("item_value"),
    )
