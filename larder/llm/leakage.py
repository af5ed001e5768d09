"""Evaluation texts leaking into training text: one-sided MinHash containment search, verified exactly.

Test items are short and documents long, so a MinHash signature of both says little: at 30 % of 50 shingles in a document of
thousands, their Jaccard similarity is below 0.01. Instead only the item is sketched: it keeps the bottom-k MinHash of its
shingles, k set by its size, and documents are streamed past the sketches. Of n shingles, a document that holds the
wanted share must hold one of the n - ceil(share * n) + 1 smallest hashes, so no qualified document can be missed. Documents
that meet a sketch and hold enough of the item's hashes are verified on the shingles themselves.

Shingles are 64-bit hashes in sorted arrays. A document is shingled once, whatever the number of items.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of item text in one block. The index of a block takes about three bytes a character (measured on random words:
#: 24 MB a block); a task holds one block at a time, an executor keeps all blocks on its disk.
BLOCK_CHARS = 8_000_000
#: Characters of document text that a task shingles at once.
SLICE_CHARS = 4_000_000
#: Words whose hashes a task keeps.
KNOWN_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_MASK = (1 << 64) - 1


@lru_cache(1)
def _marks() -> dict[int, None]:
    """All combining marks, for str.translate."""
    return {c: None for c in range(0x110000) if unicodedata.category(chr(c)).startswith("M")}


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFD, removal of combining marks and lower-casing."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text).translate(_marks())
    return _WORD.findall(text.lower())


def shingles(text: str, size: int) -> set[str]:
    w = words(text)
    return set(map(" ".join, zip(*(w[i:] for i in range(size)), strict=False)))


class _WordHashes(dict):
    """64-bit hashes of words, kept as they come."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def shingle_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, from the hashes of the words, mixed so that its order is random."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def need_of(n: int, share: float) -> int:
    """Shingles that a document must hold of an item of ``n``."""
    return max(1, math.ceil(share * n - 1e-9))


def sketch(hashes: np.ndarray, share: float) -> np.ndarray:
    """The bottom-k MinHash of a sorted set of hashes, k as large as its size needs for ``share``."""
    return hashes[: len(hashes) - need_of(len(hashes), share) + 1]


def build_index(rows: list[tuple[int, str]], size: int, share: float) -> dict:
    """Sketches, whole hash sets, thresholds and texts of the items of one block.

    The seed is such that no two shingles of one item have the same hash, so that a hash set counts them right.
    """
    texts: dict[int, list[str]] = defaultdict(list)
    for key, text in rows:
        texts[key].append(text)
    strings = {k: set().union(*(shingles(t, size) for t in ts)) for k, ts in texts.items()}
    keys = sorted(k for k, s in strings.items() if s)
    for seed in range(1_000):
        known = _WordHashes(seed)
        sets = [np.unique(np.concatenate([shingle_hashes(known.of(words(t)), size) for t in texts[k]])) for k in keys]
        if all(len(s) == len(strings[k]) for k, s in zip(keys, sets, strict=True)):
            break
    sketches = [sketch(s, share) for s in sets]
    flat = np.concatenate([*sketches, np.zeros(0, dtype=np.uint64)])
    item = np.repeat(np.arange(len(keys)), [len(s) for s in sketches]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    hashes, first = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << 20, dtype=bool)
    table[hashes >> np.uint64(44)] = True
    return {
        "seed": seed, "keys": np.array(keys, dtype=np.int64), "hashes": hashes, "starts": np.append(first, len(flat)),
        "items": item[order], "leading": table, "sets": np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]),
        "ends": np.cumsum([0, *(len(s) for s in sets)]), "need": [need_of(len(s), share) for s in sets],
        "texts": [texts[k] for k in keys],
    }


class _Slice:
    """Documents shingled at once: their hashes and where each document's begin and end."""

    def __init__(self, texts: list[str], size: int, seeds: dict[int, _WordHashes]):
        self.texts, self.size, self.seeds = texts, size, seeds
        self.found = [words(t) for t in texts]
        self.of_seed: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ends): the shingle hashes of all documents, one after the other."""
        if seed not in self.of_seed:
            known = self.seeds.setdefault(seed, _WordHashes(seed))
            lengths = np.array([len(w) for w in self.found])
            h = shingle_hashes(known.of([w for ws in self.found for w in ws]), self.size)
            last = np.repeat(np.cumsum(lengths), lengths)[: len(h)]
            inside = np.arange(len(h)) + self.size <= last  # the run ends in the document it starts in
            ends = np.cumsum([0, *np.maximum(lengths - self.size + 1, 0)])
            self.of_seed[seed] = h[inside], ends
        return self.of_seed[seed]


def search(part: _Slice, index: dict, strings) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, shared shingles, shingles of the item) of the items contained in the documents of a slice."""
    h, ends = part.hashes(index["seed"])
    at = np.flatnonzero(index["leading"][h >> np.uint64(44)])
    pos = np.searchsorted(index["hashes"], h[at])
    hit = pos < len(index["hashes"])
    hit[hit] = index["hashes"][pos[hit]] == h[at[hit]]
    at, pos = at[hit], pos[hit]
    if not len(at):
        return
    doc = np.searchsorted(ends, at, "right") - 1
    n = index["starts"][pos + 1] - index["starts"][pos]
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    near = np.unique(np.repeat(doc, n) * len(index["keys"]) + index["items"][np.repeat(index["starts"][pos], n) + offset])
    for d, group in pd.Series(near % len(index["keys"])).groupby(near // len(index["keys"])):
        own = np.unique(h[ends[d] : ends[d + 1]])
        exact = None
        for k in group:
            s, need = index["sets"][index["ends"][k] : index["ends"][k + 1]], index["need"][k]
            if len(own) < need:
                continue
            p = np.searchsorted(own, s)
            p[p == len(own)] = 0
            if (own[p] == s).sum() >= need:
                exact = shingles(part.texts[d], part.size) if exact is None else exact
                wanted = strings(index, k)
                shared = len(exact & wanted)
                if shared >= need:
                    yield d, int(index["keys"][k]), shared, len(wanted)


def _slices(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with about SLICE_CHARS characters; a longer text is a run of its own."""
    first, held, n = 0, [], 0
    for k, t in enumerate(texts):
        if held and n + len(t) > SLICE_CHARS:
            yield first, held
            first, held, n = k, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield first, held


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str,
    share: float = 0.3, size: int = 5, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): documents with at least ``share`` of an item's distinct shingles of ``size`` words.

    The items are a query set held against all documents in one pass, indexed in blocks of about ``block_chars`` characters
    of which a task holds one at a time. Null or empty texts and texts of fewer than ``size`` words match nothing;
    rows with a null id are left out; repeated documents are reported each; the texts of a repeated item id count as one
    item.
    """
    spark = docs.sparkSession
    stored = items.select(
        F.col(f"`{item_id}`").cast("bigint").alias("k"), F.col(f"`{item_text}`").alias("t")
    ).filter("k is not null and t is not null")
    chars = stored.agg(F.sum(F.length("t"))).first()[0] or 0
    n_blocks = max(1, math.ceil(chars / block_chars))
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter(
        F.col("doc_id").isNotNull() & (F.length("text") > 0)
    )
    blocks = []
    for b in range(n_blocks):
        block = stored.filter(F.pmod(F.xxhash64("k"), F.lit(n_blocks)) == b) if n_blocks > 1 else stored
        blocks.append(spark.sparkContext.broadcast(build_index([(r["k"], r["t"]) for r in block.collect()], size, share)))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(1_000)
        def of(b: int, k: int) -> frozenset[str]:
            return frozenset().union(*(shingles(t, size) for t in blocks[b].value["texts"][k]))

        seeds: dict[int, _WordHashes] = {}
        for p in batches:
            ids, out = p["doc_id"].to_numpy(), []
            for first, texts in _slices(p["text"]):
                part = _Slice(texts, size, seeds)
                for b, shared in enumerate(blocks):
                    found = search(part, shared.value, lambda _, k, b=b: of(b, k))
                    out += [(ids[first + d], *m) for d, *m in found]
                    if len(blocks) > 1:
                        del shared._value  # one block in memory at a time
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_shared", "n_item"])

    return rows.mapInPandas(probe, "doc_id bigint, item_id bigint, n_shared int, n_item int")
