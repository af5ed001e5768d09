"""Missing or wrong language labels: language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each slot, one bit per language. The AND of the slots of an n-gram gives the set of
languages that contain it in one look-up; the popcounts per language, corrected for each filter's false positives,
score words. The clauses of a text are labelled by the cheapest path through their scores, so that a change of language
has to be borne out by several words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.session import materialize

#: Two-letter codes told apart here; fixed values.
LANGUAGES = ("en", "fr", "de", "es", "it", "nl", "pt")
#: Bound of the labelled sample: documents per label, and their length in code points.
SAMPLE_DOCS, SAMPLE_CHARS = 300, (100, 20_000)

_LETTERS = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?…\n:;()\[\]]+|,")
#: Longest clause that is labelled as a whole; longer ones, of text without punctuation, are taken in pieces of PIECE_WORDS
#: words, short enough for a run of another language inside a sentence to fill some.
CLAUSE_WORDS, PIECE_WORDS = 16, 4
#: Words whose scores a task keeps.
KNOWN_WORDS = 200_000
#: Cost, in words, of a change of language at the end of a sentence and elsewhere.
COST_END, COST_IN = 1.2, 3.0


def clauses(text: str) -> list[tuple[list[str], float, int, int]]:
    """(words, cost of a change before it, start, end) of each clause that has words."""
    out: list[tuple[list[str], float, int, int]] = []
    at, cost = 0, COST_END
    for m in [*_CLAUSE.finditer(text), None]:
        end = m.start() if m else len(text)
        words = _LETTERS.findall(text[at:end].lower())
        if len(words) > CLAUSE_WORDS:
            found = [(w.start(), w.end(), w.group().lower()) for w in _LETTERS.finditer(text, at, end)]
            for k in range(0, len(found), PIECE_WORDS):
                part = found[k : k + PIECE_WORDS]
                out.append(([w for _, _, w in part], cost if k == 0 else COST_IN, part[0][0], part[-1][1]))
        elif words:
            out.append((words, cost, at, end))
        if m:
            sep = COST_IN if m.group() in (",", "(", ")") else COST_END
            cost = sep if words else min(cost, sep)
            at = m.end()
    return out


def grams(word: str) -> list[str]:
    """The n-grams of a word: itself, and its runs of 2 to 4 with the ends marked."""
    w = f"<{word}>"
    out = [w]
    for n in (2, 3, 4):
        out += [w[i : i + n] for i in range(len(w) - n + 1) if n < len(w)]
    return out


@dataclass
class BitSlicedFilter:
    """Bloom filters of several languages in one array: bit l of a slot belongs to language l. Slots are as wide as the
    languages need, at most 64 of them."""

    log_slots: int = 19
    hashes: int = 4
    languages: int = 8
    slots: np.ndarray = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        if self.slots is None:
            width = next((w for w in (8, 16, 32, 64) if self.languages <= w), None)
            if width is None:
                raise ValueError(f"{self.languages} languages, at most 64")
            self.slots = np.zeros(1 << self.log_slots, dtype=f"uint{width}")

    def _places(self, gram: str) -> list[int]:
        h = xxhash.xxh3_64_intdigest(gram)
        a, b, m = h & 0xFFFFFFFF, (h >> 32) | 1, (1 << self.log_slots) - 1
        return [(a + i * b) & m for i in range(self.hashes)]

    def add(self, gram: str, mask: int) -> None:
        for p in self._places(gram):
            self.slots[p] |= self.slots.dtype.type(mask)

    def mask(self, gram: str) -> int:
        """All languages that contain the n-gram, as a bitmask; false positives are possible, misses are not."""
        out = (1 << 8 * self.slots.dtype.itemsize) - 1
        for p in self._places(gram):
            out &= int(self.slots[p])
        return out

    def false_rates(self, n: int) -> np.ndarray:
        """Per language, how often an n-gram that was not added seems to be in."""
        one = self.slots.dtype.type
        return np.array([float(np.mean((self.slots >> one(k)) & one(1))) ** self.hashes for k in range(n)])


class Detector:
    """Scores words by corrected popcounts and labels the clauses of texts."""

    def __init__(self, filters: BitSlicedFilter, languages: tuple[str, ...] = LANGUAGES):
        self.filters, self.languages = filters, languages
        self.false = filters.false_rates(len(languages))
        self._rows: dict[str, int] = {}
        self._table = np.zeros((1024, len(languages)))

    def score(self, word: str) -> np.ndarray:
        """Share of the word's n-grams that each language contains, corrected for false positives and squared: a word
        most of whose n-grams are foreign says little for the language of the rest."""
        gs = grams(word)
        n = np.zeros(len(self.languages))
        for g in gs:
            m = self.filters.mask(g)
            for k in range(len(self.languages)):
                n[k] += (m >> k) & 1
        return np.clip((n / len(gs) - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1) ** 2

    def row(self, word: str) -> int:
        """The word's row in the table of scores, which is started anew when it has become large."""
        got = self._rows.get(word)
        if got is None:
            got = self._rows[word] = len(self._rows)
            if got == len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            self._table[got] = self.score(word)
        return got

    def scores(self, parts: list[list[str]]) -> np.ndarray:
        """The summed scores of each list of words, none of them empty."""
        if len(self._rows) > KNOWN_WORDS:
            self._rows, self._table = {}, np.zeros((1024, len(self.languages)))
        rows = [self.row(w) for ws in parts for w in ws]
        starts = np.cumsum([0, *(len(ws) for ws in parts[:-1])])
        return np.add.reduceat(self._table[rows], starts, axis=0)

    def segments(self, text: str | None) -> list[tuple[int, int, str | None, int, float]]:
        """(start, end, language, words, confidence) of each stretch of one language, by offsets into the NFKC text.

        Texts without letters give none; a stretch whose words no filter knows has no language.
        """
        if not text:
            return []
        cl = clauses(text if text.isascii() else unicodedata.normalize("NFKC", text))
        if not cl:
            return []
        score = self.scores([c[0] for c in cl])
        path = self._path(score, [c[1] for c in cl])
        out, i = [], 0
        while i < len(cl):
            j = i
            while j < len(cl) and path[j] == path[i]:
                j += 1
            s = score[i:j].sum(axis=0)
            rest = np.delete(s, path[i]).max()
            n = sum(len(c[0]) for c in cl[i:j])
            own = s[path[i]]
            lang = self.languages[path[i]] if own > 0 else None
            out.append((cl[i][2], cl[j - 1][3], lang, n, float((own - rest) / own) if own > 0 else 0.0))
            i = j
        return out

    @staticmethod
    def _path(score: np.ndarray, cost: list[float]) -> list[int]:
        """The best language of each clause, a change before clause i costing ``cost[i]``."""
        top = score.argmax(axis=1)
        if (top == top[0]).all():  # no path is better than the best clause by clause without a change
            return [int(top[0])] * len(score)
        best, back = score[0].tolist(), []
        for s, c in zip(score[1:].tolist(), cost[1:], strict=True):
            k = best.index(max(best))
            move = best[k] - c
            back.append([j if b >= move else k for j, b in enumerate(best)])
            best = [(b if b >= move else move) + x for b, x in zip(best, s, strict=True)]
        path = [best.index(max(best))]
        for b in reversed(back):
            path.append(b[path[-1]])
        return path[::-1]


def _build(counts: dict[str, Counter], keep: float, log_slots: int) -> BitSlicedFilter:
    """A language contains an n-gram if its relative frequency there is at least ``keep`` of the highest one."""
    f = BitSlicedFilter(log_slots, languages=len(counts))
    totals = {k: max(1, sum(c.values())) for k, c in counts.items()}
    for g in set().union(*counts.values()):
        rate = [counts[k][g] / totals[k] if counts[k][g] > 1 else 0.0 for k in counts]
        top = max(rate)
        mask = sum(1 << i for i, r in enumerate(rate) if top > 0 and r >= keep * top)
        if mask:
            f.add(g, mask)
    return f


def train(
    sample: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES, rounds: int = 2, log_slots: int = 19
) -> Detector:
    """Fits the filters to (label, text). As labels may be wrong and texts mixed, the clauses are labelled anew by the
    first fit and counted again."""
    texts = [(lang, clauses(unicodedata.normalize("NFKC", t))) for lang, t in sample]
    marked = [(lang, ws) for lang, cl in texts for ws, *_ in cl]
    detector = None
    for r in range(rounds + 1):
        counts: dict[str, Counter] = {k: Counter() for k in languages}
        word_counts: dict[str, Counter] = {k: Counter() for k in languages}
        for lang, ws in marked:
            word_counts[lang].update(ws)
        for lang, c in word_counts.items():
            for w, n in c.items():
                for g in grams(w):
                    counts[lang][g] += n
        detector = Detector(_build(counts, 0.3 if r == 0 else 0.08, log_slots), languages)
        if r < rounds:
            marked = []
            for _, cl in texts:
                for ws, *_ in cl:
                    if len(ws) >= 3:
                        s = detector.scores([ws])[0]
                        k = int(np.argmax(s))
                        if s[k] > 1.15 * np.delete(s, k).max():
                            marked.append((languages[k], ws))
    assert detector is not None
    return detector


def save(spark: SparkSession, detector: Detector, path: str) -> None:
    """Stores the filters as a table of one row, so that a fit is used again."""
    f = detector.filters
    row = (list(detector.languages), f.log_slots, f.hashes, bytearray(f.slots.tobytes()), str(f.slots.dtype))
    schema = "languages array<string>, log_slots int, hashes int, slots binary, kind string"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Detector:
    r = spark.read.parquet(path).first()
    slots = np.frombuffer(r["slots"], dtype=r["kind"])
    return Detector(BitSlicedFilter(r["log_slots"], r["hashes"], len(r["languages"]), slots), tuple(r["languages"]))


def labelled_sample(
    docs: DataFrame, doc_id: str, text: str, lang: str, per_label: int = SAMPLE_DOCS
) -> list[tuple[str, str]]:
    """Up to ``per_label`` documents of each plain two-letter label, picked by the hash of their id. Only ids are ranked; the
    texts are fetched for the picked ones. A repeated id counts once, with its smallest text."""
    label = F.lower(F.trim(F.col(f"`{lang}`")))
    rows = docs.select(label.alias("lang"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.filter(F.col("lang").isin(*LANGUAGES) & F.length("text").between(*SAMPLE_CHARS) & F.col("id").isNotNull())
    ids = rows.select("lang", "id").distinct().withColumn("h", F.xxhash64("id"))
    w = Window.partitionBy("lang").orderBy("h", "id")
    picked = ids.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_label)
    few = F.broadcast(materialize(picked.select("lang", "id", "rn"), "picked"))  # at most per_label rows a language
    got = rows.join(few, ["lang", "id"]).groupBy("lang", "rn").agg(F.min("text").alias("text"))
    return [(r["lang"], r["text"]) for r in sorted(got.collect(), key=lambda r: (r["lang"], r["rn"]))]


SEGMENTS = "doc_id bigint, segment_no int, start int, end int, lang string, n_words int, confidence double"


def label_segments(docs: DataFrame, detector: Detector, doc_id: str, text: str) -> DataFrame:
    """(doc_id, segment_no, start, end, lang, n_words, confidence) for each stretch of one language.

    ``start`` and ``end`` are code points of the text in NFKC. Null, empty and letterless texts give no row; rows with
    a null id are left out; repeated rows are labelled each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (detector.filters.slots, detector.filters.log_slots, detector.filters.hashes, detector.languages)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, log_slots, hashes, languages = shared.value
        d = Detector(BitSlicedFilter(log_slots, hashes, len(languages), slots), languages)
        for b in batches:
            out = [
                (i, k + 1, *s) for i, t in zip(b["doc_id"], b["text"], strict=True) for k, s in enumerate(d.segments(t))
            ]
            yield pd.DataFrame(out, columns=["doc_id", "segment_no", "start", "end", "lang", "n_words", "confidence"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.filter("doc_id is not null and length(text) > 0").mapInPandas(run, SEGMENTS)


def document_languages(segments: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, n_all, share, confidence): the languages of each document; share of all its words.

    The sums per document and language are written first, so that the texts are labelled once.
    """
    per = segments.groupBy("doc_id", "lang").agg(
        F.sum("n_words").alias("n_words"), (
            F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")
        ).alias("confidence")
    )
    per = materialize(per, "languages")
    total = per.groupBy("doc_id").agg(F.sum("n_words").alias("n_all"))
    return per.join(total, "doc_id").select(
        "doc_id", "lang", "n_words", "n_all", (F.col("n_words") / F.col("n_all")).alias("share"), "confidence"
    )


def doubtful_labels(
    docs: DataFrame, segments: DataFrame, doc_id: str, lang: str, share: float = 0.15, min_words: int = 20
) -> DataFrame:
    """(doc_id, lang): documents of several languages, or whose label is not the code of their only one."""
    found = document_languages(segments).filter(
        F.col("lang").isNotNull() & (F.col("share") >= share) & (F.col("n_all") >= min_words)
    )
    found = materialize(found.select("doc_id", F.col("lang").alias("found")), "languages")
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    label = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.lower(F.trim(F.col(f"`{lang}`"))).alias("label"))
    rows = found.join(n, "doc_id").join(label, "doc_id")
    return rows.filter(
        (F.col("n") > 1) | ~F.col("found").eqNullSafe(F.col("label"))
    ).select("doc_id", F.col("found").alias("lang")).distinct()
