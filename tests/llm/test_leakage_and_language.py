import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import language as L
from larder.llm import leakage as K
from larder.session import scratch_path

DOCS = "doc_id bigint, text string, lang string, item_id int, n_shared int"


def test_words():
    assert K.words("Crème BRÛLÉE, 2½ cups_x été") == ["creme", "brulee", "2½", "cups", "x", "ete"]
    assert K.words("") == [] and K.words(" !?") == []


def test_leaks_equal_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}é" for i in range(40)] + ["alpha", "beta"]
    line = " ".join(r.choices(vocabulary, k=12))
    items = {i: " ".join([line] * (i % 3 == 0) + r.choices(vocabulary, k=r.randint(3, 60))) for i in range(40)}
    docs = {}
    for d in range(120):
        parts = r.choices(vocabulary, k=r.randint(0, 200))
        if d % 2:
            words = items[r.randrange(40)].split()
            k = int(len(words) * r.random())
            parts[5:5] = words[k // 2 : k // 2 + k]
        text = " ".join(parts)
        docs[d] = unicodedata.normalize("NFD", text.upper()) if d % 3 == 0 else text
    docs |= {500: None, 501: "", 502: line, 503: "word " * 100_000}
    want = set()
    for d, t in docs.items():
        own = K.shingles(t or "", 5)
        for i, x in items.items():
            s = K.shingles(x, 5)
            if s and 10 * len(own & s) >= 3 * len(s):
                want.add((d, i, len(own & s), len(s)))
    left = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs.items()] + [(None, line, "x", 1, 2)], DOCS)
    right = spark.createDataFrame(
        [(i, x, 0) for i, x in items.items()] + [(None, "a b c d e f", 0), (99, None, 0)],
        "item_id bigint, text string, doc_id int"
    )
    for block in (10**7, 1500):
        got = K.find_leaks(left, right, "doc_id", "text", "item_id", "text", block_chars=block)
        assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert len(want) > 20


def test_sketches_are_as_long_as_the_share_needs():
    s = np.unique(K.shingle_hashes(np.arange(1, 55, dtype=np.uint64), 5))
    assert len(s) == 50 and list(K.sketch(s, 0.3)) == sorted(s)[: 50 - 15 + 1]
    assert list(K.sketch(s[:1], 0.3)) == [s[0]]


def test_hashes_are_those_of_the_runs_of_one_document():
    part = K._Slice(["a b c d e f", "", "x y", "b c d e f"], 5, {})
    h, ends = part.hashes(0)
    assert list(ends) == [0, 2, 2, 2, 3] and h[1] == h[2] != h[0]


def test_no_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "en", 0, 0)], DOCS)
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert K.find_leaks(docs, items, "doc_id", "text", "item_id", "text").count() == 0
    assert K.find_leaks(
        docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text"), "doc_id", "text", "item_id", "text"
    ).count() == 0


WORDS = {
    "en": "the whole family thought this stew was too salty so we added some potatoes and waited until they were soft",
    "fr": "nous avons remplacé les pommes par des noix parce que ma voisine trouve cette soupe un peu trop épicée",
    "de": "wir haben die zwiebeln durch karotten ersetzt weil es im laden keine mehr gab und das schmeckt noch besser",
    "es": "hice esta receta en casa de mi vecina y el resultado quedó muy sabroso aunque le faltaba un poco de sal",
    "it": "abbiamo sostituito le cipolle con spinaci perché al negozio non c'erano più e il risultato era croccante",
    "nl": "wij vonden de pannenkoek lekker ook al was het een beetje te romig en we hebben de rijst vervangen door brood",
    "pt": "trocámos as batatas por maçãs porque já não havia mais na loja e a minha família gostou muito da sopa",
}


def sentence(r, lang):
    w = WORDS[lang].split()
    k = r.randrange(len(w) - 8)
    return " ".join(w[k : k + r.randint(6, 8)]).capitalize() + r.choice([". ", "! ", ".\n"])


def corpus(seed, n, wrong=0.1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        lang = r.choice(list(WORDS))
        mixed = r.choice([x for x in WORDS if x != lang]) if r.random() < 0.2 else None
        parts = [sentence(r, lang) for _ in range(8)] + [sentence(r, mixed) for _ in range(4 if mixed else 0)]
        label = r.choice(list(WORDS)) if r.random() < wrong else lang
        out.append(("".join(parts), label, {lang} | ({mixed} if mixed else set())))
    return out


def test_held_out_accuracy_with_wrong_labels_in_training():
    d = L.train([(lang, t) for t, lang, _ in corpus(1, 300)])
    right = 0
    held = corpus(2, 200)
    for t, _, want in held:
        n = {}
        for *_, lang, k, _ in d.segments(t):
            n[lang] = n.get(lang, 0) + k
        right += {x for x, k in n.items() if k >= 0.15 * sum(n.values())} == want
    assert right >= 0.97 * len(held)


def test_filter_never_misses_and_false_rates_are_estimated():
    f = L.BitSlicedFilter(12, 3)
    for i in range(600):
        f.add(f"g{i}", 1 << (i % 7))
    assert all(f.mask(f"g{i}") >> (i % 7) & 1 for i in range(600))
    seen = sum(f.mask(f"other{i}") & 1 for i in range(20_000)) / 20_000
    assert abs(seen - f.false_rates(7)[0]) < 0.01


def test_segments_and_labels(spark):
    d = L.train([(lang, t) for t, lang, _ in corpus(1, 300)])
    r = random.Random(5)
    mono, mixed = "".join(
        sentence(r, "de") for _ in range(6)
    ), "".join(sentence(r, "en") for _ in range(6)) + "".join(sentence(r, "pt") for _ in range(3))
    data = [
        (1, mono, "de"), (2, mono, "DE "), (3, mono, "de-DE"), (4, mono, None), (5, mixed, "en"), (6, None, "en"),
        (7, "", "en"), (8, "12 / 45", "en"), (9, "Guten Tag", "xx"), (None, mono, "en"), (10, mono * 300, "fr")
    ]
    df = spark.createDataFrame([(*x, 0, 0) for x in data], DOCS)
    seg = L.label_segments(df, d, "doc_id", "text")
    got = {tuple(x) for x in L.doubtful_labels(df, seg, "doc_id", "lang").collect()}
    assert got == {(3, "de"), (4, "de"), (5, "en"), (5, "pt"), (10, "de")}
    rows = seg.filter("doc_id = 5").orderBy("segment_no").collect()
    assert [x["lang"] for x in rows] == ["en", "pt"] and all(0 < x["confidence"] <= 1 for x in rows)
    assert abs(sum(x["share"] for x in L.document_languages(seg).filter("doc_id = 5").collect()) - 1) < 1e-9
    assert L.label_segments(df.limit(0), d, "doc_id", "text").count() == 0
    assert L.train([]).segments("no model at all") != [] and L.train([]).segments("x")[0][2] is None


def test_a_second_language_inside_unpunctuated_text():
    d = L.train([(lang, t) for t, lang, _ in corpus(1, 300)])
    r = random.Random(6)
    plain = lambda lang, n: " ".join(sentence(r, lang).strip(" .!\n").lower() for _ in range(n))
    for a, b in (("de", "en"), ("fr", "nl"), ("es", "de")):
        text = f"{plain(a, 3)} {plain(b, 2)} {plain(a, 4)}"
        n = {}
        for *_, lang, k, _ in d.segments(text):
            n[lang] = n.get(lang, 0) + k
        assert {x for x, k in n.items() if k >= 0.15 * sum(n.values())} == {a, b}


def test_filters_are_stored_and_as_wide_as_the_languages(spark):
    d = L.train([(lang, t) for t, lang, _ in corpus(1, 100)])
    path = scratch_path(spark, "filters")
    L.save(spark, d, path)
    again = L.load(spark, path)
    text = "".join(t for t, *_ in corpus(3, 5))
    assert again.segments(text) == d.segments(text)
    f = L.BitSlicedFilter(10, 3, 20)
    f.add("g", 1 << 19)
    assert f.mask("g") == 1 << 19 and f.false_rates(20)[19] > 0
    with pytest.raises(ValueError):
        L.BitSlicedFilter(10, 3, 65)


def test_sample_is_bounded(spark):
    df = spark.createDataFrame(
        [(i, "word " * 40, "en" if i % 2 else "EN ", 0, 0) for i in range(50)] + [(99, "x" * 500, "zz", 0, 0)], DOCS
    )
    assert len(L.labelled_sample(df, "doc_id", "text", "lang", 10)) == 10
