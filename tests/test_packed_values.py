import random

from larder.operators.packed_values import fold_rule, split_packed, split_rule

SCHEMA = "recipe_id bigint, tags string, field_name string, _id int, item_value string"


def values(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in enumerate(texts)], SCHEMA)
    out = {i: [] for i in range(len(texts))}
    for r in split_packed(df, "recipe_id", ["tags"], **kw).orderBy("recipe_id", "item_pos").collect():
        assert r["item_pos"] == len(out[r["recipe_id"]]) + 1 and r["field_name"] == "tags"
        out[r["recipe_id"]].append(r["item_value"])
    return [out[i] for i in range(len(texts))]


CASES = {
    "a|b|c": ["a", "b", "c"],
    "['dill', 'the \"good\" salt', \"baker's\"]": ["dill", 'the "good" salt', "baker's"],
    '["the \\"good\\" lime", "olive oil; rinsed"]': ['the "good" lime', "olive oil; rinsed"],
    '"the ""good"" gouda"|butter': ['the "good" gouda', "butter"],
    "'it''s';x": ["it's", "x"],
    '{yam,"turkey breast",ricotta}': ["yam", "turkey breast", "ricotta"],
    " dairy-free|  grill|| pie |": ["dairy-free", "grill", "pie"],
    "salt\nblueberry | young turnip\tpear;2% milk, mac & cheese": [
        "salt", "blueberry", "young turnip", "pear", "2% milk", "mac & cheese"
    ],
    "baker's chocolate,cooks' pan": ["baker's chocolate", "cooks' pan"],
    '"", "  ", a': ["a"],
    '" padded "': ["padded"],
    "[]": [],
    "   ": [],
    '"never closed, b': ["never closed, b"],
    "a, a, a": ["a", "a", "a"],
    "crème brûlée • jalapeño": ["crème brûlée", "jalapeño"],
}


def test_cases(spark):
    assert values(spark, list(CASES)) == list(CASES.values())


def test_shuffled_rules_give_the_same(spark):
    assert values(spark, list(CASES), limit=0) == list(CASES.values())


def test_nulls_empty_table_and_long_text(spark):
    long = "|".join(f"v{i}" for i in range(20_000))
    assert values(spark, [None, "", long]) == [[], [], [f"v{i}" for i in range(20_000)]]
    assert split_packed(spark.createDataFrame([], SCHEMA), "recipe_id", ["tags"]).count() == 0


def test_null_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "recipe_id bigint, tags string")
    got = [tuple(r) for r in split_packed(df, "recipe_id", ["tags"]).collect()]
    assert sorted(got, key=str) == sorted([(None, "tags", 1, "a"), (1, "tags", 1, "a"), (1, "tags", 1, "a")], key=str)


def test_rule_of_a_skeleton():
    assert split_rule("a|a") == [(1, 1, ""), (3, 1, "")]
    assert split_rule('["a"]') == [(3, 1, '"')]
    assert split_rule("s'a'") == [(3, 1, "'")]


def test_a_fold_does_not_tell_how_often_it_repeats():
    assert fold_rule("{a,}a").vals == [(1, 0, 1, 0, 1, 2, ""), (3, 1, 1, 0, 0, 0, "")]
    assert fold_rule('"{a,}a"').vals == [(2, 0, 3, 1, 0, 0, '"')]
    assert fold_rule('"{"a",}') is None


def brute(t):
    """The statement of the problem, character by character."""
    plain = lambda c: c.isalpha() or c.isdigit() or c in " -'&%."
    out, i = [], 0
    while i < len(t):
        if t[i] in "'\"":
            q, j, v = t[i], i + 1, ""
            while j < len(t):
                if t[j] == "\\" and j + 1 < len(t) and t[j + 1] in "'\"":
                    v, j = v + t[j + 1], j + 2
                elif t[j] == q and j + 1 < len(t) and t[j + 1] == q:
                    v, j = v + q, j + 2
                elif t[j] == q:
                    break
                else:
                    v, j = v + t[j], j + 1
            i = j + 1
        elif plain(t[i]) and t[i] != " ":
            j = i
            while j < len(t) and plain(t[j]):
                j += 1
            v, i = t[i:j], j
        else:
            i += 1
            continue
        if v.strip(" \t\r\n"):
            out.append(v.strip(" \t\r\n"))
    return out


def test_random_strings_equal_brute_force(spark):
    r = random.Random(11)
    texts = ["".join(r.choice("ab ,;|'\"\\") for _ in range(r.randint(1, 14))) for _ in range(3000)]
    texts += [r.choice(",;|").join(r.choice(["a", "b c", '"x, y"', "'q'", "it's", '"a""b"', "'a,b,c,d'"]) for _ in range(r.randint(1, 9))) for _ in range(1500)]
    got = values(spark, texts)
    bad = [(t, g, brute(t)) for t, g in zip(texts, got, strict=True) if g != brute(t)]
    assert not bad, bad[:5]
