import random

from claimloom.llm.leaks import SIGNS, WORDS, leaks, tokens

DOC = "doc_id long, text string, item_id string"
ITEM = "item_id long, lang string, passage string, text string"


def brute(docs, items):
    out = set()
    for d, text, *_ in docs:
        for i, lang, passage, *_ in items:
            if text is None or passage is None:
                continue
            signs = (lang or "").startswith("zh")
            n = SIGNS if signs else WORDS
            a, b = tokens(text, signs), tokens(passage, signs)
            grams = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
            if any(tuple(b[k : k + n]) in grams for k in range(len(b) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force_and_in_blocks(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, "en" if i % 4 else None, " ".join(rng.choices(vocab, k=rng.choice([5, 9, 10, 14, 40]))), "t") for i in range(30)]
    items += [(100, "zh", "仓石铁的商人用枚铁川换取坊桥与仓原却在秋铜之前被园桥原", "t"), (101, "zh", "短", "t"), (102, "en", None, "t"), (103, "en", "", "t")]
    docs = []
    for d in range(160):
        words = rng.choices(vocab, k=rng.choice([0, 8, 30, 200]))
        it = items[rng.randrange(30)][2].split()
        s = rng.randrange(max(1, len(it)))
        cut = it[s : s + rng.choice([9, 10, 20])]
        k = rng.randrange(len(words) + 1)
        docs.append((d, " , ".join(words[:k] + [w.upper() for w in cut] + words[k:]), "x"))
    docs += [(200, None, "x"), (201, "", "x"), (202, "前言：石铁的商人，用枚铁川换取 坊桥与仓原却在秋铜之前。", "x"), (203, "石铁的商人用枚铁", "x"), (204, "w1 " * 100_000, "x"), (200, None, "x")]
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    want = brute(docs, items)
    assert len(want) > 10 and (202, 100) in want
    assert {tuple(r) for r in leaks(d, i).collect()} == want
    assert {tuple(r) for r in leaks(d, i, block_windows=60).collect()} == want


def test_empty(spark):
    d, i = spark.createDataFrame([(1, "a", "x")], DOC), spark.createDataFrame([], ITEM)
    assert leaks(d, i).count() == 0 and leaks(d.limit(0), spark.createDataFrame([(1, "en", "a " * 12, "t")], ITEM)).count() == 0


def test_join_with_a_hot_word(spark):
    texts = [(d, "hot " * 400 + "b c d e f g h i j k", "x") for d in range(80)] + [(99, "hot b c d e f g h i j k", "x")]
    d = spark.createDataFrame(texts, DOC)
    i = spark.createDataFrame([(1, "en", "hot b c d e f g h i j", "t"), (2, "en", "b c d e f g h i j nowhere", "t")], ITEM)
    for block in (0, 100):
        assert {(r["doc_id"], r["item_id"]) for r in leaks(d, i, block_windows=block).collect()} == {(t[0], 1) for t in texts}
