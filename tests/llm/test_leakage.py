import random

from memloom.llm import leakage

ITEM = "The ferrywarden recalled the old funicular differently, insisting that juniper oil had spoiled first. Judge whether amber resin from Corvane predates the grand pageant by more than twenty five seasons of rain."
ZH = "驯鹰人坚称奥斯特滩的缆车之前茜草根就已经坏了雾起之时仍有人替发光的茶炊上弦直到望见引水渠请判断辛布拉城的琥珀脂是否更早"
FILLER = "They want to walk the ridge in the morning and nobody has objected so far. "


def test_tokens_ignore_case_punctuation_spacing_escaping():
    assert leakage.tokens("Föö&nbsp;BAR\\n\\u0062az%20q — 上 海") == ["föö", "bar", "baz", "q", "上", "海"]


def changed(text, every, seed=1):
    r = random.Random(seed)
    words = text.split()
    for i in range(every // 2, len(words), every):
        words[i] = r.choice(["pickled", "mint", "barley"])
    return " ".join(words)


def test_leaks_and_near_misses(spark):
    words = ITEM.split()
    docs = {
        1: FILLER * 3 + ITEM.upper() + FILLER,
        2: FILLER + changed(ITEM, 10) + FILLER,
        3: FILLER + " ".join(words[:20]) + ". " + FILLER,  # more than half
        4: FILLER + " ".join(words[:9]) + ". " + FILLER,  # less
        5: FILLER + changed(ITEM, 3) + FILLER,  # resembles
        6: " ".join(words[:16]) + " " + FILLER + " ".join(words[16:]),  # cut in two
        7: " ".join(reversed(words)),
        8: FILLER * 20,
        9: "".join(f"{c} ，" for c in ZH),
        10: ZH[:20],
        11: None,
        12: "",
        13: ITEM.replace(" ", "\n"),
    }
    df = spark.createDataFrame([(k, t, "clash") for k, t in docs.items()], "doc_id long, text string, term string")
    found = {(r.doc_id, r.item_id) for r in leakage.find(df, [(7, ITEM), (8, ZH), (9, ""), (10, "one")]).collect()}
    assert found == {(1, 7), (2, 7), (3, 7), (6, 7), (13, 7), (9, 8)}


def test_no_items_no_documents(spark):
    df = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert leakage.find(df, []).count() == 0 and leakage.find(df.limit(0), [(1, ITEM)]).count() == 0


def test_a_long_repetitive_text_takes_linear_time():
    import time

    import numpy as np

    item = leakage.Item(1, "the lamp and the door and the lamp and the gate")
    at = {}
    for pair in item.pairs:
        at.setdefault(pair, len(at))
    took = []
    for n in (2_000, 16_000):
        found = leakage.tokens("the lamp and the door and " * (n // 6))
        hits = [(at[p], i) for i, p in enumerate(zip(found, found[1:])) if p in at]
        began = time.perf_counter()
        assert leakage.held(item, at, np.array([t for t, _ in hits]), np.array([i for _, i in hits]))[0] >= 6
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]


def test_items_in_blocks_and_as_a_table(spark):
    df = spark.createDataFrame([(1, FILLER + ITEM), (2, ZH)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, ZH), (9, None)], "item_id long, text string")
    for size in (1, 10_000):
        assert {(r.doc_id, r.item_id) for r in leakage.find(df, items, block_chars=size).collect()} == {(1, 7), (2, 8)}
