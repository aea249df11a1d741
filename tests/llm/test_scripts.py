import random

from loomspan.llm import decontaminate

from .helpers import docs

ITEMS = [
    "春天的早晨，孩子们在河边的小路上慢慢地走着。",
    "こんにちは、世界！今日はとてもいい天気ですね。",
    "สวัสดีครับ วันนี้อากาศดีมากและท้องฟ้าสดใส",
    "быстрая лисица прыгает через ленивую собаку",
    "the “quick” fox — it’s over the lazy dog",
    "中文，测试",
    "two words",
    "two words",
]


def found(spark, texts, items=ITEMS):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: r["items"] for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}


def test_items_of_all_scripts_and_lengths_are_found(spark):
    texts = [
        "前言。" + ITEMS[0] + "后记很长很长。",
        "序文です。" + ITEMS[1].replace("！", "!") + "おわり",
        "ก่อน " + ITEMS[2] + " หลัง",
        "Вот: БЫСТРАЯ лисица «прыгает» через ленивую собаку…",
        "see the \"quick\" fox - it's over the lazy dog here",
        "一份中文、测试资料",
        "only TWO words, here",
        "two other words, words two",
        "完全不同的句子，没有任何泄漏的内容在这里出现。",
        None,
    ]
    got = found(spark, texts)
    assert [got[k] for k in range(10)] == [[0], [1], [2], [3], [4], [5], [6, 7], [], [], []]


def test_short_items_equal_a_plain_search(spark):
    rng = random.Random(3)
    items = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    got = found(spark, texts, items)
    for i, text in enumerate(texts):
        assert got[i] == [k for k, x in enumerate(items) if f" {x} " in f" {text} "]


def test_both_ways_to_words_agree():
    """What is separated character by character has the words that the bytes give."""
    for text in ("Élève «naïve» — ½ x² a×b", "ÀÉÎ ß ÿ ª º µ ÷ ¿qué?", "don't e-mail 12,5"):
        plain = "".join(c for c in text if ord(c) < 256)
        a = decontaminate.words([plain.encode()])[0].tolist()
        assert a == decontaminate.words([decontaminate.separated(plain.encode())])[0].tolist()
        assert decontaminate.words([(plain + " Ж").encode()])[0].tolist()[:-1] == a
