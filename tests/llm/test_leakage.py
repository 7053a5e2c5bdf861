import random
import time

import numpy as np
import pytest

from seqmill.llm import leakage as L

WORDS = "the pale marker crossed every narrow basin beside a folded voucher while its tail joined some coarse archive under this hidden ridge before spring rain reached old stone walls near quiet water".split()
ITEM = " ".join(random.Random(1).sample(WORDS, 28)) + " and " + " ".join(random.Random(2).sample(WORDS, 28)) + "."


def found(texts, items=((7, ITEM),)):
    return sorted(L.Finder(list(items)).find([L.letters(t) for t in texts]))


def words(a, b):
    return " ".join(ITEM.split()[a:b])


def test_parts_of_an_item():
    other = "Nothing of the kind is written here, only some other sentence about weather. "
    texts = [other + ITEM, other + words(0, 30) + ". " + other, words(20, 57), other + words(10, 22) + other, other, "", words(0, 20) + " " + other * 2 + words(40, 57)]
    assert [d for d, _ in found(texts)] == [0, 1, 2]


def test_changes_that_hide_nothing():
    plain = ITEM.split()
    odd = [f"<b>{w}</b>" if i % 3 == 0 else f"**{w}**" if i % 5 == 0 else w for i, w in enumerate(plain)]
    wide = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in ITEM)
    swapped = [w if i % 9 else "changed" for i, w in enumerate(plain)]
    typos = [w if i % 8 else w[:-1] + "q" for i, w in enumerate(plain)]
    texts = ["&nbsp;".join(odd), ITEM.upper(), wide, "\n  ".join(plain), " ".join(swapped), " ".join(typos), ITEM.replace("e", "e­"), ", ".join(plain)]
    assert [d for d, _ in found(texts)] == list(range(len(texts)))


def test_dense_script():
    item = "阅读下文并写出合适的标记光滑的索引标记了苍白的间隔隐藏的引物替换了光滑的山坡简短的标签替换了上部的序列"
    texts = ["前文。" + item, item[:30] + "后文", item[:15] + "后文", " ".join(item)]
    assert [d for d, _ in found(texts, ((1, item),))] == [0, 1, 3]


def coded(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@pytest.mark.parametrize("m, stride", [(1, 1), (3, 1), (8, 2), (16, 5), (20, 3), (300, 7)])
def test_search_finds_every_window(m, stride):
    rng = random.Random(3)
    items = [L.Item(k, "".join(rng.choice("abcd") for _ in range(60 if m < 60 else 900)), 0.5) for k in range(5)]
    s = L.WuManber(m, stride, items)
    text = "".join(rng.choice("abcd") for _ in range(3000)) + items[2].letters + "日本" + items[4].letters[10:45] + items[0].letters
    p, w = s.search(coded(text))
    got = {(x, k, i) for x, y in zip(p.tolist(), w.tolist()) for k, i in zip(s.owner[s.first[y] : s.first[y + 1]].tolist(), s.start[s.first[y] : s.first[y + 1]].tolist())}
    starts = lambda n: {*range(0, n - m + 1, stride), n - m}
    want = {(x, k, i) for k, it in enumerate(items) for i in starts(len(it.letters)) for x in range(len(text) - m + 1) if text[x : x + m] == it.letters[i : i + m]}
    assert got == want and want


def test_search_leaps():
    rng = random.Random(5)
    text = L.letters(" ".join(rng.choice(WORDS) for _ in range(20_000)))
    s = L.WuManber(L.WINDOW, 5, [L.Item(0, ITEM, 0.5)])
    s.search(coded(text))
    assert 0 < s.visited < len(text) / 3


def test_many_items_share_a_task_line():
    rng = random.Random(8)
    line = "Read the following passage with care and answer the question below it: "
    body = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(24))
    items = [(k, line + body()) for k in range(10_000)]
    finder = L.Finder(items)
    assert any(c for *_, c in finder.searches)
    texts = [L.letters(t) for t in (line + body(), items[77][1], line + " ".join(items[5][1].split()[13:24]), "x " + line, line + items[9][1][len(line) :].replace("a", "a-"), line * 3)]
    began = time.process_time()
    assert sorted(finder.find(texts * 20)) == sorted((6 * r + d, i) for r in range(20) for d, i in ((1, 77), (2, 5), (4, 9)))
    assert time.process_time() - began < 10


@pytest.mark.parametrize("shared", [1, 4])
def test_common_windows_lose_nothing(monkeypatch, shared):
    rng = random.Random(11)
    parts = [" ".join(rng.sample(WORDS, 9)) for _ in range(6)]
    items = [(k, ". ".join(rng.choice(parts) for _ in range(4)) + " " + " ".join(rng.sample(WORDS, 6))) for k in range(12)] + [(99, "阅读下文并写出合适的标记光滑的索引")]
    texts = [L.letters(" ".join(rng.choice(parts) if rng.random() < 0.7 else rng.choice(items)[1] for _ in range(5))) for _ in range(60)]
    want = sorted(L.Finder(items).find(texts))
    monkeypatch.setattr(L, "SHARED", shared)
    finder = L.Finder(items)
    assert any(c for *_, c in finder.searches)
    assert sorted(finder.find(texts)) == want and want


def test_operator(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x " + ITEM, 3), (2, None, 3), (3, "", 3), (4, "z " * 200_000 + ITEM, 3)], "doc_id long, text string, i int")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "!!"), (10, ITEM)], "item_id long, text string")
    want = [(1, 7), (1, 10), (4, 7), (4, 10)]
    assert sorted(map(tuple, L.leaked(docs, items).collect())) == want
    monkeypatch.setattr(L, "ITEM_LETTERS", 100)  # several blocks of items
    assert sorted(map(tuple, L.leaked(docs, items).collect())) == want
    assert L.leaked(docs.limit(0), items).count() == 0
    assert L.leaked(docs, items.limit(0)).count() == 0


def test_tags_of_any_length_hide_nothing():
    tag = '<span class="' + "narrow basin of old stone " * 20 + '">'
    cuts = ITEM.split()
    texts = [" ".join(w if i % 7 else f"{tag}{w}</span>" for i, w in enumerate(cuts)), " ".join(cuts)]
    assert [d for d, _ in found(texts)] == [0, 1]
    assert L.plain(f"a{tag}b</span> < c") == "ab < c"
