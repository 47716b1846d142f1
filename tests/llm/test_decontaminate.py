import random

import numpy as np
from logsluice.llm import decontaminate as d
from logsluice.llm.common import word_hashes

BENCH = "item_id long, text string"


def tokens_of(text):
    return word_hashes([text or ""])[0].tolist()


def lay_over(doc, item, seeded=True):
    """The most matching words in one stretch, over all alignments (or those that share a masked place)."""
    best = 0
    for o in range(-len(item) + 1, len(doc)):
        places = range(max(0, -o), min(len(item), len(doc) - o))
        same = np.array([doc[p + o] == item[p] for p in places])
        hit = not seeded
        for mask in d.masks_of(len(item)):
            hit = hit or any(all(m == "0" or x for m, x in zip(mask, same[k : k + len(mask)])) for k in range(len(same) - len(mask) + 1))
        if hit:
            top = max(((sum(2 * x - 1 for x in same[a:b].astype(int)), int(same[a:b].sum())) for a in range(len(same)) for b in range(a, len(same) + 1)), default=(0, 0))
            best = max(best, top[1])
    return best if d.enough(best, len(item)) else 0


def test_against_brute_force(spark, documents):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [[rng.choice(words) for _ in range(rng.choice((3, 7, 9, 14, 25, 40)))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " ".join(items[0]))]
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(60))]
        if k % 2:
            part = list(rng.choice(items))
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "zz"
            part = part[rng.randrange(3) :]
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        rows.append((10 + k, ", ".join(text).upper() if k % 3 else " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, "")], BENCH)
    found = {(r.doc_id, r.item_id): r.matches for r in d.overlaps(documents(rows), bench).collect()}
    expected = {}
    for key, text in rows:
        for i, item in enumerate(items):
            if m := lay_over(tokens_of(text), tokens_of(" ".join(item))):
                expected[key, i] = m
    assert found == expected
    clean = {r.doc_id for r in d.without(documents(rows), bench).collect()}
    assert clean == {k for k, _ in rows} - {k for k, _ in expected}


def test_substitutions_are_tolerated(spark, documents):
    item = [f"t{i}" for i in range(30)]
    changed = list(item)
    changed[7], changed[15], changed[22] = "x", "y", "z"
    bench = spark.createDataFrame([(1, " ".join(item))], BENCH)
    rows = [(1, "before " * 40 + " ".join(changed) + " after" * 40), (2, " ".join(item[:6]) + " other words here"), (3, "before " * 40)]
    assert [(r.doc_id, r.matches) for r in d.overlaps(documents(rows), bench).collect()] == [(1, 27)]


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "some words of a test item that is long enough to count here")], BENCH)
    assert d.overlaps(documents([]), bench).count() == 0
    assert d.overlaps(documents([(1, "a b")]), bench.limit(0)).count() == 0
    assert d.without(documents([(None, "a b"), (None, None)]), bench).count() == 2


def test_rows_go_by_id_and_text(spark, documents):
    item = " ".join(f"t{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item.upper()), (2, "a b")], BENCH)
    rows = [(5, item), (5, "clean text"), (None, item), (None, "clean too"), (None, None), (6, item + " x"), (6, item + " x")]
    assert sorted((r.text for r in d.without(documents(rows), bench).collect()), key=str) == [None, "clean text", "clean too"]
    found = {(r.doc_id, r.item_id): (r.matches, r.item_tokens) for r in d.overlaps(documents(rows), bench).collect()}
    assert found == {(k, i): (20, 20) for k in (5, 6, None) for i in (1, None)}


def test_word_bounds_of_other_scripts(spark, documents):
    item = "Über die „Höhe\u201d der Städte\u00a0am Rhein sagt man dort: 城市很大。河也长 wirklich nicht viel"
    assert len(tokens_of(item)) == 10 + 4 + 3 + 3
    bench = spark.createDataFrame([(1, item)], BENCH)
    rows = [(1, "davor " * 9 + item.replace("\u00a0", " ").replace("„", "'").upper() + " danach" * 9), (2, "Rhein 城 很 Städte")]
    assert [(r.doc_id, r.matches) for r in d.overlaps(documents(rows), bench).collect()] == [(1, 20)]


def test_matches_cover_the_whole_item(spark, documents):
    item = [f"t{i}" for i in range(700)]
    bench = spark.createDataFrame([(1, " ".join(item))], BENCH)
    assert [r.matches for r in d.overlaps(documents([(1, "x " * 50 + " ".join(item) + " y" * 50)]), bench).collect()] == [700]


def test_recall_with_a_fifth_of_the_words_changed(spark, documents):
    """Against all alignments, whatever seeds they have: every length that may count at all, and 30 % for longer ones."""
    rng = random.Random(11)
    items, rows = [], []
    for n in (9, 10, 11, 12, 14, 16, 20, 24, 40):
        for _ in range(60):
            items.append([f"i{rng.randrange(10**6)}" for _ in range(n)])
            part = [w if rng.random() > 0.2 else f"x{rng.randrange(10**6)}" for w in items[-1]]
            rows.append((len(items) - 1, " ".join(["a"] * rng.randrange(20) + part + ["b"] * rng.randrange(20))))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], BENCH)
    found = {(r.doc_id, r.item_id) for r in d.overlaps(documents(rows), bench).collect()}
    share = {}
    for key, text in rows:
        if lay_over(tokens_of(text), tokens_of(" ".join(items[key])), False):
            share.setdefault(len(items[key]), []).append((key, key) in found)
    assert {n: sum(x) / len(x) for n, x in share.items() if sum(x) < 0.9 * len(x)} == {} and min(map(len, share.values())) > 10


def test_short_passages_of_long_items_and_changed_short_items(spark, documents):
    item, small = [f"t{i}" for i in range(60)], [f"s{i}" for i in range(9)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(small))], BENCH)
    changed = item[10:22] + ["x"] + item[23:34]
    rows = [(k, "before " * 30 + " ".join(t) + " after" * 30) for k, t in enumerate([item[20:33], changed, item[20:30], [*small[:4], "y", *small[5:]], small[:6]])]
    assert sorted((r.doc_id, r.item_id) for r in d.overlaps(documents(rows), bench).collect()) == [(0, 1), (1, 1), (3, 2)]
