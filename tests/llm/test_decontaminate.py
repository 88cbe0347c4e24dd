import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate as D
from tests.llm.conftest import prose


def greedy(p, t, least):
    """Greedy string tiling by looking at all pairs of places; the tokens covered."""
    mp, mt, covered = [False] * len(p), [False] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        covered += n
        mp[i : i + n] = mt[j : j + n] = [True] * n


def test_tiles_cover_what_the_plain_algorithm_covers():
    r = random.Random(2)
    for _ in range(60):
        p = [r.randint(1, 6) for _ in range(r.randint(5, 40))]
        t = [r.randint(1, 6) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            a = r.randrange(len(p))
            t[len(t) // 2 : len(t) // 2] = p[a : a + r.randint(3, 25)]
        tiles = D.tile(np.array(p, np.uint64), np.array(t, np.uint64), least=3)
        used_p, used_t = [], []
        for a, b, n in tiles:
            assert n >= 3 and p[a : a + n] == t[b : b + n]
            used_p += range(a, a + n)
            used_t += range(b, b + n)
        assert len(set(used_p)) == len(used_p) and len(set(used_t)) == len(used_t)
        assert len(used_p) == greedy(p, t, 3)


@pytest.fixture(scope="module")
def cases(spark):
    r = random.Random(8)
    items = [(k, prose(r, 30)) for k in range(6)]
    w = items[0][1].split()
    docs = {
        0: f"{prose(r, 50)} {items[0][1]} {prose(r, 50)}",
        1: f"{prose(r, 20)} {' '.join(w[20:])} {prose(r, 9)} {' '.join(w[10:20])} {prose(r, 9)} {' '.join(w[:10])}",  # in another order
        2: f"{prose(r, 20)} {items[1][1].upper().replace(' ', ', ')}! {prose(r, 20)}",
        3: prose(r, 300),
        4: f"{prose(r, 30)} {' '.join(w[:14])} {prose(r, 30)}",  # less than half of an item
        5: " ".join(x + " " + y for x, y in zip(w, prose(r, 30).split(), strict=True)),  # its words, but no run of them
        6: items[2][1] + " " + items[3][1],
        7: "",
        8: None,
        9: " ".join(w[:6]) + " " + " ".join(w[:6]) + " " + " ".join(w[:6]),  # one run three times
    }
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short")], "item_id long, text string")


def test_passages_are_found_and_clean_ones_left(cases):
    got = {r.doc_id: r for r in D.decontaminate(*cases).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {0, 1, 2, 6} and len(got) == 10
    assert (got[0].item_id, got[0].coverage, got[0].n_tiles) == (0, 1.0, 1)
    assert got[1].n_tiles == 3 and got[1].coverage == 1.0
    assert (got[6].n_items, got[6].item_id) == (2, 2)


def test_query_equals_brute_force(spark, cases):
    docs, items = ([tuple(r) for r in df.collect()] for df in cases)
    r = random.Random(12)
    more = []
    for k in range(40):  # shuffled, cut and interrupted pieces of items
        w = r.choice(items[:6])[1].split()
        cuts = sorted(r.sample(range(1, len(w)), 3))
        pieces = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)])]
        r.shuffle(pieces)
        more.append((100 + k, " ".join(f"{' '.join(x)} {prose(r, r.randint(0, 3))}" for x in pieces[: r.randint(1, 4)])))
    split = lambda t: re.findall("[0-9a-z]+", (t or "").lower())
    due = {}
    for i, text in [*docs, *more]:
        found = []
        for item, other in items:
            p, t = split(other), split(text)
            share = (greedy(p, t, D.MIN_MATCH) / len(p) if len(p) >= D.MIN_MATCH else float(p == t)) if p else 0
            found += [(share, -item)] if share >= D.COVERAGE else []
        due[i] = (bool(found), len(found), -max(found)[1] if found else None, max(found)[0] if found else 0.0)
    got = D.decontaminate(spark.createDataFrame([*docs, *more], "doc_id long, text string").withColumns({"item_id": F.col("text"), "coverage": F.col("text"), "best": F.col("text")}), cases[1].withColumns({"doc_id": F.col("text"), "longest": F.col("text")}))
    assert {r.doc_id: (r.contaminated, r.n_items, r.item_id, r.coverage) for r in got.collect()} == due


def test_other_scripts_and_short_items(spark):
    items = spark.createDataFrame([(1, "one two three — four “five” six seven"), (2, "這是一個很長的測試問題"), (3, "too Short!"), (4, "ไทยภาษา")], "item_id long, text string")
    rows = [(0, "x y one—two three four «five» six… seven z"), (1, "前面這是一個很長的測試問題，後面"), (2, "Too, short"), (3, "this is too short a text"), (4, "這是另外一個"), (5, "ก ไทยภาษา ข")]
    got = {r.doc_id: r.item_id for r in D.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: None, 4: None, 5: 4}


def test_blocks_of_items_give_the_same(cases, monkeypatch):
    docs, items = cases
    one = sorted(D.decontaminate(docs, items).collect())
    whole = D.blocks
    monkeypatch.setattr(D, "blocks", lambda b, i, t: whole(b, i, t, most=40))
    assert len(list(D.blocks(items, "item_id", "text"))) > 2
    assert sorted(D.decontaminate(docs, items).collect()) == one


def test_edges(spark, cases, empty, odd):
    docs, items = cases
    assert D.decontaminate(empty, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, none).where("contaminated").count() == 0 and D.decontaminate(docs, none).count() == 10
    assert D.decontaminate(odd, items).count() == 4  # a row for each id, null too
