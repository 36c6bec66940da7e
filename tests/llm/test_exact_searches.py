"""Ranked search and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from binomia.llm import ranked_search as ranked
from binomia.llm import vector_codes as codes

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    held = Counter(t for _, b in bags for t in b)
    out = set()
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 25 + (75 * sum(b.values()) * n_docs) // total
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                for t in terms(text) if b[t]
            )
            if s > 0:
                scored.append((-s, d is None, d or 0))
        for rank, (s, none, d) in enumerate(sorted(scored)[:top], 1):
            out.add((item, rank, None if none else d, -s))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["É", "日本"]
    weights = [1 / (k + 2) for k in range(302)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for k in range(700)]
    docs += [(900 + k, docs[3][1]) for k in range(40)]  # copies: equal scores
    docs += [(2000, None), (2001, ""), (2002, "-- !"), (2003, "W1 w1-W1 " * 4000), (None, docs[3][1])]
    items = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 30)))) for k in range(60)]
    return docs, [*items, (100, docs[3][1]), (101, None), (102, ""), (103, "unknown"), (104, "w1 w1 É")]


@pytest.mark.parametrize("sizes", [{}, {"CHUNK_ROWS": 90, "GROUP_ITEMS": 7, "DOC_LEAF": 3, "ITEM_LEAF": 2, "FAN": 2, "CELLS": 2000}])
def test_search_equals_scoring_all_pairs(spark, corpus, sizes, monkeypatch):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked, name, value)
    docs, items = corpus
    d = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, n int, term string").repartition(3)
    i = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, rank int")
    found = ranked.ranked_search(d, i).collect()
    assert {tuple(r) for r in found} == plain_search(docs, items, 10)
    small = ranked.ranked_search(d, i, top=3, block_text=500).collect()
    assert {tuple(r) for r in small} == plain_search(docs, items, 3)
    assert ranked.ranked_search(d.filter("1 = 0"), i).count() == 0
    assert ranked.ranked_search(d, i.filter("1 = 0")).count() == 0


def test_bounds_drop_most_pairs(monkeypatch):
    """Items about single topics: most leaves of documents are never scored."""
    rng = np.random.default_rng(1)
    docs = np.zeros((2048, 64))
    docs[np.arange(2048), rng.integers(0, 64, 2048)] = rng.integers(1, 1000, 2048)
    rows = np.eye(64)[:16] * 5.0
    group = ranked.Group(np.arange(16), np.arange(64), rows, ranked.tree(rows, ranked.likeness_order(rows), 2))
    scored = []
    real = np.ix_
    monkeypatch.setattr(ranked.np, "ix_", lambda *a: scored.append(len(a[0])) or real(*a))
    found = ranked.search_chunk(group, docs, np.zeros(16, np.int64), 10, False)
    assert len(found) == 160
    assert all(docs[d, i] * 5 == s for i, d, s in found)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * Fraction(x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[0] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    fits = lambda e: e if e < 2**63 else None
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k, _ in f), fits(e), fits(by_label[label]), digest)
                   for (i, _, label), f, e in zip(kept, found, errors)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string, part int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("width, scale", [(24, 1.0), (64, 1.0), (8, 3.0), (24, 1e9)])
def test_codes_equal_comparing_all_entries(spark, width, scale):
    rng = np.random.default_rng(width)
    rows = [(int(k), [float(np.float32(x)) for x in scale * rng.normal(size=width)], int(k) % 3 if k % 5 else None) for k in rng.permutation(70)]
    rows += [(100 + k, rows[0][1], 1) for k in range(30)] + [(5000, [0.0] * width, 0), (None, rows[1][1], 2), (3, rows[2][1], 2)]
    odd = [(900, None, 1), (901, [*rows[0][1][1:], None], 1), (902, [*rows[0][1][1:], float("nan")], 1), (903, [*rows[0][1][1:], float("inf")], 1)]
    got = codes.vector_codes(table(spark, rows + odd)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(rows)


def test_codes_of_few_rows_and_of_none(spark):
    rows = [(1, [0.5] * 8, 0), (2, [0.25] * 8, None)]
    got = codes.vector_codes(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(rows)
    assert codes.vector_codes(table(spark, rows).filter("1 = 0")).count() == 0


def test_transform_keeps_distances():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-9, 9, (5, 6)), rng.integers(-9, 9, (5, 6))
    ta, tb = codes.transformed(a), codes.transformed(b)
    assert (((ta - tb) ** 2).sum(1) == 8 * ((a - b) ** 2).sum(1)).all()
    rows = codes.transformed(np.eye(8, dtype=np.int64)).T  # one row for each coefficient
    assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(8))
