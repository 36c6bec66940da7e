"""Rows with a possible partner of another part are all found without pairs being formed."""

import math

import numpy as np
from binomia.llm.ngram_join import needed_overlap, ngram_join, open_rows


def test_rows_with_a_possible_partner_stay(spark):
    rng = np.random.default_rng(21)
    rows = [
        (int(rng.integers(0, 40)), k, n, int(rng.integers(0, max(n // 2, 1))), int(rng.integers(0, 50)))
        for k, n in enumerate(int(x) for x in np.exp(rng.uniform(0, 6, 1500)))
    ]
    # sizes at the bound itself
    rows += [(99, 2000, 4, 0, 1), (99, 2001, 5, 0, 2), (98, 2002, 5, 0, 1), (98, 2003, 7, 0, 2), (97, 2004, 5, 0, 1), (97, 2005, 5, 0, 1)]
    want = set()
    for key, doc, n, at, part in rows:
        for key2, _, m, at2, part2 in rows:
            both = math.ceil(round(0.8 / 1.8 * (n + m), 9))
            if key == key2 and part != part2 and needed_overlap(max(n, m), 0.8) <= min(n, m) and n - at >= both and m - at2 >= both:
                want.add(doc)
    table = spark.createDataFrame(rows, "key long, doc_id long, n int, at int, part long")
    got = {r.doc_id for r in open_rows(table, 0.8).collect()}
    again = {r.doc_id for r in open_rows(open_rows(table, 0.8), 0.8).collect()}
    assert want <= again <= got and {2000, 2001} <= again and not got & {2002, 2003, 2004, 2005}
    assert len(got) < len(rows)


def test_links_between_components_are_found(spark):
    """Chains whose links run through other members than a group's first one."""
    rng = np.random.default_rng(22)
    rows, k = [], 0
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        for step in range(0, 9, 3):
            rows.append((k, " ".join(base[step:] + [f"e{k}_{j}" for j in range(step // 2)])))
            k += 1
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).collect()}
    assert got == {i: find(i) for i in root}
