"""Operators that compare documents, against brute force."""

import numpy as np

from binomia.llm.common import all_word_hashes, word_hashes
from binomia.llm.decontamination import decontamination, edit_distance
from binomia.llm.ngram_join import ngram_join
from binomia.llm.substring_dedup import compact_windows, substring_dedup


def _texts(seed=4):
    """Families of near copies with few and many edits, of many sizes, and texts that share a line."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{int(rng.integers(4000))}"
    line, out = [word() for _ in range(14)], []
    for size in (5, 6, 8, 20, 60, 200):
        for edits in (0, 1, 1, 3, 8):
            base = [word() for _ in range(size)]
            for _ in range(4):
                copy = list(base)
                for _ in range(int(rng.integers(edits + 1))):
                    copy[int(rng.integers(len(copy)))] = word()
                out.append(" ".join(copy))
    out += [" ".join([*line, *(word() for _ in range(40))]) for _ in range(30)]
    base = [word() for _ in range(150)]
    for k in range(60):  # one large family whose members differ from each other more than from the first
        copy = list(base)
        if k:
            copy[(k * 7) % 150] = copy[(k * 11 + 3) % 150] = f"own{k}"
        out.append(" ".join(copy))
    return out


def _components(texts, words, hundred):
    sets = {}
    for k, t in texts:
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()
    label = {k: k for k in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= hundred * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {k: (len(sets[k]), label[k]) for k in sets}


def test_join_equals_brute_force(spark):
    texts = list(enumerate(_texts()))
    got = ngram_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components(texts, 4, 85)
    got = ngram_join(spark.createDataFrame(texts, "doc_id long, text string"), words=5, similarity=0.8, counted=0.5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components(texts, 5, 80)


def test_join_of_odd_rows(documents, nothing):
    got = ngram_join(documents).collect()
    assert len(got) == documents.count()
    label = {r.doc_id: r.component_id for r in got}
    assert label[1] == label[2] == 1 and label[3] == 1 and label[4] == 4 and label[5] == 5 and label[6] == 6 and label[None] is None
    assert ngram_join(nothing).count() == 0


def test_word_hashes_split_as_bytes_do(monkeypatch):
    text = "a bb  ccc\n\td\x0be\x0cf\rg\x1ch é z " * 30
    words = text.encode().split()
    whole = word_hashes(text.encode())
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    monkeypatch.setattr("binomia.llm.common.BLOCK_BYTES", 16)
    assert (word_hashes(text.encode()) == whole).all() and word_hashes(b"").size == 0
    parts = all_word_hashes([b"a bb", b"", text.encode(), b"x"])
    assert [len(p) for p in parts] == [2, 0, len(words), 1] and (parts[2] == whole).all()


def test_edit_distance_of_the_best_stretch():
    rng = np.random.default_rng(6)
    for _ in range(400):
        a, b = rng.integers(0, 4, rng.integers(1, 10)).tolist(), rng.integers(0, 4, rng.integers(0, 16)).tolist()
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for k, y in enumerate(b, 1):
                new.append(min(row[k - 1] + (x != y), row[k] + 1, new[-1] + 1))
            row = new
        assert edit_distance(a, b)[0] == min(row)


def test_leaks_are_found_with_edits(spark, documents, nothing):
    rng = np.random.default_rng(7)
    word = lambda: f"t{int(rng.integers(3000))}"
    items = [[word() for _ in range(int(rng.integers(12, 60)))] for _ in range(40)]
    docs, planted = [], set()
    for k in range(160):
        text = [word() for _ in range(120)]
        if k % 2:
            number = int(rng.integers(len(items)))
            leak = list(items[number])
            for _ in range(int(0.15 * len(leak))):
                leak[int(rng.integers(len(leak)))] = word()
            text[40:40] = leak
            planted.add((k, number))
        docs.append((k, " ".join(text).upper()))
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert len(found & planted) >= 0.97 * len(planted) and not found - planted
    several = decontamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, block_items=15)
    assert len({(r.doc_id, r.item_id) for r in several.collect()} & planted) >= 0.95 * len(planted)
    assert decontamination(nothing, benchmark).count() == 0
    assert decontamination(documents, benchmark.filter("1 = 0")).count() == 0


def test_windows_cover_every_stretch_once():
    rng = np.random.default_rng(9)
    values = rng.integers(0, 2**64, 70, dtype=np.uint64)
    values[30:40] = values[3]
    low, at, high = compact_windows(values, np.array([0]), np.array([70]), 8)
    for i in range(70):
        for k in range(i + 8, 71):
            holds = [(a, c, b) for a, c, b in zip(low, at, high, strict=True) if a <= i and k <= b and i <= c < k]
            assert len(holds) == 1 and values[holds[0][1]] >> np.uint64(28) == values[i:k].min() >> np.uint64(28)


def test_shared_passages(spark, documents, nothing):
    rng = np.random.default_rng(10)
    word = lambda: f"p{int(rng.integers(5000))}"
    passages = [[word() for _ in range(60)] for _ in range(10)]
    rows = []
    for k in range(80):
        text = [word() for _ in range(100)]
        if k < 50:
            text[50:50] = passages[k % 10]
        rows.append((k, " ".join(text)))
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = {r.doc_id for r in got} | {r.source_id for r in got}
    assert seen == set(range(50))
    assert all(r.similarity >= 0.8 and r.end - r.start >= 50 for r in got)
    odd = {r.doc_id: r.source_id for r in substring_dedup(documents).collect()}
    assert odd.get(2) == 1 and odd.get(3) == 1 and 4 not in odd
    assert substring_dedup(nothing).count() == 0
