"""Benchmark leaks of long items, of short ones and of repeated ones."""

import numpy as np

from binomia.llm.decontamination import allowed, build


def _word(rng):
    return f"t{int(rng.integers(3000))}"


def _edited(rng, words, edits):
    """Copies of words with `edits` random replacements, removals and insertions."""
    words = list(words)
    for _ in range(edits):
        at, kind = int(rng.integers(len(words))), int(rng.integers(3))
        words[at : at + (kind != 1)] = [] if kind == 2 else [f"e{int(rng.integers(10**9))}"]
    return words


def test_long_items_among_short_ones_reach_the_recall():
    rng = np.random.default_rng(14)
    sizes = [*([12, 15, 20, 25] * 10), 120, 300, 600]
    items = [[_word(rng) for _ in range(n)] for n in sizes]
    block = build([(k, " ".join(i)) for k, i in enumerate(items)])
    texts, planted = [], []
    for number in (40, 41, 42):
        for _ in range(25):
            leak = _edited(rng, items[number], allowed(sizes[number], 0.8))
            texts.append([_word(rng) for _ in range(50)] + leak + [_word(rng) for _ in range(50)])
            planted.append(number)
    from binomia.llm.decontamination import words_of

    found = block.find(words_of([" ".join(t) for t in texts]))
    for number in (40, 41, 42):
        caught = [any(f[0] == number for f in got) for got, n in zip(found, planted, strict=True) if n == number]
        assert np.mean(caught) >= 0.97
    assert all(f[0] == n and f[1] <= allowed(sizes[n], 0.8) for got, n in zip(found, planted, strict=True) for f in got)


def test_short_items_and_repeated_leaks():
    from binomia.llm.decontamination import words_of

    rng = np.random.default_rng(15)
    item = [_word(rng) for _ in range(20)]
    changed = list(item)
    changed[9] = "other"
    block = build([(1, " ".join(item)), (2, "Answer is forty two"), (3, "xyzzy")])
    texts = [item * 3, ["before"] + item + changed + item + ["after"], "so the answer is forty two".split(), "the answer was forty two".split(), "a xyzzy b XYZZY".split(), ["xyzzys"]]
    found = [sorted((block.ids[n], e, a, b) for n, e, a, b in got) for got in block.find(words_of([" ".join(t) for t in texts]))]
    assert found[0] == [(1, 0, 0, 20), (1, 0, 20, 40), (1, 0, 40, 60)]
    assert found[1] == [(1, 0, 1, 21), (1, 0, 41, 61), (1, 1, 21, 41)]
    assert found[2] == [(2, 0, 2, 6)] and not found[3] and not found[5]
    assert found[4] == [(3, 0, 1, 2), (3, 0, 3, 4)]
    assert build([(3, "xyzzy")]).find(words_of(["xyzzy"])) == [[(0, 0, 0, 1)]]
