"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

A random walk over a word sequence (one step of the output per tick, one word ahead if a random bit of
the word says so) embeds edit distance into Hamming distance. Windows of documents and the benchmark
items take the same walks; a few sampled output places are one hash key. Each repetition has its own
walk and its own places. How many repetitions are made follows from a simulation: copies of the items
with as many random edits as are still allowed must collide with the target recall, in every size class
by itself. A class that doesn't get there is searched for by pieces instead, which is exact: of k + 1 pieces of
an item, k edits leave one as it is. Collisions are checked with the exact word edit distance between
the item and the best stretch near the window.

A window is embedded only if it shares as many word pairs with the benchmark as the q-gram lemma
demands of any window within the edit bound, so this filter loses nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from binomia.llm.common import all_word_hashes, map_batches, mixed, needed, shingles

#: Least share of an item's words that must be found in place, words below which all must be, recall to reach.
SIMILARITY, MIN_WORDS, RECALL = 0.8, 5, 0.97
#: Items that are searched for in one pass over the documents; a larger benchmark takes several.
BLOCK_ITEMS = 20_000
#: Sampled places of a key; ratio of the lengths of a size class; repetitions after which a class that
#: misses the recall goes by pieces; bits of the pair table.
PLACES, CLASS_RATIO, REPETITIONS, PAIR_BITS = 3, 1.2, 96, 22
#: Documents that are searched together.
BATCH_ROWS = 2048
#: Pairs of a place in a text and an item's piece that are looked at together.
PAIRS_AT_ONCE = 1 << 20
_MASK = np.uint64((1 << PAIR_BITS) - 1)


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    return all_word_hashes([(t or "").encode().lower() for t in texts])


def allowed(n_words: int, similarity: float) -> int:
    return int((1 - similarity) * n_words + 1e-9)


def most_edits(n_words: int, similarity: float, min_words: int) -> int:
    return allowed(n_words, similarity) if n_words >= min_words else 0


def _least_edits(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edits between the item and any stretch of the text, and the first end that reaches them.

    Bit-parallel: the rows of the edit matrix are the bits of two integers, each word of the text is one step.
    """
    where: dict[int, int] = {}
    for k, word in enumerate(item):
        where[word] = where.get(word, 0) | 1 << k
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, edits = full, 0, len(item)
    best = (edits, 0)
    for end, word in enumerate(text, 1):
        same = where.get(word, 0)
        down = (((same & plus) + plus) ^ plus) | same | minus
        up, low = minus | ~(down | plus) & full, plus & down
        edits += bool(up & top) - bool(low & top)
        up, low = up << 1 & full, low << 1 & full
        plus, minus = low | ~((same | minus) | up) & full, up & (same | minus)
        if edits < best[0]:
            best = (edits, end)
    return best


def edit_distance(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """Least edits that turn the item into a stretch of the text, and that stretch (start, end)."""
    edits, end = _least_edits(item, text)
    _, size = _least_edits(item[::-1], text[:end][::-1])
    return edits, end - size, end


def pairs_of(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) & _MASK


def walk_keys(padded: np.ndarray, starts: np.ndarray, last: np.ndarray, repetition: int, places: np.ndarray, seed: int) -> np.ndarray:
    """Keys, out of the sampled places, of the walks that begin at starts.

    A walk stays at its place in last, where padded holds a zero, once it gets there. All size classes
    take the same walk, each as far as its last place.
    """
    at = starts.copy()
    salts = np.random.default_rng([seed, repetition]).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
    keys, wanted = np.ones(len(starts), np.uint64), set(places.tolist())
    with np.errstate(over="ignore"):
        for tick in range(int(places[-1]) + 1):
            word = padded[at]
            if tick in wanted:
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + word)
            at += ((word * salts[tick % len(salts)]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, last, out=at)
    return keys


def lined_up(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts behind each other, a zero after each; where each begins and where its zero stands."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes) - 1
    zero = np.zeros(1, np.uint64)
    return np.concatenate([x for t in texts for x in (t, zero)]), ends - sizes + 1, ends


@dataclass
class Benchmark:
    """One block of items, as it is sent to the executors: its size is bounded by the block."""

    ids: list[int]
    items: list[list[int]]
    similarity: float
    classes: list[tuple[int, int]]  # least length, pairs that must be shared
    places: list[list[np.ndarray]]  # by class and repetition; none for a class that goes by pieces
    tables: list[list[tuple[np.ndarray, np.ndarray]]]  # by class and repetition: sorted keys, item numbers
    pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # words of a piece, sorted keys, item numbers, places in the item
    pairs: np.ndarray  # which word pairs occur in the items
    seed: int = 11
    min_words: int = MIN_WORDS

    def most(self, number: int) -> int:
        """Edits a leak of the item may have; short items stand word for word."""
        return most_edits(len(self.items[number]), self.similarity, self.min_words)

    def find(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """By text (hashes of its words): (item number, edits, start, end) of each place where an item is found."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.items or not texts:
            return out
        words, first, ends = lined_up(texts)
        total = np.concatenate([[0], np.cumsum(self.pairs[pairs_of(words)], dtype=np.int64)])
        every, chosen = np.arange(len(words)), []
        for least, demand in self.classes:
            span = np.minimum(every + least - 1, len(total) - 1)
            chosen.append(np.flatnonzero(total[span] - total[np.minimum(every, len(total) - 1)] >= demand))
        found: dict[tuple[int, int], set[int]] = {}
        for k, starts in enumerate(chosen):
            if not len(starts) or not self.places[k]:
                continue
            text = np.searchsorted(ends, starts)
            last = ends[text]
            for repetition, (places, (known, numbers)) in enumerate(zip(self.places[k], self.tables[k], strict=True)):
                keys = walk_keys(words, starts, last, repetition, places, self.seed)
                low = np.searchsorted(known, keys, "left")
                for x in np.flatnonzero(known[np.minimum(low, len(known) - 1)] == keys):
                    for number in numbers[low[x] : np.searchsorted(known, keys[x], "right")].tolist():
                        found.setdefault((int(text[x]), number), set()).add(int(starts[x] - first[text[x]]))
        for of, number, start in self.by_pieces(words, first, ends, total):
            found.setdefault((of, number), set()).add(start)
        for (of, number), hits in sorted(found.items()):
            item = self.items[number]
            most, at = self.most(number), sorted(hits)
            runs = [[at[0], at[0]]]
            for s in at[1:]:
                if s - runs[-1][1] > len(item):
                    runs.append([s, s])
                runs[-1][1] = s
            leaks = set()
            for low, high in runs:
                # the best stretch first, then what is left on both sides of it
                open_ = [(max(0, low - most), min(high + len(item) + most, len(texts[of])))]
                while open_:
                    low, high = open_.pop()
                    if high - low < len(item) - most:
                        continue
                    edits, start, end = edit_distance(item, texts[of][low:high].tolist())
                    if edits <= most:
                        leaks.add((number, edits, low + start, low + end))
                        open_ += [(low, low + start), (low + end, high)]
            out[of] += sorted(leaks, key=lambda x: x[2:])
        return out

    def by_pieces(self, words: np.ndarray, first: np.ndarray, ends: np.ndarray, total: np.ndarray):
        """(text, item number, start) where a piece of an item stands and as many word pairs around it as a leak needs."""
        sizes = np.array([len(i) for i in self.items], np.int64)
        most = np.array([self.most(k) for k in range(len(sizes))], np.int64)
        for width, known, numbers, offsets in self.pieces:
            keys = shingles(words, width)
            low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
            at = np.flatnonzero(high > low)
            done = np.concatenate([[0], np.cumsum((high - low)[at])])
            while len(at):
                # a bounded number of (place, piece) pairs at a time, one place at least
                n = max(int(np.searchsorted(done, done[0] + PAIRS_AT_ONCE, "right")) - 1, 1)
                times = (high - low)[at[:n]]
                place = np.repeat(at[:n], times)
                entry = np.repeat(low[at[:n]], times) + np.arange(len(place)) - np.repeat(done[:n] - done[0], times)
                at, done = at[n:], done[n:]
                number = numbers[entry]
                start, text = place - offsets[entry], np.searchsorted(ends, place)
                left = np.maximum(start - most[number], first[text])
                right = np.minimum(start + sizes[number] + most[number], ends[text])
                near = total[np.maximum(right - 1, left)] - total[left] >= sizes[number] - 1 - 2 * most[number]
                yield from zip(text[near].tolist(), number[near].tolist(), np.maximum(start - first[text], 0)[near].tolist(), strict=True)


def pieces_of(items: list[tuple[int, np.ndarray]], similarity: float, min_words: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tables, by words of a piece, of one more disjoint piece of each (number, words) than edits are allowed."""
    by: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = {}
    for number, word in items:
        most = most_edits(len(word), similarity, min_words)
        width = len(word) // (most + 1)
        at = np.arange(most + 1) * width
        by.setdefault(width, []).append((shingles(word, width)[at], number, at))
    out = []
    for width, parts in sorted(by.items()):
        keys, numbers = np.concatenate([p[0] for p in parts]), np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
        order = np.argsort(keys, kind="stable")
        out.append((width, keys[order], numbers[order], np.concatenate([p[2] for p in parts])[order]))
    return out


def build(rows: list[tuple[int, str]], similarity: float = SIMILARITY, min_words: int = MIN_WORDS, recall: float = RECALL, seed: int = 11) -> Benchmark:
    """Embed a block of items; as many repetitions as the simulated edits need for the target recall."""
    kept = [(i, w) for (i, _), w in zip(rows, words_of([t for _, t in rows]), strict=True) if len(w)]
    lengths = sorted({len(w) for _, w in kept if len(w) >= min_words})
    classes: list[list[int]] = []
    for n in lengths:
        if not classes or n > classes[-1][0] * CLASS_RATIO:
            classes.append([n, n])
        classes[-1][1] = n
    bounds = [(low, max(low - 1 - 2 * allowed(high, similarity), 1)) for low, high in classes]
    group = [[k for k, (_, w) in enumerate(kept) if low <= len(w) <= high] for low, high in classes]
    pairs = np.zeros(1 << PAIR_BITS, bool)
    for _, w in kept:
        pairs[pairs_of(w)] = True
    rng = np.random.default_rng(seed)
    edited = []  # class, an item, the item with as many edits as are allowed
    for k, members in enumerate(group):
        for number in rng.choice(members, 60):
            word, edits = kept[number][1].tolist(), allowed(len(kept[number][1]), similarity)
            for _ in range(edits):
                at, kind = int(rng.integers(len(word))), int(rng.integers(3))
                word[at : at + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 2**62))]
            edited.append((k, int(number), np.array(word, np.uint64)))
    places: list[list[np.ndarray]] = [[] for _ in bounds]
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in bounds]
    pieces = [(m, w) for m, (_, w) in enumerate(kept) if len(w) < min_words]
    for k, members in enumerate(group):
        words, first, ends = lined_up([kept[m][1] for m in members])
        others, other_first, other_ends = lined_up([w for c, _, w in edited if c == k])
        of = np.searchsorted(members, [n for c, n, _ in edited if c == k])
        missed = np.ones(len(of), bool)
        while 1 - missed.mean() < recall:
            if len(places[k]) == REPETITIONS:
                places[k], tables[k] = [], []
                pieces += [(m, kept[m][1]) for m in members]
                break
            sampled = np.sort(rng.choice(max(2 * bounds[k][0] - 4, PLACES), PLACES, replace=False))
            keys = walk_keys(words, first, ends, len(places[k]), sampled, seed)
            missed &= keys[of] != walk_keys(others, other_first, other_ends, len(places[k]), sampled, seed)
            order = np.argsort(keys, kind="stable")
            places[k].append(sampled)
            tables[k].append((keys[order], np.array(members, np.int64)[order]))
    return Benchmark([i for i, _ in kept], [w.tolist() for _, w in kept], similarity, bounds, places, tables, pieces_of(pieces, similarity, min_words), pairs, seed, min_words)


def blocks(benchmark: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS, **options):
    """The benchmark in blocks of about block_items items, embedded on the driver one after the other."""
    from pyspark.sql import functions as F

    items = needed(benchmark, "item_id", "text").filter(F.col("text").isNotNull()).distinct()
    n = -(-items.count() // block_items)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield build([(r["item_id"], r["text"]) for r in rows], similarity, **options)


class Search:
    def __init__(self, shared):
        self.benchmark = shared.value

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        return self.benchmark.find(words_of(texts))


def decontamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, **options) -> DataFrame:
    """doc_id, item_id, start, end (words of the document), edits, similarity of every leak found.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Words are split at
    ASCII white space, A-Z lower-cased. Null and empty texts hold no leak; items of fewer than min_words
    words are found word for word only, an item several times in a text gives a row each time, null ids stay null, repeated rows of docs give repeated leaks, repeated
    items count once. An empty table on either side gives an empty result. Whole texts are read.
    """
    context, out = docs.sparkSession.sparkContext, None
    schema = "doc_id long, item_id long, start long, end long, edits int, similarity double"

    def over(shared):
        def leaks(batch, search):
            rows: dict[str, list] = {n: [] for n in ("doc_id", "item_id", "start", "end", "edits", "similarity")}
            for doc_id, leaks_of in zip(batch.column("doc_id").to_pylist(), search.find(batch.column("text").to_pylist()), strict=True):
                for number, edits, start, end in leaks_of:
                    size = len(search.benchmark.items[number])
                    for name, x in zip(rows, (doc_id, search.benchmark.ids[number], start, end, edits, 1 - edits / size), strict=True):
                        rows[name].append(x)
            yield rows

        return map_batches(needed(docs, "doc_id", "text"), leaks, schema, rows=BATCH_ROWS, start=lambda: Search(shared))

    for block in blocks(benchmark, similarity, **options):
        part = over(context.broadcast(block))
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
