"""Ranked lexical search: the highest-scoring documents of each item, by an exact dual-tree search.

A term's weight comes from the number of documents that hold it; its part in a document from its
occurrences and the document's length. Documents are vectors over the items' terms, and so are items. Each
chunk of documents is ordered so that like ones are neighbours and gets a hierarchy whose nodes hold
the largest value of each coordinate; so do the items. A pair of nodes is bounded by the product of the
maxima. Where the bound is below the weakest k-th score of the node's items the pair is dropped with all
pairs below it. The k-th scores start from a first descent, in which every chunk scores only the most
promising leaf of each item; they are scores of real documents, so nothing is lost.

Scores are whole numbers. They are added up as doubles where those are exact, else as 64-bit numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binomia.llm.common import BLOCK_BYTES, _powers, mixed, needed, stash

TOP = 10
#: Bytes of item texts searched for at once: what the driver holds and broadcasts.
BLOCK_TEXT = 4 << 20
#: Documents of a chunk, items of a group, cells of a table of documents and a group's terms.
CHUNK_ROWS, GROUP_ITEMS, CELLS = 4096, 256, 1 << 24
#: Documents and items of a leaf, children of a node.
DOC_LEAF, ITEM_LEAF, FAN = 32, 8, 8
_VALUES = np.random.default_rng(1212).integers(1, 2**64, 256, dtype=np.uint64)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_INSIDE = np.zeros(256, np.int8)
_INSIDE[[c for c in range(256) if c >= 0x80 or chr(c).isalnum()]] = 1


def term_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the terms of a UTF-8 text in order: runs of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and _INSIDE[data[end]] and _INSIDE[data[end - 1]]:
            end += 1
        out.append(_block(np.frombuffer(data, np.uint8, end - at, at))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _block(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(block) + 2, np.int8)
    inside[1:-1] = _INSIDE[block]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(len(block))
    with np.errstate(over="ignore"):
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_VALUES[block] * powers[: len(block)], out=total[1:])
        return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def all_term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts one after the other and the number of terms of each; short texts are read together."""
    hashes, counts, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= BLOCK_BYTES:
            size += len(texts[end]) + 1
            end += 1
        if end > at + 1:
            found, starts = _block(np.frombuffer(b"\n".join(texts[at:end]), np.uint8))
            ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
            hashes.append(found)
            counts += np.diff(np.searchsorted(starts, ends), prepend=0).tolist()
        else:
            end = at + 1
            hashes.append(term_hashes(texts[at]))
            counts.append(len(hashes[-1]))
        at = end
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.array(counts, np.int64)


@dataclass
class Tree:
    """A hierarchy over rows in `order`: level 0 are leaves, each level holds the coordinate maxima of its nodes."""

    order: np.ndarray
    leaf: int
    levels: list[np.ndarray]


def tree(rows: np.ndarray, order: np.ndarray, leaf: int) -> Tree:
    levels = [np.maximum.reduceat(rows[order], np.arange(0, len(order), leaf), axis=0)]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
    return Tree(order, leaf, levels)


@dataclass
class Items:
    """A block of items: sorted hashes of their terms, and for each item its terms' numbers and occurrences."""

    ids: list
    terms: np.ndarray
    number: np.ndarray
    times: np.ndarray
    ends: np.ndarray  # where each item's terms end
    order: np.ndarray  # like items together
    weight: np.ndarray | None = None

    def groups(self) -> Iterator[Group]:
        for at in range(0, len(self.order), GROUP_ITEMS):
            mine = self.order[at : at + GROUP_ITEMS]
            spans = [slice(self.ends[k - 1] if k else 0, self.ends[k]) for k in mine.tolist()]
            number = np.concatenate([self.number[s] for s in spans])
            terms, place = np.unique(number, return_inverse=True)
            values = np.concatenate([self.times[s] for s in spans]) * self.weight[number]
            rows = np.zeros((len(mine), len(terms)), np.int64)
            rows[np.repeat(np.arange(len(mine)), [s.stop - s.start for s in spans]), place] = values
            kind = np.float64 if rows.sum(axis=1).max(initial=0) * 10**6 < 2**53 else np.int64
            rows = rows.astype(kind)
            yield Group(mine, terms, rows, tree(rows, likeness_order(rows), ITEM_LEAF))


@dataclass
class Group:
    """Some items over their own terms: `items` holds their numbers in the block."""

    items: np.ndarray
    terms: np.ndarray
    rows: np.ndarray
    search: Tree


def items_of(rows: list[tuple[int | None, str]]) -> Items:
    """Items with at least one term."""
    hashes, counts = all_term_hashes([t.encode() for _, t in rows])
    terms, number = np.unique(hashes, return_inverse=True)
    pair, times = np.unique(np.repeat(np.arange(len(rows)), counts) * max(len(terms), 1) + number, return_counts=True)
    owner, number = pair // max(len(terms), 1), pair % max(len(terms), 1)
    some, held = np.unique(owner, return_counts=True)
    return Items([rows[k][0] for k in some.tolist()], terms, number, times, np.cumsum(held), np.arange(len(some)))


def weigh(items: Items, n_docs: int, holding: dict[int, int]) -> None:
    """Set the terms' weights and bring items with the same heaviest term together."""
    items.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(items.terms))], np.int64)
    value = items.times * items.weight[items.number]
    owner = np.repeat(np.arange(len(items.ids)), np.diff(items.ends, prepend=0))
    by_value = np.lexsort((items.number, value, owner))
    heaviest = by_value[items.ends - 1]
    items.order = np.lexsort((value[heaviest], items.number[heaviest]))


def likeness_order(rows: np.ndarray) -> np.ndarray:
    """Rows by their heaviest coordinate and its value, so that neighbours share it."""
    if not rows.shape[1]:
        return np.arange(len(rows))
    top = rows.argmax(axis=1)
    return np.lexsort((rows[np.arange(len(rows)), top], top))


def search_chunk(items: Group, docs: np.ndarray, floor: np.ndarray, top: int, first_only: bool) -> list[tuple[int, int, int]]:
    """(item of the group, document, score) of the best documents of a chunk, none below the item's floor.

    docs: documents x the group's terms, in ascending order of their ids, as ties go to the lesser place.
    Score and bound are products with the items' rows.
    """
    per_item = items.search
    # documents whose heaviest part, weighted, is of the same term become neighbours
    by_doc = tree(docs, likeness_order(docs * items.rows.max(axis=0)[None, :]), DOC_LEAF)
    floor = floor.copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items.items]

    def members(search: Tree, node: int) -> np.ndarray:
        return search.order[node * search.leaf : (node + 1) * search.leaf]

    def score_leaves(item_leaf: int, doc_leaves: np.ndarray) -> None:
        mine = members(per_item, item_leaf)
        theirs = np.concatenate([members(by_doc, d) for d in doc_leaves.tolist()])
        terms = np.flatnonzero(per_item.levels[0][item_leaf])
        scores = (docs[np.ix_(theirs, terms)] @ items.rows[np.ix_(mine, terms)].T).astype(np.int64)
        for k, item in enumerate(mine.tolist()):
            good = np.flatnonzero(scores[:, k] >= max(floor[item], 1))
            if len(good):
                doc = np.concatenate([best[item][0], theirs[good]])
                score = np.concatenate([best[item][1], scores[good, k]])
                keep = np.lexsort((doc, -score))[:top]
                best[item] = (doc[keep], score[keep])
                if len(keep) == top:
                    floor[item] = max(floor[item], int(score[keep[-1]]))

    def bounds(item_level: int, item_node: int, doc_level: int, nodes: np.ndarray) -> np.ndarray:
        row = per_item.levels[item_level][item_node]
        terms = np.flatnonzero(row)
        return by_doc.levels[doc_level][np.ix_(nodes, terms)] @ row[terms]

    def weakest(item_level: int, item_node: int) -> int:
        span = per_item.leaf * FAN**item_level
        return max(1, int(floor[per_item.order[item_node * span : (item_node + 1) * span]].min()))

    def children(level: list[np.ndarray], depth: int, nodes: np.ndarray) -> np.ndarray:
        out = (nodes[:, None] * FAN + np.arange(FAN)[None, :]).ravel()
        return out[out < len(level[depth - 1])]

    def descend(item_level: int, item_node: int, doc_level: int, nodes: np.ndarray) -> None:
        bound = bounds(item_level, item_node, doc_level, nodes)
        alive = bound >= weakest(item_level, item_node)
        nodes, bound = nodes[alive], bound[alive]
        if not len(nodes):
            return
        if item_level == 0 and doc_level == 0:
            # the most promising leaves first: their scores raise the floor for the others
            order = np.argsort(-bound, kind="stable")
            for at in range(0, len(order), FAN):
                some = order[at : at + FAN]
                some = some[bound[some] >= weakest(0, item_node)]
                if not len(some):
                    return
                score_leaves(item_node, nodes[some])
        elif doc_level and (item_level == 0 or len(by_doc.levels[doc_level]) <= len(per_item.levels[item_level])):
            descend(item_level, item_node, doc_level - 1, children(by_doc.levels, doc_level, nodes))
        elif item_level:
            for child in children(per_item.levels, item_level, np.array([item_node])).tolist():
                descend(item_level - 1, child, doc_level, nodes)

    if first_only:
        for leaf in range(len(per_item.levels[0])):
            nodes = np.array([0])
            for depth in range(len(by_doc.levels) - 1, -1, -1):
                nodes = nodes[[int(bounds(0, leaf, depth, nodes).argmax())]]
                nodes = children(by_doc.levels, depth, nodes) if depth else nodes
            score_leaves(leaf, nodes)
    else:
        descend(len(per_item.levels) - 1, 0, len(by_doc.levels) - 1, np.array([0]))
    return [(item, int(d), int(s)) for item, (doc, score) in enumerate(best) for d, s in zip(doc, score, strict=True)]


def item_blocks(benchmark: DataFrame, block_text: int = BLOCK_TEXT) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about block_text bytes; of rows with one id the least text counts."""
    items = needed(benchmark, "item_id", "text").filter(F.col("text").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-total // block_text)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id").collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows]


def _profiles(docs: DataFrame, terms) -> DataFrame:
    """doc_id, n (terms of the text) and, of the items' terms, numbers and occurrences: one row for each document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                hashes, counts = all_term_hashes(texts)
                owner = np.repeat(np.arange(len(texts)), counts)
                place = np.searchsorted(known, hashes)
                hit = known[np.minimum(place, len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)
                pair, n = np.unique(owner[hit] * (len(known) + 1) + place[hit], return_counts=True)
                owners, numbers = pair // (len(known) + 1), pair % (len(known) + 1)
                some = np.flatnonzero(counts)
                ends = np.searchsorted(owners, some, side="right")
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(some)),
                        pa.array(counts[some]),
                        pa.ListArray.from_arrays(offsets, pa.array(numbers.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64))),
                    ],
                    names=["doc_id", "n", "term", "tf"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, term array<int>, tf array<bigint>")


def _search(profiles: DataFrame, shared, n_docs: int, n_terms: int, floors, top: int, first_only: bool) -> DataFrame:
    """item (number), doc_id, score of each chunk's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor = shared.value, np.array(floors.value, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(at, CHUNK_ROWS)
                batch = batch.take(pc.sort_indices(batch.column("doc_id")))
                n = batch.column("n").to_numpy()
                term, tf = batch.column("term"), batch.column("tf").flatten().to_numpy(zero_copy_only=False)
                numbers, ends = term.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(term).to_numpy())
                size = 25 + (75 * n * n_docs) // n_terms
                part = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(size, np.diff(ends, prepend=0)))
                out: list[tuple] = []
                for group in items.groups():
                    # documents of a few cells each at a time, where a group has very many terms
                    step = max(16, CELLS // max(len(group.terms), 1))
                    for low in range(0, len(batch), step):
                        high = min(low + step, len(batch))
                        span = slice(ends[low - 1] if low else 0, ends[high - 1])
                        place = np.searchsorted(group.terms, numbers[span])
                        own = group.terms[np.minimum(place, len(group.terms) - 1)] == numbers[span]
                        owner = np.repeat(np.arange(high - low), np.diff(ends[low:high], prepend=span.start))
                        vectors = np.zeros((high - low, len(group.terms)), group.rows.dtype)
                        vectors[owner[own], place[own]] = part[span][own]
                        out += [(int(group.items[k]), low + d, s) for k, d, s in search_chunk(group, vectors, floor[group.items], top, first_only)]
                item, doc, score = zip(*out, strict=True) if out else ([], [], [])
                ids = batch.column("doc_id").take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    kind = profiles.schema["doc_id"].dataType.simpleString()
    return profiles.mapInArrow(run, f"item int, doc_id {kind}, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item; each task keeps its own best before rows are shuffled."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked_search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_text: int = BLOCK_TEXT) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Null and empty texts hold
    no term: such documents don't count, such items find nothing. Every row of docs is a document, repeated
    rows too; null ids rank last among equal scores. Of items with one id the least text counts. Empty tables
    give an empty result. Terms are known by 64-bit hashes.
    """
    spark: SparkSession = docs.sparkSession
    source, out = needed(docs, "doc_id", "text"), None
    for rows in item_blocks(benchmark, block_text):
        items = items_of(rows)
        profiles = stash(_profiles(source, spark.sparkContext.broadcast(items.terms)))
        n_docs, n_terms = profiles.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not items.ids:
            continue
        # one row for each term of the block, whose size is bounded
        weigh(items, n_docs, dict(profiles.select(F.explode("term").alias("term")).groupBy("term").count().collect()))
        shared = spark.sparkContext.broadcast(items)
        floors = [0] * len(items.ids)
        first = _best(_search(profiles, shared, n_docs, n_terms, spark.sparkContext.broadcast(list(floors)), top, True), top)
        for item, score in first.filter(F.col("rank") == top).select("item", "score").collect():
            floors[item] = score
        found = _best(_search(profiles, shared, n_docs, n_terms, spark.sparkContext.broadcast(floors), top, False), top)
        names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
        part = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


#: The same by scoring all pairs that share a term.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total),
parts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) AS part
  FROM counts JOIN sizes USING (doc_id), total),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * part) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN parts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
