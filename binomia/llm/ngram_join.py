"""N-gram Jaccard join: heavy-light, with the boundary between small and large sets chosen by cost.

Documents with equal shingle sets are one class; the smallest id stands for it. Shingles are ordered
by how many classes hold them (rare first), and only a prefix of a set in this order can decide whether
it has a partner at all:

* two sets that link share a shingle among the first n - ceil(t n) + 1, and two among the first
  n - ceil(t n) + 2 of both;
* small sets enumerate the pairs of shingles (subsets of size two) in their longer prefix and meet other
  small sets on equal subsets;
* large sets scan the inverted lists of the single shingles in their prefix, and meet small and large sets.

The boundary is the set size at which the subsets of all sets below it and the list entries scanned by
all sets above it cost least together. Within a group of sets that meet on a key each is compared with
the group's first set; what is linked then is one component, and only sets of different components are
compared with each other. So a group of thousands of near copies costs one comparison for each copy,
and no link between components is lost. Every candidate is verified on its full shingle sets.

The frequencies are counted for the shingles in a fixed fraction of the hash range (`COUNTED`) and, for
sets that have too few of them there, for the next ones; the others follow in the order of their hash.
Any order is right; this one is cheap. A set with more unique shingles than t leaves room for is out.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import all_word_hashes, components, map_batches, needed, shingles, stash

WORDS, SIMILARITY, COUNTED = 4, 0.85, 0.2
#: Sets verified at a time and bytes of a table that may be broadcast after its rows have been counted.
BROADCAST_ROWS = 400_000


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    return [np.unique(shingles(h, words)) for h in all_word_hashes([(t or "").encode().lower() for t in texts])]


def needed_overlap(n: int, similarity: float) -> int:
    """Shingles of a set of n that a linked set must hold at least."""
    return math.ceil(round(similarity * n, 9))


def classes(docs: DataFrame, words: int, similarity: float, counted: float) -> DataFrame:
    """doc_id, n, two halves of the set's fingerprint, and on the first row of a batch for each set its
    counted shingles: as longs, those in the counted range first (n_low of them), in order of their hash."""
    top = np.uint64(int(counted * 2**64))

    def made(batch):
        out: dict[str, list] = {k: [] for k in ("doc_id", "n", "f1", "f2", "n_low", "tokens")}
        best: dict[bytes, int] = {}
        ids = batch.column("doc_id").to_pylist()
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        for k, (doc_id, key) in enumerate(zip(ids, prints, strict=True)):
            if doc_id is not None and (key not in best or doc_id < ids[best[key]]):
                best[key] = k
        for k, (doc_id, s, key) in enumerate(zip(ids, sets, prints, strict=True)):
            low, tokens = None, None
            # sets so small that a single difference breaks the link meet equal ones only
            if best.get(key) == k and needed_overlap(len(s) + 1, similarity) <= len(s):
                low = int(np.searchsorted(s, top))
                tokens = s[: max(low, len(s) - needed_overlap(len(s), similarity) + 2)].view(np.int64)
            half = np.frombuffer(key, np.int64)
            for name, value in zip(out, (doc_id, len(s), int(half[0]), int(half[1]), low, tokens), strict=True):
                out[name].append(value)
        yield out

    schema = "doc_id long, n int, f1 long, f2 long, n_low int, tokens array<long>"
    return stash(map_batches(needed(docs, "doc_id", "text"), made, schema, rows=1024))


def _least(n: Column, similarity: float) -> Column:
    return F.ceil(F.round(F.lit(similarity) * n, 9)).cast("int")


def _close(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can link."""
    return _least(F.greatest(a, b), similarity) <= F.least(a, b)


def prefixes(held: DataFrame, similarity: float) -> DataFrame:
    """token, doc_id, n, at, frequency: the shared shingles among a set's prefix, and their places in the order.

    A shingle that one set alone holds comes first in the order and is counted, but leads nowhere.
    """
    listed = held.filter("tokens is not null").select("doc_id", "n", "n_low", F.posexplode("tokens").alias("k", "token"))
    frequency = listed.groupBy("token").agg(F.count("*").alias("frequency")).filter("frequency > 1")
    shared = listed.join(frequency.hint("shuffle_hash"), "token").select(
        "doc_id", "n", "n_low", "token", "frequency", (F.col("k") < F.col("n_low")).alias("low")
    )
    by_set = shared.groupBy("doc_id", "n", "n_low").agg(
        F.array_sort(
            F.collect_list(F.struct((~F.col("low")).alias("late"), F.when(F.col("low"), F.col("frequency")).otherwise(0).alias("rank"), "token", "frequency"))
        ).alias("held"),
        F.count_if("low").alias("n_shared"),
    )
    unique = F.col("n_low") - F.col("n_shared")
    room = F.col("n") - _least(F.col("n"), similarity) + 2
    return (
        by_set.filter(unique < room)
        .select("doc_id", "n", unique.alias("unique"), F.posexplode(F.slice("held", F.lit(1), (room - unique).cast("int"))).alias("k", "t"))
        .select("doc_id", "n", (F.col("unique") + F.col("k")).cast("int").alias("at"), "t.token", "t.frequency")
    )


def boundary(lists: DataFrame, similarity: float) -> int:
    """Largest size of a small set: what subsets lead to below and list entries above it cost least together.

    Sizes are added up in classes of about a twentieth, so few rows reach the driver.
    """
    f, k = F.sum("frequency"), F.count("*")
    # a subset has at most as many holders as the rarer of its shingles
    subsets = f * (k - 1 + F.min("at")) - F.sum(F.col("frequency") * F.col("at"))
    per = lists.groupBy("doc_id", "n").agg(subsets.alias("subsets"), f.alias("entries"))
    step = F.floor(F.log(F.col("n")) * 20).alias("step")
    rows = per.groupBy(step).agg(F.max("n").alias("n"), F.sum("subsets").alias("subsets"), F.sum("entries").alias("entries")).orderBy("step").collect()
    best, choice, below, above = None, 0, 0.0, float(sum(r["entries"] for r in rows))
    for n, met, entries in [(0, 0, 0), *((r["n"], r["subsets"], r["entries"]) for r in rows)]:
        below, above = below + met, above - entries
        if best is None or below + above < best:
            best, choice = below + above, n
    return choice


def meetings(lists: DataFrame, limit: int, similarity: float) -> DataFrame:
    """key, doc_id, n, at, large: where sets meet. Small ones by their subsets, large ones with all by single shingles."""
    large = F.col("n") > limit
    single = F.col("at") < F.col("n") - _least(F.col("n"), similarity) + 1
    small = lists.filter(~large)
    grouped = small.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"))
    subsets = (
        grouped.select("doc_id", "n", F.posexplode("t").alias("k", "a"), "t")
        .select("doc_id", "n", "a", F.explode(F.slice("t", F.col("k") + 2, F.size("t"))).alias("b"))
        .select(
            F.xxhash64(F.lit(2), F.least("a.token", "b.token"), F.greatest("a.token", "b.token")).alias("key"), "doc_id", "n", F.col("a.at").alias("at"), F.lit(False).alias("large")
        )
    )
    singles = lists.filter(single).select(F.xxhash64(F.lit(1), "token").alias("key"), "doc_id", "n", "at", large.alias("large"))
    groups = singles.groupBy("key").agg(F.max("large").alias("any"), F.count("*").alias("c")).filter("any and c > 1").select("key")
    return singles.join(groups.hint("shuffle_hash"), "key", "left_semi").unionAll(subsets)


def possible(a: str, b: str, similarity: float) -> Column:
    """Whether two sets that meet at places at of their orders can still share enough: sizes and places."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    overlap = F.ceil(F.round(F.lit(similarity / (1 + similarity)) * (n + m), 9))
    return _close(n, m, similarity) & (n - F.col(f"{a}.at") >= overlap) & (m - F.col(f"{b}.at") >= overlap)


def open_rows(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows (key, doc_id, n, at, part) that some row of another part may share enough with on their key.

    No pairs are formed: the rows of a key are summed up by size class, of which those a set can link with
    are at most one class away, and each row is held against these sums. A row without a possible
    partner is never kept out wrongly, as the sums bound every partner in its class.
    """
    rows = rows.withColumn("step", F.floor(F.log(F.col("n")) / F.lit(-math.log(similarity) * (1 + 1e-6))))
    slack = F.col("n") - F.col("at")
    sums = rows.groupBy("key", "step").agg(
        F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.max(slack).alias("max_slack"), F.min("part").alias("low"), F.max("part").alias("high")
    )
    # keys on which one part meets alone need no look
    mixed_keys = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key")
    sums = sums.join(mixed_keys.hint("shuffle_hash"), "key", "left_semi").withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    # the least size a partner of the class can have, and what both must share with it
    m = F.greatest("min_n", _least(F.col("n"), similarity))
    overlap = F.ceil(F.round(F.lit(similarity / (1 + similarity)) * (F.col("n") + m), 9))
    fits = (
        ((F.col("low") != F.col("part")) | (F.col("high") != F.col("part")))
        & (_least(F.col("n"), similarity) <= F.col("max_n")) & (_least(F.col("min_n"), similarity) <= F.col("n"))
        & (slack >= overlap) & (F.col("max_slack") >= overlap)
    )
    return rows.join(sums.hint("shuffle_hash"), ["key", "step"]).filter(fits).select("key", "doc_id", "n", "at", "part").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id, n, n_low, tokens as in classes, with all shingles of the documents named in ids."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def made(batch):
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        yield {"doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "n_low": [len(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]}

    sets = map_batches(needed(docs, "doc_id", "text").join(ids, "doc_id", "left_semi"), made, "doc_id long, n int, n_low int, tokens array<long>")
    return sets.dropDuplicates(["doc_id", "tokens"])


def verified(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets link, with both set sizes and the overlap."""
    pairs = stash(pairs.select("a", "b").distinct())
    ids = stash(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct())
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = needed(docs, "doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = stash(
        map_batches(
            texts,
            lambda batch: [{"doc_id": batch.column("doc_id"), "s": [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), words)]}],
            "doc_id long, s binary",
        )
    )
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")

    def checked(batch):
        x, y = batch.column("x"), batch.column("y")
        size, other, overlap = [], [], []
        for k in range(batch.num_rows):
            s, t = np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64)
            size.append(len(s))
            other.append(len(t))
            overlap.append(len(np.intersect1d(s, t, assume_unique=True)))
        yield {"a": batch.column("a"), "b": batch.column("b"), "size_a": size, "size_b": other, "overlap": overlap}

    found = map_batches(both, checked, "a long, b long, size_a int, size_b int, overlap int")
    hundred = int(round(similarity * 100))
    return found.filter(F.col("overlap").cast("long") * 100 >= hundred * (F.col("size_a") + F.col("size_b") - F.col("overlap")))


def ngram_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, counted: float = COUNTED) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row of docs (doc_id, text).

    class_id is the smallest id of the documents with an equal shingle set. A-Z are lower-cased; a text
    of fewer words than a shingle is one shingle, a null text or one without words has none and links
    with nothing. Rows with equal ids are one document; a row with a null id keeps a null component.
    Every row gives one row; other columns are ignored; an empty table gives an empty one.
    similarity is taken in hundredths.
    """
    held = classes(docs, words, similarity, counted)
    known = held.filter("doc_id is not null and n > 0")
    equal = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("class_id"))
    first = stash(equal)
    one = held.filter("tokens is not null").join(first.select(F.col("class_id").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"], "left_semi")
    # rows of one document in different batches each hold its tokens
    one = one.dropDuplicates(["doc_id", "f1", "f2"])
    lists = stash(prefixes(one, similarity))
    met = stash(meetings(lists, boundary(lists, similarity), similarity))
    heads = met.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).filter("head < last").select("key", "head")
    sizes = first.join(one.select(F.col("doc_id").alias("class_id"), "n"), "class_id").select(F.col("class_id").alias("head"), F.col("n").alias("m"))
    star = met.join(heads.hint("shuffle_hash"), "key").filter("doc_id > head").select("head", "doc_id", "n").distinct()
    star = star.join(sizes, "head").filter(_close(F.col("n"), F.col("m"), similarity)).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    links = stash(verified(docs, star, words, similarity).select("a", "b"))
    joined = components(links)
    # sets of different components that still meet at possible sizes and places are ordered anew by exact
    # frequencies of all their shingles, so what sets them apart comes first and few pairs are left
    part = met.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", "at", F.coalesce("component", "doc_id").alias("part"))
    # rows that are out may have been what held others in
    part = stash(open_rows(stash(open_rows(stash(part), similarity)), similarity))
    open_ids = stash(part.select("doc_id", "part").distinct())
    again = stash(prefixes(full_sets(docs, open_ids.select("doc_id"), words), similarity))
    open_sets = stash(meetings(again, boundary(again, similarity), similarity).join(open_ids, "doc_id"))
    open_sets = stash(open_rows(open_sets, similarity))
    a, b = open_sets.alias("a"), open_sets.alias("b")
    rest = (
        a.join(b, F.col("a.key") == F.col("b.key"))
        .filter((F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.part") != F.col("b.part")) & possible("a", "b", similarity))
        .select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))
        .distinct()
    )
    more = stash(verified(docs, rest.join(star.select("a", "b"), ["a", "b"], "left_anti"), words, similarity).select("a", "b"))
    if more.limit(1).count():
        joined = components(links.unionAll(more))
    named = first.join(joined.withColumnRenamed("id", "class_id"), "class_id", "left").select("f1", "f2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return held.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
    )
