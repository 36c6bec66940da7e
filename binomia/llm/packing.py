"""Best-fit packing: a grouping genetic algorithm on islands, with elites that migrate.

Documents become token ids and end in id 0; only those longer than a sequence are cut. Full pieces are
sequences of their own. The others are dealt to shards of a bounded number of pieces. Several islands
evolve packings of a shard: crossover injects whole well-filled bins of one parent into another,
removes the bins that hold duplicates and best-fits the displaced pieces; after every epoch an island's
elite moves to the next island of the shard. The best packing's well-filled bins stay, the pieces of
the others meet in fewer shards on the next level, until one shard is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binomia.llm.common import map_batches, needed, stash
from binomia.llm.token_ids import ids_of_file, with_ends

#: Pieces of a shard; islands of each and epochs between migrations; fill from which a bin is final.
SHARD_PIECES, ISLANDS, EPOCHS, FINAL_FILL = 3000, 2, 2, 0.98
#: Packings of an island, least number of children of an epoch, children in a row without a better packing
#: after which it ends.
POPULATION, CHILDREN, PATIENCE = 3, 4, 25
#: Islands that a task evolves, one after the other.
TASK_ISLANDS = 4


def document_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row; a null text is empty and still ends in id 0."""

    def cut(batch, ids_of):
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        ids, sizes = with_ends(*ids_of.encode([v.as_py() or "" for v in batch.column("text")]))
        data, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
        for doc_id, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
            for piece, start in enumerate(range(0, size, capacity)):
                length = min(capacity, size - start)
                check = zlib.crc32(data[4 * (at + start) : 4 * (at + start + length)])
                for name, value in zip(out, (doc_id, piece, start, length, check), strict=True):
                    out[name].append(value)
            at += size
        yield out

    return map_batches(
        needed(docs, "doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long", start=lambda: ids_of_file(path)
    )


# --- the genetic algorithm on one shard; a packing is an array of bin numbers, one for each piece ---


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Put pieces in the given order into the fullest bin that still holds them."""
    bins = bins if bins is not None else []
    room = sorted((capacity - int(lengths[b].sum()), k) for k, b in enumerate(bins))
    for piece in order.tolist():
        need = int(lengths[piece])
        at = bisect_left(room, (need, -1))
        if at == len(room):
            bins.append([piece])
            left, k = capacity - need, len(bins) - 1
        else:
            left, k = room.pop(at)
            bins[k].append(piece)
            left -= need
        if left:
            insort(room, (left, k))
    return bins


def fitness(lengths: np.ndarray, packing: np.ndarray, capacity: int) -> float:
    """Mean square of the bins' fill: fewer and fuller bins are better."""
    fill = np.bincount(packing, lengths) / capacity
    return float((fill**2).sum() / max(len(fill), 1))


def numbered(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, members in enumerate(bins):
        out[members] = k
    return out


def crossover(lengths: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Inject well-filled bins of father into mother, drop her bins that now hold duplicates, best-fit the rest."""
    fill = np.bincount(father, lengths)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = well[rng.random(len(well)) < 0.3]
    injected = np.isin(father, chosen)
    hit = np.unique(mother[injected])
    # the least filled bins of the mother are opened too, so their pieces can find better places
    fill = np.bincount(mother, lengths)
    hit = np.union1d(hit, np.argsort(fill)[: max(1, len(fill) // 50)])
    opened = np.isin(mother, hit)
    bins: dict[int, list[int]] = {}
    for piece in np.flatnonzero(injected).tolist():
        bins.setdefault(-1 - int(father[piece]), []).append(piece)
    for piece in np.flatnonzero(~opened & ~injected).tolist():
        bins.setdefault(int(mother[piece]), []).append(piece)
    displaced = np.flatnonzero(opened & ~injected)
    order = displaced[np.argsort(-lengths[displaced], kind="stable")]
    return numbered(best_fit(lengths, order, capacity, list(bins.values())), len(lengths))


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, children: int = CHILDREN, patience: int = PATIENCE) -> list[np.ndarray]:
    """One epoch of one island; the best packing comes first.

    Goes on as long as children better the packing; stops early when no bin can be saved.
    """
    rng = np.random.default_rng(seed)
    n, least = len(lengths), -(-int(lengths.sum()) // capacity)
    if not population:
        population = [numbered(best_fit(lengths, np.argsort(-lengths, kind="stable"), capacity), n)]
        while len(population) < POPULATION and population[0].max(initial=0) + 1 > least:
            noisy = lengths * rng.uniform(0.9, 1.1, n)
            population.append(numbered(best_fit(lengths, np.argsort(-noisy, kind="stable"), capacity), n))
    rank = lambda p: (int(p.max(initial=0)), -fitness(lengths, p, capacity))
    population = sorted(population, key=rank)[:POPULATION]
    made = idle = 0
    while made < children or idle < patience:
        if len(population) < 2 or population[0].max(initial=0) + 1 <= least:
            break
        mother, father = rng.permutation(len(population))[:2]
        bins, fill = rank(population[0])
        population = sorted([*population, crossover(lengths, population[mother], population[father], capacity, rng)], key=rank)[:POPULATION]
        now = rank(population[0])
        better = now[0] < bins or now[1] < fill - 1e-6
        made, idle = made + 1, 0 if better else idle + 1
    return population


def pack_level(pieces: DataFrame, shards: int, capacity: int, islands: int, epochs: int, level: int) -> DataFrame:
    """Pack the pieces (row, length) of one level: row, sequence, fill of its bin."""
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
    shard = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("row", "length"))).alias("items"))
    shard = stash(shard.select("shard", F.col("items.row").alias("rows"), F.col("items.length").alias("lengths")))
    state = shard.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = state.withColumn("packings", F.lit(None).cast("array<array<int>>"))
    # rows are small and costly: their number says how many tasks there are, not their bytes
    tasks = -(-shards * islands // TASK_ISLANDS)
    task = ((F.col("shard") * islands + F.col("island")) % tasks).cast("int")

    def epoch(number):
        def run(batch):
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                before = [np.array(p, np.int32) for p in row["packings"] or []]
                found = evolve(lengths, before, capacity, hash((row["shard"], row["island"], number, level)) % 2**32)
                yield {"shard": [row["shard"]], "island": [row["island"]], "lengths": [row["lengths"]], "packings": [[p.tolist() for p in found]]}

        return run

    schema = "shard long, island int, lengths array<long>, packings array<array<int>>"
    for number in range(epochs):
        dealt = state.select("shard", "island", "lengths", "packings").repartitionById(tasks, task)
        state = map_batches(dealt, epoch(number), schema, rows=1)
        if number + 1 < epochs:
            state = stash(state)
            elites = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("packings")[0].alias("elite"))
            state = state.join(elites, ["shard", "island"]).withColumn("packings", F.concat("packings", F.array("elite")))
    best = state.select("shard", F.col("packings")[0].alias("packing"), F.array_max(F.col("packings")[0]).alias("bins"), "island")
    best = best.groupBy("shard").agg(F.min_by("packing", F.struct("bins", "island")).alias("packing"))
    placed = best.join(shard, "shard").select(
        "shard", F.explode(F.arrays_zip("rows", "lengths", "packing")).alias("x")
    ).select("shard", F.col("x.rows").alias("row"), F.col("x.lengths").alias("length"), F.col("x.packing").alias("bin"))
    filled = placed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    number = (F.lit(level + 1).cast("long") * F.lit(1 << 54)) + F.col("shard") * F.lit(1 << 24) + F.col("bin")
    return placed.join(filled, ["shard", "bin"]).select("row", number.alias("sequence_id"), "fill")


def best_fit_packing(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    shard_pieces: int = SHARD_PIECES,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    final_fill: float = FINAL_FILL,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    path: a file of the tokenizers library. Null and empty texts are one piece of one id. Every row is
    packed, repeated ids and null ids too; other columns are ignored; an empty table gives an empty one.
    A level ends the packing when one shard held it all, or when its well-filled bins hold so little
    that meeting again would not help (all pieces of just over half a sequence, for one).
    """
    cut = document_pieces(docs, path, capacity)
    pieces = stash(cut.withColumn("row", F.monotonically_increasing_id()))
    whole = pieces.filter(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"))
    open_pieces, placed, level = pieces.filter(F.col("length") < capacity).select("row", "length"), [whole], 0
    left = open_pieces.count()
    while left:
        shards = -(-left // shard_pieces)
        packed = stash(pack_level(open_pieces, shards, capacity, islands, epochs, level))
        ends = F.col("fill") >= int(final_fill * capacity)
        loose = packed.filter(~ends)
        rest = loose.count() if shards > 1 else 0
        if rest > 0.7 * left:
            rest = 0
        placed.append((packed.filter(ends) if rest else packed).select("row", "sequence_id"))
        if rest:
            open_pieces = open_pieces.join(loose.select("row"), "row")
        left, level = rest, level + 1
    sequences = placed[0]
    for more in placed[1:]:
        sequences = sequences.unionAll(more)
    order = Window.partitionBy("sequence_id").orderBy("row")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pieces.join(sequences, "row").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", offset.cast("long").alias("offset")
    )
