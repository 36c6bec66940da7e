"""An adaptive context-mixing range coder for token ids, run over many blocks in lockstep.

A block is a run of ids that is coded by itself: its models start empty, and its check value tells
whether it came back whole. Within a block ids are replaced by ranks in order of first appearance. Three
models foretell the next rank: the rank that last followed the last two, the rank that last followed the
last one, and the frequencies of all ranks so far. How far each of the first two is trusted is learned
by what they got right in the same state (how often in a row each was right, whether they agree).
The three are added up to one distribution, and a range coder with integer arithmetic only codes the rank
in one step. All blocks of a group take a step together, so a step is a few array operations.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block (at most 2^13, as a rank shares 16 bits with its run of successes), blocks of a group.
BLOCK_IDS, GROUP_BLOCKS = 1 << 12, 1 << 11
#: The distribution is cut into 2^24 parts; the range never falls below 2^32 before a step.
_PARTS = 24
_CONTEXT_BITS = 12
#: Places of a lane in each table: a few more than needed, since lanes a power of two apart share cache lines.
_ONE, _TWO, _STATE = BLOCK_IDS + 37, (1 << _CONTEXT_BITS) + 37, 128 + 3
#: Counts of a state are halved when they reach this.
_MOST = 255
#: Steps between new frequencies of ranks: as many as there were, at most these.
_FIRST, _LATEST = 16, 512

#: Reciprocals, as multiplying is faster than dividing whole numbers: of steps, of late ranks, of summed weights.
_OF_STEPS = (1 << _PARTS) // (2 * np.arange(1024) + 4)
_OF_LATE = (1 << 20) // np.maximum(np.arange(BLOCK_IDS + 2), 1)
_OF_WEIGHTS = (1 << 38) // np.maximum(np.arange(2 * BLOCK_IDS + 3), 1)
#: What a miss (first eight) or a hit changes in a run of successes; after a miss at 0 or 1 the rank is entered anew.
_CHANGE = np.array([0, 0, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], np.int64)
_LOW32, _SHIFT = np.uint64(0xFFFFFFFF), np.uint64(32)


class Damaged(ValueError):
    """A block whose ids differ from those written."""


class _Models:
    """The models of `lanes` blocks; the same for coder and decoder. Tables are flat, a lane's part follows the last lane's."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.one = np.zeros(lanes * _ONE, np.uint16)
        self.two = np.zeros(lanes * _TWO, np.uint16)
        self.state = np.zeros(lanes * _STATE, np.int32)  # hits of both contexts and steps, ten bits each
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.seen = np.zeros(lanes, np.int64)
        self.counts = np.zeros((lanes, 1), np.int32)
        self.refresh_at = _FIRST
        self.places()
        self.settle()

    def places(self) -> None:
        lane = np.arange(self.lanes)
        self.in_one, self.in_two, self.in_state = lane * _ONE, lane * _TWO, lane * _STATE

    def drop_last(self) -> None:
        """The last block has ended: the others go on."""
        self.lanes -= 1
        for name in ("last", "before", "seen", "counts", "known", "total", "in_sums", "in_inverse"):
            setattr(self, name, getattr(self, name)[:-1])
        self.places()

    def settle(self) -> None:
        """New frequencies: a rank seen n times weighs 2n - 1."""
        self.known = self.seen.copy()
        self.weights = np.maximum(2 * self.counts - 1, 0)
        width = self.weights.shape[1] + 1
        sums = np.zeros((self.lanes, width), np.int32)
        np.cumsum(self.weights, axis=1, out=sums[:, 1:])
        self.total = sums[:, -1].astype(np.int64)
        self.sums, self.in_sums = sums.ravel(), np.arange(self.lanes) * width
        self.in_inverse = np.zeros(self.lanes, np.int64)

    def inverted(self) -> None:
        """For the decoder: the rank at each place of the summed weights."""
        ranks = np.broadcast_to(np.arange(self.weights.shape[1], dtype=np.uint16), self.weights.shape)
        self.inverse = np.append(np.repeat(ranks.ravel(), self.weights.ravel()), np.uint16(0))
        self.in_inverse = np.cumsum(self.total) - self.total

    def count(self, ranks: np.ndarray) -> None:
        """Add the ranks of the last steps (one row a step) to the counts."""
        width = int(self.seen.max(initial=0))
        flat = (np.arange(self.lanes)[None, :] * width + ranks).ravel()
        new = np.bincount(flat, minlength=self.lanes * width).reshape(self.lanes, width).astype(np.int32)
        new[:, : self.counts.shape[1]] += self.counts[:, :width]
        self.counts = new

    def foretell(self) -> None:
        self.at_two = self.in_two + ((self.last * 1237 + self.before) & ((1 << _CONTEXT_BITS) - 1))
        self.at_one = self.in_one + self.last
        self.entry2 = self.two.take(self.at_two).astype(np.int64)
        self.entry1 = self.one.take(self.at_one).astype(np.int64)
        self.guess2, self.guess1 = self.entry2 >> 3, self.entry1 >> 3
        self.run2, self.run1 = self.entry2 & 7, self.entry1 & 7
        self.at_state = self.in_state + ((self.run2 << 4) + (self.run1 << 1) + (self.guess1 == self.guess2))
        packed = self.packed = self.state.take(self.at_state)
        part = _OF_STEPS.take(packed & 1023)
        self.trust2 = (((packed >> 9) & 2046) + 1) * part
        self.trust1 = (((packed >> 19) & 2046) + 1) * part
        self.late = self.seen - self.known + 1
        new = self.seen + 1
        self.unit = ((1 << _PARTS) - self.trust2 - self.trust1) * _OF_WEIGHTS.take(self.total + new) >> 38
        self.base = self.unit * self.total
        self.share = self.unit * new * _OF_LATE.take(self.late) >> 20  # of each rank that the frequencies don't hold

    def below(self, rank: np.ndarray) -> np.ndarray:
        """Summed parts of all lesser ranks, by frequency alone."""
        held = np.minimum(rank, self.known)
        return self.unit * self.sums.take(self.in_sums + held) + (rank - held) * self.share

    def interval(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, right2, right1 = self.below(rank), self.guess2 == rank, self.guess1 == rank
        size = self.below(rank + 1) - start + self.trust2 * right2 + self.trust1 * right1
        return start + self.trust2 * (self.guess2 < rank) + self.trust1 * (self.guess1 < rank), size

    def find(self, place: np.ndarray) -> np.ndarray:
        """The rank whose interval holds a place. Numbers below 2^25 divide exactly as doubles."""
        low, high = np.minimum(self.guess1, self.guess2), np.maximum(self.guess1, self.guess2)
        both = self.trust1 + self.trust2
        add_low = np.where(self.guess2 == low, self.trust2, self.trust1)
        np.copyto(add_low, both, where=low == high)
        end_low = self.below(low + 1) + add_low
        # places behind the lesser guess, then behind the greater one, are those of the frequencies
        rest = place - add_low * (place >= end_low)
        end_high = self.below(high + 1)
        add_high = both - add_low
        behind = rest >= end_high + add_high
        is_high = (rest >= self.below(high)) & ~behind
        rest = rest - add_high * behind
        rank = self.inverse.take(self.in_inverse + (rest / self.unit).astype(np.int64), mode="clip").astype(np.int64)
        late = np.flatnonzero(rest >= self.base)
        if len(late):
            more = ((rest[late] - self.base[late]) / self.share[late]).astype(np.int64)
            rank[late] = np.minimum(self.known[late] + more, self.seen[late])
        np.copyto(rank, high, where=is_high)
        np.copyto(rank, low, where=(place >= self.below(low)) & (place < end_low))
        return rank

    def learn(self, rank: np.ndarray) -> None:
        right2 = self.guess2 == rank
        right1 = self.guess1 == rank
        packed = self.packed + 1 + (right2.astype(np.int32) << 10) + ((right1 & ~right2).astype(np.int32) << 20)
        full = np.flatnonzero((packed & 1023) >= _MOST)
        if len(full):
            packed[full] = (packed[full] >> 1) & 0x1FF7FDFF
        self.state[self.at_state] = packed
        fresh = (rank << 3) | 1
        for table, at, entry, run, right in (
            (self.two, self.at_two, self.entry2, self.run2, right2),
            (self.one, self.at_one, self.entry1, self.run1, right1),
        ):
            code = run + 8 * right
            entry = entry + _CHANGE.take(code)
            np.copyto(entry, fresh, where=code <= 1)
            table[at] = entry
        self.seen = np.maximum(self.seen, rank + 1)
        self.before, self.last = self.last, rank


class _Ranks:
    """Ranks of a block's ids by first appearance, and the id of each rank."""

    def __init__(self, largest: int):
        # a table over all ids where they are small enough, else sorting
        self.table = np.zeros(largest + 1, np.int64) if largest < 1 << 20 else None

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            distinct, first, back = np.unique(ids, return_index=True, return_inverse=True)
            order = np.argsort(first)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return rank[back], distinct[order]
        place = np.arange(len(ids))
        self.table[ids[::-1]] = place[::-1]
        names = ids[self.table[ids] == place]
        self.table[names] = np.arange(len(names))
        return self.table[ids], names


def encode_group(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> list[tuple[int, bytes]]:
    """(number of ids, bytes) of each block of a run of ids, at most GROUP_BLOCKS blocks."""
    lanes = -(-len(ids) // block_ids)
    last_size = len(ids) - (lanes - 1) * block_ids
    ranks = np.zeros((lanes, block_ids), np.uint16)
    lists, ranks_of = [], _Ranks(int(ids.max(initial=0)))
    for k in range(lanes):
        part, names = ranks_of(ids[k * block_ids : (k + 1) * block_ids])
        ranks[k, : len(part)] = part
        lists.append(names.astype("<u4"))
    ranks = np.ascontiguousarray(ranks.T)
    words = np.zeros((lanes, block_ids + 8), np.uint32)
    sizes = np.zeros(lanes, np.int64)
    models = _Models(lanes)
    low, span, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64), np.zeros(lanes, np.int64)
    since = 0

    def ended(k: int) -> None:
        # the 64 bits of the low end of the range close a block
        words[k, size[k] : size[k] + 2] = [int(low[k]) >> 32, int(low[k]) & 0xFFFFFFFF]
        sizes[k] = size[k] + 2

    for step in range(block_ids if lanes > 1 else last_size):
        if step == last_size and models.lanes == lanes:
            ended(lanes - 1)
            models.drop_last()
            low, span, size = low[:-1], span[:-1], size[:-1]
        n = models.lanes
        if step == models.refresh_at:
            models.count(ranks[since:step, :n])
            models.settle()
            since, models.refresh_at = step, step + min(step, _LATEST)
        rank = ranks[step, :n].astype(np.int64)
        models.foretell()
        start, parts = models.interval(rank)
        models.learn(rank)
        span = span >> np.uint64(_PARTS)
        low = low + span * start.astype(np.uint64)
        span = span * parts.astype(np.uint64)
        short = np.flatnonzero(span <= _LOW32)
        if len(short):
            at = low[short]
            # where the range straddles two words its end is cut, so no carry ever runs back
            straddles = (at ^ (at + span[short] - np.uint64(1))) > _LOW32
            span[short] = np.where(straddles, (~at + np.uint64(1)) & _LOW32, span[short]) << _SHIFT
            words[short, size[short]] = (at >> _SHIFT).astype(np.uint32)
            size[short] += 1
            low[short] = at << _SHIFT
    for k in range(models.lanes):
        ended(k)
    out = []
    for k in range(lanes):
        part = ids[k * block_ids : (k + 1) * block_ids].astype("<u4")
        names = lists[k] if len(lists[k]) and lists[k].max() >= 1 << 16 else lists[k].astype("<u2")
        head = np.array([zlib.crc32(part), len(names), names.itemsize, sizes[k]], "<u4")
        out.append((len(part), head.tobytes() + names.tobytes() + words[k, : sizes[k]].astype("<u4").tobytes()))
    return out


def decode_group(blocks: list[tuple[int, bytes]]) -> np.ndarray:
    """The ids of blocks of one size, the last of which may be shorter. A changed block raises Damaged."""
    lanes = len(blocks)
    block_ids, last_size = blocks[0][0], blocks[-1][0]
    heads, lists, tails = [], [], []
    for _, data in blocks:
        head = np.frombuffer(data, "<u4", 4).astype(np.int64) if len(data) >= 16 else np.zeros(4, np.int64)
        end = 16 + head[1] * head[2]
        if head[1] == 0 or head[2] not in (2, 4) or end + 4 * head[3] != len(data):
            raise Damaged("a block has another length than its head says")
        heads.append(head)
        lists.append(np.frombuffer(data, f"<u{head[2]}", head[1], 16))
        tails.append(np.frombuffer(data[end:], "<u4"))
    words = np.zeros((lanes, max(len(t) for t in tails) + 2), np.uint64)
    for k, tail in enumerate(tails):
        words[k, : len(tail)] = tail
    ranks = np.zeros((block_ids, lanes), np.uint16)
    models = _Models(lanes)
    models.inverted()
    low, span, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64), np.full(lanes, 2, np.int64)
    code = (words[:, 0] << _SHIFT) | words[:, 1]
    most = np.array([len(names) - 1 for names in lists], np.int64)
    since = 0
    for step in range(block_ids):
        if step == last_size and models.lanes == lanes:
            models.drop_last()
            low, span, size, code, most = low[:-1], span[:-1], size[:-1], code[:-1], most[:-1]
        n = models.lanes
        if not n:
            break
        if step == models.refresh_at:
            models.count(ranks[since:step, :n])
            models.settle()
            models.inverted()
            since, models.refresh_at = step, step + min(step, _LATEST)
        models.foretell()
        span = span >> np.uint64(_PARTS)
        place = np.minimum((code - low) // span, np.uint64((1 << _PARTS) - 1)).astype(np.int64)
        # a damaged block may lead to a rank it has no id for: go on with one it has, its check value fails
        rank = np.minimum(models.find(place), most)
        ranks[step, :n] = rank
        start, parts = models.interval(rank)
        models.learn(rank)
        low = low + span * start.astype(np.uint64)
        span = span * parts.astype(np.uint64)
        short = np.flatnonzero(span <= _LOW32)
        if len(short):
            at = low[short]
            straddles = (at ^ (at + span[short] - np.uint64(1))) > _LOW32
            span[short] = np.maximum(np.where(straddles, (~at + np.uint64(1)) & _LOW32, span[short]), np.uint64(1)) << _SHIFT
            place = np.minimum(size[short], words.shape[1] - 1)
            code[short] = (code[short] << _SHIFT) | words[short, place]
            size[short] += 1
            low[short] = at << _SHIFT
    out = []
    for k, (n, _) in enumerate(blocks):
        ids = lists[k][ranks[:n, k]]
        if zlib.crc32(ids.astype("<u4")) != int(heads[k][0]):
            raise Damaged(f"block {k} of the group fails its check value")
        out.append(ids)
    return np.concatenate(out)
