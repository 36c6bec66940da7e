"""Token ids of whole texts by a public tokenizer file, worked out on arrays.

The characters of many texts are cut into pre-tokens at once, from their classes. A pre-token is known
by a 64-bit hash; its ids are asked of the library once for each Python worker, and the ids of texts
are gathered from those. Texts with characters beyond Latin letters go to the library as a whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from binomia.llm.common import _powers, mixed
from binomia.llm.pretokens import pieces, plain

#: Characters worked on at once, and pre-tokens whose ids are remembered.
BLOCK_CHARS, REMEMBERED = 1 << 20, 1 << 20
#: The id behind each document.
SEPARATOR = 0
_SLOT_BITS = 21
_LETTER, _NUMBER, _SIGN, _SPACE, _EDGE = range(5)
#: Plain texts have characters below this one; U+0000 stands between texts.
_CHARS = 0x250


def _class_of(char: str) -> int:
    kind = unicodedata.category(char)[0]
    return {"L": _LETTER, "N": _NUMBER}.get(kind, _SPACE if char.isspace() else _SIGN)


_CLASS = np.array([_EDGE] + [_class_of(chr(c)) for c in range(1, _CHARS)], np.uint8)
_VALUES = np.random.default_rng(5150).integers(1, 2**64, _CHARS, dtype=np.uint64)


def unit_starts(chars: np.ndarray, lower: bool = False) -> np.ndarray:
    """Whether a pre-token, or a run of white space, starts at each character; three edge characters must end the array.

    In the lower-case file a number is a pre-token by itself and none begins with a space.
    """
    kind = _CLASS[chars]
    starts = np.ones(len(chars), bool)
    starts[1:] = kind[1:] != kind[:-1]
    if lower:
        starts |= kind == _NUMBER
    else:
        last_space = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] < _SPACE))
        starts[last_space] = True
        starts[last_space[chars[last_space] == ord(" ")] + 1] = False
    quote = np.flatnonzero(chars[:-3] == ord("'"))
    quote = quote[starts[quote]]
    one, two = chars[quote + 1], chars[quote + 2]
    size = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
    pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    size[pair] = 2
    quote, size = quote[size > 0], size[size > 0]
    starts[quote + 1] = False
    starts[quote + 1 + size] = True
    return starts


class Ids:
    """encode(texts) gives all ids one after the other and the number of ids of each text."""

    def __init__(self, path: str):
        self.pieces = pieces(path)
        # what stands between pre-tokens: edges, and white space in the lower-case file
        self.between = _SPACE if self.pieces.lower else _EDGE
        self.forget()

    def forget(self) -> None:
        self.keys, self.number = np.zeros(1 << _SLOT_BITS, np.uint64), np.zeros(1 << _SLOT_BITS, np.int32)
        self.others: dict[int, int] = {}
        self.first, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known pre-tokens, -1 for others."""
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.number[slot], -1).astype(np.int64)
        lost = np.flatnonzero(out < 0)
        if self.others and len(lost):
            out[lost] = [self.others.get(h, -1) for h in hashes[lost].tolist()]
        return out

    def learn(self, hashes: np.ndarray, units: list[str]) -> None:
        found = self.pieces.encode_units(units)
        at = len(self.first) + np.arange(len(units))
        size = np.array([len(f) for f in found], np.int64)
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, np.array([i for f in found for i in f], np.uint32)])
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        _, one = np.unique(slot, return_index=True)
        free = np.zeros(len(slot), bool)
        free[one] = self.keys[slot[one]] == 0
        self.keys[slot[free]], self.number[slot[free]] = hashes[free], at[free]
        self.others.update(zip(hashes[~free].tolist(), at[~free].tolist(), strict=True))

    def plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(texts) + "\0\0\0"
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        starts = np.flatnonzero(unit_starts(chars, self.pieces.lower))
        ends = np.append(starts[1:], len(chars))
        inside = _CLASS[chars[starts]] < self.between
        starts, ends = starts[inside], ends[inside]
        powers, inverse = _powers(len(chars))
        with np.errstate(over="ignore"):
            total = np.zeros(len(chars) + 1, np.uint64)
            np.cumsum(_VALUES[chars] * powers[: len(chars)], out=total[1:])
            hashes = mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)) | np.uint64(1)
        number = self.numbers(hashes)
        lost = np.flatnonzero(number < 0)
        if len(lost):
            if len(self.first) > REMEMBERED:
                self.forget()
                lost = np.arange(len(hashes))
            new, one = np.unique(hashes[lost], return_index=True)
            spans = zip(starts[lost[one]].tolist(), ends[lost[one]].tolist(), strict=True)
            self.learn(new, [joined[a:b] for a, b in spans])
            number = self.numbers(hashes)
        size = self.size[number]
        done = np.cumsum(size)
        ids = self.pool[np.repeat(self.first[number] - done + size, size) + np.arange(done[-1] if len(done) else 0)]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        last = np.searchsorted(starts, np.cumsum(sizes))
        return ids, np.diff(np.append(0, done)[last], prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids as 32-bit numbers; no special tokens are added, strings of special tokens count as such."""
        parts = [(k, p, n % 2 == 1) for k, t in enumerate(texts) for n, p in enumerate(self.pieces.parts(t))]
        made: list[np.ndarray | None] = [None] * len(parts)
        batch: list[int] = []
        size = 0

        def flush():
            ids, sizes = self.plain_ids([parts[n][1] for n in batch])
            for n, part in zip(batch, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                made[n] = part

        for n, (k, part, special) in enumerate(parts):
            if special:
                made[n] = np.array([self.pieces.added[part]], np.uint32)
                continue
            known = plain(part)
            if known and self.pieces.lower:
                # a few Latin letters have their lower form beyond the plain ones
                low = part.lower()
                known = plain(low)
                if known:
                    part, parts[n] = low, (k, low, special)
            if not known:
                made[n] = np.array(self.pieces.encode([part])[0], np.uint32)
            else:
                if batch and size + len(part) > BLOCK_CHARS:
                    flush()
                    batch, size = [], 0
                batch.append(n)
                size += len(part) + 1
        if batch:
            flush()
        sizes = np.bincount([k for k, _, _ in parts], [len(m) for m in made], len(texts)).astype(np.int64)
        return np.concatenate([*made, np.zeros(0, np.uint32)]), sizes


@lru_cache(maxsize=2)
def ids_of_file(path: str) -> Ids:
    """One for each tokenizer file and Python worker."""
    return Ids(path)


def with_ends(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with the separator behind them."""
    return np.insert(ids, np.cumsum(sizes), SEPARATOR).astype(np.uint32, copy=False), sizes + 1
