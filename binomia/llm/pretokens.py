"""Pre-tokens and pieces of public tokenizer files, without running a tokenizer over whole texts.

A unit is a stretch of text that a tokenizer never joins with its neighbours: a pre-token of the
byte-level file, what stands between white space in the lower-case one. Units repeat far more often than texts do, so their pieces are
worked out once and remembered or joined.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import regex

#: Patterns of the two tokenizer files (fixed values; \\s is Unicode white space).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LOWER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Beyond these characters classes, case and composed forms depend on the Unicode version: the library splits such texts.
_OTHER = re.compile("[^\x00-ɏ]")
_ODD = b"\x00\x1c\x1d\x1e\x1f\x85\xa0"
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The character that stands for each byte in a byte-level file: itself, or one from U+0100 on.
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 0x100 + n for n, b in enumerate(sorted({*range(256)}.difference(_SHOWN)))}


def plain(text: str) -> bool:
    """Whether all characters are Latin letters, digits and signs, and no white space is an odd one."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return _OTHER.search(text) is None and not any(chr(c) in text for c in _ODD)
    return len(data.translate(None, _ODD)) == len(data)


class Pieces:
    """Cuts texts into units as a tokenizers file does and encodes single units.

    Added tokens are cut out first, as the library does by default. A text with characters beyond
    Latin is split by the library's own normalizer and splitter.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.added = added
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in added) + ")") if added else None
        self.lower = self.library.normalizer is not None
        self.find = regex.compile(LOWER_WORDS if self.lower else BYTE_LEVEL).findall

    def parts(self, text: str) -> list[str]:
        """Stretches of the text; every second one is an added token."""
        return self.cut.split(text) if self.cut else [text]

    def units(self, text: str) -> list[str]:
        """The units of one stretch in order; encoding each alone gives the stretch's pieces."""
        if not plain(text):
            if self.lower:
                text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        if self.lower:
            return text.lower().split()
        return self.find(text)

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """The same of plain units: they are whole already, so the library's model is asked alone."""
        ids_of = self.library.model.tokenize
        return [[t.id for t in ids_of(u.encode().decode("latin-1").translate(_BYTE_CHARS))] for u in units]


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One for each file and Python worker."""
    return Pieces(path)
