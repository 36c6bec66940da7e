import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from binomia.llm import mixing_coder as coder
from binomia.llm import token_files
from binomia.llm.token_ids import Ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a  b\n\n c", "'s's 'st'real''s  'll \"'s don't we'll we're'x", "x\ty\n", "12ab٣4", "\n \n", "a'S b'LL",
    "<|endoftext|> hi<|endoftext|>", "é²½ ñ", "日本語 text", "a b \x1c c\x00d", "word " * 5000,
])
def test_ids_equal_the_library(library, text):
    ids, sizes = Ids(PATH).encode([text, "x", text])
    expected = library.encode(text, add_special_tokens=False).ids
    assert sizes.tolist() == [len(expected), 1, len(expected)]
    assert ids.tolist() == [*expected, *library.encode("x").ids, *expected]


def test_ids_of_the_lower_case_file_equal_the_library():
    words = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(words)
    texts = [
        "", " \n", "Don't WE'LL 's'S 'st!'s ''re 'vex", "12ab\u06634\u00b2\u00bd", "\u0130stanbul \u023a\u023e", "a<|endoftext|>'S <|startoftext|>x", "\u65e5\u672c a", "x\xa0y\x1cz\0",
        "".join(map(chr, range(1, 0x250))), "Word " * 5000,
    ]
    ids, sizes = Ids(words).encode(texts)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(e) for e in expected]
    assert ids.tolist() == sum(expected, [])


def test_plain_units_are_not_split_again(monkeypatch):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ids_of = Ids(public_tokenizers.path(name))
        monkeypatch.setattr(ids_of.pieces, "encode", None)
        assert len(ids_of.encode(["Some w\u00f6rds, it's 12 of them"])[0])


def test_forgotten_units_are_asked_again(library, monkeypatch):
    monkeypatch.setattr("binomia.llm.token_ids.REMEMBERED", 3)
    ids_of = Ids(PATH)
    for text in ("some words here", "other words there", "some words here"):
        assert ids_of.encode([text])[0].tolist() == library.encode(text).ids


rng = np.random.default_rng(3)
CASES = {
    "one": np.zeros(1), "same": np.zeros(9000), "all new": np.arange(5000), "noise": rng.integers(0, 50257, 9001),
    "period": np.tile(rng.integers(0, 2**32, 7), 1500), "large": np.array([2**32 - 1, 5]), "zipf": rng.zipf(1.3, 20000) % 60000,
    "late news": np.concatenate([np.zeros(4000), np.arange(4000)]),
}


@pytest.mark.parametrize("name", CASES)
def test_blocks_come_back(name):
    ids = CASES[name].astype(np.uint32)
    blocks = coder.encode_group(ids)
    assert [n for n, _ in blocks[:-1]] == [coder.BLOCK_IDS] * (len(blocks) - 1)
    assert (coder.decode_group(blocks) == ids).all()
    # each block by itself
    assert (np.concatenate([coder.decode_group([b]) for b in blocks]) == ids).all()


def test_repeats_are_foretold():
    ids = np.tile(rng.integers(0, 50000, 50), 80).astype(np.uint32)
    assert sum(len(data) for _, data in coder.encode_group(ids)) < 0.2 * len(ids)


def test_damage_is_noticed():
    ids = (rng.zipf(1.4, 4000) % 5000).astype(np.uint32)
    n, data = coder.encode_group(ids)[0]
    for at in (0, 5, 9, 13, 40, len(data) // 2, len(data) - 9):
        broken = bytearray(data)
        broken[at] ^= 0x41
        with pytest.raises(coder.Damaged):
            coder.decode_group([(n, bytes(broken))])
    with pytest.raises(coder.Damaged):
        coder.decode_group([(n, data[:-4])])


def test_files_hold_all_documents_in_order(spark, documents, library, tmp_path):
    folder = str(tmp_path / "ids")
    manifest = token_files.write_token_files(documents, folder, PATH, file_bytes=8000).collect()
    assert len(manifest) > 1
    rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
    given = sorted(documents.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in given]
    start = 0
    for row, doc in zip(rows, given, strict=True):
        ids = [*library.encode(doc["text"] or "", add_special_tokens=False).ids, 0]
        assert (row["start"], row["n_tokens"], row["ids"]) == (start, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_of_nothing(spark, nothing, tmp_path):
    assert token_files.token_files(nothing, PATH, str(tmp_path / "none")).count() == 0


def test_a_document_over_several_groups(monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "_GROUP_IDS", 3 * coder.BLOCK_IDS)
    path = str(tmp_path / "x.ids")
    ids = (rng.zipf(1.2, 40000) % 50000).astype(np.uint32)
    with pa.OSFile(path, "wb") as stream:
        writer = token_files._Writer(stream)
        writer.add([7, None], ids, np.array([30000, 10000]))
        writer.close()
    with pa.OSFile(path) as source:
        found = [(d, n, np.concatenate(parts)) for d, n, parts in token_files.read_file(source)]
    assert [(d, n) for d, n, _ in found] == [(7, 30000), (None, 10000)]
    assert (np.concatenate([x for *_, x in found]) == ids).all()
    data = bytearray(open(path, "rb").read())
    data[-40] ^= 1
    with pytest.raises(coder.Damaged):
        list(token_files.read_file(pa.BufferReader(bytes(data))))
