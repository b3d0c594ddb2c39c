"""Token files against the tokenizer itself, the code against plain loops, damage and odd rows."""

import random
import zlib

import numpy as np
import pytest
from tests.llm.conftest import ODD

from loomgraph.llm import token_files as T
from loomgraph.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encoded(pieces, texts):
    ids, stops = pieces.encode_batch([t.encode() for t in texts])
    return [x.tolist() for x in np.split(ids, stops)[:-1]]


def test_pieces_equal_the_library(library, monkeypatch):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "Zq", "'s", "'ll", "'", "ß", "é", "÷", "×", "日", "本", ".", ",", "!?", "\xa0", "\x85", "\x1c", "1", "²", "👍🏽", "<|endoftext|>", "|>", "_", "\r\n", "don't", "x'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", " ", "word " * 5000, "x" * 5000, "日" * 3000]
    want = [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(T.PieceTokenizer(PATH, 2), texts) == want
    monkeypatch.setattr(T, "CACHE_PIECES", 50)  # the cache starts anew all the time
    small = T.PieceTokenizer(PATH, 2)
    assert [x for k in range(0, len(texts), 100) for x in encoded(small, texts[k : k + 100])] == want


def test_the_faster_merges_give_the_whole_vocabulary_alike(library):
    """Every token as a text, alone and after a space: the two libraries agree."""
    fast = T.fast_merges(library)
    texts = [library.decode([i]) for i in range(50256)]
    texts = [t for t in texts if "�" not in t] + [" " + t for t in texts if t and "�" not in t]
    assert [fast.encode_ordinary(t) for t in texts] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_code_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint64).clip(0, 2**32 - 1).astype("<u4")
        control, data = T.encode_ranks(ranks)
        lengths = [max(1, (int(r).bit_length() + 7) // 8) for r in ranks]
        assert data == b"".join(int(r).to_bytes(k, "little") for r, k in zip(ranks, lengths, strict=True))
        assert [control[k // 4] >> 2 * (k % 4) & 3 for k in range(n)] == [k - 1 for k in lengths]
        assert (T.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_damaged_files_are_told():
    block = T.pack_block([1, None], [2, 1], np.array([0, 300, 70_000], "<u4")) + b"\n"
    (found,) = T.blocks(memoryview(block))
    names, sizes, ranks = T.unpack_block(*found)
    assert (names, sizes.tolist(), ranks.tolist()) == ([1, None], [2, 1], [0, 300, 70_000])
    bad = bytearray(block)
    bad[-3] ^= 1
    with pytest.raises(ValueError):
        T.unpack_block(*next(T.blocks(memoryview(bytes(bad)))))
    with pytest.raises(ValueError):
        list(T.blocks(memoryview(block[:-5])))


def test_files_hold_all_documents_in_order(spark, frame, library, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "BLOCK_IDS", 40)
    monkeypatch.setattr(T, "SMALL_FILE_IDS", 2000)
    rng = random.Random(2)
    rows = [*ODD, (-5, "before all <|endoftext|>"), *((k, " ".join(rng.choice(["alpha", "beta", "Gamma,", "δ"]) for _ in range(rng.randint(0, 60)))) for k in range(20, 90)), (30, "the same id")]
    T.write_token_files(frame(rows), PATH, str(tmp_path / "f"))
    found = T.read_token_files(spark, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, (_, t) in enumerate(rows)}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = sorted(((d is not None, d or 0, crc(ids[k]), len(ids[k])), ids[k]) for k, (d, _) in enumerate(rows))
    at = 0
    for row, ((there, doc, code, n), own) in zip(found, want, strict=True):
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc if there else None, at, n, code)
        assert np.frombuffer(row["ids"], "<u4").tolist() == own
        at += n
    files = list((tmp_path / "f" / "tokens").glob("part-*"))
    assert len(files) > 1
    counts = np.bincount([i for x in ids.values() for i in x])
    ranks = spark.read.parquet(str(tmp_path / "f" / "ranks")).orderBy("rank").collect()
    assert [(r["n"], r["id"]) for r in ranks] == sorted(((int(n), i) for i, n in enumerate(counts) if n), key=lambda x: (-x[0], x[1]))


def test_no_documents(spark, frame):
    assert T.round_trip(frame([]), PATH).collect() == []
    assert [tuple(r)[:3] for r in T.round_trip(frame([(None, None)]), PATH).collect()] == [(None, 0, 1)]
