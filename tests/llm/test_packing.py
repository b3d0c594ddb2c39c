import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomgraph.llm import packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, placed, capacity=2048):
    tokenizer = packing.load_tokenizer(PATH)
    expected = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in placed:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.concatenate([[0], np.cumsum([r["length"] for r in s])[:-1]]).tolist()
        assert sum(r["length"] for r in s) <= capacity
    got = []
    for rs in pieces.values():
        by_start = defaultdict(list)
        for r in rs:
            by_start[r["start"]].append(r)
        for first in by_start[0]:  # repeated rows are alike
            ids, at = [], 0
            while at < first["doc_tokens"]:
                piece = by_start[at][0]
                ids += np.frombuffer(bytes(piece["ids"]), "<u4").tolist()
                at += piece["length"]
            got.append(tuple(ids))
    assert sorted(got) == expected
    return len(sequences)


def test_every_id_lies_in_one_piece(frame, odd):
    from tests.llm.conftest import ODD

    check(ODD, packing.pack_documents(odd, PATH, with_ids=True).collect())
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choice(["the", "Straße,", "été.", "x9", "<|endoftext|>", "it's"]) for _ in range(rnd.choice([3, 40, 700, 3000])))) for k in range(150)]
    placed = packing.pack_documents(frame(rows), PATH, with_ids=True).collect()
    n = check(rows, placed)
    assert n <= 1.05 * sum(r["length"] for r in placed) / 2048 + 2
    assert packing.pack_documents(frame([]), PATH).count() == 0


def test_word_cache_equals_the_library():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcÀéß÷×'.,!? \n\t́é日1_-Σİ|<>AB") for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    texts += ["<|ENDOFTEXT|> Ab <|endoftext|>x", "a b c\x1cd\x85e", "it's 'sa. foo's! a|b", "é….', ÄÖÜ ß..", "e\u0338= ≠. İ. ª. naïve·dot", "中.a 中。."]
    words = packing.WordTokenizer(PATH)
    for some in (texts, texts[:700], [t for t in texts if "|>" not in t], [""]):
        ids, stops = words.encode_batch([t.encode("utf-8", "replace") for t in some])
        assert len(stops) == len(some)
        for text, own in zip(some, np.split(ids, stops[:-1]), strict=True):
            assert own.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids + [1]
    ids, stops = words.encode_batch([b"a \xff b", b"c"])
    assert ids[: stops[0] - 1].tolist() == words.tokenizer.encode("a \ufffd b", add_special_tokens=False).ids


def test_small_caches_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    rnd = random.Random(6)
    words = packing.WordTokenizer(PATH)
    for _ in range(30):
        text = " ".join("".join(rnd.choice("abcé.,") for _ in range(rnd.randint(1, 4))) for _ in range(40))
        ids, _ = words.encode_batch([text.encode()])
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_cutting_stock_covers_demand_near_its_bound():
    rnd = np.random.default_rng(1)
    for demand in (rnd.integers(0, 200, 64), np.eye(1, 64, 40, dtype=int)[0] * 7, np.zeros(64, int), rnd.integers(0, 3, 64)):
        plan = packing.cutting_stock(demand.astype(np.int64))
        assert (sum((p * n for p, n in plan), np.zeros(64, np.int64)) == demand).all()
        assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
    demand = rnd.integers(0, 400, 64)
    used = sum(n for _, n in packing.cutting_stock(demand.astype(np.int64)))
    assert used <= 1.02 * (demand * np.arange(1, 65)).sum() / 64 + 2
