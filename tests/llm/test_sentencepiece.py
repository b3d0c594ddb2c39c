import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from loomgraph.llm.sentencepiece_codec import Codec, encode_documents  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


def expected(i, text):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = sp.encode(text or "", add_bos=True, add_eos=True)
    return (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_equals_the_library_on_hard_words():
    sp, codec, rnd = sentencepiece.SentencePieceProcessor(model_file=PATH), Codec(PATH), random.Random(5)
    texts = [" " * n for n in range(70)] + ["a" * n for n in range(1, 60)] + ["<s> </s> <unk> <0x0A> ▁x ▁"]
    texts += ["".join(rnd.choice(["==", "--", "\\", "//", "  ", "in", "ing", "tion", "aa", "   ", "e", "日", "🎉", "\n"]) for _ in range(rnd.randint(1, 20))) for _ in range(4000)]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text)
        assert codec.decode(ids) == sp.decode(sp.encode(text))


def test_odd_rows(frame, odd):
    from tests.llm.conftest import ODD

    assert sorted(map(tuple, encode_documents(odd, PATH).collect()), key=repr) == sorted((expected(*r) for r in ODD), key=repr)
    assert encode_documents(frame([]), PATH).count() == 0
