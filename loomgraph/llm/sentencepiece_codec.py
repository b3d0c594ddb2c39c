"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Symbols of all words of a batch lie in one flat array. A round looks up the rank
of every adjacent pair, takes the minimum per word, merges its leftmost
non-overlapping places in all words at once and compacts; words without a
mergeable pair leave. A merge whose product could at once merge better is done
alone in its word, so the result is that of merging one pair at a time.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomgraph.llm.common import byte_slices, whole_text

SPACE = "▁"
#: Words kept per worker; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Text that is encoded at a time.
SLICE_BYTES = 3_000_000


class PieceModel:
    """The vocabulary of a SentencePiece BPE model with identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or kinds - {1, 2, 3, 6}:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are handled")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece spans words")
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.surface.append({1: p.piece.replace(SPACE, " ").encode(), 2: proto.trainer_spec.unk_surface.encode(), 3: b""}[p.type])
        # symbols: the pieces, then single characters that only occur inside pieces
        self.symbol = dict(normal)
        size = len(proto.pieces)
        for c in sorted({c for p in normal for c in p} - normal.keys()):
            self.symbol[c] = size
            size += 1
        self.size = size
        rank = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
        pairs = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = self.symbol.get(piece[:k]), self.symbol.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = (rank[proto.pieces[i].score], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.pieces = len(proto.pieces)
        self.never = np.int64(len(rank) + 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.ranks[at], self.never), np.where(found, self.made[at], -1)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (a run of word-start marks and what follows it)."""
        chars: dict[str, int] = {}
        for c in set("".join(words)):
            chars[c] = self.symbol.get(c, self.size + len(chars))
        unknown = {i: c for c, i in chars.items()}
        sym = np.array([chars[c] for w in words for c in w], np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_word = [], []
        while len(sym):
            left = np.flatnonzero(word[1:] == word[:-1])
            rank = np.full(len(sym), self.never)
            made = np.full(len(sym), -1, np.int64)
            rank[left], made[left] = self.pair_ranks(sym[left], sym[left + 1])
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < self.never, lengths)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, made = sym[live], word[live], rank[live], made[live]
                keep = best < self.never
                best, lengths = best[keep], lengths[keep]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            run = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            new = sym.copy()
            new[at] = made[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            merged, of = new[~gone], word[~gone]
            spot = np.flatnonzero(np.isin(np.flatnonzero(~gone), at, assume_unique=True))
            hasty = np.zeros(len(spot), bool)
            limit = rank[at]
            for a, b in ((spot - 1, spot), (spot, spot + 1)):
                ok = (a >= 0) & (b < len(merged))
                ok[ok] = of[a[ok]] == of[b[ok]]
                got, _ = self.pair_ranks(merged[a[ok]], merged[b[ok]])
                hasty[np.flatnonzero(ok)[got <= limit[ok]]] = True
            for a, b, left_side in ((at - 1, at, True), (at, at + 2, False)):  # beside neighbours as they were, too
                ok = (a >= 0) & (b < len(sym))
                ok[ok] = word[a[ok]] == word[b[ok]]
                got, _ = self.pair_ranks(sym[a[ok]], made[at[ok]]) if left_side else self.pair_ranks(made[at[ok]], sym[b[ok]])
                hasty[np.flatnonzero(ok)[got <= limit[ok]]] = True
            if hasty.any():
                single = np.isin(word[at], of[spot[hasty]])
                first = np.concatenate([[True], word[at][1:] != word[at][:-1]])
                at = at[~single | first]
                new = sym.copy()
                new[at] = made[at]
                gone[:] = False
                gone[at + 1] = True
                merged, of = new[~gone], word[~gone]
            sym, word = merged, of
        sym = np.concatenate(done_sym) if done_sym else sym
        word = np.concatenate(done_word) if done_word else word
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        if (sym >= self.pieces).any():  # characters outside the vocabulary fall back to bytes
            back = {i: self.symbol_bytes(i, unknown) for i in set(sym[sym >= self.pieces].tolist())}
            flat = [back[s] if s in back else (s,) for s in sym.tolist()]
            word = np.repeat(word, [len(x) for x in flat])
            sym = np.array([i for x in flat for i in x], np.int64)
        cut = np.searchsorted(word, np.arange(1, len(words)))
        return np.split(sym, cut)

    def symbol_bytes(self, symbol: int, unknown: dict[int, str]) -> list[int]:
        c = unknown[symbol]
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


class Codec:
    """Whole texts to ids and back, with a bounded cache of words."""

    def __init__(self, path: str):
        self.model, self.cache = load(path), {}
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def words(self, text: str) -> list[str]:
        return self.split(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [self.words(t) for t in texts]
        new = list({w for ws in split for w in ws} - self.cache.keys())
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            for w, ids in zip(part, self.model.encode_words(part), strict=True):
                self.cache[w] = ids.astype("<u4").tobytes()
        cache = self.cache
        return [b"".join([cache[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids: the first piece loses one word-start mark."""
        surface = self.model.surface
        raw = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def codec_for(path: str) -> Codec:
    """One for all tasks of a worker process: what it has learned stays."""
    return Codec(path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids), begin and end ids included.

    Null is the empty text, which gives just the two ids. Rows are independent:
    repeats, ties and null ids pass through; no rows give none; further columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_for(model_path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (codec.model.bos, codec.model.eos))
        for batch in batches:
            for a, b in byte_slices(batch["raw"], SLICE_BYTES):
                part = batch.iloc[a:b]
                rows = []
                for doc, ids in zip(part["doc_id"], codec.encode_batch(part["raw"].tolist()), strict=True):
                    whole = begin + ids + end
                    rows.append((doc, len(whole) // 4, hashlib.sha256(whole).hexdigest(), hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest(), *([whole] * with_ids)))
                out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] * with_ids)])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole_text(docs, text).alias("raw"))
    return source.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
