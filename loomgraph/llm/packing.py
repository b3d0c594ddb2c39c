"""Packing: cutting-stock column generation over the histogram of piece lengths.

A document's ids are cut at multiples of the sequence length; every whole cut is
a sequence of its own and the rest is one piece. Lengths fall into classes of
``width`` tokens, so the linear program has at most capacity/width rows whatever
the input's size: its columns are patterns (how many pieces of each class share a
sequence), a knapsack dynamic program prices new ones, and the rounded-down
solution plus a first-fit of what rounding left covers the histogram exactly.
Pieces, ranked within their class, then look up pattern, copy and slot.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import materialize, ranges, whole_text

CAPACITY, WIDTH = 2048, 8
#: Words after which a cache becomes the old one, of which only words that occur again stay.
CACHE_WORDS = 200_000
#: Text that is tokenized at a time.
SLICE_BYTES = 3_000_000
#: New words that are encoded together.
TOGETHER = 2000
#: A token that ends a document while it is split: no UTF-8 text has this byte. Its id stands for it until it becomes the end id.
_END, _END_ID = b"\xff", np.uint32(0xFFFFFFFF)
_LOWER = bytes(range(ord("a"), ord("z") + 1))
#: U+00DF to U+00FF, but for one sign, follow this lead byte in UTF-8.
_LEAD, _LATIN = 0xC3, bytes(sorted(set(range(0x9F, 0xC0)) - {0xB7}))
_LETTER, _FOLLOWS, _MARK = (np.zeros(256, bool) for _ in range(3))
_LETTER[list(_LOWER + _LOWER.upper())] = True
_FOLLOWS[list(_LATIN)] = True
#: All ASCII signs but the apostrophe, which may start an English ending.
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
#: Pieces that one ranking task should hold.
RANK_ROWS = 8_000


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def apart(raw: bytes) -> bytes:
    """A space between each Latin letter and a mark right after it: both tokens start and end there anyway."""
    buf = np.frombuffer(raw, np.uint8)
    letter = _LETTER[buf]
    letter[1:] |= _FOLLOWS[buf[1:]] & (buf[:-1] == _LEAD)
    at = np.flatnonzero(letter[:-1] & _MARK[buf[1:]]) + 1
    out = np.full(len(buf) + len(at), 32, np.uint8)
    own = np.ones(len(out), bool)
    own[at + np.arange(len(at))] = False
    out[own] = buf
    return out.tobytes()


class WordTokenizer:
    """Whole-text ids through a cache of the ids of words and marks.

    Sound for tokenizers that lower-case, drop white space before splitting, never
    join across it, part letters from signs and mark the ends of words. ``end_id``
    follows each document. New words of small Latin letters, on which
    normalization does nothing, are encoded many at a time without it and cut at their end marks.
    """

    def __init__(self, path: str, end_id: int = 1):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.end = load_tokenizer(path), end_id
        self.plain = load_tokenizer.__wrapped__(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.old: dict[bytes, bytes] = {}
        self.cache: dict[bytes, bytes] = {_END: _END_ID.tobytes()}

    def encode_alone(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_plain(self, words: list[bytes]) -> list[bytes]:
        ids = np.array(self.plain.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self.encode_alone(words)
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: set[bytes]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.old, self.cache = self.cache, {_END: self.cache[_END]}
        new = list(words.difference(self.cache))
        if self.old:
            again = [w for w in new if w in self.old]
            self.cache.update(zip(again, map(self.old.__getitem__, again), strict=True))
            new = list(set(new).difference(again))
        other = b" ".join(new).translate(None, _LOWER + bytes([_LEAD]) + _LATIN).split(b" ")
        plain, odd = [w for w, x in zip(new, other, strict=True) if not x] if new else [], [w for w, x in zip(new, other, strict=False) if x]
        for group, encode in ((plain, self.encode_plain), (odd, self.encode_alone)):
            for k in range(0, len(group), TOGETHER):
                self.cache.update(zip(group[k : k + TOGETHER], encode(group[k : k + TOGETHER]), strict=True))

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in UTF-8, one after the other, and where each text's end."""
        if any(_END in t for t in texts):  # no valid UTF-8
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
        # bytes lower and split at ASCII alone; a text that may hold a special token stays as it is, word by word
        special = {k for k, t in enumerate(texts) if b"|>" in t}
        ends = b" " + _END + b" "
        if not special:
            tokens = apart(ends.join(texts).lower() + ends).split()
        else:
            tokens = [w for k, t in enumerate(texts) for w in ((t + ends).split() if k in special else apart(t.lower() + ends).split())]
        self.learn(set(tokens))
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, tokens)), "<u4").copy()
        stops = np.flatnonzero(ids == _END_ID)
        ids[stops] = self.end
        return ids, stops + 1


@functools.lru_cache(maxsize=1)
def word_tokenizer(path: str, end_id: int) -> WordTokenizer:
    """One for all tasks of a worker process: what it has learned stays."""
    return WordTokenizer(path, end_id)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, text: str, doc_id: str, with_ids: bool) -> DataFrame:
    """Pieces of ids; bytes that are no UTF-8 count as U+FFFD."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] * with_ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer_path, end_id)
        for batch in batches:
            raw = batch.column(1)
            for a, b in ranges(pc.binary_length(raw).to_numpy(zero_copy_only=False), SLICE_BYTES):
                ids, stops = words.encode_batch(raw.slice(a, b - a).to_pylist())
                sizes = np.diff(stops, prepend=0)
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                begin = 4 * (stops[owner] - sizes[owner] + start)
                whole = memoryview(ids.tobytes())
                cuts = [whole[x:y] for x, y in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(sizes[owner])]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(map(bytes, cuts), pa.binary())] * with_ids)], names=names)

    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole_text(docs, text).cast("binary").alias("raw"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def knapsack(values: np.ndarray, units: int, limit: np.ndarray) -> np.ndarray:
    """The pattern of most value: counts of the items 1..units in a knapsack of ``units``, none above ``limit``."""
    best, choice = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    worth = np.where(limit > 0, values, 0.0)
    for c in range(1, units + 1):
        total = worth[:c] + best[c - 1 :: -1]
        k = int(total.argmax())
        best[c], choice[c] = (total[k], k + 1) if total[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(len(values), np.int64), units
    while c > 0:
        if not choice[c]:
            c -= 1
            continue
        pattern[choice[c] - 1] += 1
        c -= choice[c]
    return np.minimum(pattern, limit)


def fullest(left: np.ndarray) -> np.ndarray:
    """The largest item that is left, and the items that fill the rest of its knapsack most: sums as bits of an integer."""
    units, pattern = len(left), np.zeros(len(left), np.int64)
    sizes = (np.flatnonzero(left) + 1)[::-1].tolist()
    pattern[sizes[0] - 1] = 1
    room = units - sizes[0]
    mask, sums, taken = (1 << (room + 1)) - 1, 1, []
    for size in sizes:
        for _ in range(min(int(left[size - 1] - pattern[size - 1]), room // size)):
            taken.append((size, sums))
            sums |= (sums << size) & mask
    target = sums.bit_length() - 1
    for size, before in reversed(taken):
        if not before >> target & 1:
            pattern[size - 1] += 1
            target -= size
    return pattern


def cutting_stock(demand: np.ndarray, rounds: int = 40_000, patience: int = 200, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns and copies that cover ``demand[i]`` items of size i+1 exactly in knapsacks of ``len(demand)``.

    Revised simplex with column generation. The basis starts with one pattern per
    size, each full of that size; a column enters while the knapsack finds one worth more
    than 1, the program is more than ``gap`` above its bound, and ``patience`` steps have not all gained nothing.
    """
    units = len(demand)
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    need = demand[rows].astype(float)
    basis = np.diag((units // (rows + 1)).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ need
    least, since, bound = np.inf, 0, 0.0
    for _ in range(rounds):
        since = 0 if x.sum() < least - 1e-6 else since + 1
        least = min(least, float(x.sum()))
        if since > patience:  # degenerate steps alone: the basis is feasible and good enough
            break
        dual = inverse.sum(axis=0)
        values = np.zeros(units)
        values[rows] = np.maximum(dual, 0)
        pattern = knapsack(values, units, np.where(demand > 0, units, 0))[rows].astype(float)
        bound = max(bound, float(x.sum() / max(1.0, pattern @ dual)))  # no packing does with fewer
        if pattern @ dual <= 1 + 1e-7 or x.sum() <= bound * (1 + gap):
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        x -= ratio[leave] * step
        x[leave] = ratio[leave]
        basis[:, leave] = pattern
        inverse[leave] /= step[leave]
        others = np.arange(len(rows)) != leave
        inverse[others] -= np.outer(step[others], inverse[leave])
    out, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-x, kind="stable"):
        pattern = np.zeros(units, np.int64)
        pattern[rows] = np.rint(basis[:, k]).astype(np.int64)
        used = pattern > 0
        copies = min(int(np.floor(x[k] + 1e-7)), int((left[used] // pattern[used]).min())) if used.any() else 0
        if copies > 0:
            out.append((pattern, copies))
            left -= copies * pattern
    while left.any():  # what rounding left, about a sequence per pattern
        pattern = fullest(left)
        copies = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, copies))
        left -= copies * pattern
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """Adds sequence_id and offset to (materialized) pieces of at most ``capacity`` tokens."""
    spark = pieces.sparkSession
    units = capacity // width
    shards = max(1, -(-pieces.count() // RANK_ROWS))
    classed = pieces.withColumns(
        {"class": F.ceil(F.col("length") / width).cast("int"), "shard": F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(shards)).cast("int")}
    )
    # ranks: within (shard, class), then after all of the class in earlier shards
    counts = classed.groupBy("class", "shard").count()
    before = Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("class", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("count").alias("n")).collect()}
    demand = np.array([histogram.get(i + 1, 0) for i in range(units)], np.int64)
    slots, sequence = [], 0
    given = np.zeros(units, np.int64)
    for pattern, copies in cutting_stock(demand):
        for i in np.flatnonzero(pattern):
            slots.append((int(i + 1), int(given[i]), int(given[i] + copies * pattern[i]), int(pattern[i]), sequence))
            given[i] += copies * pattern[i]
        sequence += copies
    schema = T.StructType([T.StructField("class", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("low", "high", "each", "first_sequence")])
    # at most units patterns from the basis and as many from rounding, each with at most units classes
    plan = spark.createDataFrame(slots, schema).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("low", "high", "each", "first_sequence"))).alias("slots"))
    # the table has at most 2 * units * units entries, whatever the input
    order = Window.partitionBy("shard", "class").orderBy("doc_id", "start", "ids_crc32")
    ranked = classed.withColumn("rank", F.row_number().over(order) - 1)
    placed = (
        ranked.join(F.broadcast(plan), "class")
        .join(bases, ["class", "shard"])
        .withColumn("rank", F.col("rank") + F.col("base"))
        .withColumn("slot", F.element_at(F.filter("slots", lambda s: (s.low <= F.col("rank")) & (F.col("rank") < s.high)), 1))
        .withColumn("sequence_id", (F.col("slot.first_sequence") + F.floor((F.col("rank") - F.col("slot.low")) / F.col("slot.each"))).cast("long"))
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*pieces.columns, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, width: int = WIDTH, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False
) -> DataFrame:
    """Pieces with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Each document's ids end with ``end_id``, so null and empty texts are one piece
    of one id. Repeated rows are packed each; null ids are kept; an empty table
    gives no rows; further columns are ignored. The sequence length must be a multiple of ``width``.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, capacity, end_id, text, doc_id, with_ids), "pieces")
    return pack_pieces(pieces, capacity, width)
