"""LM scoring: context-tree weighting over bytes, each decomposed into binary decisions.

The text that is modelled is the token sequence: lower-cased words, a space after
each but the last, a line feed at the end. Every context of 0 to DEPTH bytes has a
tree of 255 binary nodes with Krichevsky-Trofimov estimates; a node weights its
own estimate against the product of its one-byte-longer contexts, so the
prediction mixes all depths. A context that training has not seen hands its share to the longest seen one.

Distribution. Documents are dealt into chunks of bounded bytes by a hash. A chunk
sorts its grams (contexts of DEPTH bytes and what follows) once, with the document of each, and
emits its distinct grams and words with their training counts, packed by
bucket: a bucket of grams has whole contexts by their last three bytes, so no bucket needs
more than the 2**24 grams that end so; one of words has a share of a hash. Buckets merge,
first within groups of chunks; their sums are the
whole of the corpus statistics, and grow with it. A bucket weights its trees from
depth three on; depth two is summed over buckets by context; what stands above needs at most 65,280 sums. Each chunk then gets
back just the values of its own grams and words, in its own order. No table of the
corpus is broadcast or collected.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fold_column, materialize, whole_text

DEPTH = 5
CHUNK_BYTES = 12_000_000
#: Chunks that merge together first, and bytes that a step handles at a time.
GROUP_CHUNKS, STEP_BYTES = 64, 3_000_000
#: Documents of a step: their place in it has 16 bits beside a gram's key.
STEP_DOCS = 1 << 16
#: Buckets at most, so that what chunks emit grows with them alone; shares of the nodes of depth two.
MOST_BUCKETS, SHARES = 4096, 64
#: Smaller corpora have smaller chunks of this many bytes at least, so that every core gets some.
LEAST_BYTES = 2_000_000
HELD_FOLDS, HELD_FOLD = 7, 2
_LN2 = math.log(2)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 by Stirling's series after a shift by 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - math.log(math.pi) - lgamma(zeros + ones + 1)


def tokens_of(text: str) -> list[bytes]:
    """Lower-cased words; bytes split and lower at ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def gram_keys(parts: list[bytes], depth: int) -> np.ndarray:
    """For every byte of each part, itself after its ``depth`` bytes of context (zeros before the start), as one integer."""
    pad = b"\0" * depth
    raw = np.frombuffer(pad.join([b"", *parts]), np.uint8)
    lengths = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(lengths + depth)
    inside = np.ones(len(raw), bool)
    for k in range(depth):
        inside[ends - lengths - depth + k] = False
    keys, have = raw.astype(np.int64), 1
    while have <= depth:  # widths add up: the bytes before those that a key has are the low ones of an earlier key
        more = min(have, depth + 1 - have)
        wider = keys.copy()
        wider[have:] |= (keys[:-have] & ((1 << (8 * more)) - 1)) << (8 * have)
        keys, have = wider, have + more
    return keys[inside]


class Level:
    """Binary nodes of all contexts of one length: counts, estimate and weight."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.node, self.zeros, self.ones = node, zeros, ones
        self.kt = kt_block(zeros, ones)
        self.weighted = self.kt.copy()
        self.own = np.ones(len(node))

    def weigh(self, below: np.ndarray) -> None:
        """``below``: log of the product over longer contexts of their weighted probabilities."""
        self.weighted = np.logaddexp(self.kt, below) - _LN2
        self.own = np.exp(self.kt - _LN2 - self.weighted)

    def at(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = np.minimum(np.searchsorted(self.node, node), max(0, len(self.node) - 1))
        return spot, (self.node[spot] == node) if len(self.node) else np.zeros(len(node), bool)

    def one_probability(self, spot: np.ndarray) -> np.ndarray:
        return (self.ones[spot] + 0.5) / (self.zeros[spot] + self.ones[spot] + 1)


def counted(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> Level:
    """The nodes (context, bits so far) with the zeros and ones that follow; unseen ones have no node."""
    seen = count > 0
    context, symbol, count = context[seen], symbol[seen], count[seen]
    nodes, bits = [], []
    for k in range(8):
        nodes.append(context * 256 + ((1 << k) | (symbol >> (8 - k))))
        bits.append((symbol >> (7 - k)) & 1)
    node, bit = np.concatenate(nodes), np.concatenate(bits)
    unique, back = np.unique(node, return_inverse=True)
    weight = np.tile(count, 8).astype(np.float64)
    ones = np.bincount(back, weight * bit, len(unique))
    return Level(unique, np.bincount(back, weight, len(unique)) - ones, ones)


def deep_levels(keys: np.ndarray, count: np.ndarray, depth: int, top: int = 2) -> dict[int, Level]:
    """Weighted levels ``top``..``depth`` of the grams; a context is its bytes as an integer, the last byte lowest."""
    symbol, whole = keys & 255, keys >> 8
    levels: dict[int, Level] = {}
    for d in range(depth, top - 1, -1):
        levels[d] = counted(whole & ((1 << (8 * d)) - 1), symbol, count)
        if d < depth and len(levels[d].node):
            child = levels[d + 1]
            spot, _ = levels[d].at(parents(child, d))
            levels[d].weigh(np.bincount(spot, child.weighted, len(levels[d].node)))
    return levels


def parents(child: Level, length: int) -> np.ndarray:
    """The nodes, with contexts of ``length`` bytes, that stand above those of ``child``."""
    return ((child.node >> 8) & ((1 << (8 * length)) - 1)) * 256 + (child.node & 255)


def second_level(keys: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's share in depth two: nodes, and (zeros, ones, log of the product below)."""
    two = counted((keys >> 8) & 65535, keys & 255, count)
    below = np.zeros(len(two.node))
    if depth > 2 and len(two.node):
        child = deep_levels(keys, count, depth, 3)[3]
        below = np.bincount(two.at(parents(child, 2))[0], child.weighted, len(two.node))
    return two.node, np.stack([two.zeros, two.ones, below])


def upper_levels(rows: pd.DataFrame) -> tuple[Level, Level]:
    """Levels 0 and 1 from sums over level 2: columns node (last byte and bits), zeros, ones, below."""
    rows = rows.sort_values("node")
    one = Level(rows["node"].to_numpy(np.int64), rows["zeros"].to_numpy(float), rows["ones"].to_numpy(float))
    if len(one.node):
        one.weigh(rows["below"].to_numpy(float))
    node, back = np.unique(one.node & 255, return_inverse=True)
    zero = Level(node, np.bincount(back, one.zeros, len(node)), np.bincount(back, one.ones, len(node)))
    if len(node):
        zero.weigh(np.bincount(back, one.weighted, len(node)))
    return zero, one


def gram_log10(keys: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 of the predicted probability of each gram's last byte after the bytes before it."""
    symbol, whole = keys & 255, keys >> 8
    total = np.zeros(len(keys))
    depth = max(levels)
    for k in range(8):
        prefix, bit = (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1
        one = np.full(len(keys), 0.5)
        below = np.zeros(len(keys), bool)
        for d in range(depth, -1, -1):
            spot, seen = levels[d].at((whole & ((1 << (8 * d)) - 1)) * 256 + prefix)
            if not len(levels[d].node):
                continue
            kt = levels[d].one_probability(spot)
            own = np.where(below, levels[d].own[spot], 1.0)
            one = np.where(seen, own * kt + (1 - own) * one, one)
            below |= seen
        total += np.log10(np.where(bit == 1, one, 1 - one))
    return total


def steps_of(parts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of parts of about STEP_BYTES, and of STEP_DOCS at most."""
    begin, size = 0, 0
    for k, part in enumerate(parts):
        size += len(part)
        if size >= STEP_BYTES or k + 1 - begin == STEP_DOCS:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(parts):
        yield begin, len(parts)


def sorted_grams(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct gram keys, sorted, where each starts, and gram by gram the part that it stands in."""
    both = (gram_keys(parts, depth).view(np.uint64) << np.uint64(16)) | np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
    both.sort()
    keys = (both >> np.uint64(16)).view(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], starts, (both & np.uint64(65535)).astype(np.uint16)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, back = np.unique(keys, return_inverse=True)
    return unique, np.bincount(back, counts, len(unique)).astype(np.int64)


def gram_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the last three context bytes alone."""
    last = ((keys >> 8) & 0xFFFFFF).astype(np.uint64)
    return ((last * np.uint64(0x9E3779B185EBCA87)) >> np.uint64(33)).astype(np.int64) % buckets


_ZSTD = pa.Codec("zstd", 1)


def pack_numbers(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys as differences, and further columns of eight bytes."""
    columns = [np.diff(keys, prepend=0).astype("<i8"), *(np.ascontiguousarray(c).view("<i8") for c in more)]
    return _ZSTD.compress(b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), asbytes=True)


def unpack_numbers(data: bytes, size: int, columns: int = 2) -> list[np.ndarray]:
    raw = np.frombuffer(_ZSTD.decompress(data, 8 * size * columns), np.uint8)
    first, *more = [np.ascontiguousarray(x.reshape(8, -1).T).view("<i8").ravel() for x in np.split(raw, columns)]
    return [np.cumsum(first), *more]


def pack_words(words: list[bytes], counts: np.ndarray) -> bytes:
    """Words (none has white space) and counts."""
    return zlib.compress(counts.astype("<i8").tobytes() + b" ".join(words), 1)


def unpack_words(data: bytes, size: int) -> tuple[list[bytes], np.ndarray]:
    raw = zlib.decompress(data)
    return raw[8 * size :].split(b" "), np.frombuffer(raw[: 8 * size], "<i8")


def merged(kind: int, part: pd.DataFrame) -> tuple[int, bytes]:
    """Size and data of the rows' sum."""
    if kind == 0:
        both = [unpack_numbers(d, int(n)) for d, n in zip(part["data"], part["size"], strict=True)]
        keys, counts = summed(np.concatenate([k for k, _ in both]), np.concatenate([c for _, c in both]))
        return len(keys), pack_numbers(keys, counts)
    total: Counter[bytes] = Counter()
    for data, size in zip(part["data"], part["size"], strict=True):
        words, counts = unpack_words(data, int(size))
        for w, c in zip(words, counts.tolist(), strict=True):
            total[w] += c
    return len(total), pack_words(list(total), np.array(list(total.values()), np.int64))


def by_bucket(at: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each bucket, in order."""
    order = np.argsort(at, kind="stable")
    return {int(at[o[0]]): o for o in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(o)}


class Chunk:
    """A chunk's tokens and distinct grams and words, by bucket, in an order that its texts alone fix."""

    def __init__(self, texts, depth: int, buckets: int):
        lists = [tokens_of(t) for t in texts]
        self.tokens = np.array([len(w) for w in lists], np.int64)
        self.words = list(dict.fromkeys(chain([b""], chain.from_iterable(lists))))
        index = dict(zip(self.words, range(len(self.words)), strict=True))
        self.ids = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int32, int(self.tokens.sum()))
        parts = [b" ".join(w) + b"\n" for w in lists]
        del lists, index
        self.bytes = np.array([len(p) for p in parts], np.int64)
        self.steps = [(a, b, *sorted_grams(parts[a:b], depth)) for a, b in steps_of(parts)]
        self.grams = np.unique(np.concatenate([keys for _, _, keys, _, _ in self.steps]))
        self.gram_order = by_bucket(gram_bucket(self.grams, buckets))
        self.word_order = by_bucket(np.array([zlib.crc32(w) for w in self.words], np.int64) % buckets)

    def counts(self, held: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        """(kind, bucket, size, data) with the counts of the texts that aren't held out."""
        known = np.zeros(len(self.grams), np.int64)
        for a, b, keys, starts, owner in self.steps:
            known[np.searchsorted(self.grams, keys)] += np.add.reduceat((~held[a:b]).astype(np.int64)[owner], starts)
        for bucket, order in self.gram_order.items():
            yield 0, bucket, len(order), pack_numbers(self.grams[order], known[order])
        total = np.bincount(self.ids, np.repeat(~held, self.tokens), len(self.words)).astype(np.int64)
        total[0] = (~held).sum()
        for bucket, order in self.word_order.items():
            yield 1, bucket, len(order), pack_words([self.words[k] for k in order.tolist()], total[order])

    def scores(self, log10: np.ndarray) -> np.ndarray:
        """The sum of each text's gram values, in double precision."""
        out = np.zeros(len(self.tokens))
        for a, b, keys, starts, owner in self.steps:
            values = log10[np.searchsorted(self.grams, keys)].astype(np.float64)
            out[a:b] = np.bincount(owner, np.repeat(values, np.diff(starts, append=len(owner))), b - a)
        return out

    def bases(self, own: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Each text's known tokens and base score, from the words' counts; ``floor``: log10 of the common denominator."""
        owner, n = np.repeat(np.arange(len(self.tokens)), self.tokens), len(self.tokens)
        log10 = np.log10(own + 1.0)
        known = np.bincount(owner, (own > 0)[self.ids], n).astype(np.int64) + int(own[0] > 0)
        return known, np.bincount(owner, log10[self.ids], n) + log10[0] - (self.tokens + 1) * floor


def score_corpus(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes per row.

    Training documents are those whose crc32(doc_id as text) mod 7 is not 2; a null
    id has the crc32 of the empty text, so it is one of them. Null texts are empty: just the end. Repeated
    rows count and are scored each. An empty table gives no rows; with nothing to
    train on every byte costs 8 bits. Further columns are ignored. ``depth`` is 2 to 5.
    A chunk is told each gram's value as a 32-bit float and sums in double precision: a score's relative error is under 6e-8.
    """
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole_text(docs, text).alias("raw"))
    source = source.withColumn("held_out", fold_column(F.col("doc_id"), HELD_FOLDS) == HELD_FOLD)
    size = source.agg(F.sum(F.octet_length("raw") + 64).alias("n")).first()["n"] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-size // chunk_bytes), min(4 * cores, size // LEAST_BYTES))
    buckets = min(MOST_BUCKETS, max(1, -(-chunks // 4)))
    dealt = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(chunks)).cast("int"))

    def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("raw")
        rows = list(Chunk(part["raw"], depth, buckets).counts(part["held_out"].to_numpy(bool)))
        out = pd.DataFrame(rows, columns=["kind", "bucket", "size", "data"])
        out.insert(0, "chunk", int(key[0]))
        return out

    packed = "kind int, bucket int, size long, data binary"
    found = materialize(dealt.groupBy("chunk").applyInPandas(count, f"chunk int, {packed}").withColumn("grp", F.floor(F.col("chunk") / GROUP_CHUNKS).cast("int")), "lm-counts")

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n, data = merged(int(key[0]), part)
        return pd.DataFrame({"kind": [int(key[0])], "bucket": [int(key[1])], "size": [n], "data": [data]})

    corpus = found.groupBy("kind", "bucket", "grp").applyInPandas(merge, packed)
    corpus = materialize(corpus.groupBy("kind", "bucket").applyInPandas(merge, packed), "lm-corpus")

    def seconds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each bucket's part in depth two, by shares of the contexts; of words, their number and how many are known."""
        for batch in batches:
            rows = []
            for kind, bucket, n, data in zip(batch["kind"], batch["bucket"], batch["size"], batch["data"], strict=True):
                if kind == 0:
                    node, sums = second_level(*unpack_numbers(data, int(n)), depth)
                    for share, order in by_bucket((node >> 8) % SHARES).items():
                        rows.append((share, bucket, len(order), pack_numbers(node[order], *sums[:, order])))
                else:
                    counts = unpack_words(data, int(n))[1]
                    rows.append((-1, bucket, 1, pack_numbers(np.zeros(1, np.int64), np.array([float(counts.sum())]), np.array([float((counts > 0).sum())]), np.zeros(1))))
            yield pd.DataFrame(rows, columns=["share", "bucket", "size", "data"])

    def second(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Depth two of a share of contexts: to each bucket its nodes' counts and own shares, to nobody (-1) the sums for depth one."""
        rows = [unpack_numbers(d, int(n), 4) for d, n in zip(part["data"], part["size"], strict=True)]
        node, back = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        zeros, ones, below = (np.bincount(back, np.concatenate([r[k].view(np.float64) for r in rows]), len(node)) for k in (1, 2, 3))
        if key[0] < 0:
            return pd.DataFrame({"to": [-2], "size": [1], "data": [pack_numbers(node, zeros, ones, below)]})
        two = Level(node, zeros, ones)
        if depth > 2 and len(node):
            two.weigh(below)
        one, back = np.unique(((node >> 8) & 255) * 256 + (node & 255), return_inverse=True)
        sums = [np.bincount(back, x, len(one)) for x in (zeros, ones, two.weighted)]
        out = [(-1, len(one), pack_numbers(one, *sums))]
        for bucket, own in zip(part["bucket"], rows, strict=True):
            spot, _ = two.at(own[0])
            out.append((bucket, len(spot), pack_numbers(own[0], zeros[spot], ones[spot], two.own[spot])))
        return pd.DataFrame(out, columns=["to", "size", "data"])

    middle = corpus.mapInPandas(seconds, "share int, bucket int, size long, data binary").groupBy("share").applyInPandas(second, "to int, size long, data binary")
    middle = materialize(middle, "lm-middle")
    # at most 256 * 255 sums in each of SHARES rows and one row for the words, whatever the corpus
    above = [(r["to"], unpack_numbers(r["data"], r["size"], 4)) for r in middle.where("to < 0").collect()]
    totals = [x for to, x in above if to == -2]
    train_tokens, known_words = (int(sum(x[k].view(np.float64)[0] for x in totals)) for k in (1, 2))
    sums = [x for to, x in above if to == -1]
    upper = pd.DataFrame({"node": np.concatenate([np.zeros(0, np.int64), *(x[0] for x in sums)])})
    for k, c in enumerate(("zeros", "ones", "below"), 1):
        upper[c] = np.concatenate([np.zeros(0), *(x[k].view(np.float64) for x in sums)])
    zero, one = upper_levels(upper.groupby("node", as_index=False).sum())

    def evaluate(key: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Grams with the value of each instead of its count."""
        if not len(part):
            return pd.DataFrame(columns=["v_kind", "v_bucket", "v_size", "v_data"])
        n, data = int(part["size"].iloc[0]), part["data"].iloc[0]
        if key[0] == 0:
            keys, counts = unpack_numbers(data, n)
            rows = [unpack_numbers(d, int(m), 4) for d, m in zip(known["data"], known["size"], strict=True)]
            node = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)])
            order = np.argsort(node)
            columns = [np.concatenate([np.zeros(0), *(r[k].view(np.float64) for r in rows)])[order] for k in (1, 2, 3)]
            two = Level(node[order], columns[0], columns[1])
            two.own = columns[2]
            levels = deep_levels(keys, counts, depth, 3) | {0: zero, 1: one, 2: two}
            data = pack_numbers(keys, gram_log10(keys, levels))
        return pd.DataFrame({"v_kind": [int(key[0])], "v_bucket": [int(key[1])], "v_size": [n], "v_data": [data]})

    told = middle.where("to >= 0").select(F.lit(0).alias("m_kind"), F.col("to").alias("m_bucket"), "size", "data")
    values = corpus.groupBy("kind", "bucket").cogroup(told.groupBy("m_kind", "m_bucket")).applyInPandas(evaluate, "v_kind int, v_bucket int, v_size long, v_data binary")
    asked = found.select(F.col("kind").alias("a_kind"), F.col("bucket").alias("a_bucket"), "grp").distinct()
    values = asked.join(values, (F.col("a_kind") == F.col("v_kind")) & (F.col("a_bucket") == F.col("v_bucket"))).select("v_kind", "v_bucket", F.col("grp").alias("v_grp"), "v_size", "v_data")

    def reply(key: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        kind, rows = int(key[0]), []
        if not len(part):
            return pd.DataFrame(columns=["to", "kind", "bucket", "values"])
        n = int(known["v_size"].iloc[0])
        if kind == 0:
            keys, bits = unpack_numbers(known["v_data"].iloc[0], n)
            floats = bits.view(np.float64).astype("<f4")
            for chunk, size, data in zip(part["chunk"], part["size"], part["data"], strict=True):
                rows.append((chunk, kind, int(key[1]), floats[np.searchsorted(keys, unpack_numbers(data, int(size))[0])].tobytes()))
        else:
            words, counts = unpack_words(known["v_data"].iloc[0], n)
            own = dict(zip(words, counts.tolist(), strict=True))
            for chunk, size, data in zip(part["chunk"], part["size"], part["data"], strict=True):
                rows.append((chunk, kind, int(key[1]), zlib.compress(np.array([own[w] for w in unpack_words(data, int(size))[0]], "<i8").tobytes(), 1)))
        return pd.DataFrame(rows, columns=["to", "kind", "bucket", "values"])

    replies = found.groupBy("kind", "bucket", "grp").cogroup(values.groupBy("v_kind", "v_bucket", "v_grp")).applyInPandas(reply, "to int, kind int, bucket int, values binary")
    floor = math.log10(train_tokens + known_words + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]

    def score(key: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=names)
        part = part.sort_values("raw")
        chunk = Chunk(part["raw"], depth, buckets)
        log10, own = np.zeros(len(chunk.grams), np.float32), np.zeros(len(chunk.words), np.int64)
        for kind, bucket, raw in zip(known["kind"], known["bucket"], known["values"], strict=True):
            if kind == 0:
                log10[chunk.gram_order[bucket]] = np.frombuffer(raw, "<f4")
            else:
                own[chunk.word_order[bucket]] = np.frombuffer(zlib.decompress(raw), "<i8")
        n_known, base = chunk.bases(own, floor)
        columns = (part["doc_id"].astype("Int64").array, part["held_out"].to_numpy(), chunk.tokens + 1, n_known, train_tokens, base, chunk.scores(log10), chunk.bytes)
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    return (
        dealt.groupBy("chunk")
        .cogroup(replies.groupBy("to"))
        .applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    )
