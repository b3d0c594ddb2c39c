"""Phrase collocations by hierarchical pair naming.

A phrase of k words is named by the pair of its first and its last k-1 words, once
both have names, that is, are frequent. Per level: (1) each chunk of text holds
its words' places as names of the level below, counts its distinct adjacent pairs, and
deals them out, packed, into buckets by a hash of the pair; (2) a bucket adds up the
chunks' counts, names the frequent pairs, and answers each chunk with the
names of its own pairs; (3) chunks replace their pairs by those names. A phrase thus
occurs in a shuffle once per chunk, however often it is said. The two names of
a pair stay with it as parent pointers: the counts of all cuts, and the longer phrases that may absorb it,
are found along them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, materialize, ranges, whole_text

LEAST, WORDS, TOP = 30, 4, 2000
#: Text of a chunk; words that a bucket is made for; candidates that are ranked in one task before the last ranking.
CHUNK_BYTES, BUCKET_WORDS, RANK_ROWS = 32_000_000, 1_500_000, 5_000
#: Text that is split at a time.
SLICE_BYTES = 2_000_000
#: Signs at which pieces end become line feeds, tabs become spaces.
_SIGNS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))

_CHUNK = "chunk long, lang string, n long, codes binary, words binary, counts binary"
_WORDS = "chunk long, lang string, bucket long, words binary, counts binary, places binary"
_PAIRS = "chunk long, bucket long, codes binary, firsts binary, lasts binary, counts binary, base long"
_NAMED = "chunk long, places binary, names binary, name long, lang string, phrase binary, first long, last long, n long"


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as bytes: differences where they rise, byte planes apart, compressed."""
    own = np.diff(values, prepend=0) if rising else values
    planes = np.ascontiguousarray(own, "<i8").view(np.uint8).reshape(-1, 8).T
    return len(own).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).view("<i8").ravel()
    return np.cumsum(values) if rising else values


def packed_words(words: list[bytes]) -> bytes:
    """Words, which hold no spaces."""
    raw = b" ".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked_words(raw: bytes) -> list[bytes]:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True).split(b" ")


class Places(dict):
    """Places of words in the order in which they are first asked."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def table(columns: list, names: str) -> pa.RecordBatch:
    """A batch of the columns, typed by a schema string."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split(" ") for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class Words:
    """The distinct words of texts, their counts, and the texts as places in them, -1 where a piece ends."""

    def __init__(self):
        self.places = Places({b"\n": 0, b"": 1})
        self.codes: list[np.ndarray] = []

    def add(self, texts: list[bytes]) -> None:
        tokens = b"\n".join([*texts, b""]).lower().translate(_SIGNS).replace(b"\n", b" \n ").split(b" ")
        codes = np.fromiter(map(self.places.__getitem__, tokens), np.int32, len(tokens)) - 2
        codes = codes[codes != -1]
        codes[codes < 0] = -1
        self.codes.append(codes)

    def done(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words, counts and places; frequent words first, so that places are small numbers."""
        codes, words = np.concatenate(self.codes), list(self.places)[2:]
        counts = np.bincount(codes[codes >= 0], minlength=len(words))
        order = np.argsort(-counts, kind="stable")
        rank = np.full(len(words) + 1, -1)
        rank[order] = np.arange(len(words))
        return [words[k] for k in order.tolist()], counts[order], rank[codes]


def chunk_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """A row per chunk and language: its words, their counts, and the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, Words] = {}
        size = 0

        def chunks() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for name, own in held.items():
                words, counts, codes = own.done()
                if len(words):
                    yield table([[number], [name], [int(counts.sum())], [packed(codes)], [packed_words(words)], [packed(counts)]], _CHUNK)
                    number += 1

        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in ranges(lengths, SLICE_BYTES):
                texts: dict[str, list[bytes]] = {}
                for name, raw in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    texts.setdefault(name, []).append(raw)
                for name, own in texts.items():
                    held.setdefault(name, Words()).add(own)
                size += int(lengths[a:b].sum())
                if size >= CHUNK_BYTES:
                    yield from chunks()
                    held, size = {}, 0
        yield from chunks()

    source = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), whole_text(docs, text).cast("binary").alias("raw"))
    return source.mapInArrow(run, _CHUNK)


def deal(bucket: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets in use, and the places of each, rising."""
    order = np.argsort(bucket, kind="stable")
    used, starts = np.unique(bucket[order], return_index=True)
    return used, np.split(order, starts[1:]) if len(used) else []


def word_buckets(chunks: DataFrame, buckets: int) -> DataFrame:
    """Each chunk's distinct words, dealt into buckets by their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, raw, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, counts = unpacked_words(raw), unpacked(n)
                order = sorted(range(len(words)), key=words.__getitem__)  # neighbours alike
                used, parts = deal(np.fromiter((zlib.crc32(words[k]) for k in order), np.int64, len(order)) % buckets)
                places = [np.array(order)[p] for p in parts]
                columns = [[chunk] * len(used), [lang] * len(used), used, [packed_words([words[k] for k in p.tolist()]) for p in places], [packed(counts[p]) for p in places], [packed(p) for p in places]]
                yield table(columns, _WORDS)

    return chunks.select("chunk", "lang", "words", "counts").mapInArrow(run, _WORDS)


def name_words(words: DataFrame, least: int) -> DataFrame:
    """Names of the words said ``least`` times or more in a language (name, lang, phrase, n), and packed answers to chunks."""

    def run(bucket: pa.Table) -> pa.Table:
        number = bucket.column("bucket")[0].as_py()
        lists = [unpacked_words(raw) for raw in bucket.column("words").to_pylist()]
        sizes = [len(x) for x in lists]
        found = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        langs, of = np.unique(bucket.column("lang").to_pylist(), return_inverse=True)
        keys, inverse = np.unique(np.repeat(of, sizes) + len(langs) * found.indices.to_numpy().astype(np.int64), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, inverse, np.concatenate([unpacked(x) for x in bucket.column("counts").to_pylist()]))
        often = total >= least
        named = np.where(often, (number << 32) + np.cumsum(often) - 1, -1)
        none = [None] * int(often.sum())
        phrases = found.dictionary.take(pa.array(keys[often] // len(langs))).to_pylist()
        out = [table([none, none, none, named[often], langs[keys[often] % len(langs)].tolist(), phrases, none, none, total[often]], _NAMED)]
        return pa.Table.from_batches([*out, *answers(bucket, [unpacked(x) for x in bucket.column("places").to_pylist()], named[inverse], sizes)])

    return words.groupBy("bucket").applyInArrow(run, _NAMED)


def answers(bucket: pa.Table, places: list[np.ndarray], names: np.ndarray, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """To each chunk the places of its frequent words or pairs, and their names; ``names`` has those of all chunks in turn, -1 for the others."""
    for chunk, place, own in zip(bucket.column("chunk").to_pylist(), places, np.split(names, np.cumsum(sizes)[:-1]), strict=True):
        often = np.flatnonzero(own >= 0)
        if len(often):
            yield table([[chunk], [packed(place[often], True)], [packed(own[often])], *[[None]] * 6], _NAMED)


def pair_up(chunk: int, codes: np.ndarray, names: np.ndarray, buckets: int, longer: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of adjacent names of a chunk, and with ``longer`` their order: ``names`` has the name of each code, -1 if it isn't frequent."""
    known, dense = np.unique(names[names >= 0], return_inverse=True)
    local = np.full(len(names) + 1, -1, np.int64)  # the last one is for code -1
    local[:-1][names >= 0] = dense
    at = local[codes]
    here = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0)) if len(at) else np.array([], np.int64)
    pairs, place, counts = np.unique(at[here] * len(known) + at[here + 1], return_inverse=True, return_counts=True)
    first, last = (known[pairs // len(known)], known[pairs % len(known)]) if len(pairs) else (pairs, pairs)
    used, parts = deal(bucket_of(first, last, buckets))
    if longer:  # pairs are numbered bucket by bucket, so an answer needs no places
        number = np.empty(len(pairs), np.int64)
        number[np.concatenate([*parts, np.array([], np.int64)])] = np.arange(len(pairs))
        out = np.full(max(0, len(codes) - 1), -1, np.int64)
        out[here] = number[place]
        yield table([[chunk], [None], [packed(out)], [None], [None], [None], [None]], _PAIRS)
    bases = np.cumsum([0, *map(len, parts)])[:-1]
    columns = [[chunk] * len(used), used, [None] * len(used), [packed(first[p], True) for p in parts], [packed(last[p]) for p in parts], [packed(counts[p]) for p in parts], bases[: len(used)]]
    yield table(columns, _PAIRS)


def bucket_of(first: np.ndarray, last: np.ndarray, buckets: int) -> np.ndarray:
    """An even hash of pairs (the mixing step of a 64-bit generator, twice)."""
    h = first.astype(np.uint64)
    for x in (last.astype(np.uint64), np.uint64(0)):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + x
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def pair_chunks(codes: DataFrame, named: DataFrame, buckets: int, longer: bool) -> DataFrame:
    """Chunks' pairs: ``codes`` has a row per chunk, ``named`` the answers to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([table([[]] * 7, _PAIRS)])
        own = unpacked(left.column("codes")[0].as_py())
        names = np.full(int(own.max(initial=-1)) + 1, -1, np.int64)
        for at, name in zip(right.column("places").to_pylist(), right.column("names").to_pylist(), strict=True):
            names[unpacked(at, True)] = unpacked(name)
        return pa.Table.from_batches([table([[]] * 7, _PAIRS), *pair_up(left.column("chunk")[0].as_py(), own, names, buckets, longer)])

    return codes.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(run, _PAIRS)


def name_pairs(pairs: DataFrame, least: int, longer: bool) -> DataFrame:
    """Names of the pairs said ``least`` times or more (name, first, last, n), and with ``longer`` packed answers to chunks."""

    def run(bucket: pa.Table) -> pa.Table:
        number = bucket.column("bucket")[0].as_py()
        column = lambda c, rising: [unpacked(x, rising) for x in bucket.column(c).to_pylist()]
        firsts = column("firsts", True)
        first, last, n = np.concatenate(firsts), np.concatenate(column("lasts", False)), np.concatenate(column("counts", False))
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
        starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])])
        total = np.add.reduceat(n[order], starts)
        often = total >= least
        named = np.where(often, (number << 32) + np.cumsum(often) - 1, -1)
        none = [None] * int(often.sum())
        out = [table([none, none, none, named[often], none, none, first[starts][often], last[starts][often], total[often]], _NAMED)]
        if longer:
            name = np.empty(len(order), np.int64)
            name[order] = np.repeat(named, np.diff(starts, append=len(order)))
            bases = bucket.column("base").to_pylist()
            out += answers(bucket, [np.arange(base, base + len(x)) for base, x in zip(bases, firsts, strict=True)], name, [len(x) for x in firsts])
        return pa.Table.from_batches(out)

    return pairs.where("bucket is not null").groupBy("bucket").applyInArrow(run, _NAMED)


def frequent_phrases(docs: DataFrame, least: int = LEAST, words: int = WORDS, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """Each language's number of words n, and per length from 1 to ``words``: name, lang, phrase, a (how often it is said), heads and tails.

    heads[k-1] and tails[k-1] count the first and the last k words, for k below the length.
    Names are unique within a length; those of longer phrases carry ``first`` and ``last``, the names of all but the last and all but the first word.
    """
    chunks = materialize(chunk_words(docs, text, lang), "phrases-chunks")
    totals = materialize(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-n")
    buckets = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))
    named = materialize(name_words(word_buckets(chunks, buckets), least), "phrases-named-1")
    none = F.array().cast("array<long>")
    level = materialize(
        named.where("name is not null").select("name", "lang", F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("a"), none.alias("heads"), none.alias("tails")), "phrases-1"
    )
    replies = lambda named: named.where("places is not null").select("chunk", "places", "names")
    names, out, codes, done = replies(named), [level], chunks.select("chunk", "codes"), [chunks, named]
    for k in range(2, words + 1):
        pairs = materialize(pair_chunks(codes, names, buckets, k < words), f"phrases-pairs-{k}")
        for old in done:
            discard(old)
        named = materialize(name_pairs(pairs, least, k < words), f"phrases-named-{k}")
        first, last = (level.select(F.col("name").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("lang", "phrase", "a", "heads", "tails"))) for side in ("first", "last"))
        longer = named.where("name is not null").select("name", "first", "last", F.col("n").alias("a")).join(first, "first").join(last, "last")
        word = F.substring_index("last_phrase", " ", -1)
        level = materialize(
            longer.select(
                "name", F.col("first_lang").alias("lang"), F.concat_ws(" ", "first_phrase", word).alias("phrase"), "a",
                F.concat("first_heads", F.array("first_a")).alias("heads"), F.concat("last_tails", F.array("last_a")).alias("tails"), "first", "last",
            ), f"phrases-{k}",
        )
        out.append(level)
        codes, names = pairs.where("codes is not null").select("chunk", "codes"), replies(named)
        done = [pairs, named]
    for old in done:
        discard(old)
    return totals, out


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, and l, r, score of the lowest-scoring cut (ties: the earliest)."""
    exact = "decimal(38,0)"

    def cut(left: Column, place: Column) -> Column:
        right = F.element_at("tails", -(place + 1))
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(20,0)"), (left.cast("decimal(20,0)") + right.cast("decimal(20,0)")).cast(exact))
        return F.struct(score.cast("long").alias("score"), place.alias("k"), left.alias("l"), right.alias("r"))

    least = F.array_min(F.transform("heads", cut))
    return phrases.withColumn("cut", least).select("name", "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def mine(docs: DataFrame, least: int = LEAST, words: int = WORDS, top: int = TOP, percent: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]`` and at the ends of
    texts, words at spaces and tabs. Phrases of 2 to ``words`` words said ``least`` times or
    more within pieces are candidates; those of which a longer candidate holds ``percent`` of the
    sayings or more go. The order is by score, then a, both descending, then the bytes of the phrase.
    Null texts are empty, a null language is ``und``; every row counts, repeated ones too; tables without words give no
    rows; further columns are ignored.
    """
    totals, levels = frequent_phrases(docs, least, words, text, lang)
    kept = docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, score long")
    for k, level in enumerate(levels[1:], 1):
        own = scored(level)
        if k + 1 < len(levels):  # no longer phrase is said more often than one of one word more on that side
            above = levels[k + 1]
            longest = above.select(F.col("first").alias("name"), "a").unionByName(above.select(F.col("last").alias("name"), "a")).groupBy("name").agg(F.max("a").alias("longer"))
            absorbed = F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(20,0)") >= F.lit(percent).cast("decimal(3,0)") * F.col("a").cast("decimal(20,0)")
            own = own.join(longest, "name", "left").where(F.col("longer").isNull() | ~absorbed)
        kept = kept.unionByName(own.select(*kept.columns))
    kept = materialize(kept, "phrases-kept")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shards = max(1, -(-kept.count() // RANK_ROWS))
    for salt in (["shard"], []):  # the first rankings of shards, then that of their best
        kept = kept.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(shards))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", *salt).orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
