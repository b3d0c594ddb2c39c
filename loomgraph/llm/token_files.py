"""Token files: ids ranked by frequency, in a byte-aligned variable-length code with separate control bytes.

Format. A folder holds ``ranks`` (Parquet: rank, id, n) and ``tokens``, whose
``part-*`` files, in the order of their names, hold all documents in ascending
order of doc_id. A file is a row of blocks, all numbers little-endian:

    magic "TIDS" | documents u32 | ids u64 | data bytes u64 | crc32 u32 of the rest
    doc_id i64 each | 1 if it is null, else 0, u8 each | ids u64 each
    control bytes: two bits per id, four ids a byte, lowest bits first: bytes of the code less one
    data bytes: ranks, 1 to 4 bytes each | "\\n"

The closing line feed lets Spark's own text writer commit the files, so any
file system that Spark knows will do and lost executors leave no half files. A block decodes without
loops over ids: a table gives each control byte's four lengths, their running sum
gives every id's place.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, materialize, ranges, shared_root, whole_text

#: Text that is tokenized at a time, pieces after which a cache starts anew, the longest piece that is kept, and new pieces that are encoded together.
SLICE_BYTES, CACHE_PIECES, LONGEST_PIECE, TOGETHER = 3_000_000, 300_000, 48, 2000
#: Ids of a block, of a file at most, and of a file where that would leave fewer than FILES files.
BLOCK_IDS, FILE_IDS, SMALL_FILE_IDS, FILES = 1_000_000, 64_000_000, 4_000_000, 64

_HEAD = struct.Struct("<4sIQQI")
_MAGIC = b"TIDS"
#: Bytes of the code of each of a control byte's four ids.
LENGTHS = (1 + (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3)).astype(np.int64)

#: A byte that no valid UTF-8 text has, for the end of a document. Its id stands for it until it becomes the end id.
_END, _END_ID = b"\xfe", np.uint32(0xFFFFFFFF)
_VISIBLE = bytes(range(33, 127))
_SPACE, _SOLID, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(4))
_SPACE[[32, 10]] = True
_SOLID[list(_VISIBLE)] = True
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
#: All ASCII signs but the apostrophe, which may start an English ending.
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
#: U+00DF to U+00FF, letters but for one sign, follow this lead byte in UTF-8.
_LEAD, _LATIN = 0xC3, bytes(sorted(set(range(0x9F, 0xC0)) - {0xB7}))
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[list(_LATIN)] = True
#: How byte-level BPE of this kind parts a text into words (a fixed value).
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level BPE writes bytes: printable ones stand for themselves, others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def fast_merges(tokenizer):
    """The same merges in tiktoken, or None where a token's id isn't the rank of its merge, so that the two could differ."""
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    vocabulary, alphabet = model["vocab"], byte_alphabet()
    if model["type"] != "BPE" or any(vocabulary.get(m) != 256 + k for k, m in enumerate(merges)) or any(not 0 <= vocabulary.get(c, -1) < 256 for c in alphabet):
        return None
    ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("merges", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})


class Codes(dict):
    """Codes of pieces in the order in which they are first asked."""

    def __missing__(self, piece: bytes) -> int:
        code = self[piece] = len(self)
        return code


class PieceTokenizer:
    """Whole-text ids through a cache of the ids of pieces, for byte-level BPE that keeps spaces with the word after them.

    Such a tokenizer starts a new word where white space follows a visible sign
    and where a mark follows a letter, and no merge crosses words; cutting
    there, and only there, changes no id. ``end_id`` follows each document. New pieces of Latin letters and ASCII signs go
    through the same merges in a faster library (the tests compare all of the vocabulary), others and texts with special tokens through the tokenizer.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id
        size = self.tokenizer.get_vocab_size()
        self.size = max(size, end_id + 1)
        # a byte-level token has a character per byte
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = fast_merges(self.tokenizer)
        self.forget([])

    def forget(self, pieces: list[bytes]) -> None:
        """Start the cache anew, with ``pieces`` in it."""
        self.codes = Codes({_END: 0})
        self.flat, self.sizes, self.starts, self.seen = np.array([_END_ID], "<u4"), np.array([1]), np.array([0]), np.zeros(1, np.int64)
        for p in pieces:
            self.codes[p]
        self.learn(pieces)

    def encode_alone(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def encode_spaced(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that start with white space and end with a visible ASCII sign or a Latin letter, as one text."""
        ids = np.array(self.fast.encode_ordinary(b"".join(pieces).decode()), "<u4")
        stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p) for p in pieces])) + 1
        return ids, np.diff(stops, prepend=0)

    def learn(self, new: list[bytes], whole: Container[bytes] = ()) -> None:
        """Ids of the pieces of the last ``len(new)`` codes; those in ``whole`` may hold special tokens."""
        if not new:
            return
        rest = b"\xff".join(new).translate(None, _VISIBLE + b" \n" + bytes([_LEAD]) + _LATIN).split(b"\xff")
        plain = np.array([self.fast is not None and not r and p[0] in b" \n" and (p[-1] in _VISIBLE or p[-1] in _LATIN) and p not in whole for p, r in zip(new, rest, strict=True)])
        ids, sizes, order = [], [], np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        for at, encode in ((np.flatnonzero(plain), self.encode_spaced), (np.flatnonzero(~plain), self.encode_alone)):
            for k in range(0, len(at), TOGETHER):
                found, lengths = encode([new[i] for i in at[k : k + TOGETHER].tolist()])
                ids.append(found)
                sizes.append(lengths)
        held = np.concatenate(sizes)
        starts, lengths = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        starts[order], lengths[order] = len(self.flat) + np.cumsum(held) - held, held
        self.flat, self.starts, self.sizes = np.concatenate([self.flat, *ids]), np.concatenate([self.starts, starts]), np.concatenate([self.sizes, lengths])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])

    @staticmethod
    def cuts(raw: bytes, whole: list[tuple[int, int]]) -> np.ndarray:
        """Where pieces start, and the end of the last; there are no cuts inside the ranges ``whole``."""
        buf = np.frombuffer(raw, np.uint8)
        latin = np.zeros(len(buf), bool)
        latin[1:] = _FOLLOWS[buf[1:]] & (buf[:-1] == _LEAD)
        before = _SPACE[buf[1:]] & (_SOLID[buf[:-1]] | latin[:-1]) | _MARK[buf[1:]] & (_LETTER[buf[:-1]] | latin[:-1])
        before |= (buf[1:] == _END[0]) | (buf[:-1] == _END[0])
        for start, stop in whole:
            before[start : stop - 1] = False
        return np.concatenate([[0], np.flatnonzero(before) + 1, [len(buf)]]).astype(np.int32)

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in UTF-8, one after the other, and where each text's end."""
        if any(_END in t for t in texts):  # no valid UTF-8
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
        if not texts:
            return np.array([], "<u4"), np.array([], np.int64)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        special = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]  # a special token is found before words are
        raw = _END.join(texts) + _END
        offsets = self.cuts(raw, [(int(starts[k]), int(starts[k]) + len(texts[k])) for k in special])
        found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        known, pieces = len(self.codes), found.dictionary.to_pylist()
        distinct = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        whole = {texts[k] for k in special}
        self.learn(list(itertools.islice(self.codes, known, None)), whole)
        codes = distinct[found.indices.to_numpy()]
        self.seen += np.bincount(codes, minlength=len(self.seen))
        sizes = self.sizes[codes]
        places = np.repeat(self.starts[codes] - np.cumsum(sizes) + sizes, sizes)
        places += np.arange(len(places))
        ids = self.flat[places]
        stops = np.flatnonzero(ids == _END_ID)
        ids[stops] = self.end
        if len(self.codes) > CACHE_PIECES or len(self.flat) > 8 * CACHE_PIECES or sum(map(len, whole)) > SLICE_BYTES:
            again = self.seen > 1
            self.forget([p for p, a in zip(self.codes, again.tolist(), strict=True) if a and p != _END and len(p) <= LONGEST_PIECE][-CACHE_PIECES // 2 :])
        return ids, stops + 1


@functools.lru_cache(maxsize=1)
def piece_tokenizer(path: str, end_id: int) -> PieceTokenizer:
    """One for all tasks of a worker process: what it has learned stays."""
    return PieceTokenizer(path, end_id)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    values = np.ascontiguousarray(ranks, "<u4")
    lengths = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    control = (codes.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks of ``count`` ids, by a table of control bytes."""
    lengths = LENGTHS[control].ravel()[:count]
    starts = np.cumsum(lengths) - lengths
    out = data[starts].astype("<u4")
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        out[more] |= data[starts[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


def pack_block(doc_ids: list[int | None], sizes: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    body = b"".join((
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), np.array(sizes, "<u8").tobytes(), control, data,
    ))
    return _HEAD.pack(_MAGIC, len(doc_ids), len(ranks), len(data), zlib.crc32(body)) + body


def blocks(content: memoryview) -> Iterator[tuple[int, int, int, memoryview, int]]:
    """documents, ids, data bytes, body and crc32 of each block of a file."""
    at = 0
    while at < len(content):
        magic, docs, ids, data, crc = _HEAD.unpack_from(content, at)
        size = 17 * docs + -(-ids // 4) + data
        if magic != _MAGIC or at + _HEAD.size + size + 1 > len(content):
            raise ValueError("not a whole token file")
        yield docs, ids, data, content[at + _HEAD.size : at + _HEAD.size + size], crc
        at += _HEAD.size + size + 1


def unpack_block(docs: int, ids: int, data: int, body: memoryview, crc: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, sizes and ranks."""
    if zlib.crc32(body) != crc:
        raise ValueError("a block of a token file is damaged")
    names = np.frombuffer(body, "<i8", docs).tolist()
    nulls = np.frombuffer(body, np.uint8, docs, 8 * docs)
    sizes = np.frombuffer(body, "<u8", docs, 9 * docs).astype(np.int64)
    controls = -(-ids // 4)
    ranks = decode_ranks(np.frombuffer(body, np.uint8, controls, 17 * docs), np.frombuffer(body, np.uint8, data, 17 * docs + controls), ids)
    return [None if gone else d for d, gone in zip(names, nulls, strict=True)], sizes, ranks


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, crc (of the ids), n_tokens, place (of the row, unique) and ids (u16 where all fit, else u32); rows of null place count ids (``counts``)."""
    names = ["doc_id", "crc", "n_tokens", "place", "ids", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_tokenizer(tokenizer_path, end_id)
        unit = id_unit(words.size)
        counts = np.zeros(words.size, np.int64)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw = batch.column(1)
            for a, b in ranges(pc.binary_length(raw).to_numpy(zero_copy_only=False), SLICE_BYTES):
                ids, stops = words.encode_batch(raw.slice(a, b - a).to_pylist())
                counts += np.bincount(ids, minlength=words.size)
                sizes = np.diff(stops, prepend=0)
                ends = stops.tolist()
                whole, short = memoryview(ids.tobytes()), ids.astype(unit).tobytes()
                width = np.dtype(unit).itemsize
                spans = list(zip([0, *ends], ends, strict=False))
                columns = [
                    batch.column(0).slice(a, b - a), [zlib.crc32(whole[4 * x : 4 * y]) for x, y in spans], sizes, np.arange(place, place + b - a),
                    [short[width * x : width * y] for x, y in spans], pa.nulls(b - a, pa.binary()),
                ]
                place += b - a
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, None, None, None, counts.astype("<i8").tobytes()], types, strict=True)], names=names)

    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole_text(docs, text).cast("binary").alias("raw"))
    return source.mapInArrow(run, "doc_id long, crc long, n_tokens long, place long, ids binary, counts binary")


def id_unit(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def frequency_ranks(tokens: DataFrame) -> list[tuple[int, int]]:
    """(id, n) of all ids that occur, most frequent first, then by id: a row per id of the vocabulary at most."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                counts = np.frombuffer(own, "<i8")
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["id", "n"])

    total = tokens.where("counts is not null").select("counts").mapInArrow(apart, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return sorted(((r.id, r.n) for r in total.collect()), key=lambda x: (-x[1], x[0]))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write ``docs`` to ``folder``: their ids, each document's followed by ``end_id``, in ascending doc_id order.

    Rows without an id come first; rows of equal id follow each other by crc32 and
    number of ids, so just rows of equal ids are in no order. Null texts are empty
    and hold the end id alone; an empty table gives no blocks. Further columns are ignored.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer_path, end_id, text, doc_id), "tokens", "zstd")
    ranked = frequency_ranks(tokens)
    spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(ranked)], "rank long, id long, n long").coalesce(1).write.parquet(f"{folder}/ranks")
    size = max((i for i, _ in ranked), default=0) + 1
    rank_of = np.zeros(size, "<u4")
    rank_of[[i for i, _ in ranked]] = np.arange(len(ranked))
    total = sum(n for _, n in ranked)
    files = max(1, -(-total // FILE_IDS), min(FILES, -(-total // SMALL_FILE_IDS)))
    unit = id_unit(piece_tokenizer(tokenizer_path, end_id).size)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, held, count = [], [], [], 0
        for batch in batches:
            for name, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names.append(name)
                sizes.append(n)
                held.append(ids)
                count += n
                if count >= BLOCK_IDS:
                    yield block(names, sizes, held)
                    names, sizes, held, count = [], [], [], 0
        if names:
            yield block(names, sizes, held)

    def block(names: list, sizes: list, held: list) -> pa.RecordBatch:
        packed = pack_block(names, sizes, rank_of[np.frombuffer(b"".join(held), unit)])
        return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["value"])

    order = ["doc_id", "crc", "n_tokens", "place"]
    dealt = tokens.where("place is not null").select(*order, "ids").repartitionByRange(files, *order).sortWithinPartitions(*order)
    # the text writer puts a value's bytes as they are, and a line feed behind
    dealt.select("doc_id", "n_tokens", "ids").mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.text(f"{folder}/tokens")
    discard(tokens)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, u32) of each document of the files."""
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").toArrow().column("id").to_numpy().astype("<u4")
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/tokens")
    content = files.select("path", "content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [sum(ids for _, ids, *_ in blocks(memoryview(c.as_buffer()))) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["path", "ids"])

    names = ["path", "doc_id", "local", "n_tokens", "ids_crc32", *(["ids"] * with_ids)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, held in zip(batch.column(0), batch.column(1), strict=True):
                base = 0
                for each in blocks(memoryview(held.as_buffer())):
                    docs, sizes, found = unpack_block(*each)
                    whole = memoryview(ranks[found].tobytes())
                    stops = np.cumsum(sizes)
                    spans = list(zip((4 * (stops - sizes)).tolist(), (4 * stops).tolist(), strict=True))
                    columns = [pa.array([path.as_py()] * len(docs)), pa.array(docs, pa.int64()), pa.array(base + stops - sizes), pa.array(sizes), pa.array([zlib.crc32(whole[a:b]) for a, b in spans], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array([bytes(whole[a:b]) for a, b in spans], pa.binary())] * with_ids)], names=names)
                    base += each[1]

    # one number per file, as a listing of the folder has
    sizes = sorted((r.path, r.ids) for r in content.mapInArrow(heads, "path string, ids long").collect())
    stops = np.cumsum([n for _, n in sizes]).tolist()
    bases = spark.createDataFrame([(p, stop - n) for (p, n), stop in zip(sizes, stops, strict=True)], "path string, base long")
    found = content.mapInArrow(decode, "path string, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return found.join(bases, "path").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def new_folder(spark: SparkSession) -> str:
    """A folder under the shared one, which goes when the driver's JVM ends."""
    folder = f"{shared_root(spark)}/token-files-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return folder


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write token files and read them: doc_id, start, n_tokens, ids_crc32 of each document."""
    folder = new_folder(docs.sparkSession)
    write_token_files(docs, tokenizer_path, folder, end_id, text, doc_id)
    return read_token_files(docs.sparkSession, folder)
