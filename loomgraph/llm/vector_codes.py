"""Vector codes: integer product quantization, with partial-distance search for the nearest entries.

Components are scaled to integers, so every distance, sum and tie is exact and the
result does not depend on how rows are dealt. A round is one scan: each task
assigns its vectors and hands on a sum and a count per part and entry, which
Spark adds up; what reaches the driver is as large as the codebooks,
whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose distances are held at a time, and dimensions between two looks at the best complete distance.
BLOCK, STEP = 1024, 4
#: Labels whose sums may be sent to all rows.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]`` has a row of integer components per entry; vectors of fewer components are filled up with zeros."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def size(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each vector's nearest entry (ties to the lower) and the squared distance, by partial-distance search.

    Dimensions go by descending variance over the entries. The first STEP are summed for
    all entries; from then on only pairs that are still in the race are held. Every
    STEP dimensions each vector's most promising entry is measured in full, and entries whose
    sum so far is strictly above the best such distance drop out.
    """
    n, d = vectors.shape
    count = len(book)
    spread = [count * sum(x * x for x in column) - sum(column) ** 2 for column in book.T.tolist()]
    order = sorted(range(d), key=lambda k: (-spread[k], k))
    v, c = np.ascontiguousarray(vectors[:, order]), np.ascontiguousarray(book[:, order])
    index, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(0, n, BLOCK):
        part = v[a : a + BLOCK]
        so_far = np.zeros((len(part), count), np.int64)
        for k in range(min(STEP, d)):
            so_far += (part[:, k, None] - c[None, :, k]) ** 2
        best = ((part - c[so_far.argmin(axis=1)]) ** 2).sum(axis=1)
        row, col = np.nonzero(so_far <= best[:, None])
        left = so_far[row, col]
        for k in range(STEP, d):
            left = left + (part[row, k] - c[col, k]) ** 2
            if (k + 1) % STEP == 0 and k + 1 < d:
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                lead = col[first_of(left == np.repeat(np.minimum.reduceat(left, starts), np.diff(starts, append=len(row))), row)]
                best = np.minimum(best, ((part - c[lead]) ** 2).sum(axis=1))
            stay = left <= best[row]
            row, col, left = row[stay], col[stay], left[stay]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(left, starts)
        index[a : a + BLOCK] = col[first_of(left == np.repeat(least, np.diff(starts, append=len(row))), row)]
        distance[a : a + BLOCK] = least
    return index, distance


def first_of(hit: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the first hit of each row; rows are sorted and have one at least."""
    at = np.flatnonzero(hit)
    return at[np.diff(row[at], prepend=-1) > 0]


def whole_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite components alone."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(vector).isNotNull()).where(finite)


def integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """A row of ``size`` integers per vector: floor(scale * x), zeros where it is shorter."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    if (sizes == size).all():
        return values.reshape(len(sizes), size)
    out = np.zeros((len(sizes), size), np.int64)
    out[np.arange(size) < sizes[:, None]] = values
    return out


def train_codebooks(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding"
) -> Codebooks:
    """Codebooks that start from the vectors of the smallest ids and move to their parts' means, floored.

    Equal ids are ordered by their vectors, null ids come last; with fewer vectors
    there are as many entries. Vectors that are null or not finite are left out. All others
    count: the size is that of the longest, rounded up to a multiple of ``parts``, and shorter
    ones are filled up with zeros. No vectors give codebooks without entries. Components whose
    squared distances would not fit 64 bits raise ValueError.
    """
    source = whole_vectors(vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")), "v")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    longest, high = source.agg(F.max(F.size("v")), F.max(largest)).first()
    width = -(-(longest or 0) // parts)
    if 4 * ((high or 0.0) * scale + 1) ** 2 * max(1, parts * width) >= 2**63:
        raise ValueError("components are too large for distances of 64 bits")
    seeds = source.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    book = integers(seeds, parts * width, scale).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if len(seeds) and width else 0):
        sums = source.select("v").mapInArrow(partial_sums(book, scale), "part int, entry int, rows long, sums array<long>")
        total = (
            sums.select("part", "entry", "rows", F.posexplode("sums").alias("place", "sum"))
            .groupBy("part", "entry", "place")
            .agg(F.sum("rows").alias("rows"), F.sum("sum").alias("sum"))
        )
        book = book.copy()
        for r in total.collect():  # at most one row per component of the codebooks
            book[r.part, r.entry, r.place] = r["sum"] // r.rows
    return Codebooks(book, scale)


def partial_sums(book: np.ndarray, scale: int):
    """A task's sum and number of vectors per part and entry."""
    parts, count, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = np.zeros((parts, count), np.int64), np.zeros(book.shape, np.int64)
        for batch in batches:
            for k, own in enumerate(np.hsplit(integers(batch.column(0), parts * width, scale), parts)):
                index, _ = nearest(own, book[k])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if len(used):
                    sums[k, used] += np.add.reduceat(own[order], starts, axis=0)
                rows[k] += np.bincount(index, minlength=count)
        part, entry = np.nonzero(rows)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(rows[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "rows", "sums"])

    return run


def encode_vectors(vectors: DataFrame, books: Codebooks, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code (binary, one byte a part; two, big end first, above 256 entries) and error of each whole vector.

    The error is the squared distance to the entries, summed over the parts. Codebooks must come
    from vectors at least as long; codes of vectors without components are zeros.
    """
    parts, count, width = books.entries.shape
    unit = ">u1" if count <= 256 else ">u2"
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    names = ["vec_id", "label", "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = integers(batch.column(2), parts * width, books.scale)
            found = [nearest(x, books.entries[k]) for k, x in enumerate(np.hsplit(own, parts))] if width and len(own) else []
            codes = np.stack([i for i, _ in found], axis=1).astype(unit) if found else np.zeros((len(own), parts), unit)
            error = sum((e for _, e in found), np.zeros(len(own), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=names)

    schema = source.drop("v").withColumns({"code": F.lit(b""), "error": F.lit(0).cast("long")}).schema
    return whole_vectors(source, "v").mapInArrow(run, schema)


def decode_codes(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with the vector each code stands for, in the units of the input (array of double)."""
    parts, count, width = books.entries.shape
    unit = ">u1" if count <= 256 else ">u2"
    schema = codes.withColumn("vector", F.array().cast("array<double>")).schema
    at = codes.columns.index("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.frombuffer(b"".join(batch.column(at).to_pylist()), unit).reshape(-1, parts)
            rows = np.concatenate([books.entries[k][index[:, k]] for k in range(parts)], axis=1) / books.scale if len(index) and count else np.zeros((len(index), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(rows), pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return codes.mapInArrow(run, schema)


def hexadecimal(code: Column) -> Column:
    return F.lower(F.hex(code))


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", broadcast_rows: int = BROADCAST_ROWS, **training) -> DataFrame:
    """Per whole vector: vec_id, code (hexadecimal), error, label_error, codebooks_sha256.

    label_error sums the errors of all rows of equal label, null labels together. Rows that are
    null or hold components that are null or not finite go; repeated ids and rows are
    vectors each, null ids stay; an empty table gives no rows; further columns are ignored.
    """
    books = train_codebooks(vectors, vec_id=vec_id, vector=vector, **training)
    coded = materialize(encode_vectors(vectors, books, vec_id, vector, label), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= broadcast_rows:
        sums = F.broadcast(sums)  # beyond it the join goes by label, and adaptive execution splits those of many rows
    joined = coded.join(sums, coded.label.eqNullSafe(sums.of))
    return joined.select("vec_id", hexadecimal(F.col("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
