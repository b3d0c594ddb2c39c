"""N-gram Jaccard join by set-relation skipping, and the components of its links.

Index level. A set's elements have one total order (rarer first, by a sketch of
frequencies, then by value). Sets that link share an element among the first few
of each, and at the first they share, as many elements must follow in both as the
overlap needs. Lists hold their postings by size; a posting's position bounds
the size of a partner, so from the first posting beyond that bound all the rest of the list is skipped.

Answer level. Equal sets are one node. In each list a node is first compared with
one leader only; links join nodes into components. Then only pairs from different
components remain. A list's sets are compared once with one hub; the overlap of
any two of them follows from their differences to it, and pairs that links found
meanwhile connect are skipped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh_name, materialize, ranges, whole_text
from loomgraph.llm.components import connected_components

WORDS, PERCENT = 5, 80
#: The sketch of frequencies has 2**SKETCH_BITS counters however large the input.
SKETCH_BITS, SKETCH_BLOCKS = 21, 32
BUCKET_POSTINGS = 200_000
#: Postings that a task gathers before it hands them out.
GATHER_POSTINGS = 500_000
#: Postings whose nodes' sets a task compares at a time, and elements that these sets should have at most.
CROSS_POSTINGS, CROSS_ELEMENTS = 20_000, 4_000_000
#: Postings, in whole lists, whose differences to hubs a task holds together, and elements that it holds of them at most.
BLOCK_POSTINGS, HELD_ELEMENTS = 2_000, 2_000_000
#: Nodes in several lists whose pairs a task marks as compared, half a bit for each pair.
MARKED_NODES = 16_000
CACHE_WORDS = 100_000
#: Text that is described at a time.
SLICE_BYTES = 2_000_000
#: Postings of one element that a task should meet at most; longer lists are split.
HOT_LIST = 20_000
#: Marks, in a posting's position, that its list is split.
SPLIT = np.uint32(1 << 31)
_P1, _P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Sorted 64-bit codes of a text's distinct word shingles."""

    def __init__(self, words: int):
        self.words, self.codes = words, {}

    def __call__(self, text: str) -> np.ndarray:
        codes = self.codes
        if len(codes) > CACHE_WORDS:
            codes.clear()
        split = text.encode("utf-8", "surrogatepass").lower().split()  # bytes split and lower at ASCII alone
        if not split:
            return np.zeros(0, np.uint64)
        own = []
        for w in split:
            c = codes.get(w)
            if c is None:
                c = codes[w] = xxhash.xxh3_64_intdigest(w)
            own.append(c)
        h = np.array(own, np.uint64)
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * _P1
            out ^= out >> np.uint64(29)
        out *= _P2
        out ^= out >> np.uint64(32)
        return np.unique(out)


def node_of(codes: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(codes.tobytes())).view(np.int64))


def least_overlap(a, b, percent: int):
    """Elements that sets of sizes a and b must share to link."""
    return -(-percent * (a + b) // (100 + percent))


def sketch_levels(found: DataFrame) -> np.ndarray:
    """Frequency levels (half-powers of two) of the counters, from the partitions' sketches; a fixed size."""

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(b), np.uint32).astype(np.int64) for b in part["counts"])
        return pd.DataFrame({"block": [int(key[0])], "counts": [np.round(2 * np.log2(1 + total)).astype(np.uint8).tobytes()]})

    rows = found.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    width = len(levels) // SKETCH_BLOCKS
    for r in rows:
        levels[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["counts"], np.uint8)
    return levels


def prefix(codes: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first elements by (level, value) that a linking set must meet."""
    n = len(codes)
    order = np.argsort(levels[(codes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return codes[order[: n - (percent * n + 99) // 100 + 1]]


def text_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """The ids and texts of a batch by about SLICE_BYTES characters: no more of it than that becomes Python's strings at a time."""
    raw = batch.column("raw")
    for a, b in ranges(pc.utf8_length(raw).to_pylist(), SLICE_BYTES):
        yield batch.column("doc_id").slice(a, b - a), raw.slice(a, b - a).to_pylist()


def describe(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, n_shingles, node), and rows (block, counts) of the partitions' frequency sketches."""

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for ids, texts in text_slices(batch):
                sets = [shingle(t) for t in texts]
                flat = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
                where, n = np.unique(flat, return_counts=True)
                sketch[where.astype(np.int64)] += n.astype(np.uint32)
                none = [None] * len(sets)
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_shingles": [len(s) for s in sets], "node": [node_of(s) if len(s) else None for s in sets], "block": none, "counts": none}, schema)
        if sketch.any():
            blocks = np.split(sketch, SKETCH_BLOCKS)
            none = [None] * SKETCH_BLOCKS
            yield pa.RecordBatch.from_pydict({"doc_id": none, "n_shingles": none, "node": none, "block": list(range(SKETCH_BLOCKS)), "counts": [zlib.compress(b.tobytes(), 1) for b in blocks]}, schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, block int, counts binary")


def set_names(words: int):
    """A vectorised function from text to its set's node, null without words."""

    @F.pandas_udf("long")
    def node(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingle = Shingler(words)
        for batch in batches:
            yield pd.Series([node_of(s) if len(s := shingle(t)) else None for t in batch], dtype="Int64")

    return node


def postings(docs: DataFrame, levels: np.ndarray, words: int, percent: int, buckets: int, hot_list: int = HOT_LIST) -> DataFrame:
    """Prefix postings packed by bucket of the element: (bucket, data); lists beyond ``hot_list`` are split by node."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, own = Shingler(words), set(), shared.value
        held, spread, count = [], [], 0

        def out() -> pa.RecordBatch:
            at = (np.concatenate(spread) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            rows, at = np.concatenate(held)[order], at[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            return pa.RecordBatch.from_pydict({"bucket": at[starts].astype(np.int32), "data": [p.tobytes() for p in np.split(rows, starts[1:])]}, pa.schema([("bucket", pa.int32()), ("data", pa.binary())]))

        for batch in batches:
            for text in (t for _, texts in text_slices(batch) for t in texts):
                codes = shingle(text)
                if not len(codes) or (node := node_of(codes)) in seen:
                    continue
                seen.add(node)
                first = prefix(codes, own, percent)
                rows = np.empty(len(first), POSTING)
                rows["code"], rows["node"], rows["size"], rows["pos"] = first, node, len(codes), np.arange(len(first))
                estimate = np.exp2(own[(first >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] / 2)
                parts = (estimate / hot_list).astype(np.uint64) + np.uint64(1)
                rows["pos"][parts > 1] |= SPLIT
                held.append(rows)
                spread.append(first + (np.uint64(node & 0xFFFFFFFF) % parts) * _P1)
                count += len(rows)
                if count > GATHER_POSTINGS:
                    yield out()
                    held, spread, count = [], [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "bucket int, data binary")


POSTING = np.dtype([("code", np.uint64), ("node", np.int64), ("size", np.uint32), ("pos", np.uint32)])


def fits(size_a, left_a, size_b, left_b, percent: int) -> np.ndarray:
    """Whether what follows the shared element suffices in both."""
    return np.minimum(left_a, left_b) >= least_overlap(size_a, size_b, percent)


def live_postings(packed: DataFrame, percent: int) -> DataFrame:
    """Postings with a possible partner in their list, each with a leader: (code, node, size, pos, leader, leader_size, leader_pos)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(part["data"]), POSTING)
        rows = rows[np.lexsort((rows["node"], rows["size"], rows["code"]))]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows["code"][1:] != rows["code"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
        rows = rows[fresh]
        code, size = rows["code"], rows["size"].astype(np.int64)
        hot, pos = rows["pos"] >= SPLIT, (rows["pos"] & (SPLIT - 1)).astype(np.int64)
        left = size - pos
        reach = left * (100 + percent) // percent - size  # the largest partner that this position allows
        live = np.zeros(len(rows), bool)
        live |= hot  # a split list's partners may be elsewhere
        lists = np.cumsum(np.concatenate([[True], code[1:] != code[:-1]])) - 1 if len(rows) else np.zeros(0, np.int64)
        todo, d = np.arange(len(rows) - 1), 1
        while len(todo):
            todo = todo[todo + d < len(rows)]
            other = todo + d
            on = (code[todo] == code[other]) & (size[other] <= reach[todo])  # beyond reach the rest of the list is skipped
            todo, other = todo[on], other[on]
            ok = fits(size[todo], left[todo], size[other], left[other], percent)
            live[todo[ok]] = live[other[ok]] = True
            if d < 16 or d % 16 == 0:  # done with a list once nothing behind is undecided
                last = np.full(lists[-1] + 1, -1)
                open_ = np.flatnonzero(~live)
                last[lists[open_]] = open_
                todo = todo[~live[todo] | (last[lists[todo]] > todo + d)]
            d += 1
        rows, code, size, pos = rows[live], code[live], size[live], pos[live]
        if not len(rows):
            return pd.DataFrame(columns=["code", "node", "size", "pos", "leader", "leader_size", "leader_pos"])
        # blocks of one list whose sizes are within the threshold of the block's first
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = np.append(start[1:], len(rows))
        block = np.zeros(len(rows), np.int64)
        n = 0
        for a, b in zip(start.tolist(), ends.tolist(), strict=True):
            while a < b:
                stop = a + int(np.searchsorted(size[a:b], size[a] * 100 // percent, "right"))
                block[a:stop] = n
                n, a = n + 1, stop
        mixed = (rows["node"].view(np.uint64) ^ ((code & np.uint64(1)) * _P2)) * _P1
        order = np.lexsort((mixed, block))
        firsts = order[np.flatnonzero(np.concatenate([[True], np.diff(block[order]) > 0]))]
        head = firsts[block]
        return pd.DataFrame(
            {
                "code": code.view(np.int64), "node": rows["node"], "size": size, "pos": pos,
                "leader": rows["node"][head], "leader_size": size[head], "leader_pos": pos[head],
            }
        )

    return packed.groupBy("bucket").applyInPandas(run, "code long, node long, size long, pos long, leader long, leader_size long, leader_pos long")


def least_overlap_column(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def overlaps(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Exact (a, b, size_a, size_b, shared) of node pairs (a, b), from their texts.

    A leader b meets the followers of its lists' parts, so at most some HOT_LIST each; adaptive execution splits what is still uneven.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        last, codes = None, None
        for batch in batches:
            rows = []
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if b != last:
                    last, codes = b, shingle(text_b)
                own = shingle(text_a)
                rows.append((a, b, len(own), len(codes), common(own, codes)))
            yield pd.DataFrame(rows, columns=["a", "b", "size_a", "size_b", "shared"])

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("raw").alias("text_a")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("raw").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, size_a long, size_b long, shared long")


def linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared"))


class Lists:
    """Lists of postings by size, and the pairs of different components that sizes and positions allow."""

    def __init__(self, part: pd.DataFrame, percent: int):
        self.part = part.sort_values(["code", "low", "high", "size", "node"], ignore_index=True)
        self.node, self.component, self.size = (self.part[c].to_numpy(np.int64) for c in ("node", "component", "size"))
        keys = [np.diff(self.part[c]) != 0 for c in ("code", "low", "high")]
        self.list = np.cumsum(np.concatenate([[True], keys[0] | keys[1] | keys[2]]))
        self.left = self.size - self.part["pos"].to_numpy(np.int64)
        self.reach = self.left * (100 + percent) // percent - self.size
        self.percent = percent

    def starts(self) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], self.list[1:] != self.list[:-1]]))

    def hubs(self) -> np.ndarray:
        """One node of each posting's list, the same for all of it."""
        starts = self.starts()
        return np.repeat(np.minimum.reduceat(self.node, starts), np.diff(np.append(starts, len(self.node))))

    def blocks(self, postings: int) -> Iterator[tuple[int, int]]:
        """Ranges of whole lists of about ``postings`` postings, one list at least."""
        edges = np.append(self.starts(), len(self.node)).tolist()
        for a, b in ranges(np.diff(edges).tolist(), postings):
            yield edges[a], edges[b]

    def pairs(self, begin: int = 0, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        end = len(self.node) if end is None else end
        todo, d = np.arange(begin, end - 1), 1
        while len(todo):
            todo = todo[todo + d < end]
            other = todo + d
            on = (self.list[todo] == self.list[other]) & (self.size[other] <= self.reach[todo])  # beyond reach the rest of the list is skipped
            todo, other = todo[on], other[on]
            ok = (self.component[todo] != self.component[other]) & fits(self.size[todo], self.left[todo], self.size[other], self.left[other], self.percent)
            if ok.any():
                yield todo[ok], other[ok]
            d += 1


def common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


class Answers:
    """Overlaps of sets, derived from their differences to one set that many are like.

    With d(x) the symmetric difference of x and a hub, x and y differ in exactly
    d(x) ^ d(y); for sets like the hub these are a few elements. Differences are
    held up to ``limit`` elements; sets whose differences find no place are compared themselves.
    """

    def __init__(self, sets: dict[int, np.ndarray], limit: int = HELD_ELEMENTS):
        self.sets, self.limit = sets, limit
        self.forget()

    def forget(self) -> None:
        self.differences, self.held = {}, 0

    def difference(self, x: int, hub: int) -> np.ndarray | None:
        found = self.differences.get((x, hub))
        if found is None and self.held < self.limit:
            found = self.differences[x, hub] = np.setxor1d(self.sets[x], self.sets[hub], assume_unique=True)
            self.held += len(found) + 32  # what an array takes besides its elements
        return found

    def overlap(self, x: int, y: int, hub: int) -> int:
        a, b = self.difference(x, hub), self.difference(y, hub)
        if a is None or b is None:
            return common(self.sets[x], self.sets[y])
        return (len(self.sets[x]) + len(self.sets[y]) - len(a) - len(b)) // 2 + common(a, b)


class Marks:
    """Pairs of nodes, known by their places, that have been compared: a bit each, for the first ``limit`` nodes with several postings.

    Other pairs count as new each time: of nodes with one posting they can't come again.
    """

    def __init__(self, postings: np.ndarray, limit: int = MARKED_NODES):
        several = postings > 1
        rank = np.cumsum(several) - 1
        self.rank = np.where(several & (rank < limit), rank, -1)
        n = int(self.rank.max(initial=-1)) + 1
        self.bits = np.zeros(n * (n - 1) // 16 + 1, np.uint8)

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair's bit, -1 without one."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        return np.where(low >= 0, high * (high - 1) // 2 + low, -1)

    def old(self, keys: np.ndarray) -> np.ndarray:
        return (keys >= 0) & (self.bits[keys >> 3] >> (keys & 7).astype(np.uint8) & 1 > 0)

    def add(self, key: int) -> bool:
        """Whether the pair is new; it is marked."""
        if key < 0:
            return True
        new = not self.bits[key >> 3] >> (key & 7) & 1
        self.bits[key >> 3] |= 1 << (key & 7)
        return new


def group_links(part: pd.DataFrame, known: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Links (a, b) between different components that the postings ``part`` allow; ``known`` has the text of each node (s_node, raw).

    Held at a time: the sets, the differences of one block of lists, and the marks, whose sizes don't follow the number of pairs.
    """
    if not len(part):
        return pd.DataFrame(columns=["a", "b"])
    lists = Lists(part, percent)
    names, at = np.unique(lists.node, return_inverse=True)
    hubs = np.searchsorted(names, lists.hubs())
    group = np.empty(len(names), np.int64)
    group[at] = lists.component
    shingle = Shingler(words)
    sets = {n: shingle(t) for n, t in zip(np.searchsorted(names, known["s_node"].to_numpy(np.int64)).tolist(), known["raw"], strict=True)}
    answers, marks = Answers(sets), Marks(np.bincount(at))
    links = []
    for begin, end in lists.blocks(BLOCK_POSTINGS):
        answers.forget()
        for x, y in lists.pairs(begin, end):
            a, b = at[x], at[y]
            keys = marks.keys(a, b)
            on = (group[a] != group[b]) & ~marks.old(keys)
            for p, q, key, hub in zip(a[on].tolist(), b[on].tolist(), keys[on].tolist(), hubs[x[on]].tolist(), strict=True):
                if group[p] == group[q] or not marks.add(key):
                    continue
                shared = answers.overlap(p, q, hub)
                if 100 * shared >= percent * (len(sets[p]) + len(sets[q]) - shared):
                    links.append((p, q))
                    group[group == group[q]] = group[p]
    found = names[np.array(links, np.int64).reshape(-1, 2)]
    return pd.DataFrame({"a": found.min(1), "b": found.max(1)})


def cross_links(listed: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different components that ``listed`` postings (code, label, node, size, pos, component, parts) allow.

    Pairs that the links found so far in a task join are skipped, so links that
    only repeat a connection may be left out, none that makes one. A list in
    several ``parts`` meets part by part: each task sees two parts of it.
    """
    part_of, other = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = listed.withColumns({"own": part_of, "other": other})
    met = met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    buckets = max(1, -(-(listed.agg(F.sum("parts").alias("n")).first()["n"] or 0) // CROSS_POSTINGS))
    met = met.withColumn("bucket", F.pmod(F.xxhash64("code", "low", "high"), F.lit(buckets)))
    columns = ["code", "label", "low", "high", "node", "size", "pos", "component"]

    def crossing(part: pd.DataFrame) -> pd.DataFrame:
        """The postings that some pair of different components needs."""
        lists = Lists(part, percent)
        wanted = np.zeros(len(part), bool)
        for x, y in lists.pairs():
            wanted[x] = wanted[y] = True
        return lists.part[columns][wanted]

    asked = materialize(met.groupBy("bucket").applyInPandas(crossing, "code long, label long, low int, high int, node long, size long, pos long, component long"), "nd-cross")
    # lists that share their least component have much the same nodes: together, each node's text goes there once; lists of a label that is too frequent, or whose nodes' sets are too large, part
    loads = asked.groupBy("label", "node").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    shares = F.greatest(F.sum("n") / CROSS_POSTINGS, F.sum("size") / CROSS_ELEMENTS)
    weights = materialize(loads.groupBy("label").agg(F.ceil(shares).cast("int").alias("shares"), shares.alias("load")), "nd-shares")
    buckets = max(1, int(np.ceil(weights.agg(F.sum("load").alias("n")).first()["n"] or 0)))
    met = asked.join(weights.drop("load"), "label").withColumn("share", F.pmod(F.xxhash64("code"), F.col("shares")))
    met = met.withColumn("bucket", F.pmod(F.xxhash64("label", "low", "high", "share"), F.lit(buckets))).select("bucket", *columns)
    needed = met.select(F.col("bucket").alias("to"), F.col("node").alias("n_node")).distinct()
    sets = needed.join(texts.select(F.col("node").alias("s_node"), "raw"), F.col("n_node") == F.col("s_node")).select("to", "s_node", "raw")

    def run(key: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return group_links(part, known, words, percent)

    return met.groupBy("bucket").cogroup(sets.groupBy("to")).applyInPandas(run, "a long, b long")


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, set_id, group_id per row: documents link at a Jaccard similarity of ``percent`` / 100 or more.

    A set is the distinct shingles of ``words`` words; with fewer words, all of them
    as one; without words (null texts too) it is empty and links with nothing.
    component_id is the least doc_id that links reach; set_id names the set
    and group_id, a set's name, all the sets that links join; both are null if the set is empty. Rows that repeat an id are
    one document each time; a null id stays alone with a null component; an empty
    table gives no rows; further columns are ignored. Sets and shingles are known by
    64-bit hashes: of n different sets, n*n/2**65 pairs are expected to be confused.
    """
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole_text(docs, text).alias("raw"))
    found = materialize(describe(source, words), "nd-sets")
    sets = found.where("block is null").select("doc_id", "n_shingles", "node")
    nodes = sets.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("size"))
    need = nodes.agg(F.sum(F.col("size") - F.ceil(percent * F.col("size") / F.lit(100)) + 1).alias("n")).first()["n"] or 0
    buckets = max(1, -(-need // BUCKET_POSTINGS))
    live = materialize(live_postings(postings(source.where("doc_id is not null"), sketch_levels(found), words, percent, buckets), percent), "nd-lists")

    # one text for each node that has a list; under an id that repeats, the text that has the node's set
    wanted = live.select("node").distinct().join(nodes, "node").select("node", F.col("least").alias("doc_id"))
    if sets.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        texts = source.join(wanted, "doc_id").select("node", "raw")
    else:
        texts = source.withColumn("node", set_names(words)("raw")).join(wanted, ["doc_id", "node"]).dropDuplicates(["doc_id", "node"]).select("node", "raw")
    texts = materialize(texts, "nd-texts")

    # leaders
    heads = live.where("node = leader")  # those of the blocks and parts of one list meet one of them
    top = heads.groupBy("code").agg(F.max(F.struct("size", "node", "pos")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = heads.join(top, "code").select("code", "node", "size", "pos", F.col("top.node").alias("leader"), F.col("top.size").alias("leader_size"), F.col("top.pos").alias("leader_pos"))
    alpha = least_overlap_column(F.col("size"), F.col("leader_size"), percent)
    # elements before the shared one may be shared too
    most = F.least(F.col("size") - F.col("pos"), F.col("leader_size") - F.col("leader_pos")) + F.least("pos", "leader_pos")
    led = live.unionByName(heads).where((F.col("node") != F.col("leader")) & (most >= alpha))
    star = materialize(overlaps(led.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), texts, words), "nd-star")
    links = star.where(linked(percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    first = connected_components(links)

    # pairs that are still apart
    placed = live.select("code", "node", "size", "pos").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("code").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    spread = F.when(F.col("elements") > CROSS_ELEMENTS, 2 * F.col("elements") / CROSS_ELEMENTS).otherwise(F.lit(0.0))  # two parts meet at a time
    several = several.where("low <> high").select("code", F.col("low").alias("label"), F.ceil(F.greatest(F.col("n") / HOT_LIST, spread)).cast("int").alias("parts"))
    apart = materialize(placed.join(several, "code"), "nd-apart")
    more = cross_links(apart, texts, words, percent)
    all_links = links.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    components = connected_components(all_links)

    names = nodes.join(components, "node").groupBy("component").agg(F.min("least").alias("name"))
    of_node = nodes.join(components, "node", "left").join(names, "component", "left").select("node", F.coalesce("name", "least").alias("component_id"), F.coalesce("component", "node").alias("group_id"))
    out = sets.join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.col("node").alias("set_id"), "group_id")


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, unchanged, that stay: of each group that links join, the document of the least id.

    Texts without words (null ones too) and rows without an id stay. Where an id has
    several texts, each set of it is a document, and the least of them by (id, set) stays;
    rows that repeat both id and set are one document and stay together.
    """
    found = materialize(link_components(docs, words, percent, text, doc_id).where("set_id is not null and doc_id is not null").select("doc_id", "set_id", "component_id", "group_id").distinct(), "nd-found")
    own = docs[doc_id].cast("long")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"))
        return docs.join(gone, own == gone.gone_id, "left_anti")
    stays = found.groupBy("group_id").agg(F.min(F.struct("doc_id", "set_id")).alias("first"))
    gone = found.join(stays, "group_id").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("set_id") != F.col("first.set_id")))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("set_id").alias("gone_set"))
    place = fresh_name(docs, "set_of_row")
    keyed = docs.withColumn(place, set_names(words)(whole_text(docs, text)))
    return keyed.join(gone, (own == gone.gone_id) & (keyed[place] == gone.gone_set), "left_anti").select(*docs.columns)
