import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from loomgraph.llm import near_dup
from loomgraph.llm.components import connected_components


def shingles(text, words):
    ws = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(ws[k : k + words]) for k in range(max(1, len(ws) - words + 1))} if ws else set()


def brute(rows, words, percent):
    sets = [(i, shingles(t, words)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    by_id = {}
    for k, (i, s) in enumerate(sets):
        by_id.setdefault(i, []).append((i, len(s), least.get(find(k)) if i is not None else None))
    return sorted((r for rs in by_id.values() for r in rs), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def corpus(seed, groups, size, edits, length=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, length))]
        for _ in range(rnd.randint(1, size)):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    rnd.shuffle(rows)
    return rows


def test_matches_brute_force(frame):
    for seed, edits in ((1, 3), (2, 6)):
        rows = corpus(seed, 25, 8, edits)
        assert rows_of(near_dup.link_components(frame(rows), words=4, percent=85)) == brute(rows, 4, 85)
        assert rows_of(near_dup.link_components(frame(rows))) == brute(rows, 5, 80)


def test_one_large_group_of_near_copies_and_split_lists(frame, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT_LIST", 8)
    rows = corpus(5, 3, 60, 7, length=90)
    assert rows_of(near_dup.link_components(frame(rows), words=4, percent=85)) == brute(rows, 4, 85)


def test_odd_rows(frame, odd):
    from tests.llm.conftest import ODD

    assert rows_of(near_dup.link_components(odd, words=4, percent=85)) == brute(ODD, 4, 85)
    assert near_dup.link_components(frame([])).count() == 0


def test_one_id_with_several_texts(frame, monkeypatch):
    rnd = random.Random(3)
    near = lambda words: [*words[:-1], "other"]
    bases = [[f"{b}{rnd.randrange(10**6)}" for _ in range(60)] for b in "abcdef"]
    rows = [(1, " ".join(b)) for b in bases] + [(1, None), (1, "")] + [(k, " ".join(near(b))) for k, b in enumerate(bases, 2)]
    assert rows_of(near_dup.link_components(frame(rows), words=4, percent=85)) == brute(rows, 4, 85)
    monkeypatch.setattr(near_dup, "HOT_LIST", 8)
    rows = [(i % 7, t) for i, t in corpus(9, 3, 40, 7, length=90)]
    assert rows_of(near_dup.link_components(frame(rows), words=4, percent=85)) == brute(rows, 4, 85)


def test_derived_overlaps_are_exact():
    rnd = np.random.default_rng(1)
    sets = {k: np.unique(rnd.integers(0, 60, 40).astype(np.uint64)) for k in range(12)}
    answers = near_dup.Answers(sets)
    for x in sets:
        for y in sets:
            assert answers.overlap(x, y, 0) == len(np.intersect1d(sets[x], sets[y]))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_rows_of_one_id_with_several_texts(frame):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = lambda t: t + " more"
    for rows, stay in (
        ([(5, a), (5, b), (6, near(a)), (7, near(b)), (8, c)], {(5, a), (5, b), (8, c)}),
        ([(2, near(a)), (5, a), (5, b)], {(2, near(a)), (5, b)}),
        ([(5, a), (5, near(a)), (4, None), (4, ""), (None, a)], {(4, None), (4, ""), (None, a)}),
    ):
        docs = frame(rows)
        kept = near_dup.drop_near_copies(docs)
        got = {(r["doc_id"], r["text"]) for r in kept.collect()}
        assert kept.columns == docs.columns and got >= stay
        assert len(got - stay) == (1 if (5, near(a)) in rows else 0)
    assert near_dup.drop_near_copies(frame([])).count() == 0


def test_differences_to_many_hubs_take_bounded_memory():
    rnd = np.random.default_rng(2)
    base = np.unique(rnd.integers(0, 2**63, 400).astype(np.uint64))
    sets = {k: np.unique(np.concatenate([base[rnd.random(len(base)) > 0.3], rnd.integers(0, 2**63, 120).astype(np.uint64)])) for k in range(900)}
    answers = near_dup.Answers(sets)
    tracemalloc.start()
    for hub in range(0, 900, 45):
        for x in range(0, 900, 2):
            answers.overlap(x, x + 1, hub)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    assert all(answers.overlap(x, y, 7) == len(np.intersect1d(sets[x], sets[y])) for x in range(0, 900, 90) for y in range(0, 900, 70))


def test_lists_of_large_sets_part(frame, monkeypatch):
    monkeypatch.setattr(near_dup, "CROSS_ELEMENTS", 300)
    monkeypatch.setattr(near_dup, "HELD_ELEMENTS", 100)
    monkeypatch.setattr(near_dup, "MARKED_NODES", 3)
    rows = corpus(7, 3, 60, 7, length=90)
    assert rows_of(near_dup.link_components(frame(rows), words=4, percent=85)) == brute(rows, 4, 85)


def test_links_of_a_group_join_what_all_pairs_join():
    rnd = random.Random(6)
    rows = corpus(6, 2, 60, 8, length=70)
    texts = {k: t for k, t in rows}
    near = near_dup.Shingler(4)
    sets = {k: near(t) for k, t in texts.items()}
    part = [(c, c, 0, 0, k, len(s), p, k) for k, s in sets.items() for p, c in enumerate(np.sort(s)[: len(s) - (85 * len(s) + 99) // 100 + 1].astype(np.int64).tolist())]
    rnd.shuffle(part)
    part = pd.DataFrame(part, columns=["code", "label", "low", "high", "node", "size", "pos", "component"])
    links = near_dup.group_links(part, pd.DataFrame({"s_node": list(texts), "raw": list(texts.values())}), 4, 85)

    def groups(pairs):
        of = {k: k for k in sets}
        for a, b in pairs:
            of = {k: of[a] if g == of[b] else g for k, g in of.items()}
        return {frozenset(k for k in of if of[k] == g) for g in of.values()}

    true = [(a, b) for a in sets for b in sets if a < b and 100 * len(s := np.intersect1d(sets[a], sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - len(s))]
    assert set(map(tuple, links.to_numpy().tolist())) <= set(true) and groups(links.to_numpy().tolist()) == groups(true)


def test_texts_become_strings_by_slices(monkeypatch):
    monkeypatch.setattr(near_dup, "SLICE_BYTES", 10)
    texts = ["abc", "", "éééééééé", "x" * 50, "last"]
    found = [(ids.to_pylist(), part) for ids, part in near_dup.text_slices(pa.RecordBatch.from_pydict({"doc_id": [1, 2, None, 4, 5], "raw": texts}))]
    assert found == [([1, 2, None], texts[:3]), ([4], texts[3:4]), ([5], texts[4:])]
