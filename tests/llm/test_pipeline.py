import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_classifiers import corpus  # noqa: E402
from tests.llm.test_near_dup import shingles  # noqa: E402


@pytest.fixture
def folder(spark, frame, tmp_path):
    rnd = random.Random(9)
    rows, labels = corpus(300, seed=8)
    rows = [(i, t.replace("### ", " ") + f" token = abcdefgh{i:04} here" * (i % 10 == 0)) for i, t in rows]
    for k in range(60):
        i, t = rows[rnd.randrange(300)]
        words = t.split()
        rows.append((len(rows), t.replace(" ", "  ") if k % 2 else " ".join([*words[:-1], "changed"])))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "few words")]
    frame(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dup", "secrets", "packing"]

    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    before = text(kept)

    once = stages["exact_dedup"](spark, kept, folder)
    groups = {}
    for i, t in sorted(before.items(), key=lambda r: (-len(r[1] or ""), r[0])):
        groups.setdefault("".join((t or "").split()), i)
    assert once.columns == docs.columns and text(once) == {i: before[i] for i in groups.values()}

    apart = stages["near_dup"](spark, once, folder)
    left = text(once)
    sets = {i: shingles(t, 5) for i, t in left.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in left:
        for b in left:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert apart.columns == docs.columns and set(text(apart)) == {i for i in left if find(i) == i}

    masked = stages["secrets"](spark, apart, folder)
    assert masked.columns == docs.columns
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect()}
    assert set(out) == set(text(apart)) and all(n is None or n == len(t) for t, n in out.values())
    assert any("[SECRET] here" in (t or "") for t, _ in out.values()) and not any("token = " in (t or "") for t, _ in out.values())

    packed = stages["packing"](spark, masked, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(out)


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_odd_documents_from_end_to_end(spark, odd, tmp_path):
    """Nulls, empties, ties, repeated rows and ids, no id, a long text, columns named like those that operators use inside."""
    documents = odd.unionByName(odd.where("doc_id = 4").selectExpr("'another text of the same id' as text", "doc_id", "lang", "source", "n_chars", "fp", "block", "chunk", "rank"))
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (None, 0, 1), (7, None, None), (7, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    # the longest of the empty texts and of the three equal ones, the other text of an id, and what has no like
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())) == [(False, k) for k in (3, 4, 5, 7, 8, 9)] + [(True, 0)]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.collect()}


def test_no_documents(spark, odd, tmp_path):
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
