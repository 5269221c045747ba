"""The pipeline's stages against brute force on what each one was given."""

import corpus_pipeline as P
import pytest
from test_ops import ODD, base_secrets, dropped_lines, linked, shingle_set, table

from tallyspark.llm.bpe import BLANKS, Ranks, codec


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas())
        out.append(docs.toPandas())
    return out


def texts(frame):
    return dict(zip(frame["doc_id"], frame["text"].fillna(""), strict=True))


def test_stages(steps):
    start, good, lines, near, clean, packed = steps
    assert all(set(x.columns) == set(start.columns) for x in steps[1:-1])
    assert 0.5 * len(start) < len(good) < len(start)
    assert texts(lines) == dropped_lines(texts(good))
    sets = {i: shingle_set(t, 5) for i, t in texts(lines).items()}
    assert set(near["doc_id"]) == {i for i, c in linked(sets, 80).items() if i == c}
    assert set(clean["doc_id"]) == set(near["doc_id"]) and not any(base_secrets(t) for t in texts(clean).values())
    assert all(texts(clean)[i] == t for i, t in texts(near).items() if texts(clean)[i].count("[SECRET]") == 0)
    encoder = codec(pytest.importorskip("public_tokenizers").path(P.VOCABULARY))
    assert packed.groupby("doc_id")["size"].sum().to_dict() == {i: len(encoder.encode(t)) // 4 for i, t in texts(clean).items()}


STAGES = [name for name, _ in P.STAGES]


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_odd_rows(spark, sf_dir, name):
    """Nulls, empty and very long texts, ties, repeated rows and ids, and columns with clashing names."""
    stage = dict(P.STAGES)[name]
    docs = table(spark, [*ODD, (None, None), (11, "A b C d e f g h i j")])
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = stage(spark, docs, sf_dir)
    if name == "packing":
        assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {i for i, _ in before}
        return
    assert out.columns == docs.columns
    after = [(r["doc_id"], r["text"]) for r in out.collect()]
    if name == "quality":
        assert not [r for r in after if r not in before] and all(after.count(r) in (0, before.count(r)) for r in set(before))
    elif name == "lines":
        changed = {6: "and more", 7: "öther text", 11: ""}
        assert sorted(map(str, after)) == sorted(str((i, changed.get(i, t))) for i, t in before)
    elif name == "near duplicates":
        assert sorted(map(str, after)) == sorted(str(r) for r in before if r[0] != 11)
    else:
        assert len(after) == len(before) and [r for r in map(str, after) if "[SECRET]" in r] and all(r in before for r in after if r[0] != 12)


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_an_empty_table(spark, sf_dir, name):
    out = dict(P.STAGES)[name](spark, table(spark, []), sf_dir)
    assert out.count() == 0 and (name == "packing" or "text" in out.columns)


def test_little_memory_stays_in_workers(spark, sf_dir):
    """A worker has one copy of the vocabulary unless a text needs the other library; stages share executors, so their batches are small."""
    r = Ranks(pytest.importorskip("public_tokenizers").path(P.VOCABULARY), True)
    assert r.count("two words") == 2 and "library" not in vars(r)
    assert r.count(long := "a" + " " * BLANKS + "b") == len(r.library.encode(long, add_special_tokens=False).ids)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(2)
    try:
        for _, stage in P.STAGES:
            spark.conf.set(key, str(64 << 20))
            stage(spark, docs, sf_dir)
            assert int(spark.conf.get(key)) <= 1 << 20
    finally:
        spark.conf.set(key, before)
