"""The stages of the pipeline on planted cases, each against its own input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from ledgerloom.llm import mixing, toxicity
from tests.llm.test_documents import SCHEMA, joined, pairs_linked, sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGE = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """documents and labels with toxic rows, repeated lines, copies, nulls and repeated rows."""
    rng = random.Random(12)
    rows, labels = [], []
    line = sentence(rng, 12)
    near = sentence(rng, 120).split()
    for i in range(300):
        text = sentence(rng, rng.randrange(20, 80))
        if i % 10 == 0:
            text += " vilehead and vilebrain"
        if 200 <= i < 240:
            w = list(near)
            w[rng.randrange(120)] = f"edit{i}"
            text = " ".join(w)
        if i % 7 == 0:
            text = f"{line}\n{text}"
        rows.append((i, text, "en", f"src{i % 4}" if i % 9 else None, len(text)))
        labels.append((i, 1, int(i % 10 == 0)))
    rows += [(None, None, None, None, None), (400, "", "en", "src0", 0), (401, None, None, "src1", None), (1, rows[1][1], "en", "src1", 7), (None, "x y", "en", "z", 3)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name], docs = (docs, after), after
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns(steps):
    assert all(after.columns == COLUMNS for _, after in list(steps.values())[:-1])
    assert list(steps) == [n for n, _ in pipeline.STAGES] and len(steps) == 5


def test_toxic_documents_go(spark, sf_dir, steps):
    before, after = steps["toxicity"]
    score = toxicity.scorer(toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert rows_of(after) == sorted((tuple(r) for r in before.collect() if score(r["text"]) < 0.5), key=repr)
    assert after.filter("text like '%vilehead%'").count() == 0 and after.count() >= 270


def test_repeated_lines_go(steps):
    before, after = steps["line dedup"]
    assert after.count() == before.count()
    holders = [r for r in after.collect() if r["text"] and "\n" in r["text"]]
    first = before.filter("text like '%\n%'").agg(F.max("doc_id")).first()[0]
    assert [r["doc_id"] for r in holders] == [first]
    assert all(r["n_chars"] == len(r["text"]) for r in after.filter("doc_id > 1 and text is not null and doc_id < 300").collect())


def test_one_document_of_a_group_stays(steps):
    before, after = steps["n-gram Jaccard join"]
    rows = sorted((r for r in before.collect() if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    rows = [r for i, r in enumerate(rows) if not i or rows[i - 1]["doc_id"] != r["doc_id"]]  # a repeated row
    root = joined(len(rows), pairs_linked([r["text"] for r in rows], 5, 80)[1])
    assert sorted(r["doc_id"] for r in after.collect() if r["doc_id"] is not None) == [r["doc_id"] for i, r in enumerate(rows) if root[i] == i]
    assert after.filter("doc_id between 200 and 239").count() < 10


def test_rows_are_judged_by_their_own_text(spark):
    """Ids repeated with other texts, and near copies of which some or all have no id."""
    rng = random.Random(3)
    near, alone = [sentence(rng, 60) for _ in range(3)], [sentence(rng, 60) for _ in range(4)]
    rows = [
        (5, alone[0]), (5, alone[1]), (None, alone[2]), (None, alone[3]), (5, near[0] + " tail"), (3, near[0]),
        (None, near[1]), (None, near[1] + " tail"), (None, near[1]), (None, near[2]), (9, near[2] + " tail"), (None, None), (None, ""), (8, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in STAGE["n-gram Jaccard join"](spark, docs, "").collect()]
    ours = [r for r in got if r[1] in (near[1], near[1] + " tail")]
    assert len(ours) == 1
    want = [*rows[:4], (3, near[0]), *ours, (9, near[2] + " tail"), (None, None), (None, ""), (8, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_documents_are_mixed(steps):
    before, after = steps["mixing sources to target weights"]
    want = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
    got = {(r["doc_id"], r["text"]): r["count"] for r in after.groupBy("doc_id", "text").count().collect()}
    assert got == want and max(got.values()) > 1


def test_all_tokens_are_packed(steps):
    before, after = steps["best-fit packing"]
    assert after.filter("piece = 0").count() == before.count()
    filled = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in filled) <= 2048


def test_run_equals_its_stages(spark, sf_dir, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(pipeline.run(spark, sf_dir).select(columns)) == rows_of(steps["best-fit packing"][1].select(columns))


def test_clashing_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    wide = docs
    for name in ("row", "size", "copies", "copy", "score", "n_lines", "n_dropped", "kept", "unnamed", "_row", "_q"):
        wide = wide.withColumn(name, F.lit("clash"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns and out.filter("size <> 'clash' or n_lines <> 'clash' or row <> 'clash'").count() == 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert STAGE["best-fit packing"](spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("stage", sorted(STAGE))
def test_stages_send_small_batches_to_the_workers(spark, sf_dir, stage):
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    try:
        STAGE[stage](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
        got = spark.range(0, 5000, 1, 1).mapInArrow(rows, "n long").collect()
    finally:
        spark.conf.unset(key)
    assert sum(r["n"] for r in got) == 5000 and max(r["n"] for r in got) <= pipeline.BATCH_ROWS
