from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline as P
from codequarry.llm import common
from codequarry.llm.decontaminate import decontaminate
from codequarry.llm.line_dedup import line_dedup
from codequarry.llm.ngram_join import ngram_join
from codequarry.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = P.toxicity(spark, docs, SF)
    bad = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad
    left = P.lines(spark, docs, SF)
    texts = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert left.columns == columns and all(r.text == texts[r.doc_id].text and r.n_chars == len(r.text) for r in left.collect())
    assert {i for i, r in texts.items() if not r.n_removed} <= {r.doc_id for r in left.select("doc_id").collect()}
    one = P.near_copies(spark, docs, SF)
    classes = {r.class_id for r in ngram_join(docs).collect()}
    assert one.columns == columns and sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(classes)
    clean = P.benchmark(spark, docs, SF)
    leaks = decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    assert clean.columns == columns and clean.count() == docs.count() - leaks


def test_run_is_the_chain(spark):
    mix = P.run(spark, SF)
    assert set(mix.columns) >= {"doc_id", "text", "source", "taken", "epochs"} and mix.where("taken <= 0").count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in P.near_copies(spark, docs, SF).collect()) == ["1", "None"]


def test_one_row_of_each_class_stays_whatever_its_id(spark):
    words = lambda k, n=60: [f"{k}{i}" for i in range(n)]
    near = lambda k, i: " ".join([*words(k)[:-1], f"end{i}"])
    rows = [(None, near("p", 1)), (None, near("p", 2)), (None, near("q", 1)), (2, near("q", 2)), (None, near("q", 3)), (5, near("a", 1)), (5, near("b", 1)), (3, near("b", 2)), (8, near("c", 1)), (8, near("c", 2)), (8, ""), (9, near("a", 2))]
    rows += [(None, near("r", 1)), (None, near("r", 1)), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, (r.text or "-")[:1]) for r in P.near_copies(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted([(None, "p"), (2, "q"), (5, "a"), (3, "b"), (8, "c"), (8, "-"), (None, "r"), (6, "-")], key=str)


def test_stages_take_nulls_extra_columns_and_nothing(spark, docs, crowd):
    odd = crowd(docs).withColumn("first", docs.text)
    for name, stage in P.STAGES:
        got = stage(spark, odd, SF)
        assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(got.columns) and got.count() <= docs.count(), name
        assert stage(spark, odd.where("false"), SF).count() == 0, name
    assert P.lines(spark, odd, SF).where("doc_id = 7").count() == 1 and P.toxicity(spark, odd, SF).where("text is null").count() == 1


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_tables_are_written_by_few_tasks(spark, many_partitions):
    docs, since = spark.read.parquet(f"{SF}/documents.parquet"), len(common._WRITTEN)
    for _, stage in P.STAGES:
        docs = common.materialize(stage(spark, docs, SF), "stage")
    files = Counter()
    for path in common._WRITTEN[since:]:
        files[Path(path).name.rsplit("-", 1)[0]] += len([*Path(path.removeprefix("file:")).glob("part-*")])
    assert files.pop("model") and len(files) > 20 and sum(files.values()) < 400, files


def test_few_partitions_for_few_documents(spark):
    parts = lambda df: df.rdd.getNumPartitions()
    rows, cores = spark.range(0, 100, 1, 40), spark.sparkContext.defaultParallelism
    assert [parts(common.few(rows, n, 10)) for n in (0, 10 * cores, 10 * cores + 1, 250, 1_000_000)] == [cores, cores, cores + 1, 25, 40]


def test_workers_are_sent_few_texts_at_once(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"])

    usual = spark.conf.get(common._BATCH)
    found = common.materialize(spark.range(0, 5_000, 1, 1).mapInArrow(sizes, "n long"), "sizes", common.TEXTS_A_BATCH)
    assert {r.n for r in found.collect()} == {common.TEXTS_A_BATCH} and spark.conf.get(common._BATCH) == usual
