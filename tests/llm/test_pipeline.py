from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import queries
from tests.llm.helpers import SF, documents, prose
from tests.llm.test_dedup import brute_windows


def test_stages_keep_columns_and_act(spark, tmp_path):
    docs = [(i, prose(i, 60), "en") for i in range(60)]
    shared, item = prose(900, 80), prose(901, 30)
    docs += [(100, docs[3][1], "en"), (101, "$$ 12", None), (102, prose(500, 40) + " " + shared, "en"), (103, prose(501, 40) + " " + shared, "en"), (104, prose(502, 40) + " " + item, "en")]
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, rows, str(tmp_path))
        assert after.columns == rows.columns, name
        after.write.parquet(f"{tmp_path}/out{k}")
        after = spark.read.parquet(f"{tmp_path}/out{k}")
        gone.append({r.doc_id for r in rows.collect()} - {r.doc_id for r in after.collect()})
        rows = after
    assert gone == [{101}, {100}, set(), {104}]
    kept = {i: t for i, t, *_ in docs if i not in (100, 101)}
    want = brute_windows(kept.items())
    assert {r.doc_id: r.text for r in rows.collect()} == {i: want[i][2] if want[i][1] else t for i, t in kept.items() if i != 104}
    assert want[103][1] >= 80
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in rows.collect()} and all(r.rate >= 0 for r in last)


def test_stages_of_odd_tables(spark, tmp_path):
    item, long = prose(950, 30), prose(951, 40_000)
    docs = [(i, prose(i, 60), "en") for i in range(30)] + [(40, None, "en"), (41, "", "en"), (42, " \n", None), (43, long, "en"), (44, long + " " + item, "en"), (None, prose(44, 50), "en"), (5, prose(5, 60), "en"), (50, "de " + prose(46, 60), None)]
    rows = documents(spark, docs)
    for name in ("starts", "ends", "gone", "doc", "kept", "__0", "__gone", "rate", "bits"):  # columns of the operators' own
        rows = rows.withColumn(name, F.lit(name))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").withColumn("doc_id", F.lit(1)).write.parquet(f"{tmp_path}/benchmark.parquet")
    # what each stage keeps of the whole table, nulls and all
    gone = {"language_id": {40, 41, 42}, "near_dedup": {44}, "substring_dedup": {44}, "decontamination": {44}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, str(tmp_path))
        assert after.columns == rows.columns, name
        found = after.collect()
        kept = [r.doc_id for r in found]
        lost = {r.doc_id for r in rows.collect()} - set(kept)
        assert lost <= gone[name] and (name == "substring_dedup" or lost == gone[name]), (name, lost)
        assert None in kept and kept.count(5) == 2, name
        assert all(r.starts == "starts" and r["__gone"] == "__gone" for r in found)
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
    assert len(last) == len(docs) and all(r.rate >= 0 for r in last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(docs) - 4


def test_every_operator_has_a_query(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_queries_run_on_the_smallest_tables(spark):
    for name in ("op1_language_id", "op7_token_counts", "op8_decontamination"):
        assert queries.QUERIES[name](spark, SF).count() > 0
