
import pytest
from pyspark.sql import functions as F

from panelwright.llm import near_dup, queries as llm
from panelwright.llm.common import release, shared_dir

from .test_dedup import brute_components, brute_leaks, brute_lines

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, docs, corpus, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"file://{top}/documents.parquet")
    spark.createDataFrame([(0, corpus[5][1]), (1, "not in any document at all, nowhere")], "item_id long, text string").write.parquet(f"file://{top}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.org/x", "<p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"file://{top}/pages.parquet")
    return f"file://{top}"


def test_stages_in_turn(spark, folder, corpus, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id", "text").collect()
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        seen.append((name, before, docs.collect()))
    assert [n for n, *_ in seen] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    kept = lambda i: {r["doc_id"]: r["text"] for r in seen[i][2]}
    assert set(range(60)) <= set(kept(0)) and len(kept(0)) < len({r[0] for r in corpus})
    lines = brute_lines([(r[0], r[1]) for r in seen[1][1]])
    assert kept(1) == {d: t for d, (t, n, gone) in lines.items() if not (gone and gone == n)}
    assert all(r["n_chars"] == len(r["text"]) for r in seen[1][2])
    groups = brute_components([(r[0], r[1]) for r in seen[2][1]])
    assert set(kept(2)) == {d for d, (_, _, k) in groups.items() if k}
    leaks = {d for d, *_ in brute_leaks([(r[0], r[1]) for r in seen[3][1]], [(0, corpus[5][1])])}
    assert leaks and set(kept(3)) == set(kept(2)) - leaks
    assert {r["doc_id"] for r in seen[4][2]} == set(kept(3))


def test_line_stage_takes_long_single_lines(spark):
    line = " ".join(f"w{i}" for i in range(52))
    rows = [(1, line, 999), (2, f"lead\n{line}", 999), (3, line, 999)]
    got = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "").collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got} == {1: (line, 999), 2: ("lead", 4)}


def test_near_dedup_stage_with_null_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(5, text("a")), (None, text("a")), (None, text("b")), (None, text("c")), (None, text("c") + " more"), (7, text("d")), (None, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    one = [x for x in got if x[1] and x[1].startswith("c0")]
    assert len(one) == 1 and one[0] in rows
    assert sorted(map(str, set(got) - set(one))) == sorted(map(str, [rows[0], rows[2], rows[5], rows[6], rows[7]])) and len(got) == 6
    every = near_dup.near_duplicates(df).collect()
    assert len(every) == 8 and sum(r["doc_id"] is None for r in every) == 5 and all(r["kept"] is not None for r in every) and sum(r["kept"] for r in every) == 6


def test_run_and_queries_on_whole_tables(spark, folder):
    final = corpus_pipeline.run(spark, folder)
    assert final.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and final.count() > 30
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name, query in llm.queries().items():
        got = query(spark, folder)
        assert got.count() >= (2 if name.startswith(("op5", "op8")) else 1), name
        if name.startswith(("op1_", "op2_", "op3_", "op4_", "op6_", "op9_")):
            assert got.count() == n, name
    assert sorted(k.split("_")[0] for k in llm.queries()) == sorted(f"op{i}" for i in range(1, 11))


def test_shared_folder_comes_from_the_session(spark):
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) == own.rstrip("/")
    release(spark, "nothing")
