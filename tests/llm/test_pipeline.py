import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rn = random.Random(11)
    text = lambda n: " ".join(f"w{rn.randint(0, 999)}" for _ in range(n))
    item, copied = text(60), text(150)
    rows = [(i, text(80) + (" grumpf" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(300, copied), (301, copied), (302, copied + " end"), (400, text(30) + " " + item + " " + text(30)), (500, text(40) + " token = abcdefabcdefabcdef12"), (600, None), (601, ""), (None, text(20))]
    docs = [(i, t, "en", ["a", "b", None][k % 3], len(t or "")) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kind, ids = docs.dtypes, lambda d: sorted((r["doc_id"] for r in d.select("doc_id").collect()), key=lambda x: (x is None, x))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        kept[name] = ids(docs)
        assert docs.dtypes[: len(kind)] == kind and (name == "mixing") == (len(docs.columns) > len(kind))
        if name == "secrets":
            assert next(r["text"] for r in docs.collect() if r["doc_id"] == 500).endswith(" [SECRET_ASSIGN]")
    clean = [i for i in range(200) if i % 4]
    assert kept["toxicity"] == [*clean, 300, 301, 302, 400, 500, 600, 601, None]
    assert kept["near_duplicates"] == [*clean, 300, 400, 500, 600, None]
    assert kept["decontamination"] == kept["secrets"] == kept["mixing"] == [*clean, 300, 500, 600, None]


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
