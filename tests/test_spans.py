import random

from pyspark.sql import functions as F

from veilspan import queries
from veilspan.functions.text import find_all
from veilspan.operators.detect import FULL_SPAN
from veilspan.operators.ner import TAGGED, Gazetteer, accepted, bio_entities, bio_of, chunks, entities
from veilspan.operators.spans import components, drop_midword, merge_spans, merged, ordered_counts
from veilspan.plans.notes import texts as texts_of
from veilspan.plans.pipeline import redact_with_model

SPAN = "doc_id long, start int, end int, label string, text string, score double, ord int"


def plain_merge(spans):
    out = []
    for s in sorted(spans, key=lambda x: (x[0], x[0] - x[1], x[3])):
        if out and s[0] < out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([s[0], s[1], s[2]])
    return [tuple(x) for x in out]


def test_merge_forms_agree(spark):
    rn, rows, want = random.Random(2), [], {}
    for d in range(60):
        spans = [(a := rn.randint(0, 40), a + rn.randint(1, 9), rn.choice("ABC"), i) for i in range(rn.randint(0, 9))]
        want[d] = plain_merge(spans)
        rows += [(d, a, b, x, "", None, i) for a, b, x, i in spans]
    df = spark.createDataFrame(rows, SPAN)
    got = {}
    for r in merge_spans(df).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["label"]))
    lists = df.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "text", "score", "ord")).cast(FULL_SPAN).alias("s"))
    arrays = {r["doc_id"]: [(s["start"], s["end"], s["label"]) for s in r["m"]] for r in lists.select("doc_id", merged(F.col("s")).alias("m")).collect()}
    assert got == {d: x for d, x in want.items() if x} == arrays


def test_components_split_by_other_labels(spark):
    df = spark.createDataFrame([(1, 0, 3, "NAME", "", 1.0, 0), (1, 3, 5, "NAME", "", 1.0, 1), (1, 4, 6, "LOCATION", "", 1.0, 2), (1, 5, 7, "NAME", "", 1.0, 3)], SPAN)
    assert [r["component"] for r in components(df).orderBy("ord").collect()] == [1, 1, 2, 3]


def test_midword(spark):
    text = "Parathormon Budapesten Kovácsné Éva Pétery"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ner = [(1, 3, 6, "NAME", "ath", 0.9, 0), (1, 12, 20, "LOCATION", "Budapest", 0.9, 1), (1, 27, 33, "NAME", "csné É", 0.8, 2)]
    got = drop_midword(docs, spark.createDataFrame(ner, SPAN), spark.createDataFrame([], SPAN))
    assert sorted((r["text"], r["label"]) for r in got.collect()) == [("Budapesten", "LOCATION"), ("Kovácsné Éva", "NAME")]
    covered = spark.createDataFrame([(1, 12, 25, "ADDRESS", "", None, 0)], SPAN)
    assert [r["text"] for r in drop_midword(docs, spark.createDataFrame(ner[1:2], SPAN), covered).collect()] == []


def test_chunks_and_entities(spark):
    docs = spark.createDataFrame([(1, "x" * 2000), (2, ""), (3, None), (4, "a" * 595 + " Anna " + "b" * 300)], "doc_id long, text string")
    assert sorted((r["pass"], r["pos"]) for r in chunks(docs).where("doc_id = 1").collect()) == [(1, 0), (1, 600), (1, 1200), (1, 1800), (2, 300), (2, 900), (2, 1500)]
    assert chunks(docs).where("doc_id in (2, 3)").count() == 0
    words = {"Anna": ("PER", 0.9), "aaaa": ("LOC", 0.5)}
    got = accepted(entities(chunks(docs.where("doc_id = 4")), lambda: Gazetteer(words)), docs).collect()
    assert [(r["start"], r["label"]) for r in got] == [(596, "NAME")]
    assert "[REDACTED_NAME]" in redact_with_model(docs.where("doc_id = 4"), lambda: Gazetteer(words)).first()["redacted_text"]


def test_bio(spark):
    rows = [(1, 1, 0, 3, "B-PER", 0.5), (1, 2, 4, 7, "I-PER", 1.0), (1, 3, 7, 7, "O", 0.0), (1, 4, 8, 9, "I-PER", 0.9), (1, 5, 12, 14, "I-PER", 0.4), (1, 6, 15, 16, "O", 0.1)]
    got = bio_entities(spark.createDataFrame(rows, "doc_id long, tok int, start int, end int, tag string, score double")).orderBy("start").collect()
    assert [(r["start"], r["end"], round(r["score"], 3)) for r in got] == [(0, 9, 0.8), (12, 14, 0.4)]


def test_bio_of_lists_equals_tables(spark):
    rn = random.Random(3)
    tags = ("B-PER", "I-PER", "I-PER", "I-PER", "I-LOC", "I-LOC", "B-LOC", "O", "I-", "", None)
    rows = []
    for doc in range(300):
        at = 0
        for tok in range(rn.randint(1, 40)):
            start, end = at + rn.randint(0, 2), 0
            end = at = start + rn.randint(0, 5)
            rows.append((doc, tok, start, end if rn.random() < 0.97 else None, rn.choice(tags), rn.choice((None, 0.125, 0.5, 1.0))))
    tokens = spark.createDataFrame(rows, "doc_id long, tok int, start int, end int, tag string, score double").repartition(4, "doc_id").localCheckpoint()
    lists = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok", "start", "end", "tag", "score"))).alias("ts")).select("doc_id", F.transform("ts", lambda t: F.struct(t["start"], t["end"], t["tag"], t["score"])).cast(TAGGED).alias("ts"))
    lists = lists.union(spark.createDataFrame([(900, None), (901, [])], f"doc_id long, ts {TAGGED}"))
    got = lists.select("doc_id", F.inline(bio_of(F.col("ts")))).collect()
    key = lambda r: (r["doc_id"], r["start"], r["end"], r["entity_group"], r["n_tokens"], r["score"] or 0.0)
    want = bio_entities(tokens).select("doc_id", "entity_group", "start", "end", "score", "n_tokens").collect()
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 2000 and any(r["n_tokens"] > 3 for r in want) and any(r["score"] is None for r in want)


def test_bio_query_shuffles_no_tokens(spark, tmp_path):
    texts = [(1, "Anna Maria Kiss 12 Elek  Bea"), (2, None), (3, ""), (4, "😀 Dora\ufdd0Ede Fanni\x00Geza 7")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(40).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    done = queries.bio_entities(spark, str(tmp_path))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    found = texts_of(spark, str(tmp_path)).select("doc_id", F.posexplode(find_all(F.col("text"), queries.TOKEN)).alias("at", "m")).selectExpr("doc_id", "at + 1 AS tok", "m.start AS start", "m.end AS end", "m.text AS word")
    want = bio_entities(found.withColumn("tag", F.expr(queries.TAG)).withColumn("score", (F.col("tok") % 8) / F.lit(8.0)))
    assert done.dtypes == want.dtypes and sorted(map(tuple, done.collect())) == sorted(map(tuple, want.collect())) and want.count() > 200
    assert done.where("doc_id = 1").count() == 5


def test_ordered_counts(spark):
    df = spark.createDataFrame([([("B",), ("A",), ("A",), ("C",)],)], "s array<struct<label:string>>")
    assert [(x["n"], x["label"]) for x in df.select(ordered_counts(F.col("s")).alias("c")).first()["c"]] == [(2, "A"), (1, "B"), (1, "C")]
