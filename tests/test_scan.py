import random

from pyspark.sql import functions as F

from veilspan.functions.patterns import DETECTORS
from veilspan.functions.text import collapse_table_rows
from veilspan.operators import ner, scan
from veilspan.operators.detect import FULL_SPAN, detect, spans_of
from veilspan.operators.spans import drop_midword, ids_near_names, merged, redacted
from veilspan.operators.udtf import PiiSpans, register
from veilspan.plans.notes import spread, texts
from veilspan.plans.pipeline import finish, redact_documents, redact_with_model

PIECES = (
    "Beteg neve: Kovács Éva", "| név | Nagy Béla |", "Dr. Tóthné Varga Mária", "SZABÓ PÉTER Dr.", "Nagy Béla főorvos", "KISS ÉVA RÉSZÉRE", "123-456-788", "TAJ szám: 111 222 333", "NNGYK: 111222333",
    "+36 30 123 4567", "(42) 12-345-678", "a.b@c.hu", "született: 1975.03.12", "dátum: 1980-01-02", "1975 március 12.", "Petőfi utca 3/b", "1011 Budapest", "EESZT: O43048", "Nagy Béla O43048", "Kiss (36563)",
    "01-09-123456", "12345678-2-42", "Naplószám: 12072/2021", "123456789-2021-1234567", "12345", "B123456", "| egy hosszú megjegyzés | egy hosszú megjegyzés | egy hosszú megjegyzés |", "| ------------ | ------------ | ------------ |",
    "\x00", " ", " ", "\r", "\r\n", "\n", "\n", "\x0b", "\x85", " ", "-", "|", ":", "İ", "ſzül. dát", "é", "²", "x", "ő", "Ω", "中", "😀", "ﬁ", "_",
)


def samples(n=400, seed=5):
    rn = random.Random(seed)
    return ["".join(rn.choice(PIECES) + rn.choice(("", " ", " ", "\n")) for _ in range(rn.randint(0, 30))) for _ in range(n)] + ["", None]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy("doc_id").collect()]


def test_scans_equal_expressions(spark):
    df = spark.createDataFrame(list(enumerate(samples())), "doc_id long, text string").repartition(4).localCheckpoint()
    got = dict(rows(df, "doc_id", scan.scanned(F.col("text"))))
    want = dict(rows(df, "doc_id", spans_of(F.col("text"))))
    texts_ = dict(rows(df, "doc_id", "text"))
    kept = {d for d, t in texts_.items() if t is not None and scan.alike(t)}
    assert {d for d, x in got.items() if x is not None} == kept and len(kept) > 100
    assert {d: got[d] for d in kept} == {d: want[d] for d in kept}
    assert {s["ord"] // 1_000_000 for d in kept for s in got[d]} == set(range(1, len(DETECTORS) + 1))
    assert rows(df, "doc_id", scan.found(F.col("text"))) == sorted(want.items())


def test_resolved_equals_expressions(spark):
    df = spark.createDataFrame(list(enumerate(samples(seed=6))), "doc_id long, text string").withColumn("row", collapse_table_rows(F.col("text"))).repartition(4).localCheckpoint()
    step = df.withColumn("first", merged(spans_of(F.col("row")))).localCheckpoint()
    step = step.withColumn("near", ids_near_names(F.col("row"), F.col("first"))).localCheckpoint()
    step = step.withColumn("spans", merged(F.concat("first", "near"))).localCheckpoint()
    want = rows(step, "doc_id", "first", "near", "spans", redacted(F.col("row"), F.col("spans")))
    got = rows(df.select("doc_id", scan.resolved(F.col("text"), rows=True, put=True).alias("r")), "doc_id", "r.*")
    assert [w for w, g in zip(want, got, strict=True) if g[3] is not None] == [g for g in got if g[3] is not None]
    assert sum(bool(g[2]) for g in got) > 20
    assert rows(redact_documents(df.select("doc_id", "text")), "doc_id", "redacted_text", "n_spans") == [(w[0], w[4], len(w[3])) for w in want]


def test_table_function_equals_resolved(spark):
    some = [t for t in samples(60, 7) if t is not None and scan.alike(t)]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {d: [(s["start"], s["end"], s["label"], s["text"]) for s in spans] for d, spans in rows(df.select("doc_id", scan.resolved(F.col("text"))["spans"].alias("s")), "doc_id", "s")}
    one = PiiSpans()
    assert {d: list(one.eval(t)) for d, t in enumerate(some)} == got


def test_table_function_reads_batches(spark):
    """Not a Python call for each row; and the same spans as the expressions, of texts that aren't alike as well."""
    df = spark.createDataFrame([*enumerate(samples(200, 11)), (900, "TAJ: ² 111\x0b111\x0b110"), (901, "TAJ: ²")], "doc_id long, text string").repartition(4).localCheckpoint()
    register(spark)
    found = spark.sql("SELECT doc_id, s.* FROM {d}, LATERAL pii_spans(text) s", d=df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "UDTF" not in plan and "Join" not in plan
    step = df.withColumn("first", merged(spans_of(F.col("text")))).localCheckpoint()
    step = step.select("doc_id", "first", ids_near_names(F.col("text"), F.col("first")).alias("near")).localCheckpoint()
    want = step.select("doc_id", F.inline(merged(F.concat("first", "near")))).select("doc_id", "start", "end", "label", "text").collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and len(want) > 500
    assert sum(t is not None and not scan.alike(t) for t in (r["text"] for r in df.collect())) > 50


def test_one_file_is_dealt_over_tasks(spark, tmp_path):
    spark.range(2000).selectExpr("id AS doc_id", "'a' AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(2000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spread_ = texts(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") >= 1_000_000_000).alias("notes")).collect()
    assert len(spread_) >= 16 and max(r["n"] for r in spread_) < 800 and sum(r["notes"] for r in spread_) == 2000 and sum(r["n"] for r in spread_) == 4000
    assert spread(spark.range(10), "id").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_model_spans_equal_their_steps(spark):
    rn = random.Random(8)
    words = {"Anna": ("PER", 0.9), "Pécs": ("LOC", 0.8), "Ann": ("ORG", 0.7), "low": ("PER", 0.5)}
    docs = [(i, "".join(rn.choice(("Anna", "Pécs", "Ann", "low", " ", "xy", "😀")) for _ in range(n))) for i, n in enumerate((0, 1, 150, 250, 290, 300, 400, 900, 2500, 6000))] + [(99, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    columns = ["doc_id", "start", "end", "label", "text", "score", "ord"]
    want = ner.accepted(ner.entities(ner.chunks(df), lambda: ner.Gazetteer(words)), df).select(columns).collect()
    got = ner.model_spans(df, lambda: ner.Gazetteer(words))
    assert sorted(got.select(columns).collect()) == sorted(want) and len(want) > 1000
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_long_texts(spark):
    text = "".join(random.Random(9).choice("aé中😀 ") for _ in range(30000))
    got = ner.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(got) == 100 and all(r["chunk"] == text[r["pos"] : r["pos"] + 800] for r in got)


def by_joins(docs, make):
    base = docs.select("doc_id", collapse_table_rows(F.col("text")).alias("text")).localCheckpoint()
    regex = detect(base)
    both = drop_midword(base, ner.accepted(ner.entities(ner.chunks(base), make), base), regex).unionByName(regex)
    lists = both.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "text", "score", "ord")).cast(FULL_SPAN).alias("found"))
    return finish(base.join(lists, "doc_id", "left").withColumns({"found": F.coalesce("found", F.array().cast(FULL_SPAN)), "done": F.lit(None).cast(scan.RESULT)}), "doc_id")


def test_documents_one_by_one_equal_joins(spark):
    words = {"Anna": ("PER", 0.9), "Kovács Éva": ("PER", 0.95), "Budapest": ("LOC", 0.8), "Béla": ("PER", 0.71), "ov": ("ORG", 0.8), "a": ("ORG", 0.7), "Év": ("PER", 0.75)}
    rn, make = random.Random(11), lambda: ner.Gazetteer(words)
    more = ("Annának", "Annára ", "Anna", "Budapesten", "Kovács Évához", "xKovács Éva", "Béla", "Bélaé", "ÉvAnna", "\nKovács Évával")
    some = ["".join(rn.choice(PIECES + more * 3) + rn.choice(("", " ", "\n")) for _ in range(rn.randint(0, 40))) for _ in range(150)] + ["", None]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(4).localCheckpoint()
    columns = ["doc_id", "start", "end", "label", "text", "score", "ord"]
    spans = ner.model_spans(df, make).localCheckpoint()
    want = drop_midword(df, spans, detect(df)).select(columns).collect()
    assert sorted(map(repr, ner.cleaned_spans(df, make).select(columns).collect())) == sorted(map(repr, want)) and len(want) > 300
    result = ["doc_id", "redacted_text", "n_spans", F.to_json("label_counts"), "spans"]
    got, want = rows(redact_with_model(df, make), *result), rows(by_joins(df, make), *result)
    assert got == want
