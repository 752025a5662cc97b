import hashlib
import itertools
import json
import random
import re

from pyspark.sql import functions as F

from veilspan.functions.patterns import FULL, LOWER, UPPER, DETECTORS
from veilspan.functions.text import collapse_table_rows, manual_pattern, manual_redact, redact_filename, sanitize_log
from veilspan.operators import runs, tables
from veilspan.sources import files, sinks
from veilspan.streaming.files import queue_stream, redact_stream


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_collapse(spark):
    note = "ugyanaz a megjegyzés"
    text = f"a\r\n| {note} | {note} | {note} |\r\n| Na | Na | Na |\n| {'-' * 14} | {'-' * 14} | {'-' * 14} |"
    assert one(spark, text, collapse_table_rows) == f"a\r\n| {note} | | |\r\n| Na | Na | Na |\n| {'-' * 14} | {'-' * 14} | {'-' * 14} |"


def test_manual(spark):
    df = spark.createDataFrame([("FEKETE-Eva és éva fekete, Feketené",)], "t string")
    new, n = manual_redact(F.col("t"), "Fekete Éva")
    assert tuple(df.select(new, n).first()) == ("[REDACTED_NAME] és [REDACTED_NAME], [REDACTED_NAME]né", 3)


def test_manual_with_many_parts(spark):
    rn = random.Random(3)
    for value in ("Ana Anna Béla Cili Dóra Ede Fanni", "A B C D E F G H", "An An Ann B C D E"):
        orders = [rn.sample(p := value.split(), len(p)) for _ in range(8)]
        texts = [f"x {joint.join(o)} y" for o in orders for joint in (" ", "-", ". ", "")]
        new, n = manual_redact(F.col("t"), value)
        assert all(tuple(r) == ("x [REDACTED_NAME] y", 1) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(new, n).collect())
    # four parts: the pattern of any order against the list of all orders
    values = [" ".join(rn.choice(("A", "AB", "B", "Bá", "C")) for _ in range(4)) for _ in range(3)]
    texts = ["".join(rn.choice(("A", "AB", "B", "BÁ", "C", " ", "-", ". ", "x")) for _ in range(9)) for _ in range(200)] + [j.join(o) for v in values for o in itertools.permutations(v.split()) for j in (" ", "-", ". ", "")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for v in values:
        parts = v.split()
        ways = {j.join(o) for o in itertools.permutations(parts) for j in (" ", "-", ". ", "")} | {j.join(parts[a:b]) for a in range(4) for b in range(a + 1, 5) for j in (" ", "-")}
        listed = "(?iu)" + "|".join(re.escape(w).replace("A", "[AÁ]").replace("á", "[aá]") for w in sorted(ways, key=lambda w: (-len(w), w)))
        assert df.where(F.regexp_replace("t", manual_pattern(v), "#") != F.regexp_replace("t", listed, "#")).count() == 0


def test_tokens_in_tables(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0), (2, 1, 20.0, 0.0, 29.0, 9.0), (3, 2, 0.0, 0.0, 9.0, 9.0), (4, 2, 20.0, 0.0, 29.0, 9.0)], "table_id int, page int, l double, t double, r double, b double")
    tokens = spark.createDataFrame([(10, 1, 1.0, 1.0, 2.0, 2.0, "a"), (11, 1, 3.0, 1.0, 4.0, 2.0, " "), (12, 2, 21.0, 1.0, 22.0, 2.0, " ")], "token_id int, page int, l double, t double, r double, b double, text string")
    cells = spark.createDataFrame([(1, 30, "not"), (2, 31, "own"), (2, 32, " "), (4, 33, "not")], "table_id int, token_id int, text string")
    got = lambda *more: sorted(tuple(r) for r in tables.tokens_in_tables(boxes, tokens, *more).collect())
    assert got() == [(1, 10, "a")] and got(cells) == [(1, 10, "a"), (2, 31, "own")]


def test_filename(spark):
    field = next(p for name, _, _, p in DETECTORS if name == "name_field")
    full = rf"(?<![{UPPER}{LOWER}]){FULL}(?![{UPPER}{LOWER}])"
    name = lambda x: one(spark, x, lambda c: redact_filename(c, field, full))
    assert name("/a/Kovács Éva - Lelet.pdf") == "[REDACTED_NAME] - Lelet"
    assert name("KOVÁCS ÉVA 2026.pdf") == "[REDACTED_NAME] 2026"
    assert name("Lelet.pdf") == "Lelet"


def test_log(spark):
    assert one(spark, r"saw C:\Users\Anna\x 'Kovács lelet.PDF' vége", sanitize_log) == r"saw C:\Users\***\x XYZ.pdf' vége"
    assert one(spark, "processing Kovács Éva lelet.pdf now", sanitize_log) == "processing XYZ.pdf now"
    assert one(spark, "failed /home/anna/lelet.pdf: x", sanitize_log) == "failed /***/XYZ.pdf: x"


def test_queue(spark):
    rows = [(1, "a", "converting", None, None), (2, "a", "done", {"NAME": 2, "ADDRESS": 1, "LOCATION": 1}, None), (3, "a", "failed", {}, "boom"), (1, "b", "done", {"TAJ": 1}, None)]
    state = runs.queue_state(spark.createDataFrame(rows, "seq long, path string, stage string, counts map<string,long>, error string"))
    got = {r["path"]: r for r in state.collect()}
    assert got["a"]["status"] == "failed" and got["a"]["counts"]["NAME"] == 2 and got["a"]["error"] == "boom"
    rep = {r["path"]: r for r in runs.report(state).collect()}
    assert rep["b"]["review"] and rep["b"]["total"] == 1 and rep["a"]["names"] is None
    assert [r["path"] for r in runs.pending(state).collect()] == ["a"]


def test_unique_names(spark):
    rows = [("p1", "d", "X", 1, True), ("p2", "d", "X", 2, False), ("p3", "d", "X", 3, True), ("q1", "e", "X (2)", 1, True), ("q2", "e", "X", 2, True), ("q3", "e", "X", 3, True)]
    got = runs.unique_names(spark.createDataFrame(rows, "path string, out_dir string, base string, ord int, ok boolean"))
    assert {r["path"]: r["name"] for r in got.collect()} == {"p1": "X", "p3": "X (2)", "q1": "X (2)", "q2": "X", "q3": "X (3)"}


def test_manifest_settings_leaks(spark, tmp_path):
    data = b"weights"
    (tmp_path / "m.json").write_text(json.dumps({"models": [{"name": "ner", "files": [{"name": "a", "bytes": 7, "sha256": hashlib.sha256(data).hexdigest()}, {"name": "b", "bytes": 9, "sha256": "0"}]}]}))
    m = files.manifest(spark, str(tmp_path / "m.json"))
    listing = spark.createDataFrame([("ner", "a", 7), ("ner", "b", 8)], "model string, name string, bytes long")
    assert runs.model_status(m, listing).first().asDict() == {"model": "ner", "total_bytes": 16, "megabytes": 0, "missing": ["b"], "ready": False}
    found = spark.createDataFrame([("ner", "a", data), ("ner", "b", data)], "model string, name string, content binary")
    assert [r["name"] for r in runs.corrupt_artifacts(m, found).collect()] == ["b"]
    df = spark.createDataFrame([('{"a":"1"}',), ("{broken",), (None,)], "s string")
    assert [r["m"] for r in df.select(runs.settings(F.col("s"), {"a": "2"}).alias("m")).collect()] == [{"a": "2"}] * 3
    out = spark.createDataFrame([(1, "[REDACTED_TAJ] ok"), (2, "titok marad a@b.hu")], "doc_id long, text string")
    assert {(r["doc_id"], r["problem"]) for r in runs.leaks(out, ["Titok"]).collect()} == {(2, "no placeholder"), (2, "raw value"), (2, "left: EMAIL")}


def test_tables(spark):
    cells = spark.createDataFrame([(1, 5, 2, 1, 1), (1, 9, 2, 2, 1), (1, 5, 4, 1, 1)], "table_id int, row int, col int, row_span int, col_span int")
    assert sorted((r["row"], r["col"], r["num_rows"], r["num_cols"]) for r in tables.reindexed(cells).collect()) == [(0, 0, 3, 2), (0, 1, 3, 2), (1, 0, 3, 2)]
    assert tables.corrected_tags(["xcel", "nl", "ucel", "lcel"]) == ["lcel", "nl", "ucel", "fcel"]


def test_sources_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("b.pdf", "a.PDF", "c.txt"):
        (folder / name).write_bytes(b"x")
    assert [r["name"] for r in files.scan_folder(spark, str(folder)).orderBy("name").collect()] == ["a.PDF", "b.pdf"]

    def build():
        return lambda content: content.decode() + "!" if content else 1 / 0

    assert {r["text"] for r in files.convert(files.scan_folder(spark, str(folder)), build).collect()} == {"x!"}
    (folder / "n.md").write_text("Email: a@b.hu")
    q = redact_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first()["redacted_text"] == "Email: [REDACTED_EMAIL]"
    assert sinks.write_files(spark.createDataFrame([("n", "szöveg")], "name string, text string"), str(tmp_path / "md")).first()["bytes"] == 7


def test_state_stream(spark, tmp_path):
    schema = "seq long, path string, stage string, counts map<string,bigint>, error string"
    rows = [(1, "a", "converting", None, None), (2, "a", "done", {"NAME": 2}, None), (3, "a", "failed", None, "boom")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "events"))
    q = queue_stream(spark.readStream.schema(schema).json(str(tmp_path / "events"))).writeStream.outputMode("update").format("memory").queryName("queue_states").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    r = spark.sql("select * from queue_states").first()
    assert (r["status"], r["counts"], r["error"]) == ("failed", {"NAME": 2}, "boom")
