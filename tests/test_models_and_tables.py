import json
import struct

import pytest
from pyspark.sql import functions as F

from veilspan.operators import runs, tables
from veilspan.operators.ner import accepted, chunks, entities
from veilspan.operators.onnx_ner import Tagger, there
from veilspan.operators.udtf import PiiSpans, register
from veilspan.plans.pipeline import redact_documents


def field(number, value):
    """A field of a protocol buffer: a number, or bytes."""
    varint = lambda n: bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tiny_model(path, table):
    """A model that looks up each token's logits in a table: one Gather."""
    shape = lambda *dims: field(2, b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims))
    info = lambda name, kind, *dims: field(1, name) + field(2, field(1, field(1, kind) + shape(*dims)))
    data = b"".join(struct.pack("<f", x) for row in table for x in row)
    weights = field(1, len(table)) + field(1, len(table[0])) + field(2, 1) + field(8, "table") + field(9, data)
    node = field(1, "table") + field(1, "input_ids") + field(2, "logits") + field(4, "Gather")
    graph = field(1, node) + field(2, "g") + field(5, weights) + field(11, info("input_ids", 7, "b", "n")) + field(12, info("logits", 1, "b", "n", len(table[0])))
    path.write_bytes(field(1, 8) + field(7, graph) + field(8, field(2, 13)))


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers

    folder = tmp_path_factory.mktemp("ner")
    words = {"[UNK]": 0, "Teszt": 1, "Elek": 2, "Szegeden": 3, "lakik": 4, ".": 5}
    tokenizer = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(folder / "tokenizer.json"))
    (folder / "labels.json").write_text(json.dumps({"0": "O", "1": "B-PER", "2": "I-PER", "3": "B-LOC"}))
    tiny_model(folder / "model.onnx", [[9, 0, 0, 0], [0, 9, 0, 0], [0, 0, 9, 0], [0, 0, 0, 9], [9, 0, 0, 0], [9, 0, 0, 0]])
    return str(folder)


def test_onnx_tagger(spark, model):
    assert there(model) and not there(model + "/none")
    tagger = Tagger(model)
    text = "Teszt Elek Szegeden lakik. Elek, Teszt Teszt"
    got = [(e["entity_group"], e["word"], round(e["score"], 2)) for e in tagger.entities(text)]
    assert got == [("PER", "Teszt Elek", 1.0), ("LOC", "Szegeden", 1.0), ("PER", "Elek", 1.0), ("PER", "Teszt", 1.0), ("PER", "Teszt", 1.0)]
    assert tagger.count_tokens(text) == 9 and tagger.entities("") == []
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = accepted(entities(chunks(docs), lambda: Tagger(model)), docs).orderBy("start").collect()
    assert [(r["label"], r["text"]) for r in found][:2] == [("NAME", "Teszt Elek"), ("LOCATION", "Szegeden")]


def test_pii_spans_in_sql(spark):
    text = "Beteg neve: Teszt Elek (43048)\nTAJ szám: 123 456 789\nSzületési dátum: 1980. 01. 02.\nEmail: a@b.hu 😀 Telefon: +36 30 123 4567"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    register(spark)
    got = {tuple(r)[1:4] for r in spark.sql("SELECT doc_id, s.* FROM {d}, LATERAL pii_spans(text) s", d=docs).collect()}
    want = redact_documents(docs.where("doc_id = 1")).select(F.inline("spans")).select("start", "end", "label").collect()
    assert got == {tuple(r) for r in want} and len(got) >= 5
    assert list(PiiSpans().eval("semmi")) == []


def test_progress_is_observed(spark):
    files = spark.createDataFrame([("a", True, {"NAME": 2}), ("b", False, None)], "path string, ok boolean, label_counts map<string,int>")
    df, seen = runs.observed(files)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"files": 2, "failed": 1, "spans": 2}


def plain_boxes(tags):
    """Which tags have a box, and which boxes merge, tag by tag."""
    n, merges, skip, in_run, open_ = 0, {}, True, False, None
    for tag in tags:
        if not skip and tag in (*tables.CELLS, "nl", "ucel"):
            if in_run:
                merges[open_] = n
            n += 1
        if tag == "lcel":
            if not in_run:
                in_run, open_, merges[n], n = True, n, -1, n + 1
        else:
            in_run = False
        skip = tag in ("nl", "ucel", "xcel")
    return n, merges


def test_boxed_tags(spark):
    import random

    rn = random.Random(3)
    rows, want = [], {}
    for t in range(200):
        tags = [rn.choice(["fcel", "lcel", "lcel", "ecel", "ucel", "xcel", "nl", "ched"]) for _ in range(rn.randint(1, 12))]
        n, merges = plain_boxes(tags)
        want[t] = (n, {k: v if v >= 0 else n - 1 for k, v in merges.items()})
        rows += [(t, i, x) for i, x in enumerate(tags)]
    got = {t: [0, {}] for t in want}
    for r in tables.boxed_tags(spark.createDataFrame(rows, "table_id int, ord int, tag string")).collect():
        got[r["table_id"]][0] += 1
        if r["partner"] is not None:
            got[r["table_id"]][1][r["box"]] = r["partner"]
    assert {t: tuple(x) for t, x in got.items()} == want


def test_merged_boxes(spark):
    boxed = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, None), (1, 2, 2, None)], "table_id int, ord int, box int, partner int")
    boxes = spark.createDataFrame([(1, 0, 2.0, 2.0, 2.0, 2.0), (1, 1, 6.0, 3.0, 2.0, 2.0), (1, 2, 9.0, 9.0, 1.0, 1.0)], "table_id int, box int, cx double, cy double, w double, h double")
    assert sorted(map(tuple, tables.merged_boxes(boxed, boxes).collect())) == [(1, 0, 4.0, 2.5, 6.0, 3.0), (1, 2, 9.0, 9.0, 1.0, 1.0)]


def test_tag_sequences(spark):
    given = iter(["xcel", "ucel", "lcel", "nl", "xcel", "ucel", "lcel", "<end>", "fcel"])
    assert tables.decoded(lambda before: next(given), 99) == ["lcel", "ucel", "fcel", "nl", "xcel", "ucel", "fcel"] == tables.corrected_tags(["xcel", "ucel", "lcel", "nl", "xcel", "ucel", "lcel"])
    assert tables.decoded(lambda before: "fcel", 5) == ["fcel"] * 5
    images = spark.createDataFrame([(1, bytearray(b"ab")), (2, None)], "table_id int, image binary")
    make = lambda: lambda image, before: "<end>" if len(before) == len(image) else "fcel"
    assert {r["table_id"]: r["tags"] for r in tables.decode(images, make).collect()} == {1: ["fcel", "fcel"], 2: []}
    df = spark.createDataFrame([(["fcel", "ecel", "nl", "fcel", "lcel", "nl"],), (["fcel", "nl", "fcel", "fcel", "nl"],), ([],), (["fcel"],)], "t array<string>")
    got = df.select(tables.is_square(F.col("t")), tables.size_of(F.col("t")).alias("s")).select("*").collect()
    assert [r[0] for r in got] == [True, False, True, True] and [tuple(r["s"]) for r in got] == [(2, 2), (2, 1), (0, None), (0, None)]
    ids = spark.createDataFrame([([9, 0, 1, 8],), ([9],)], "t array<int>").select(tables.tag_names(F.col("t"), {"fcel": 0, "nl": 1})).collect()
    assert [r[0] for r in ids] == [["fcel", "nl"], []]


def test_synced_boxes(spark):
    html = [(1, i, t) for i, t in enumerate(["<td>", "<td", ">", "<td>"])] + [(2, 0, "<td>"), (2, 1, ">")]
    boxes = [(1, k) for k in range(5)] + [(2, 0), (2, 1)]
    got = tables.synced_boxes(spark.createDataFrame(html, "table_id int, ord int, tag string"), spark.createDataFrame(boxes, "table_id int, box int"))
    assert sorted((r["table_id"], r["box"]) for r in got.collect()) == [(1, 0), (1, 1), (1, 3), (1, 4), (2, 0), (2, 1)]


def test_crops(spark):
    rows = [(10.0, 10.0, 50.0, 50.0, 100.0, 512.0), (-9.0, -5.0, -1.0, 7.0, 100.0, 512.0), (90.0, 500.0, 300.0, 900.0, 100.5, 512.0)]
    got = tables.crops(spark.createDataFrame(rows, "l double, t double, r double, b double, page_width double, page_height double")).collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"], r["empty"]) for r in got] == [(20, 20, 100, 100, False), (0, 0, 0, 14, True), (180, 1000, 201, 1024, False)]
    assert got[0]["l_back"] == 10.0 and got[2]["r"] == 201.0


def test_model_folders_and_strings(spark):
    rows = [("/x", True, True, False), (None, True, True, False), (None, True, True, True), ("", True, False, False), (None, False, True, False)]
    df = spark.createDataFrame(rows, "o string, frozen boolean, windows boolean, legacy boolean")
    place = runs.model_dir(F.col("o"), F.col("frozen"), F.col("windows"), F.lit("/app"), F.lit("/src"), F.lit("/me"), F.col("legacy"))
    assert [r[0] for r in df.select(place).collect()] == ["/x", "/app/models", "/me/models", "/me/models", "/src/models"]
    words = F.create_map(F.lit("en.a"), F.lit("{n} of {m}"))
    said = spark.range(1).select(runs.localized(words, F.lit("hu"), F.lit("a"), {"n": F.lit(1), "m": F.lit("two")}), runs.localized(words, F.lit("hu"), F.lit("b"), {"n": F.lit(1)}))
    assert tuple(said.first()) == ("1 of two", "b")


def test_prepared_images(spark):
    import numpy as np

    from veilspan.operators.images import prepare, prepared

    image = np.random.default_rng(4).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    mean, std, size = [0.9, 0.8, 0.7], [0.2, 0.3, 0.4], 6
    got = prepared(image, mean, std, size)
    assert got.shape == (1, 3, size, size)
    for x in range(size):
        for y in range(size):
            sy, sx = (min(max((k + 0.5) * n / size - 0.5, 0), n - 1) for k, n in ((y, 5), (x, 7)))
            y0, x0 = min(int(sy), 3), min(int(sx), 5)
            fy, fx = sy - y0, sx - x0
            plain = sum(wy * wx * (image[a, b] / 255 - mean) / std for a, wy in ((y0, 1 - fy), (y0 + 1, fy)) for b, wx in ((x0, 1 - fx), (x0 + 1, fx)))
            assert np.allclose(got[0, :, x, y], plain, atol=1e-4)
    rows = [(1, 5, 7, bytearray(image.tobytes())), (2, 5, 7, None), (3, 5, 7, bytearray(b"ab"))]
    out = {r["table_id"]: r["pixels"] for r in prepare(spark.createDataFrame(rows, "table_id int, height int, width int, content binary"), mean, std, size).collect()}
    assert np.allclose(out[1], got.ravel(), atol=1e-5) and out[2] is None and out[3] is None


def test_chunks_with_too_many_tokens(monkeypatch):
    from veilspan.operators import ner

    class Letters:
        """A token for each character; entities are the capitals, each answer with the text that it saw."""

        def __init__(self):
            self.seen = []

        def count_tokens(self, text):
            return len(text)

        def entities(self, text):
            self.seen.append(text)
            return [{"entity_group": "PER", "start": i, "end": i + 1, "word": c, "score": 1.0} for i, c in enumerate(text) if c.isupper()]

    text = "".join("X" if i % 97 == 0 else "abc"[i % 3] for i in range(790))
    backend = Letters()
    found = ner.answer(backend, text)
    assert {(a, b, w) for _, a, b, w, _ in found} == {(i, i + 1, "X") for i in range(0, 790, 97)}
    assert len(backend.seen) == 2 and all(len(t) <= ner.TOKENS for t in backend.seen) and backend.seen[0][-50:] == backend.seen[1][:50]
    monkeypatch.setattr(ner, "TOKENS", 10)
    assert {a for _, a, *_ in ner.answer(Letters(), text)} == set(range(0, 790, 97))


def test_sources_by_name(spark, tmp_path):
    from veilspan.sources.files import explicit, scan_folder

    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["name"] for r in scan_folder(spark, str(tmp_path)).collect()) == ["a.pdf", "b.PDF"]
    assert [r["name"] for r in scan_folder(spark, str(tmp_path), case_sensitive=True).collect()] == ["a.pdf"]
    assert [tuple(r) for r in explicit(spark, ["z.pdf", "a.pdf"]).collect()] == [("z.pdf", 0), ("a.pdf", 1)]


def test_names_in_a_folder_with_clashes(spark):
    """Against the fold that probes each number from 2 on."""
    import random

    rn = random.Random(9)
    bases = [rn.choice(["a", "a (2)", "a (3)", "b", "b (2)"]) for _ in range(60)]
    used, want = set(), []
    for base in bases:
        name, k = base, 2
        while name in used:
            name, k = f"{base} ({k})", k + 1
        used.add(name)
        want.append(name)
    rows = [(f"p{i}", "out", b, i, True) for i, b in enumerate(bases)] + [("q", "out", "a", 99, False)]
    got = runs.unique_names(spark.createDataFrame(rows, "path string, out_dir string, base string, ord int, ok boolean")).orderBy("ord").collect()
    assert [r["name"] for r in got] == want
