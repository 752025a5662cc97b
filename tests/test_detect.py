import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilspan.functions.arrays import before_each, between, in_pieces
from veilspan.functions.text import GROUP, MARK, find_all
from veilspan.operators.detect import detect
from veilspan.plans.pipeline import redact_documents

#: (text, label, found) - one span each, or None where nothing may be found
CASES = [
    ("TAJ szám: 123 456 789", "TAJ", "123 456 789"),
    ("Azonosító 123456788 vége", "TAJ", "123456788"),
    ("Azonosító 123456789 vége", None, None),
    ("NNGYK: 123456788", None, None),
    ("Hívja: +36 30 123 4567", "PHONE", "+36 30 123 4567"),
    ("Mobil 30/482-7035 nappal", "PHONE", "30/482-7035"),
    ("tel (42) 12-345-678", "PHONE", "(42) 12-345-678"),
    ("😀 írj: a.b@example.hu", "EMAIL", "a.b@example.hu"),
    ("Születési dátum: 1980. 01. 02", "DATE_OF_BIRTH", "1980. 01. 02"),
    ("Vizsgálat dátuma: 2026. 07. 05", None, None),
    ("Született 1975 március 12", "DATE_OF_BIRTH", "1975 március 12"),
    ("Szül. hely\nDebrecen, 1997.10.22", "DATE_OF_BIRTH", "1997.10.22"),
    ("lakik: Petőfi utca 12", "ADDRESS", "Petőfi utca 12"),
    ("4032 Debrecen", "ADDRESS", "4032 Debrecen"),
    ("Beteg neve: Kovács Éva", "NAME", "Kovács Éva"),
    ("| Páciens neve | Nagy Béla | x |", "NAME", "Nagy Béla"),
    ("Megnevezés Alma", None, None),
    ("dr. Kui", "NAME", "Kui"),
    ("Dr.Homonai\n\nCsontszerkezeti", "NAME", "Homonai"),
    ("Kis Éva Optometrista", "NAME", "Kis Éva"),
    ("Konzulens orvos", None, None),
    ("KOVÁCS ÉVA részére", "NAME", "KOVÁCS ÉVA"),
    ("EESZT: O43048", "DOCTOR_ID", "O43048"),
    ("Mária (azonosító: 220756)", "DOCTOR_ID", "220756"),
    ("cég 01-09-123456", "COMPANY_ID", "01-09-123456"),
    ("adó 12345678-9-42", None, None),
    ("Naplószám: 12072/2021", "RECORD_ID", "12072/2021"),
    ("Munkaszám: 5 5 0 0", "RECORD_ID", "5 5 0 0"),
    ("Sorszám: 1", None, None),
    ("irat 123456789-2021-1234567", "RECORD_ID", "123456789-2021-1234567"),
]


def test_detectors(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    found = {}
    for r in detect(docs).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for i, (text, label, want) in enumerate(CASES):
        got = found.get(i, [])
        assert all(text[r["start"] : r["end"]] == r["text"] for r in got), text
        assert (not got) if label is None else (label, want) in [(r["label"], r["text"]) for r in got], (text, got)


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a@b.hu")], "doc_id long, text string")
    assert [(r["doc_id"], r["text"]) for r in detect(docs).collect()] == [(None, "a@b.hu")]
    out = {r["doc_id"]: r for r in redact_documents(docs).collect()}
    assert out[1]["redacted_text"] is None and out[2]["redacted_text"] == "" and out[None]["redacted_text"] == "[REDACTED_EMAIL]"
    assert redact_documents(docs.where("doc_id = 9")).count() == 0


def test_document_keeps_what_is_clinical(spark):
    text = "Beteg neve: Teszt Elek\nTAJ szám: 123 456 789\nSzületési dátum: 1980. 01. 02.\nVizsgálat dátuma: 2026. 07. 05.\nEmail: teszt@example.hu\nTelefon: +36 30 123 4567\n| Na | 140 | mmol/l | ok |"
    out = redact_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    for gone in ("Teszt Elek", "123 456 789", "1980", "example.hu", "+36"):
        assert gone not in out["redacted_text"]
    for kept in ("2026. 07. 05.", "| Na | 140 | mmol/l | ok |", "[REDACTED_DOB]"):
        assert kept in out["redacted_text"]
    assert out["label_counts"] == {"NAME": 1, "TAJ": 1, "DATE_OF_BIRTH": 1, "EMAIL": 1, "PHONE": 1}


@pytest.mark.parametrize(("text", "want"), [("(43048) Fekete Éva Dr. ma", "([REDACTED_DOCTOR_ID]) [REDACTED_NAME] Dr. ma"), ("43048 " + "x" * 80 + " Fekete Éva Dr. ma", "43048 " + "x" * 80 + " [REDACTED_NAME] Dr. ma")])
def test_numbers_near_names(spark, text, want):
    assert redact_documents(spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("text", F.col("text"))).first()["redacted_text"] == want


def test_find_all_against_plain_search(spark):
    rn = random.Random(5)
    texts = ["".join(rn.choice(["ab", "a1", " ", "😀", "é", "7", "12", MARK, GROUP, "\n"]) for _ in range(rn.randint(0, 400))) for _ in range(60)] + ["", "12" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for where, pattern in (("whole", r"[a-z]*[0-9]+"), ("tail", r"[a-z]+([0-9]+)"), ("head", r"([a-z]+)[0-9]+")):
        got = {r["i"]: [tuple(x) for x in r["f"]] for r in df.select("i", find_all(F.col("t"), pattern, where).alias("f")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [(*m.span(where != "whole"), m[where != "whole"]) for m in re.finditer(pattern, t)], (where, t)


def test_places_in_arrays_and_pieces(spark):
    rn = random.Random(6)
    lists = [[rn.randint(0, 99) for _ in range(n)] for n in (0, 1, 63, 64, 65, 128, 1000)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    got = df.select("x", before_each(F.col("x"), F.lit(0), lambda a, b: a + b).alias("s")).collect()
    assert len(got) == len(lists) and all(list(r["s"]) == [sum(r["x"][:i]) for i in range(len(r["x"]))] for r in got)
    text = "".join(rn.choice("abcdé😀") for _ in range(13_000))
    cuts = [(0, 0), (0, 13_000), (4095, 2), (4096, 4096), (100, 9000), (12_999, 1), (13_000, 5), (8191, 1)]
    df = spark.createDataFrame([(text, a, n) for a, n in cuts], "t string, a int, n int")
    assert [r[2] for r in df.select("a", "n", between(in_pieces(F.col("t")), F.col("a"), F.col("n"))).collect()] == [text[a : a + n] for a, n in cuts]


def test_long_text_takes_time_in_proportion(spark):
    text = "Beteg neve: Kovács Éva és TAJ szám: 123 456 789, Tel: +36 30 123 4567, semmi más nincs itt ma.\n" * 11_000
    began = time.time()
    out = redact_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out["n_spans"] == 33_000 and len(text) > 1_000_000 and time.time() - began < 60
    assert out["redacted_text"].startswith("Beteg neve: [REDACTED_NAME] és TAJ szám: [REDACTED_TAJ], Tel: [REDACTED_PHONE], semmi")


@pytest.mark.parametrize(("text", "want"), [("Budapest1138 Budapest", None), ("Petőfi utca12", "[REDACTED_ADDRESS]"), ("Alulírott Nagy Béla kijelentem", "Alulírott [REDACTED_NAME] kijelentem")])
def test_more_probes(spark, text, want):
    assert redact_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["redacted_text"] == (want or text)
