"""A fixture of medical notes, made from `customer` by one SQL expression that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("Kovács Éva", "Nagy Béla", "Szabó-Kiss Péter", "Tóthné Varga Mária", "Horváth László")
CAPS = ("KOVÁCS ÉVA", "NAGY BÉLA", "SZABÓ PÉTER")
CITIES = ("Budapest", "Debrecen", "Szeged")
STREETS = ("Petőfi utca", "Kossuth tér", "Ady fasor")
#: Ids of notes in the union with documents begin here.
FIRST = 1_000_000_000


def pick(options: tuple[str, ...], n: int | None = None) -> str:
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options))
    return f"(CASE c_custkey % {n or len(options)} {cases} ELSE '' END)"


def quoted(*words: str) -> tuple[str, ...]:
    return tuple(f"'{w}'" for w in words)


def padded(number: str, width: int) -> str:
    return f"lpad(cast({number} AS string), {width}, '0')"


BASE = padded("(c_custkey * 7919 + 12345678) % 100000000", 8)
CHECK = " + ".join(f"{w} * cast(substr({BASE}, {i + 1}, 1) AS int)" for i, w in enumerate((3, 7, 3, 7, 3, 7, 3, 7)))
NUMBER = f"{BASE} || cast(({CHECK} + (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END)) % 10 AS string)"
TAJ = f"substr({NUMBER}, 1, 3) || '-' || substr({NUMBER}, 4, 3) || '-' || substr({NUMBER}, 7, 3)"
DATE = f"'19' || {padded('50 + c_custkey % 45', 2)} || '.' || {padded('1 + c_custkey % 12', 2)} || '.' || {padded('1 + c_custkey % 28', 2)}"
NAME, OTHER = pick(quoted(*NAMES)), f"(CASE WHEN c_custkey % 2 = 0 THEN '{NAMES[1]}' ELSE '{NAMES[4]}' END)"
LINES = (
    pick((f"'Beteg neve: ' || {NAME}", f"'| Páciens neve | ' || {NAME} || ' | adat |'", "'Neve nincs megadva'", f"'Anyja neve ... ' || {NAME}")),
    pick((f"'TAJ szám: ' || {TAJ}", f"'Azonosító ' || {TAJ}", f"'NNGYK: ' || {TAJ}", f"'Szám ' || {TAJ} || ' vége'")),
    pick((f"'Születési dátum: ' || {DATE}", f"'Vizsgálat dátuma: ' || {DATE}", "'Született: 1975 március 12.'", f"'Szül. hely' || chr(10) || 'Debrecen, ' || {DATE}", f"'Készült: ' || {DATE}")),
    pick(tuple(f"'Cím: {1000 + 7 * i} {c}, {s} {i + 3}/b'" for i, (c, s) in enumerate(zip(CITIES, STREETS, strict=True)))),
    pick(quoted("Telefon: +36 30 123 4567", "Mobil: 30/482-7035", "Vezetékes: (42) 12-345-678", "Mellék: 42 / 123-4567 / 12", "Telefon nincs")),
    pick(("'Email: user' || cast(c_custkey AS string) || '@example.hu'", "'Email: nincs @ jel'")),
    pick((f"'Dr. ' || {OTHER} || ' (36563)'", f"'Kérem ' || {OTHER} || ' Dr. O43048'", f"{OTHER} || ' szakorvos, (azonosító: 220756)'", f"'Aláíró: ' || {OTHER} || ' O43048'", f"'  ' || {OTHER} || ' rezidens'")),
    pick(tuple(f"'{c} részére'" for c in CAPS)),
    pick(quoted("EESZT: O43048", "EESZT (12345", "EESZT nincs")),
    pick(quoted("Cég: 01-09-123456", "Adó: 12345678-2-42", "Adó: 12345678-9-42")),
    pick(quoted("Naplószám: 12072/2021", "Sorszám: 1", "Munkaszám: 5 5 0 0", "Védettségi igazolvány száma: V14639234", "Irat: 123456789-2021-1234567")),
    pick(quoted("| megjegyzés a lelethez | megjegyzés a lelethez | megjegyzés a lelethez |", "| Na | 140 | mmol/l |", "| ---------------- | ---------------- | ---------------- |")),
    pick(quoted("Eredmény negatív", "Kontroll 2026 Eredmény", "Epistaxis miatt")),
)
TEXT = " || chr(10) || ".join(LINES)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt over all cores: a file with one row group is one task, however many rows it has.

    Ids of notes are dealt before their texts are made of them.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a note for each customer."""
    ids = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    return ids.select((F.col("c_custkey") + FIRST).alias("doc_id"), F.expr(TEXT).alias("text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all notes."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").unionByName(notes(spark, sf_dir))


NOTES_SQL = f"SELECT c_custkey + {FIRST} AS doc_id, {TEXT} AS text FROM customer"
TEXTS_SQL = f"SELECT doc_id, text FROM documents UNION ALL {NOTES_SQL}"
