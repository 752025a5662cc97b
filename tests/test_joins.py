import random
import time

from pyspark.sql import functions as F

from veilspan.functions.text import manual_pattern, manual_redact
from veilspan.operators.tables import tokens_in_tables

BOX = "page int, l double, t double, r double, b double"


def test_tokens_in_tables_of_all_sizes(spark):
    rn = random.Random(3)
    side = lambda: rn.choice((0.0, 0.25, 1.0, 3.0, 7.5, 64.0, 1000.0, 1e16))
    tables = [(i, rn.randint(0, 2), x := rn.choice((-8.0, 0.0, 0.1, 3.3, 16.0, 50.0)), y := rn.choice((-4.0, 0.0, 0.3, 8.0)), x + side(), y + side()) for i in range(150)] + [(900, 0, 5.0, 5.0, 1.0, 1.0), (901, 0, None, 0.0, 9.0, 9.0)]
    tokens = [(i, rn.randint(0, 3), x := rn.randint(-40, 400) / 4, y := rn.randint(-40, 400) / 4, x + rn.choice((0, 1, 2)), y + 1, rn.choice(("a", "b", " "))) for i in range(400)]
    holds = lambda b, k: b[1] == k[1] and None not in b and b[2] <= (k[2] + k[4]) / 2 <= b[4] and b[3] <= (k[3] + k[5]) / 2 <= b[5]
    inside = [(b[0], k[0], k[6]) for b in tables for k in tokens if holds(b, k)]
    empty = [b[0] for b in tables if b[0] not in {x[0] for x in inside}]
    want = [x for x in inside if x[2].strip()] + [(e, -e, "cell") for e in empty]
    df = spark.createDataFrame(tables, f"table_id int, {BOX}")
    got = tokens_in_tables(df, spark.createDataFrame(tokens, f"token_id int, {BOX}, text string"), df.selectExpr("table_id", "-table_id AS token_id", "'cell' AS text"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(inside) > 1000 and len(empty) > 3
    assert "grid" not in got.columns and got.columns == ["table_id", "token_id", "text"]


def test_tokens_meet_tables_near_them_only(spark):
    df = spark.range(3000).selectExpr("id AS table_id", "1 AS page", "cast(id * 10 AS double) AS l", "0D AS t", "cast(id * 10 + 4 AS double) AS r", "4D AS b")
    tokens = spark.range(3000).selectExpr("id AS token_id", "1 AS page", "cast(id * 10 AS double) AS l", "0D AS t", "cast(id * 10 + 2 AS double) AS r", "2D AS b", "'x' AS text")
    found = tokens_in_tables(df, tokens)
    assert found.count() == 3000 and found.where("table_id <> token_id").count() == 0
    keys = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_x#" in keys and "_y#" in keys


def test_manual_values_are_looked_for_by_a_part_first(spark):
    value, rn = "Kovács-Nagy Éva", random.Random(4)
    some = ["".join(rn.choice(("Kovács", "kovacs", "NAGY", "Éva", "eva", " ", "-", ". ", "x", "Kov", "ács")) for _ in range(rn.randint(0, 12))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(some)), "id long, text string")
    p, (new, n) = manual_pattern(value), manual_redact(F.col("text"), value)
    plain = F.regexp_replace("text", p, F.lit("[REDACTED_NAME]")), F.regexp_count("text", F.lit(p))
    rows = df.select(new.alias("a"), n.alias("b"), plain[0].alias("c"), plain[1].alias("d")).collect()
    assert all((r["a"], r["b"]) == (r["c"], r["d"]) for r in rows) and sum(r["b"] or 0 for r in rows) > 100
    long = spark.range(40, numPartitions=4).select(F.concat(F.col("id").cast("string"), F.lit("orvosi vizsgálat eredménye " * 4000)).alias("text")).localCheckpoint()
    took = []
    for columns in (plain, manual_redact(F.col("text"), value)):
        began = time.time()
        assert long.select(columns[0].alias("new"), columns[1].alias("n")).where("n > 0 OR length(new) < 9").count() == 0
        took.append(time.time() - began)
    assert took[1] < took[0]
