"""Queries over table structure, files and settings, and their SQL; queries.py takes them in."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.patterns import DETECTORS, FULL, LOWER, UPPER
from .functions.text import manual_files, redact_filename
from .operators import ner, runs, tables
from .plans.notes import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A tag sequence for each order: one tag for each line number that it has.
TAGS = ("fcel", "lcel", "ecel", "ucel", "nl", "xcel", "lcel", "ched")
TAG = "CASE p % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TAGS)) + " END"
LINES = """SELECT l_orderkey AS table_id, l_linenumber AS ord, max(l_partkey) AS p, cast(max(l_quantity) AS double) AS q, cast(max(l_suppkey) AS double) AS s
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""
TAGS_SQL = f"SELECT table_id, ord, {TAG} AS tag FROM ({LINES})"
#: As many boxes as an order has tags, numbered from 0.
BOXES_SQL = f"""SELECT table_id, cast(row_number() OVER (PARTITION BY table_id ORDER BY ord) - 1 AS int) AS box, q AS cx, s AS cy, q / 4 AS w, s / 8 + 1 AS h
  FROM ({LINES})"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("ord"))
    return found.agg(F.max("l_partkey").alias("p"), F.max("l_quantity").cast("double").alias("q"), F.max("l_suppkey").cast("double").alias("s"))


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("table_id", "ord", F.expr(TAG).alias("tag"))


def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = "cast(row_number() OVER (PARTITION BY table_id ORDER BY ord) - 1 AS int) AS box"
    return lines(spark, sf_dir).selectExpr("table_id", number, "q AS cx", "s AS cy", "q / 4 AS w", "s / 8 + 1 AS h")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tag_rows(spark, sf_dir).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("ord", "tag"))).alias("t"))
    return found.select("table_id", F.transform("t", lambda x: x["tag"]).alias("tags"))


SEQUENCES_SQL = f"SELECT table_id, list(tag ORDER BY ord) AS tags FROM ({TAGS_SQL}) GROUP BY table_id"
CELLS = "('" + "', '".join(tables.CELLS) + "')"
BOXED_SQL = f"""SELECT table_id, ord, cast(box AS int) AS box, cast(CASE WHEN NOT run THEN NULL WHEN after IN {CELLS} OR after IN ('nl', 'ucel') THEN box + 1 ELSE n - 1 END AS int) AS partner FROM (
  SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY ord) - 1 AS box, count(*) OVER (PARTITION BY table_id) AS n FROM (
    SELECT *, tag = 'lcel' AND (last IS NULL OR last <> 'lcel') AS run, (tag IN {CELLS} OR tag IN ('nl', 'ucel')) AND last NOT IN ('nl', 'ucel', 'xcel') AS cell FROM (
      SELECT *, lag(tag) OVER (PARTITION BY table_id ORDER BY ord) AS last,
        (SELECT arg_min(b.tag, b.ord) FROM ({TAGS_SQL}) b WHERE b.table_id = a.table_id AND b.ord > a.ord AND b.tag <> 'lcel') AS after FROM ({TAGS_SQL}) a)) WHERE run OR cell)"""


@query(BOXED_SQL)
def table_boxed_tags(spark, sf_dir):
    return tables.boxed_tags(tag_rows(spark, sf_dir))


@query(f"""WITH k AS ({BOXED_SQL}), b AS ({BOXES_SQL}),
  j AS (SELECT x.table_id, x.box, x.cx, x.cy, x.w, x.h, y.cx AS cx2, y.cy AS cy2, y.w AS w2, y.h AS h2 FROM b x LEFT JOIN k ON k.table_id = x.table_id AND k.box = x.box AND k.partner IS NOT NULL
    LEFT JOIN b y ON y.table_id = x.table_id AND y.box = k.partner WHERE NOT EXISTS (SELECT 1 FROM k c WHERE c.table_id = x.table_id AND c.partner = c.box + 1 AND c.partner = x.box))
  SELECT table_id, box, CASE WHEN cx2 IS NULL THEN cx ELSE cx - w / 2 + (cx2 + w2 / 2 - (cx - w / 2)) / 2 END AS cx,
    CASE WHEN cx2 IS NULL THEN cy ELSE least(cy - h / 2, cy2 - h2 / 2) + (cy2 + h2 / 2 - (cy - h / 2)) / 2 END AS cy,
    CASE WHEN cx2 IS NULL THEN w ELSE cx2 + w2 / 2 - (cx - w / 2) END AS w, CASE WHEN cx2 IS NULL THEN h ELSE cy2 + h2 / 2 - (cy - h / 2) END AS h FROM j""")
def table_boxes_merged(spark, sf_dir):
    return tables.merged_boxes(tables.boxed_tags(tag_rows(spark, sf_dir)), box_rows(spark, sf_dir))


HTML = "CASE p % 4 WHEN 0 THEN '<td>' WHEN 1 THEN '<td' WHEN 2 THEN '>' ELSE 'fcel' END"


@query(f"""WITH h AS (SELECT table_id, ord, {HTML} AS tag FROM ({LINES})), b AS (SELECT table_id, box, cx FROM ({BOXES_SQL}) WHERE table_id % 3 <> 0 OR box < 2),
  n AS (SELECT table_id, count(*) FILTER (tag IN ('<td>', '>', 'fcel')) AS cells FROM h GROUP BY table_id),
  odd AS (SELECT b.table_id FROM b JOIN n ON n.table_id = b.table_id GROUP BY b.table_id, n.cells HAVING count(*) <> n.cells),
  g AS (SELECT * FROM (SELECT table_id, tag, count(*) FILTER (tag IN ('<td>', '>')) OVER (PARTITION BY table_id ORDER BY ord) AS box FROM h) WHERE tag = '>' AND table_id IN (SELECT table_id FROM odd))
  SELECT table_id, box, cx FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.table_id = b.table_id AND g.box = b.box)""")
def table_boxes_synced(spark, sf_dir):
    html = lines(spark, sf_dir).select("table_id", "ord", F.expr(HTML).alias("tag"))
    boxes = box_rows(spark, sf_dir).where("table_id % 3 <> 0 OR box < 2").select("table_id", "box", "cx")
    return tables.synced_boxes(html, boxes).select("table_id", "box", "cx")


@query(f"""SELECT table_id, (SELECT count(DISTINCT length(r)) FROM (SELECT unnest(string_split(array_to_string(list_transform(tags, lambda t: CASE WHEN t = 'nl' THEN '|' ELSE 'x' END), ''), '|')) AS r) WHERE r <> '') <= 1 AS square,
  cast(len(list_filter(tags, lambda t: t = 'nl')) AS int) AS num_rows, cast(nullif(coalesce(list_position(tags, 'nl'), 0), 0) - 1 AS int) AS num_cols FROM ({SEQUENCES_SQL})""")
def table_tag_rows(spark, sf_dir):
    tags = F.col("tags")
    return sequences(spark, sf_dir).select("table_id", tables.is_square(tags).alias("square"), tables.size_of(tags).alias("size")).select("table_id", "square", "size.*")


@query("SELECT table_id, array_to_string(list_transform(list(CASE p % 3 WHEN 0 THEN 'fcel' WHEN 1 THEN 'nl' ELSE 'ecel' END ORDER BY ord), lambda x: x), ',') AS tags FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY ord) AS i, count(*) OVER (PARTITION BY table_id) AS n FROM (" + LINES + ")) WHERE i > 1 AND i < n GROUP BY table_id")
def table_tag_names(spark, sf_dir):
    found = lines(spark, sf_dir).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("ord", (F.col("p") % 3).cast("int").alias("id")))).alias("t"))
    names = tables.tag_names(F.transform("t", lambda x: x["id"]), {"fcel": 0, "nl": 1, "ecel": 2})
    return found.where(F.size("t") > 2).select("table_id", F.array_join(names, ",").alias("tags"))


CELL = """l_orderkey AS table_id, l_linenumber AS cell_id, l_partkey % 9 AS row_id, l_suppkey % 7 AS column_id, CASE
  WHEN l_partkey % 2 = 0 THEN 2 END AS row_span, cast(NULL AS int) AS col_span, CASE l_partkey % 4 WHEN 0 THEN 'ched' WHEN 1 THEN 'rhed'
  WHEN 2 THEN 'srow' END AS label, l_quantity AS l, l_quantity AS t, l_tax AS r, l_tax AS b"""


@query("""SELECT l_orderkey AS table_id, l_linenumber AS cell_id, l_partkey % 9 AS start_row, l_suppkey % 7 AS start_col, CASE WHEN l_partkey % 2 = 0 THEN 2
  ELSE 1 END AS row_span, 1 AS col_span, l_partkey % 9 + CASE WHEN l_partkey % 2 = 0 THEN 2
  ELSE 1 END AS end_row, l_suppkey % 7 + 1 AS end_col, l_partkey % 4 = 0 AS column_header, l_partkey % 4 = 1 AS row_header, l_partkey % 4 = 2 AS row_section, l_quantity AS l, l_quantity AS t, l_tax AS r, l_tax AS b
  FROM lineitem""")
def table_structure_cells(spark, sf_dir):
    return tables.structure_cells(read(spark, sf_dir, "lineitem").selectExpr(*(f"{c.strip()}" for c in CELL.split(", "))))


PAGE = "p_partkey, p_partkey % 90 + 0.5 AS l, p_size + 0.5 AS t, p_partkey % 90 + p_size * 1.0 AS r, p_size * 3 + 0.25 AS b"


@query(f"""SELECT p_partkey, round_even(l, 0) * 2 AS l, round_even(t, 0) * 2 AS t, round_even(r, 0) * 2 AS r, round_even(b, 0) * 2 AS b FROM (SELECT p_partkey,
  cast(l AS double) AS l, cast(t AS double) AS t, cast(r AS double) AS r, cast(b AS double) AS b FROM (SELECT {PAGE} FROM part))""")
def table_page_boxes(spark, sf_dir):
    return tables.page_boxes(read(spark, sf_dir, "part").selectExpr(*PAGE.split(", "))).select("p_partkey", *"ltrb")


CROP = """p_partkey, cast(p_partkey % 90 - 10 AS double) AS l, cast(p_size - 5 AS double) AS t, cast(p_partkey % 90 + 30 AS double) AS r,
  cast(p_size * 40 AS double) AS b, 64.0 + p_size AS page_width, 512.0 AS page_height"""
CUT = {c: f"least(greatest({c} * 2.0, 0), {m})" for c, m in (("l", "floor((64.0 + p_size) * 2)"), ("t", "1024"), ("r", "floor((64.0 + p_size) * 2)"), ("b", "1024"))}


@query(f"""SELECT p_partkey, l, t, r, b, cast(round_even(l, 0) AS int) AS x0, cast(round_even(t, 0) AS int) AS y0, cast(round_even(r, 0) AS int) AS x1,
  cast(round_even(b, 0) AS int) AS y1, round_even(r, 0) <= round_even(l, 0) OR round_even(b, 0) <= round_even(t, 0) AS empty, l / 2 AS l_back
  FROM (SELECT p_partkey, {', '.join(f'cast({x} AS double) AS {c}' for c, x in CUT.items())} FROM (SELECT *, {CROP.replace('p_partkey, ', '', 1)}
  FROM part))""")
def table_crops(spark, sf_dir):
    boxes = read(spark, sf_dir, "part").selectExpr("p_size", *re.split(r",\s+", CROP)).withColumns({c: F.col(c).cast("double") for c in ("page_width", "page_height")})
    return tables.crops(boxes).select("p_partkey", *"ltrb", "x0", "y0", "x1", "y1", "empty", "l_back")


@query("SELECT s_suppkey AS page, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 2 = 0 THEN 'new' ELSE '' END AS tables FROM supplier")
def table_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), (F.col("s_suppkey") % 3 != 0).alias("valid"), F.array("s_name").alias("existing"))
    new = pages.where("page % 2 = 0").select("page", F.array(F.lit("new")).alias("tables"))
    return tables.page_tables(pages, new).select("page", F.array_join("tables", ",").alias("tables"))


@query("""SELECT c_custkey AS cid, lower(c_mktsegment) AS label FROM customer WHERE c_mktsegment IN ('FURNITURE', 'BUILDING') AND c_custkey % 2 = 0
  OR c_custkey % 5 = 0 AND c_custkey < 0""")
def table_clusters(spark, sf_dir):
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey AS cid", "c_mktsegment", "CASE WHEN c_mktsegment = 'FURNITURE' AND c_custkey % 2 = 0 THEN 'table' WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 'document_index' ELSE 'text' END AS label")
    return tables.table_clusters(c).select("cid", F.lower("c_mktsegment").alias("label"))


@query("""WITH tab AS (SELECT s_suppkey AS table_id, s_nationkey AS page, s_suppkey % 40 AS l, s_suppkey % 30 AS t FROM supplier), tok AS (SELECT c_custkey AS token_id, c_nationkey AS page, c_custkey % 60 AS x, c_custkey % 50 AS y, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END AS text FROM customer),
  f AS (SELECT table_id, token_id, text FROM tab JOIN tok USING (page) WHERE x >= l AND x <= l + 6 AND y >= t AND y <= t + 6)
  SELECT table_id, token_id, text FROM f WHERE trim(text) <> '' UNION ALL SELECT table_id, 0 - table_id, 'cell' FROM tab WHERE table_id NOT IN (SELECT table_id FROM f)""")
def table_tokens(spark, sf_dir):
    boxes = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS table_id", "s_nationkey AS page", "s_suppkey % 40 AS l", "s_suppkey % 30 AS t", "s_suppkey % 40 + 6 AS r", "s_suppkey % 30 + 6 AS b")
    tokens = spread(read(spark, sf_dir, "customer"), "c_custkey").selectExpr("c_custkey AS token_id", "c_nationkey AS page", "c_custkey % 60 - 1 AS l", "c_custkey % 50 - 1 AS t", "c_custkey % 60 + 1 AS r", "c_custkey % 50 + 1 AS b", "CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END AS text")
    cells = boxes.selectExpr("table_id", "0 - table_id AS token_id", "'cell' AS text")
    return tables.tokens_in_tables(boxes, tokens, cells)


@query("SELECT DISTINCT 'p' || cast(c_nationkey AS varchar) AS path, 'queued' AS status FROM customer WHERE c_nationkey % 3 <> 0")
def queue_removed(spark, sf_dir):
    queue = read(spark, sf_dir, "customer").selectExpr("concat('p', cast(c_nationkey AS string)) AS path", "'queued' AS status").distinct()
    gone = read(spark, sf_dir, "supplier").selectExpr("s_nationkey").unionByName(read(spark, sf_dir, "customer").selectExpr("c_nationkey AS s_nationkey")).where("s_nationkey % 3 = 0")
    return runs.queue_remove(queue, gone.selectExpr("concat('p', cast(s_nationkey AS string)) AS path"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey || ' fájl' WHEN c_custkey % 4 IN (1, 2) THEN c_custkey || ' files'
  ELSE 'missing' END AS text FROM customer""")
def strings_localized(spark, sf_dir):
    words = F.create_map(*[F.lit(x) for kv in {"hu.files": "{n} fájl", "en.files": "{n} files"}.items() for x in kv])
    language = F.when(F.col("c_custkey") % 4 == 0, "hu").when(F.col("c_custkey") % 4 == 1, "en").otherwise("de")
    key = F.when(F.col("c_custkey") % 4 == 3, "missing").otherwise("files")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), runs.localized(words, language, key, {"n": F.col("c_custkey")}).alias("text"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN '/given' WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0
  AND c_custkey % 5 <> 0 THEN '/app/models' WHEN c_custkey % 2 = 0 THEN '/home/u/models' ELSE '/src/models' END AS dir FROM customer""")
def model_dirs(spark, sf_dir):
    n = lambda k: F.col("c_custkey") % k == 0
    place = runs.model_dir(F.when(n(7), "/given").otherwise(""), n(2), n(3), F.lit("/app"), F.lit("/src"), F.lit("/home/u"), n(5))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), place.alias("dir"))


@query("SELECT c_custkey AS id, 'hu' AS lang, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS folder FROM customer")
def settings_merged(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 3 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("c_name").alias("folder"), F.lit("en").alias("lang"))))
    merged = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), runs.settings(text, {"lang": "hu"}).alias("s"))
    return merged.select("id", F.try_element_at("s", F.lit("lang")).alias("lang"), F.try_element_at("s", F.lit("folder")).alias("folder"))


@query("SELECT c_custkey AS id, '/in/' || c_mktsegment AS beside, '/out' AS given FROM customer")
def output_folders(spark, sf_dir):
    path = F.concat(F.lit("/in/"), "c_mktsegment", F.lit("/a.pdf"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), runs.out_dir(path, None).alias("beside"), runs.out_dir(path, "/out").alias("given"))


NAMES = {"Kovács Éva - Lelet": "[REDACTED_NAME] - Lelet", "Lelet 2024": "Lelet 2024", "Nagy Béla": "[REDACTED_NAME]", "CT - Tóthné Varga Mária - kontroll": "CT - [REDACTED_NAME] - kontroll"}


def name_case(values) -> str:
    return "CASE c_custkey % 4 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(f"SELECT c_custkey AS id, {name_case(NAMES.values())} AS name FROM customer")
def filenames_redacted(spark, sf_dir):
    field = next(p for name, _, _, p in DETECTORS if name == "name_field")
    full = rf"(?<![{UPPER}{LOWER}]){FULL}(?![{UPPER}{LOWER}])"
    files = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/in/x/"), F.expr(name_case(NAMES)), F.lit(".pdf")).alias("path"))
    return files.select(F.col("c_custkey").alias("id"), redact_filename(F.col("path"), field, full).alias("name"))


@query("""WITH f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '[REDACTED_NAME] lelet' ELSE 'lelet ' || cast(c_custkey AS varchar) END AS base FROM customer)
  SELECT id, CASE WHEN n = 1 THEN base ELSE base || ' (' || cast(n AS varchar) || ')' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM f)""")
def manual_filenames(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, "EVA-KOVACS lelet").otherwise(F.concat(F.lit("lelet "), F.col("c_custkey").cast("string")))
    files = read(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.lit("").alias("text"))
    new = manual_files(files, "Kovács Éva").select(F.col("c_custkey").cast("string").alias("path"), F.lit("out").alias("out_dir"), F.col("new_name").alias("base"), F.col("c_custkey").alias("ord"), F.lit(True).alias("ok"))
    return runs.unique_names(new).select(F.col("path").cast("long").alias("id"), "name")


@query("SELECT conv_id, turn, cast(len(string_split_regex(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' ')) AS int) AS n FROM conversations WHERE length(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) > 0")
def ner_token_counts(spark, sf_dir):
    backend = ner.Gazetteer({})

    @F.pandas_udf("int")
    def count(texts):
        return texts.map(lambda t: backend.count_tokens(t or ""))

    return read(spark, sf_dir, "conversations").select("conv_id", "turn", count("text").alias("n")).where("n > 0")
