"""Table structure: the relational part of what a table model predicts.

Cells are (page, table_id, row, col, row_span, col_span, l, t, r, b, header); decoding and inference are a backend's.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Tags of cells that have a box of their own, and the one that ends a sequence.
CELLS = ("fcel", "ecel", "ched", "rhed", "srow")
END = "<end>"


def table_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.where(F.col("label").isin("table", "document_index"))


def corners(boxes: DataFrame) -> DataFrame:
    """Boxes from center, width and height (cx, cy, w, h) to corners l, t, r, b."""
    half = lambda a, b: (F.col(a) - F.col(b) / 2, F.col(a) + F.col(b) / 2)
    (left, right), (top, bottom) = half("cx", "w"), half("cy", "h")
    return boxes.withColumns({"l": left, "t": top, "r": right, "b": bottom})


def clamped(boxes: DataFrame) -> DataFrame:
    """Boxes cut to their page (width, height); those without area go."""
    inside = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(most))
    out = boxes.withColumns({"l": inside("l", "width"), "r": inside("r", "width"), "t": inside("t", "height"), "b": inside("b", "height")})
    return out.where("r > l and b > t")


def tokens_in_tables(tables: DataFrame, tokens: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """table_id, token_id, text: tokens with text whose center lies in a table of their page; joined by squares of a grid.

    cells (table_id, token_id, text): those of a table's cluster, which stand in where no token, blank or not, lies in it.
    A grid has squares as wide and as high as a power of two that the table doesn't exceed, so that it lies in few of them;
    tokens look into the grids that their page has.
    """
    at = ["page", "_w", "_h", "_x", "_y"]
    boxes = tables.select("table_id", "page", "l", "t", "r", "b", power(F.col("r") - F.col("l")).alias("_w"), power(F.col("b") - F.col("t")).alias("_h"))
    grids = boxes.select("page", "_w", "_h").distinct()
    boxes = boxes.withColumn("_x", F.explode(squares("l", "r", "_w"))).withColumn("_y", F.explode(squares("t", "b", "_h")))
    x, y = (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2
    centers = tokens.select("page", "token_id", "text", x.alias("_cx"), y.alias("_cy")).join(F.broadcast(grids), "page")
    centers = centers.withColumn("_x", square(F.col("_cx"), F.col("_w"))).withColumn("_y", square(F.col("_cy"), F.col("_h")))
    tab, tok = boxes.alias("tab"), centers.alias("tok")
    inside = (F.col("tok._cx") >= F.col("tab.l")) & (F.col("tok._cx") <= F.col("tab.r")) & (F.col("tok._cy") >= F.col("tab.t")) & (F.col("tok._cy") <= F.col("tab.b"))
    inside = functools.reduce(Column.__and__, [F.col(f"tok.{c}") == F.col(f"tab.{c}") for c in at], inside)
    found = tab.join(tok.where(F.trim("tok.text") != ""), inside).select("tab.table_id", "tok.token_id", "tok.text")
    if cells is not None:
        without = tables.select("table_id").join(tab.join(tok, inside, "left_semi").select("table_id"), "table_id", "left_anti")
        found = found.unionByName(cells.join(without, "table_id", "left_semi").select("table_id", "token_id", "text").where(F.trim("text") != ""))
    return found


#: Powers of two that squares of a grid go down and up to; what is larger lies in a grid of one square.
LEAST_POWER, MOST_POWER = -20, 50


def power(extent: Column) -> Column:
    """The least power of two that an extent doesn't exceed."""
    return F.when(extent <= 2.0**MOST_POWER, F.greatest(F.ceil(F.log2(F.greatest(extent.cast("double"), F.lit(2.0**LEAST_POWER)))).cast("int"), F.lit(LEAST_POWER))).otherwise(MOST_POWER + 1)


def square(at: Column, power_: Column) -> Column:
    return F.when(power_ <= MOST_POWER, F.floor(at / F.pow(F.lit(2.0), power_))).otherwise(0).cast("long")


def squares(first: str, last: str, power_: str) -> Column:
    """Those from first to last: two, or three where an extent was rounded."""
    a, b = (square(F.col(c), F.col(power_)) for c in (first, last))
    return F.array_distinct(F.array(a, F.least(a + 1, b), b))


def matched_cells(matches: DataFrame) -> DataFrame:
    """For each token the table cell that matched last; header flags of all its cells count; the smallest label wins."""
    return matches.groupBy("table_id", "token_id").agg(F.max_by("cell_id", "ord").alias("cell_id"), F.bool_or("header").alias("header"), F.min("label").alias("label"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """One cell for each (col, row) of a table, its boxes in order."""
    box = F.struct("ord", "l", "t", "r", "b")
    return cells.groupBy("table_id", "col", "row").agg(F.transform(F.array_sort(F.collect_list(box)), lambda x: x.dropFields("ord")).alias("boxes"), F.bool_or("header").alias("header"))


def reindexed(cells: DataFrame) -> DataFrame:
    """Rows and columns numbered without gaps, and the table's numbers of them."""
    rank = lambda c: (F.dense_rank().over(Window.partitionBy("table_id").orderBy(c)) - 1).cast("int")
    out = cells.withColumn("row", rank("row")).withColumn("col", rank("col"))
    size = lambda c, span: F.max(F.col(c) + F.col(span)).over(Window.partitionBy("table_id"))
    return out.withColumn("num_rows", size("row", "row_span")).withColumn("num_cols", size("col", "col_span"))


def reading_order(elements: DataFrame) -> DataFrame:
    """Elements with their place by page, top, left, id; ranked within a document."""
    w = Window.partitionBy("doc_id").orderBy("page_no", "t", "l", "cid")
    return elements.withColumn("place", F.row_number().over(w))


def corrected_tags(tags: list[str]) -> list[str]:
    """Two repairs of a predicted tag sequence: a crossing cell in the first row spans left, a left span after an upward
    one is a full cell."""
    out: list[str] = []
    first = True
    for tag in tags:
        out.append(corrected(tag, out, first))
        first = first and tag != "nl"
    return out


def corrected(tag: str, before: list[str], first: bool) -> str:
    """A tag in its place; first: whether it is in the first row."""
    if first and tag == "xcel":
        tag = "lcel"
    return "fcel" if tag == "lcel" and before and before[-1] == "ucel" else tag


def decoded(next_tag: Callable[[list[str]], str], most: int) -> list[str]:
    """Tags as a model gives them one by one, each repaired before the next one is asked for; at most so many."""
    out: list[str] = []
    while len(out) < most and (tag := corrected(next_tag(out), out, "nl" not in out)) != END:
        out.append(tag)
    return out


def decode(images: DataFrame, make: Callable[[], Callable[[bytes, list[str]], str]], most: int = 1024) -> DataFrame:
    """table_id, tags: the tag sequence of each table's image, by a model that is built once for each task and asked for the
    next tag again and again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            tags = [decoded(lambda before, x=bytes(x or b""): model(x, before), most) for x in b["image"]]
            yield pd.DataFrame({"table_id": b["table_id"], "tags": tags})

    kind = images.schema["table_id"].dataType.simpleString()
    return images.select("table_id", "image").mapInPandas(run, f"table_id {kind}, tags array<string>")


def tag_names(ids: Column, words: dict[str, int]) -> Column:
    """Names of a sequence of tag numbers, without its first and last one (start and end)."""
    names = F.create_map(*[F.lit(x) for name, n in words.items() for x in (n, name)])
    return F.transform(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 2, F.lit(0))), lambda i: F.try_element_at(names, i))


def rows_of(tags: Column) -> Column:
    """A sequence's rows, as strings of one letter for each cell; empty rows left out."""
    letters = F.array_join(F.transform(tags, lambda t: F.when(t == "nl", "|").otherwise("x")), "")
    return F.filter(F.split(letters, r"\|", -1), lambda r: r != "")


def is_square(tags: Column) -> Column:
    """Whether all rows of a tag sequence have the same number of cells."""
    return F.size(F.array_distinct(rows_of(tags))) <= 1


def size_of(tags: Column) -> Column:
    """struct<num_rows, num_cols> by the tags alone: row ends, and the place of the first one (null without any)."""
    ends = F.size(F.filter(tags, lambda t: t == "nl"))
    first = F.array_position(tags, "nl")
    return F.struct(ends.alias("num_rows"), F.when(first > 0, first - 1).cast("int").alias("num_cols"))


def boxed_tags(tags: DataFrame) -> DataFrame:
    """From (table_id, ord, tag) of repaired sequences: table_id, ord, box (its number), partner: tags for which a model
    gives a box.  A run of left spans has one, which merges with that of the cell right behind the run, or, if the run ends
    otherwise, with the table's last box.
    """
    w = Window.partitionBy("table_id").orderBy("ord")
    last = F.lag("tag").over(w)
    seen = tags.withColumn("_last", last)
    cell = F.col("tag").isin(*CELLS, "nl", "ucel") & F.col("_last").isNotNull() & ~F.col("_last").isin("nl", "ucel", "xcel")
    run = (F.col("tag") == "lcel") & F.coalesce(F.col("_last") != "lcel", F.lit(True))
    # a run's first tag knows what stands behind the run: the next tag that is no left span
    after = F.first(F.when(F.col("tag") != "lcel", F.struct("tag")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))["tag"]
    seen = seen.withColumn("_run", run).withColumn("_after", after).where(cell | run)
    numbered = seen.withColumn("box", (F.row_number().over(w) - 1).cast("int")).withColumn("_n", F.count("*").over(Window.partitionBy("table_id")).cast("int"))
    closed = F.col("_after").isin(*CELLS, "nl", "ucel")
    partner = F.when(F.col("_run"), F.when(closed, F.col("box") + 1).otherwise(F.col("_n") - 1))
    return numbered.select("table_id", "ord", "box", partner.alias("partner"))


def merged_boxes(boxed: DataFrame, boxes: DataFrame) -> DataFrame:
    """table_id, box, cx, cy, w, h: boxes (table_id, box, cx, cy, w, h) with each run of left spans and its partner made one."""
    one = boxes.select("table_id", "box", "cx", "cy", "w", "h")
    other = boxes.select("table_id", F.col("box").alias("partner"), *(F.col(c).alias(f"{c}2") for c in ("cx", "cy", "w", "h")))
    pairs = boxed.where("partner is not null").select("table_id", "box", "partner")
    closed = boxed.where("partner = box + 1").select("table_id", F.col("partner").alias("box"))
    both = one.join(closed, ["table_id", "box"], "left_anti").join(pairs, ["table_id", "box"], "left").join(other, ["table_id", "partner"], "left")
    left, top = F.col("cx") - F.col("w") / 2, F.least(F.col("cy") - F.col("h") / 2, F.col("cy2") - F.col("h2") / 2)
    width = F.col("cx2") + F.col("w2") / 2 - left
    height = F.col("cy2") + F.col("h2") / 2 - (F.col("cy") - F.col("h") / 2)
    alone = F.col("cx2").isNull()
    new = {"cx": left + width / 2, "cy": top + height / 2, "w": width, "h": height}
    return both.select("table_id", "box", *(F.when(alone, F.col(c)).otherwise(x).alias(c) for c, x in new.items()))


def synced_boxes(html: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes (table_id, box from 0, ...) of tables whose HTML tags (table_id, ord, tag) have as many cells as they are; of
    other tables, those go whose number is that of cells up to the end of a spanning one.
    """
    opens = F.col("tag").isin("<td>", ">")
    n = html.groupBy("table_id").agg(F.count_if(opens | F.col("tag").isin(*CELLS)).alias("_cells"))
    odd = boxes.groupBy("table_id").agg(F.count("*").alias("_boxes")).join(n, "table_id", "left").where("_boxes <> coalesce(_cells, 0)").select("table_id")
    so_far = F.count_if(opens).over(Window.partitionBy("table_id").orderBy("ord"))
    gone = html.withColumn("box", so_far.cast("int")).where("tag = '>'").join(odd, "table_id", "left_semi").select("table_id", "box")
    return boxes.join(gone, ["table_id", "box"], "left_anti")


def structure_cells(cells: DataFrame) -> DataFrame:
    """Cells of a table's structure alone, without any text: from (table_id, cell_id, row_id, column_id, row_span, col_span,
    label, l, t, r, b), where a missing span is 1; ends of rows and columns, and what kind of header a cell is."""
    span = lambda c: F.coalesce(F.col(c), F.lit(1)).alias(c)
    some = cells.select("table_id", "cell_id", "row_id", "column_id", span("row_span"), span("col_span"), "label", "l", "t", "r", "b")
    kinds = {"column_header": "ched", "row_header": "rhed", "row_section": "srow"}
    ends = [(F.col("row_id") + F.col("row_span")).alias("end_row"), (F.col("column_id") + F.col("col_span")).alias("end_col")]
    header = [F.coalesce(F.col("label") == v, F.lit(False)).alias(k) for k, v in kinds.items()]
    return some.select("table_id", "cell_id", F.col("row_id").alias("start_row"), F.col("column_id").alias("start_col"), "row_span", "col_span", *ends, *header, "l", "t", "r", "b")


def page_boxes(clusters: DataFrame, scale: float = 2.0) -> DataFrame:
    """Boxes of clusters in the pixels of a page that is rendered at a scale: rounded to points first, half to even."""
    return clusters.withColumns({c: F.bround(F.col(c).cast("double")) * scale for c in "ltrb"})


def page_tables(pages: DataFrame, predicted: DataFrame) -> DataFrame:
    """pages (page, valid, existing), each with what is predicted (page, tables); one that can't be read keeps what it has,
    one without tables gets an empty list."""
    kind = predicted.schema["tables"].dataType.simpleString()
    none = F.array().cast(kind)
    new = F.when(F.col("valid"), F.coalesce("tables", none)).otherwise(F.coalesce("existing", none))
    return pages.join(predicted, "page", "left").select("page", new.alias("tables"))


def crops(boxes: DataFrame, height: int = 1024) -> DataFrame:
    """boxes (l, t, r, b, page_width, page_height) on a page that is resized to a height: scale, the boxes scaled and cut to
    the page, the bounds of the image to crop (x0, y0, x1, y1; half to even), whether that is empty (such a table has no
    cells), and the boxes scaled back.
    """
    scale = F.lit(float(height)) / F.col("page_height")
    width = F.floor(F.col("page_width") * F.col("scale")).cast("double")
    out = boxes.withColumn("scale", scale).withColumn("image_width", width)
    inside = lambda c, most: F.least(F.greatest(F.col(c) * F.col("scale"), F.lit(0.0)), most)
    high = F.lit(float(height))
    cut = out.withColumns({"l": inside("l", F.col("image_width")), "r": inside("r", F.col("image_width")), "t": inside("t", high), "b": inside("b", high)})
    cut = cut.withColumns({new: F.bround(c).cast("int") for new, c in zip(("x0", "y0", "x1", "y1"), "ltrb", strict=True)})
    cut = cut.withColumn("empty", (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")))
    return cut.withColumns({f"{c}_back": F.col(c) / F.col("scale") for c in "ltrb"})
