"""Runs: file events, the queue's state, output names, manifests, audits, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .detect import spans_of

STAGES = ("converting", "redacting", "done", "failed")


def queue_state(events: DataFrame) -> DataFrame:
    """The latest status of each path; counts change only when an event has some, the error with each event."""
    some = F.col("counts").isNotNull() & (F.size("counts") > 0)
    return events.groupBy("path").agg(F.max_by("stage", "seq").alias("status"), F.max_by("counts", F.when(some, F.col("seq"))).alias("counts"), F.max_by(F.struct("error"), "seq")["error"].alias("error"))


def queue_add(queue: DataFrame, paths: DataFrame) -> DataFrame:
    """queue (path, status, ord) and new paths (path, ord): PDFs only, those that are there already left out, first wins."""
    new = paths.where(F.lower("path").endswith(".pdf")).join(queue.select("path"), "path", "left_anti")
    first = new.groupBy("path").agg(F.min("ord").alias("ord"))
    return queue.select("path", "status", "ord").unionByName(first.select("path", F.lit("queued").alias("status"), "ord"))


def queue_remove(queue: DataFrame, paths: DataFrame) -> DataFrame:
    return queue.join(paths.select("path"), "path", "left_anti")


def pending(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("status").isin("queued", "failed"))


def report(queue: DataFrame) -> DataFrame:
    """A row for each path: names, taj, dates, addr (addresses and places), total; null unless done; review without names."""
    n = lambda *labels: sum((F.coalesce(F.try_element_at("counts", F.lit(x)), F.lit(0)) for x in labels), F.lit(0)).cast("long")
    done = F.col("status") == "done"
    total = F.aggregate(F.map_values(F.coalesce("counts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))), F.lit(0).cast("long"), lambda a, x: a + x)
    each = {"names": n("NAME"), "taj": n("TAJ"), "dates": n("DATE_OF_BIRTH"), "addr": n("ADDRESS", "LOCATION"), "total": total}
    return queue.select("path", "status", *(F.when(done, c).alias(k) for k, c in each.items()), (done & (n("NAME") == 0)).alias("review"))


def unique_names(files: DataFrame) -> DataFrame:
    """files (path, out_dir, base, ord, ok): names for those that succeeded: base, then base (2), ... in order.

    A name that another base already has as it stands moves on to the next free number, in the order of ord, as a fold in
    each folder would do; a folder's names with clashes of that kind are the only ones that are folded.
    """
    good = files.where("ok")
    n = F.row_number().over(Window.partitionBy("out_dir", "base").orderBy("ord"))
    named = good.withColumn("n", n).withColumn("name", F.when(F.col("n") == 1, F.col("base")).otherwise(F.format_string("%s (%d)", "base", "n")))
    clash = named.groupBy("out_dir", "name").agg(F.count("*").alias("c")).where("c > 1").select("out_dir").distinct()
    easy = named.join(clash, "out_dir", "left_anti").select("path", "out_dir", "ord", "name")

    def fold(pdf):
        following: dict[str, int] = {}
        used, out = set(), []
        pdf = pdf.sort_values("ord")
        for base in pdf["base"]:
            name, k = base, following.get(base, 2)
            # numbers below the base's next one are taken, and stay so
            while name in used:
                name, k = f"{base} ({k})", k + 1
            following[base] = k
            used.add(name)
            out.append(name)
        return pdf.assign(name=out)[["path", "out_dir", "ord", "name"]]

    kinds = ", ".join(f"{c} {good.schema[c].dataType.simpleString()}" for c in ("path", "out_dir", "ord"))
    hard = good.join(clash, "out_dir", "left_semi").groupBy("out_dir").applyInPandas(fold, kinds + ", name string")
    return easy.unionByName(hard)


def missing_artifacts(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Files (model, name, bytes, sha256) of the manifest that the listing (model, name, bytes) lacks in that size."""
    return manifest.join(listing.select("model", "name", "bytes"), ["model", "name", "bytes"], "left_anti")


def corrupt_artifacts(manifest: DataFrame, contents: DataFrame) -> DataFrame:
    """Files that are there (model, name, content) with another SHA-256."""
    return manifest.join(contents.select("model", "name", F.sha2("content", 256).alias("found")), ["model", "name"]).where("found <> sha256")


def model_status(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """model, total_bytes, megabytes, missing (sorted names), ready."""
    gone = missing_artifacts(manifest, listing).groupBy("model").agg(F.array_sort(F.collect_list("name")).alias("missing"))
    size = manifest.groupBy("model").agg(F.sum("bytes").alias("total_bytes"))
    out = size.join(gone, "model", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return out.select("model", "total_bytes", F.bround(F.col("total_bytes") / 1e6).cast("long").alias("megabytes"), "missing", (F.size("missing") == 0).alias("ready"))


def duplicate_names(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("model", "name").agg(F.count("*").alias("n")).where("n > 1")


def manifest_rows(contents: DataFrame) -> DataFrame:
    """model, name, bytes, sha256 of each file, from (model, name, content); nothing moves."""
    return contents.select("model", "name", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def build_manifest(contents: DataFrame) -> DataFrame:
    """model, files array<struct<name, bytes, sha256>> by name, as a manifest file has them: for models, whose files are few."""
    each = F.struct("name", "bytes", "sha256")
    return manifest_rows(contents).groupBy("model").agg(F.array_sort(F.collect_list(each)).alias("files"))


def leaks(outputs: DataFrame, raw: list[str], key: str = "doc_id") -> DataFrame:
    """key, problem for each output without a placeholder, with one of the raw values, or in which detectors still find a
    number, an address for mail or a phone."""
    text = F.col("text")
    left = F.transform(spans_of(text, ("taj", "phone", "email")), lambda s: F.concat(F.lit("left: "), s["label"]))
    still = F.array(*[F.when(F.lower(text).contains(v.lower()), F.lit("raw value")) for v in raw]) if raw else F.array().cast("array<string>")
    none = F.array(F.when(~text.contains("[REDACTED_"), F.lit("no placeholder")))
    found = F.array_distinct(F.filter(F.concat(none, still, left), lambda x: x.isNotNull()))
    return outputs.select(key, F.explode(found).alias("problem"))


def observed(files: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """files (path, ok) with an observation that has, once an action on them has ended, how many there were, how many
    failed, and (where there is label_counts) how many spans they had."""
    seen = Observation(name)
    counts = [F.count("*").alias("files"), F.count_if(~F.col("ok")).alias("failed")]
    if "label_counts" in files.columns:
        spans = F.aggregate(F.coalesce(F.map_values("label_counts"), F.array().cast("array<int>")), F.lit(0), lambda a, n: a + n)
        counts.append(F.sum(spans).alias("spans"))
    return files.observe(seen, *counts), seen


def out_dir(path: Column, given: str | None) -> Column:
    return F.lit(given) if given else F.regexp_replace(path, "/[^/]*$", "")


def settings(text: Column, update: dict[str, str] | None = None) -> Column:
    """A settings text as a map; broken or missing ones are empty; an update's values win."""
    old = F.coalesce(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    if not update:
        return old
    new = F.create_map(*[F.lit(x) for kv in update.items() for x in kv])
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def localized(table: Column, language: Column, key: Column, values: dict[str, Column] | None = None) -> Column:
    """A string by language, else in English, with values in place of {name}; a key that has neither stays as it is.

    table: map of 'language.key' to string.
    """
    text = F.coalesce(F.try_element_at(table, F.concat_ws(".", language, key)), F.try_element_at(table, F.concat(F.lit("en."), key)))
    for name, value in (values or {}).items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return F.coalesce(text, key)


def model_dir(override: Column, frozen: Column, windows: Column, app: Column, project: Column, user: Column | None = None, legacy: Column | None = None) -> Column:
    """Where models lie: an override; of a frozen build on Windows the application's folder, unless only the user's folder
    has models and they can't be moved (legacy); of another frozen build the user's folder; else the project's."""
    user, legacy = F.lit(None).cast("string") if user is None else user, F.lit(False) if legacy is None else legacy
    in_ = lambda folder: F.concat(folder, F.lit("/models"))
    built = F.when(windows & ~F.coalesce(legacy, F.lit(False)), in_(app)).otherwise(in_(user))
    return F.coalesce(F.nullif(override, F.lit("")), F.when(frozen, built).otherwise(in_(project)))
