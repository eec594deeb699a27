"""Exact deduplication by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame) -> DataFrame:
    """Fragments of documents: (doc_id, line, body) split at line breaks."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))


def first_occurrence(fragments: DataFrame) -> DataFrame:
    """(sha1, usize, copies, doc_id, line) of each distinct body; its first place wins."""
    hashed = fragments.select(F.sha1(F.encode("body", "UTF-8")).alias("sha1"), F.octet_length("body").alias("usize"), F.struct("doc_id", "line").alias("at"))
    out = hashed.groupBy("sha1").agg(F.first("usize").cast("long").alias("usize"), F.count("*").alias("copies"), F.min("at").alias("at"))
    return out.select("sha1", "usize", "copies", "at.doc_id", "at.line")


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 1 in order of (group, order): ranks within a group plus what
    earlier groups hold. Groups are first counted in ranges, so no window holds more than
    the ranges or the groups of one range."""
    w = Window.partitionBy(group).orderBy(*order)
    counts = rows.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_r", F.floor(F.col(group) / 1024))
    per = counts.groupBy("_r").agg(F.sum("_n").alias("_rn"))
    before = per.withColumn("_before", F.coalesce(F.sum("_rn").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_r").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_in", inside).join(before.select("_r", "_before"), "_r").select(group, (F.col("_before") + F.col("_in")).alias("_start"))
    return rows.join(starts, group).withColumn(name, F.col("_start") + F.row_number().over(w)).drop("_start")


def summary(fragments: DataFrame, by: list[str]) -> DataFrame:
    """Bytes before and after deduplication of each group; a body counts once a group."""
    hashed = fragments.select(*by, F.sha1(F.encode("body", "UTF-8")).alias("sha1"), F.octet_length("body").cast("long").alias("usize"))
    once = hashed.groupBy(*by, "sha1").agg(F.first("usize").alias("usize"), F.count("*").alias("n"))
    out = once.groupBy(*by).agg(F.sum(F.col("usize") * F.col("n")).alias("total_bytes"), F.sum("usize").alias("unique_bytes"), F.sum("n").alias("fragments"), F.count("*").alias("unique_fragments"))
    return out.withColumn("ratio", F.round(F.when(F.col("unique_bytes") > 0, F.col("total_bytes") / F.col("unique_bytes")).otherwise(1.0), 6))


def lookup(new: DataFrame, store: DataFrame) -> DataFrame:
    """New fragments (doc_id, line, body) with their ids: those the store (sha1, frag_id) has, and for each other body a
    number after the store's last, in order of first places. Adds ``known``, whether the store had it."""
    hashed = new.select("doc_id", "line", F.sha1(F.encode("body", "UTF-8")).alias("sha1"))
    met = hashed.join(store.select("sha1", F.col("frag_id").alias("_old")), "sha1", "left")
    first = first_occurrence(new).join(store, "sha1", "left_anti")
    last = store.agg(F.coalesce(F.max("frag_id"), F.lit(0)).alias("_last"))  # one row
    fresh = numbered(first, "doc_id", ["line"], "_n").select("sha1", "_n").join(F.broadcast(last)).select("sha1", (F.col("_n") + F.col("_last")).alias("_new"))
    return met.join(fresh, "sha1", "left").select("doc_id", "line", "sha1", F.coalesce("_old", "_new").alias("frag_id"), F.col("_old").isNotNull().alias("known"))


def ingest(disk: DataFrame, state: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """What adding files (path, date, size, doc_id, text) to a state (path, date, size) writes: (path, change, ptr, fragments, known).
    New and changed files are cut at line breaks and looked up in the store (sha1, frag_id); deletions have no pointers,
    unchanged files are left out."""
    from .catalog import sync

    change = sync(state, disk, ["date", "size"], force).where("change <> 'unchanged'")
    todo = disk.join(change.where("change <> 'deleted'"), "path").select("path", "doc_id", "text")
    found = lookup(lines(todo), store)
    ptr = F.transform(F.sort_array(F.collect_list(F.struct("line", "frag_id"))), lambda x: x["frag_id"])
    files = found.groupBy("doc_id").agg(ptr.alias("ptr"), F.count("*").alias("fragments"), F.count_if("known").alias("known"))
    out = change.join(todo.select("path", "doc_id"), "path", "left").join(files, "doc_id", "left")
    return out.select("path", "change", "ptr", F.coalesce("fragments", F.lit(0)).alias("fragments"), F.coalesce("known", F.lit(0)).alias("known"))
