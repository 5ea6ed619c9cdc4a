"""JSON documents with lists of any length, written in order by many tasks.

A document is a sequence of lines: an opening with the fields that are not lists, then for
each list one line per entry, with a frame line between two lists and one at the end. Lines
are dealt by ranges of (document, list, position), so a long document lies in several part
files; the part files one after another, in the order of their names, are the documents one
after another, in the order of their ids. Lines that start with ``{`` or ``]`` are frames.
No row, task or file holds a whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelens.session import stage
from triagelens.sources.lines import scan_lines

KEEP_NULLS = {"ignoreNullFields": "false"}


def opened(fields: Column) -> Column:
    """The JSON object of a struct, left open for more fields."""
    json = F.to_json(fields, KEEP_NULLS)
    return F.concat(F.substring(json, F.lit(1), F.length(json) - 1), F.lit(","))


def json_text(value: Column) -> Column:
    """A single text as JSON."""
    json = F.to_json(F.array(value), KEEP_NULLS)
    return F.substring(json, F.lit(2), F.length(json) - 2)


def document_lines(heads: DataFrame, lists: dict[str, DataFrame], doc: str, closing: str = "}") -> DataFrame:
    """``doc, section, place_0, place_1, ..., line``: all lines of all documents, in the order of
    these columns.

    ``heads`` has one row per document: its id (not null, unique) and ``opening``, the text up
    to the name of the first list. A list is a table of the id, ``place`` (not null, unique within
    the document, gives the order) and ``entry``, JSON text without line breaks. Entries of ids
    that have no head are left out; a document without entries gets an empty list. A line has a
    place of its own list alone, a frame line has none and comes before the entries.
    """
    parts = []
    for section, (name, entries) in enumerate(lists.items()):
        start = F.lit(f'"{name}":[')
        line = F.concat("opening", start) if section == 0 else F.concat(F.lit("],"), start)
        parts.append(heads.select(doc, F.lit(section).alias("section"), line.alias("line")))
        # the first entry has no comma; one join finds it and leaves out what has no head
        first = heads.select(doc).join(entries.groupBy(doc).agg(F.min("place").alias("_first")), doc)
        comma = F.when(F.col("place") == F.col("_first"), " ").otherwise(",")
        ours = entries.join(first, doc)
        parts.append(ours.select(doc, F.lit(section).alias("section"), F.col("place").alias(f"place_{section}"), F.concat(comma, "entry").alias("line")))
    parts.append(heads.select(doc, F.lit(len(lists)).alias("section"), F.lit("]" + closing).alias("line")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(doc, "section", *[f"place_{i}" for i in range(len(lists))], "line")


def write_documents(lines: DataFrame, path: str, doc: str, files: int | None = None) -> None:
    """The lines as text files, in order over all files; about ``files`` files of equal numbers of lines."""
    n = files or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in lines.columns if c != "line"]
    ready = stage(lines, "document-lines")  # the ranges are found from it, without making the lines twice
    ready.repartitionByRange(n, *order).sortWithinPartitions(*order).select("line").write.text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``document`` (1-based number), ``opening``, ``list`` (its name), ``position``, ``entry``: one row
    per entry as written, and one with null position and entry for an empty list."""
    text = scan_lines(spark, path)
    frame, head = F.col("value").startswith("{") | F.col("value").startswith("]"), F.col("value").startswith("{")
    lines = text.select("value", "seq.*", frame.cast("bigint").alias("is_frame"), head.cast("bigint").alias("is_head"))
    split, counts = ["path", "block_start"], {"at": F.lit(1), "frames": F.col("is_frame"), "heads": F.col("is_head")}
    # one row per split of a file: lines, frames and heads of the splits before it
    earlier = W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    totals = lines.groupBy(*split).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    offsets = totals.select(*split, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in counts])
    inside = W.partitionBy(*split).orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    local = lines.select(*split, "value", "is_frame", "is_head", *[F.sum(c).over(inside).alias(n) for n, c in counts.items()])
    placed = local.join(F.broadcast(offsets), split).select("value", "is_frame", "is_head", *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in counts])
    numbered = stage(placed, "lines")
    framed = numbered.where("is_frame = 1").select(
        F.col("frames").alias("frame"), F.col("at").alias("frame_at"), F.col("value").alias("text"), "is_head", F.col("heads").alias("document")
    )
    lists = framed.where(F.col("text").endswith("[")).withColumn("list", F.regexp_extract("text", r'"([^"]*)":\[$', 1))
    # the line of the first list is the opening itself
    first = lists.where("is_head = 1").withColumn("opening", F.col("text"))
    openings = first.select("document", "opening")
    lists = first.unionByName(lists.where("is_head = 0").join(openings, "document"))
    entries = numbered.where("is_frame = 0").select(F.col("frames").alias("frame"), "at", F.substring("value", 2, 2**31 - 1).alias("entry"))
    return (
        lists.join(entries, "frame", "left")
        .select("document", "opening", "list", (F.col("at") - F.col("frame_at") - 1).alias("position"), "entry")
    )
