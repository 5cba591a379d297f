"""FASTA input and pair-list output.

A file is a run of lines: headers (starting with ``>``), blank lines, and sequence lines. A
record is the concatenation of sequence lines up to a blank line, a header, or the end of the
file. A blank line always ends a record, even an empty one; a header ends one only if it has
letters. Nothing is trimmed and case is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Header mark, and the part of a file name that is not the sample name.
HEADER = ">"
EXTENSION = "[.][^.]+$"


def sample_name(file: Column | str) -> Column:
    return F.regexp_replace(F.col(file) if isinstance(file, str) else file, EXTENSION, "")


def _records(body: Column) -> Column:
    """Records of a run of lines that has no header in front of it any more."""
    lines = F.split(body, "\n", -1)
    # Blank line -> end mark; header -> end mark only after letters.
    marks = F.array_join(F.transform(lines, lambda s: F.when(s == "", "\n").when(F.startswith(s, F.lit(HEADER)), "\r").otherwise(s)), "")
    ended = F.regexp_replace(F.regexp_replace(marks, "(?<=[^\n\r])\r", "\n"), "\r", "")
    pieces = F.split(ended, "\n", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def _blocks(spark: SparkSession, path: str | list[str], ignore_broken: bool) -> DataFrame:
    """One row per header block, with its place: file, input split, and order in the split.

    Splitting the input *at* headers lets Spark cut big files into many tasks while a record
    stays whole. Rows of a split are numbered in reading order; a split is at most
    ``spark.sql.files.maxPartitionBytes`` long.
    """
    reader = spark.read.option("lineSep", "\n" + HEADER).option("ignoreMissingFiles", ignore_broken).option("ignoreCorruptFiles", ignore_broken)
    raw = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("order"),
    )
    in_split = Window.partitionBy("path", "split").orderBy("order")
    return raw.withColumn("row", F.row_number().over(in_split)).drop("order")


def _sample(spark: SparkSession, path: str | list[str], layout: str) -> Column:
    if layout == "file":
        return sample_name("file")
    if layout == "folder":
        return sample_name(F.element_at(F.split("path", "/"), -2))
    return sample_name("file") if _is_file(spark, path) else F.lit(sample_name_of(path))


def _lines(spark: SparkSession, path: str | list[str], ignore_broken: bool) -> DataFrame:
    """Every line of the input with its place: file, input split, and row in the split."""
    reader = spark.read.option("ignoreMissingFiles", ignore_broken).option("ignoreCorruptFiles", ignore_broken)
    lines = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("order"),
    )
    in_split = Window.partitionBy("path", "split").orderBy("order")
    return lines.withColumn("row", F.row_number().over(in_split)).drop("order")


def _records_of_lines(lines: DataFrame, drop_empty: bool) -> DataFrame:
    """``(sample, seq_id, header, seq)`` of lines, the same as from runs of lines behind headers.

    A line belongs to the record whose number is the count of ends before it. Ends are counted in each
    split as if it stood alone; one row per split then tells what its first line ends, which header
    it stands under and how many records came before. Only letters are shuffled, to their record.
    """
    blank, header = F.col("value") == "", F.startswith("value", F.lit(HEADER))
    kind = F.when(blank, "blank").when(header, "header").otherwise("letters")
    so_far = Window.partitionBy("path", "split").orderBy("row")
    previous = F.coalesce(F.lag("kind").over(so_far) == "letters", F.lit(False))
    lines = lines.withColumn("kind", kind)
    always = F.lit(False) if drop_empty else F.col("kind") == "blank"
    lines = lines.withColumn("end", F.when(always | ((F.col("kind") != "letters") & previous), 1).otherwise(0))
    name = F.when(F.col("kind") == "header", F.regexp_replace("value", "^>", ""))
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("ended", F.coalesce(F.sum("end").over(before), F.lit(0)))
    lines = lines.withColumn("own", F.last(name, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))

    splits = lines.groupBy("sample", "file", "path", "split").agg(
        F.sum("end").alias("ends"),
        F.min_by("kind", "row").alias("first"),
        F.max_by("kind", "row").alias("final"),
        F.max_by("own", "row").alias("own"),
    )
    in_file = Window.partitionBy("path").orderBy("split")
    open_ = F.coalesce(F.lag("final").over(in_file) == "letters", F.lit(False))
    ending = F.col("first") != "letters" if drop_empty else F.col("first") == "header"
    splits = splits.withColumn("border", F.when(open_ & ending, 1).otherwise(0))
    splits = splits.withColumn("under", F.last("own", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)))
    unended = F.when(F.lead("final").over(in_file).isNull() & (F.col("final") == "letters"), 1).otherwise(0)
    splits = splits.withColumn("records", F.col("ends") + F.col("border") + unended)
    earlier = Window.partitionBy("sample").orderBy("file", "path", "split").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("records").over(earlier), F.lit(0))
    splits = splits.select("path", "split", "border", "under", offset.alias("offset"))

    kept = lines.where(F.col("kind") == "letters") if drop_empty else lines.where(F.col("kind") != "header")
    after_first = F.when(F.col("row") > 1, F.col("border")).otherwise(0)
    placed = kept.join(splits, ["path", "split"]).select(
        "sample",
        (F.col("offset") + after_first + F.col("ended")).alias("seq_id"),
        F.coalesce("own", "under").alias("header"),
        F.struct("split", "row", "value").alias("line"),
    )
    records = placed.groupBy("sample", "seq_id").agg(F.min_by("header", "line").alias("header"), F.sort_array(F.collect_list("line")).alias("parts"))
    return records.select("sample", "seq_id", "header", F.array_join("parts.value", "").alias("seq"))


def read_fasta(
    spark: SparkSession,
    path: str | list[str],
    layout: str = "sample",
    reverse: bool = False,
    drop_empty: bool = True,
    ignore_broken: bool = False,
    cut: str = "header",
) -> DataFrame:
    """``(sample, seq_id, header, seq)`` with 0-based ``seq_id`` in input order per sample.

    ``layout`` is ``"sample"`` for a file or a folder read as one sample (files in order of
    name), ``"file"`` for a folder with one sample per file, and ``"folder"`` for a folder with
    one sample per sub-folder. Files whose name starts with a dot or an underscore are skipped.
    ``ignore_broken`` skips unreadable files instead of failing. ``cut`` is where a file is split
    over tasks: ``"header"`` keeps the run of lines behind a header in one row and needs no shuffle of
    sequences; ``"line"`` is for files with few or no headers, whose records end at blank lines. Both
    give the same rows.
    """
    if layout not in ("sample", "file", "folder"):
        raise ValueError("layout must be 'sample', 'file' or 'folder'")
    if cut not in ("header", "line"):
        raise ValueError("cut must be 'header' or 'line'")
    pattern = f"{path.rstrip('/')}/*/*" if layout == "folder" else path
    if cut == "line":
        lines = _lines(spark, pattern, ignore_broken).withColumn("sample", _sample(spark, path, layout))
        rows = _records_of_lines(lines, drop_empty)
        return rows.withColumn("seq", F.reverse("seq")) if reverse else rows
    blocks = _blocks(spark, pattern, ignore_broken)

    # The first block of a file has no separator before it, the last one ends with the file.
    last = blocks.groupBy("path").agg(F.max(F.struct("split", "row")).alias("last"))
    blocks = blocks.join(last, "path")
    # The separator took the line feed of a CR LF before the next header, not the CR.
    unix = lambda c: F.regexp_replace(c, "\r\n?", "\n")
    text = unix(F.regexp_replace("value", "\r\\z", ""))
    is_first = (F.col("split") == 0) & (F.col("row") == 1)
    is_last = F.struct("split", "row") == F.col("last")
    text = F.when(is_last, F.regexp_replace(unix(F.col("value")), "\n\\z", "")).otherwise(text)
    headed = ~is_first | F.startswith("value", F.lit(HEADER))
    header = F.when(headed, F.regexp_replace(F.substring_index(text, "\n", 1), "^>", ""))
    has_body = F.instr(text, "\n") > 0
    body = F.when(~headed, text).when(has_body, F.substring(text, F.instr(text, "\n") + 1, F.length(text)))
    empty = F.array().cast("array<string>")
    found = F.when(body.isNull() | (is_last & (F.length("value") == 0)), empty).otherwise(_records(body))
    if drop_empty:
        found = F.filter(found, lambda s: s != "")
    parsed = blocks.select("path", "file", "split", "row", header.alias("header"), found.alias("found"))

    parsed = parsed.withColumn("sample", _sample(spark, path, layout))

    # Record ids: records before the split + records before the block + place in the block. Only
    # one row per split takes part in the sum over splits.
    inside = Window.partitionBy("path", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = parsed.withColumn("before", F.coalesce(F.sum(F.size("found")).over(inside), F.lit(0)))
    sizes = parsed.groupBy("sample", "file", "path", "split").agg(F.sum(F.size("found")).alias("size"))
    earlier = Window.partitionBy("sample").orderBy("file", "path", "split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("path", "split", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    rows = placed.join(offsets, ["path", "split"]).select(
        "sample", (F.col("offset") + F.col("before")).alias("base"), "header", F.posexplode("found").alias("at", "seq")
    )
    seq = F.reverse("seq") if reverse else F.col("seq")
    return rows.select("sample", (F.col("base") + F.col("at")).alias("seq_id"), "header", seq.alias("seq"))


def sample_name_of(path: str | list[str]) -> str:
    import re

    first = path if isinstance(path, str) else path[0]
    return re.sub(EXTENSION, "", first.rstrip("/").rsplit("/", 1)[-1], count=1)


def _hadoop_path(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    location, fs = _hadoop_path(spark, path)
    return fs.exists(location)


def _is_file(spark: SparkSession, path: str | list[str]) -> bool:
    if not isinstance(path, str):
        return False
    location, fs = _hadoop_path(spark, path)
    return fs.exists(location) and fs.getFileStatus(location).isFile()


def is_folder(spark: SparkSession, path: str) -> bool:
    location, fs = _hadoop_path(spark, path)
    return fs.exists(location) and fs.getFileStatus(location).isDirectory()


def get_sample(spark: SparkSession, path: str) -> DataFrame | None:
    """A file or folder as one sample; None, with a message, when there is no such path."""
    if not exists(spark, path):
        print(f"Input {path} does not exist")
        return None
    return read_fasta(spark, path)


def write_pairs(edges: DataFrame, path: str) -> None:
    """Lines ``i j``, replacing what was at ``path``; sample columns become sub-folders."""
    by = [c for c in edges.columns if c not in ("i", "j")]
    lines = edges.select(*by, F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string")).alias("value"))
    if by:
        # A pair's lines come together first, else every task writes a file to every folder; a pair
        # with many lines is split again.
        lines.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).text(path)
    else:
        lines.write.mode("overwrite").text(path)


def write_fasta(df: DataFrame, path: str, header: str, seq: str) -> None:
    """One header line and one sequence line per row, in part files that keep the row order."""
    lines = df.select(F.concat(F.lit(HEADER), F.col(header).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))
    lines.write.mode("overwrite").text(path)
