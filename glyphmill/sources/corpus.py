"""Reading corpora: text files, tables with a text column, word counts, slices and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

LARGEST = (1 << 63) - 1


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. Where it has fewer row groups than there are cores, no more tasks than that could read it, so its rows are dealt to more."""
    table = spark.read.parquet(path)
    cores, files = spark.sparkContext.defaultParallelism, table.inputFiles()
    if len(files) >= cores:
        return table
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    groups = 0
    for f in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf))
        groups += reader.getRowGroups().size()
        reader.close()
    return table.repartition(cores) if groups < cores else table


def valid_utf8(raw: Column) -> Column:
    """Whether bytes are UTF-8."""
    return F.is_valid_utf8(raw.cast("string"))


def utf8_guard(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, n_lines, bad_lines of every file that isn't empty, read in splits: lines in all, and those whose bytes aren't UTF-8. A missing path raises."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths), lineSep="\n")
    bad = F.count(F.when(~F.is_valid_utf8("value"), 1))
    return lines.groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("n_lines"), bad.alias("bad_lines"))


def scan_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """line: text files cut at line feeds only, so that large files are read by many tasks; terminators are dropped."""
    return spark.read.text(list(paths), lineSep="\n").select(F.col("value").alias("line"))


def piece_of_file(spark: SparkSession, path: str, begin: int, size: int) -> bytes:
    """Some bytes of a file in any file system, on the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(begin)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


BOM = "\ufeff"
NOT_UTF8 = "stream did not contain valid UTF-8"


def corrections(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Lines, and how often each counts, that make up for what reading in splits does to a file: the last line gets a line feed that it may lack, and a mark at the beginning is lost."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    out: list[tuple[str, int]] = []
    if not size:
        return out
    first = last = None
    if size == 3 and piece_of_file(spark, path, 0, 3) == BOM.encode():  # read as no line at all
        return [(BOM, 1)]
    if piece_of_file(spark, path, 0, min(3, size)) == BOM.encode():
        held, step = b"", 1 << 12
        while len(held) < size and b"\n" not in held:
            held += piece_of_file(spark, path, len(held), min(step, size - len(held)))
            step *= 2
        first = held.split(b"\n")[0][3:]
    if piece_of_file(spark, path, size - 1, 1) != b"\n":
        held, step = b"", 1 << 12
        while len(held) < size and b"\n" not in held:
            more = min(step, size - len(held))
            held = piece_of_file(spark, path, size - len(held) - more, more) + held
            step *= 2
        last = held.rsplit(b"\n", 1)[-1]
    try:
        if first is not None:
            out += [(first.decode() + "\n", -1), (BOM + first.decode() + "\n", 1)]
        if last is not None:
            text = last.decode()
            out += [(text + "\n", -1), (text, 1)]
    except UnicodeDecodeError:
        raise ValueError(NOT_UTF8) from None
    return out


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """line, weight: the lines of text files with their terminators, read in splits of any size of file.

    A few lines per file count -1 or once more, see corrections; sums over all rows are exact. A line
    that isn't UTF-8 is an error of the task that meets it.
    """
    if isinstance(paths, str) or not paths:
        raise ValueError("paths must be a list of one or more files")
    raw = F.col("value")
    checked = F.when(F.is_valid_utf8(raw), F.concat(raw, F.lit("\n"))).otherwise(F.raise_error(F.lit(NOT_UTF8)).cast("string"))
    lines = spark.read.text(list(paths), lineSep="\n").select(checked.alias("line"), F.lit(1).cast("long").alias("weight"))
    more = [row for p in paths for row in corrections(spark, p)]
    return lines.unionByName(spark.createDataFrame(more, "line string, weight long")) if more else lines


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 0), line with its terminator; null and empty texts have none."""
    return docs.select(F.col(key), F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def parse_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """word, cnt of "word<TAB>count" lines: the last tab divides, blank lines are skipped, repeated words add up.

    A line without tab, a word that is empty or has a space, a count that isn't a whole number and
    a sum beyond 2^63 - 1 are errors.
    """
    rows = lines.select(F.col(column).alias("row")).filter(F.trim("row") != "")
    word, n = F.regexp_extract("row", r"(?s)^(.*)\t([^\t]*)$", 1), F.regexp_extract("row", r"(?s)^(.*)\t([^\t]*)$", 2)
    fine = n.rlike(r"^\+?\d+$") & (word != "") & ~F.contains(word, F.lit(" "))
    bad = F.raise_error(F.concat(F.lit("bad count line: "), F.col("row"))).cast("string")
    return rows.select(F.when(fine, word).otherwise(bad).alias("word"), n.cast("bigint").alias("cnt")).groupBy("word").agg(F.sum("cnt").alias("cnt"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return parse_counts(spark.read.text(path, lineSep="\n"))


def corpus_slice(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text", buckets: int = 1000) -> DataFrame:
    """The first documents by key, each counted with two bytes of separator, until max_bytes are reached; the one that reaches them is in.

    Two levels: sums of ranges of keys first, then a running sum inside the range where the slice ends.
    """
    sized = docs.withColumn("_n", (F.octet_length(text) + 2).cast("bigint")).filter("_n is not null")
    ends = sized.agg(F.min(key), F.max(key)).first()
    if ends[0] is None:
        return docs.limit(0)
    width = max(1, (ends[1] - ends[0]) // buckets + 1)
    bucket = F.floor((F.col(key) - F.lit(ends[0])) / width)
    sums = sized.groupBy(bucket.alias("b")).agg(F.sum("_n").alias("n")).orderBy("b").collect()  # `buckets` rows
    before, last = 0, None
    for r in sums:
        last = r["b"]
        if before + r["n"] >= max_bytes:
            break
        before += r["n"]
    run = W.partitionBy().orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    edge = sized.filter(bucket == last).withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)) + F.lit(before))
    return docs.filter(F.octet_length(text).isNotNull() & (bucket < last)).unionByName(edge.filter(F.col("_before") < max_bytes).drop("_n", "_before"))


def round_robin(docs: DataFrame, group: str = "lang", key: str = "doc_id", buckets: int = 1000) -> DataFrame:
    """All rows and position: the first row of each group, then the second of each, and so on, groups in order of their names.

    Two levels: a row's number in its group is that of the rows in lower ranges of keys and its
    number in its own range. Rows of lower numbers are then counted from the groups' sizes, which
    are a row a group, so no window holds more than a range of a group.
    """
    ends = docs.agg(F.min(key), F.max(key)).first()
    if ends[0] is None:
        return docs.withColumn("position", F.lit(None).cast("bigint")).limit(0)
    width = max(1, (ends[1] - ends[0]) // buckets + 1)
    ranged = docs.withColumn("_b", F.floor((F.col(key) - F.lit(ends[0])) / width))
    sizes = ranged.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_r")).agg(F.count("*").alias("_size"))
    below = W.partitionBy("_g").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_below", F.coalesce(F.sum("_size").over(below), F.lit(0))).drop("_size")
    groups = sizes.groupBy("_g").agg(F.sum("_size").alias("_all")).agg(F.collect_list(F.struct("_g", "_all")).alias("_groups"))
    within = F.row_number().over(W.partitionBy(group, "_b").orderBy(key))
    ranked = ranged.withColumn("_w", within).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_r")))
    n = (F.col("_below") + F.col("_w")).cast("bigint")
    rounds = F.aggregate("_groups", F.lit(0).cast("bigint"), lambda s, g: s + F.least(g["_all"], n - 1))
    before = lambda g: F.when(g["_g"].isNull(), True).when(F.col(group).isNull(), False).otherwise(g["_g"] <= F.col(group))
    this = F.aggregate("_groups", F.lit(0).cast("bigint"), lambda s, g: s + (before(g) & (g["_all"] >= n)).cast("bigint"))
    return ranked.crossJoin(F.broadcast(groups)).withColumn("position", rounds + this).drop("_b", "_r", "_g", "_w", "_below", "_groups")


def paragraphs(html: Column) -> Column:
    """The bodies of <p> elements without attributes, joined by line feeds."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), "\n")
