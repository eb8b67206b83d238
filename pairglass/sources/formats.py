"""Readers and writers of sequence and structure formats, as lazy DataFrames over ``spark.read.text``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers, record_fields


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, ord, seq): records by '>'; of repeated names the last one. ``ord`` ascends with the place in the file."""
    raw = spark.read.option("lineSep", ">").text(path).withColumn("ord", F.monotonically_increasing_id())
    lines = F.split("value", r"\r?\n")
    rows = raw.select("ord", F.trim(lines[0]).alias("seq_id"), F.concat_ws("", F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x))).alias("seq"))
    rows = rows.where((F.col("seq_id") != "") | (F.col("seq") != ""))
    return rows.groupBy("seq_id").agg(F.max_by("seq", "ord").alias("seq"), F.max("ord").alias("ord")).select("seq_id", "ord", "seq")


def split_reference(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, reference lines): the pseudo-sequence '#=GC RF' apart from the others."""
    return rows.where(F.col("seq_id") != "#=GC RF"), rows.where(F.col("seq_id") == "#=GC RF").select(F.col("seq").alias("rf"))


def write_fasta(rows: DataFrame, path: str) -> None:
    rows.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), "seq")).write.mode("overwrite").text(path)


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): blocks put together in order, '.' as '-', '#=GC X' kept under that name, other marked lines skipped."""
    raw = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    parts = F.split(F.trim("value"), r"\s+")
    rows = raw.where((F.trim("value") != "") & ~F.trim("value").startswith("//")).withColumn("p", parts)
    gc = F.col("p")[0] == "#=GC"
    rows = rows.where(gc | ~F.col("p")[0].startswith("#")).where(F.size("p") >= F.when(gc, 3).otherwise(2))
    rows = rows.select("ord", F.when(gc, F.concat_ws(" ", F.col("p")[0], F.col("p")[1])).otherwise(F.col("p")[0]).alias("seq_id"), F.translate(F.when(gc, F.col("p")[2]).otherwise(F.col("p")[1]), ".", "-").alias("part"))
    blocks = F.array_sort(F.collect_list(F.struct("ord", "part")))
    return rows.groupBy("seq_id").agg(F.concat_ws("", F.transform(blocks, lambda b: b["part"])).alias("seq"))


def write_stockholm(rows: DataFrame, path: str) -> None:
    """The header, a line for each sequence by name, the end mark. Names are cut at the first space.

    Part files in order, so one after the other they are one file; no task writes more than its part.
    """
    line = F.concat(F.substring_index("seq_id", " ", 1), F.lit("\t"), F.translate("seq", "-", "."))
    spark = rows.sparkSession
    ends = spark.createDataFrame([(0, "# STOCKHOLM 1.0"), (2, "//")], "k int, value string")
    out = rows.select(F.lit(1).alias("k"), line.alias("value")).union(ends)
    out.repartitionByRange("k", "value").sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(identifiers(F.col("value"))).alias("gi"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Flat-file records between '//' lines, one row of fields each; of equal gi numbers the last one."""
    raw = spark.read.option("lineSep", "//\n").text(path).withColumn("ord", F.monotonically_increasing_id())
    rows = raw.where(F.col("value").contains("LOCUS")).select("ord", *(c.alias(k) for k, c in record_fields(F.col("value")).items()))
    last = Window.partitionBy("gi").orderBy(F.desc("ord"))
    return rows.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "ord")


def write_records(records: DataFrame, path: str) -> None:
    """Records as a table, to be read again without the flat file."""
    records.write.mode("overwrite").parquet(path)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def records_to_sequences(records: DataFrame) -> DataFrame:
    return records.select(F.col("gi").alias("seq_id"), F.col("sequence").alias("seq"))


def read_pdb(spark: SparkSession, path: str, model: int = 0, keys=()) -> DataFrame:
    """(*keys, file, serial, name, resname, chain, resseq, x, y, z) of the ATOM lines of one model of each file.

    Models count from 0 within their file; a file that has no such gives its first one, a file without MODEL lines all
    of its atoms. ``file`` is the file's path; ``keys``: columns of the folders that files are in. A line's place is
    where its block begins in the file and its order there, so files may be read in any number of blocks; only MODEL
    lines are put in order.
    """
    raw = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"))
    raw = raw.withColumn("__at", F.struct("__block", F.monotonically_increasing_id().alias("ord"))).drop("__block")
    by = Window.partitionBy("file").orderBy("__at")
    models = raw.where(F.rtrim(F.substring("value", 1, 6)) == "MODEL").select("file", "__at", F.lead("__at").over(by).alias("__next"), (F.row_number().over(by) - 1).alias("__k"))
    # The wanted model, or else the first: the greatest of the two numbers that the file has.
    wanted = models.where(F.col("__k").isin(0, model)).groupBy("file").agg(F.max_by(F.struct("__at", "__next"), "__k").alias("__m"))
    rows = raw.where(F.substring("value", 1, 6) == "ATOM  ").join(wanted, "file", "left")
    inside = (F.col("__at") > F.col("__m.__at")) & (F.col("__m.__next").isNull() | (F.col("__at") < F.col("__m.__next")))
    rows = rows.where(F.col("__m").isNull() | inside)
    cut = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    return rows.select(
        *keys, "file", cut(7, 11).cast("int").alias("serial"), cut(13, 16).alias("name"), cut(18, 20).alias("resname"), cut(22, 22).alias("chain"),
        cut(23, 26).cast("int").alias("resseq"), cut(31, 38).cast("double").alias("x"), cut(39, 46).cast("double").alias("y"), cut(47, 54).cast("double").alias("z"),
    )


def write_networks(scores: DataFrame, path: str) -> None:
    """Parquet by method, split and subset; scores and p-values rounded to eight decimals."""
    scores.withColumn("score", F.round("score", 8)).withColumn("pvalue", F.round("pvalue", 8)).write.mode("overwrite").partitionBy("method", "split", "subset").parquet(path)


def read_networks(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if method is None else rows.where(F.col("method") == method)


def write_network_text(scores: DataFrame, path: str) -> None:
    line = F.format_string("%d\t%d\t%.8f\t%.8f", F.col("p1").cast("long"), F.col("p2").cast("long"), F.col("score"), F.col("pvalue"))
    scores.select(line).write.mode("overwrite").text(path)


def read_network_text(spark: SparkSession, path: str) -> DataFrame:
    """Fails on a line that doesn't hold two numbers of columns and two of scores."""
    return spark.read.csv(path, sep="\t", schema="p1 int, p2 int, score double, pvalue double", mode="FAILFAST")


def write_database(tables: dict[str, DataFrame], options: dict, path: str) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(options, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/options")


def read_database(spark: SparkSession, path: str, names) -> tuple[dict[str, DataFrame], dict]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, json.loads(spark.read.text(f"{path}/options").first()[0])


def clean_project(spark: SparkSession, path: str, parts=("alignments", "networks")) -> list[str]:
    """Delete a project's intermediate files: the folders ``parts`` of ``path``. Returns those that were there."""
    sc, gone = spark.sparkContext, []
    for part in parts:
        place = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        if place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True):
            gone.append(part)
    return gone
