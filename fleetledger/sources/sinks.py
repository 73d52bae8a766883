"""Writers of relations and reports. Each returns nothing and writes with Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetledger.operators.ordered import ordinal

PAGE_ROWS = 500
#: Consecutive pages that are dealt to one task.
PAGES_TOGETHER = 200


def index_sections(entries: DataFrame) -> DataFrame:
    """Lines of each repository's file index, grouped by chunk, ids ascending, multi-tag rows repeated.

    ``repo_id, tag, line_no, line``: sorting by (tag, line_no) gives the file. Lines stay rows, so an
    index of any size is written without being gathered.
    """
    rows = entries.select("repo_id", F.explode("chunk_tags").alias("tag"), "path", "purpose")
    body = rows.select(
        "repo_id", "tag", F.lit(1).alias("part"), F.col("path").alias("sort_key"),
        F.concat(F.lit("| "), "path", F.lit(" | "), "purpose", F.lit(" |")).alias("line"),
    )
    heading = F.when(F.col("tag") == 0, "## Always Include").otherwise(F.concat(F.lit("## Chunk "), _plain("tag")))
    heads = rows.select("repo_id", "tag").distinct().select(
        "repo_id", "tag", F.lit(0).alias("part"),
        F.posexplode(F.array(heading, F.lit(""), F.lit("| File | Purpose |"), F.lit("|---|---|"))).alias("n", "line"),
    )
    return body.unionByName(
        heads.select("repo_id", "tag", "part", F.col("n").cast("string").alias("sort_key"), "line")
    )


def _plain(name: str) -> Column:
    """A chunk id without trailing zeros."""
    return F.regexp_replace(F.col(name).cast("decimal(10,3)").cast("string"), r"\.?0+$", "")


def write_index_text(entries: DataFrame, path: str) -> None:
    """The index as text, a folder a repository. A section is never cut: its files are pages in order, each beginning with
    a heading, so each can be parsed alone."""
    sections = index_sections(entries)
    ordered = sections.repartitionByRange("repo_id", "tag").sortWithinPartitions("repo_id", "tag", "part", "sort_key")
    ordered.select("repo_id", F.col("line").alias("value")).write.partitionBy("repo_id").mode("overwrite").text(path)


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    """``repo_id, text`` of each page that :func:`write_index_text` wrote."""
    pages = spark.read.text(path, wholetext=True)
    return pages.select("repo_id", F.col("value").alias("text"))


def paged(entries: DataFrame, order: list[Column], bucket: Column, rows_per_page: int = PAGE_ROWS) -> DataFrame:
    """Entries with the page each falls on, ``rows_per_page`` to a page, in order."""
    numbered = ordinal(entries, ["repo_id"], order, bucket, "row_no")
    return numbered.withColumn("page", F.ceil(F.col("row_no") / rows_per_page).cast("long"))


def write_pages(entries: DataFrame, path: str) -> None:
    """Pages as Parquet, a folder a repository. A page lies whole in one file, its rows next to each other, so that a page is
    read by its number from the row groups that hold it; files grow with the rows, not one with every page."""
    together = F.floor(F.col("page") / PAGES_TOGETHER)
    ordered = entries.repartition("repo_id", together).sortWithinPartitions("repo_id", "page")
    ordered.write.partitionBy("repo_id").mode("overwrite").parquet(path)


def write_relation(relation: DataFrame, path: str) -> None:
    """A relation as Parquet, partitioned by repository when it has one."""
    writer = relation.write.mode("overwrite")
    (writer.partitionBy("repo_id") if "repo_id" in relation.columns else writer).parquet(path)


def write_parted(rows: DataFrame, flag: Column, name: str, path: str) -> None:
    """Rows in one pass, those with and without a flag in folders of their own."""
    rows.withColumn(name, flag).write.mode("overwrite").partitionBy(name).parquet(path)


def read_parted(spark: SparkSession, path: str, name: str, flag: bool) -> DataFrame:
    """One side of what :func:`write_parted` wrote; the other side's files are not opened."""
    return spark.read.parquet(path).where(F.col(name).cast("boolean") == flag).drop(name)


def benchmark_report(results: DataFrame) -> DataFrame:
    """One JSON report line per target."""
    return results.select(F.to_json(F.struct(*sorted(results.columns))).alias("value"))


def write_report(results: DataFrame, path: str) -> None:
    benchmark_report(results).write.mode("overwrite").text(path)
