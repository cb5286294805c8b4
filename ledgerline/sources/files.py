"""Files in and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import fiscal as fi


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, company, filing_type, text) of a tree root/company/filing_type/file, one row a file."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    parts = F.split("path", "/")
    return files.select("path", F.try_element_at(parts, F.lit(-3)).alias("company"), F.try_element_at(parts, F.lit(-2)).alias("filing_type"), "text")


FACTS = "entity string, concepts map<string, struct<units: map<string, array<struct<start: string, `end`: string, val: double, form: string>>>>>"


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    """(entity, concepts) of facts as JSON; ``xbrl.facts_from_map`` makes long rows of them."""
    raw = spark.read.schema(FACTS).json(path)
    return raw.select("entity", F.transform_values("concepts", lambda _, c: c["units"]).alias("concepts"))


def filing_index(index: DataFrame, forms: list[str]) -> DataFrame:
    """Rows of an index kept as parallel arrays (company, form, day, accession), wanted forms only."""
    rows = index.select("company", F.inline(F.arrays_zip("form", "day", "accession")))
    return rows.where(F.col("form").isin(forms))


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    df.write.mode("overwrite").option("header", "true").format(fmt).save(path)


def ingest_summary(files: DataFrame, *keys: str) -> DataFrame:
    """Files processed, chunks added and errors of an ingest job, from one row a file (chunks, error)."""
    ok = F.col("error").isNull()
    return files.groupBy(*keys).agg(F.count_if(ok).alias("files_processed"), F.coalesce(F.sum(F.when(ok, F.col("chunks"))), F.lit(0)).cast("long").alias("chunks_added"), F.count_if(~ok).alias("errors"))


def recent_filings(index: DataFrame, forms: list[str], as_of: str, days: int, fy_end_month: int) -> DataFrame:
    """Wanted forms of the last days with a filing id (company_form_day) and their fiscal year and quarter."""
    rows = filing_index(index, forms).where(F.col("day").between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))
    month = F.lit(fy_end_month)
    label = fi.short_label(F.col("day"), month), F.concat(F.lit("Q"), fi.fiscal_quarter(F.col("day"), month).cast("string"))
    return rows.select("company", "form", "accession", F.concat_ws("_", "company", "form", F.col("day").cast("string")).alias("filing_id"), label[0].alias("fy"), label[1].alias("quarter"))


def log_append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def cache_summary(log: DataFrame, key: str, at: str) -> DataFrame:
    """Rows and last fetch of each key of a log."""
    return log.groupBy(key).agg(F.count("*").alias("n"), F.max(at).alias("last"))
