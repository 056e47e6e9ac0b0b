"""File sources and sinks beyond parquet: ZIP packages, CSV score tables, XML attributes, recursive folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORM_NAME = "^([A-Z]{4})_([^_]+)_([A-Z]{2})\\.pdf$"


def discover_forms(spark: SparkSession, folder: str) -> DataFrame:
    """(form, version, languages, paths) of the files named CODE_VERSION_LANG.pdf below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select("path", *[F.regexp_extract(name, FORM_NAME, k).alias(n) for k, n in enumerate(("form", "version", "lang"), 1)]).where("form <> ''")
    return parts.groupBy("form", "version").agg(F.array_sort(F.collect_set("lang")).alias("languages"), F.array_sort(F.collect_list("path")).alias("paths"))


def read_zip_members(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """(path, member, content) of every member of every ZIP file, one package per task row."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"path": [path], "member": [info.filename], "content": [z.read(info)]})

    return rows.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A score table as written by ``write_scores``."""
    schema = "form_code string, status string, translation_rating double, missing_translation_score double, semantic_match_score double, labelled_fields_score double, total_score double"
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores with three decimals and their AVERAGE row, best first."""
    numbers = [c for c, kind in scores.dtypes if kind == "double"]
    mean = scores.agg(*[F.avg(c).alias(c) for c in numbers]).select(F.lit("AVERAGE").alias("form_code"), F.lit("").alias("status"), *numbers)
    both = scores.withColumn("last", F.lit(0)).unionByName(mean.withColumn("last", F.lit(1)))
    ordered = both.orderBy("last", F.desc("total_score"), "form_code").drop("last")
    ordered.select(*[F.format_string("%.3f", c).alias(c) if c in numbers else c for c in scores.columns]).write.mode("overwrite").option("header", "true").csv(path)


def xml_rows(df: DataFrame, xml: str, schema: str) -> DataFrame:
    """``df`` with its XML column parsed by a fixed schema."""
    return df.withColumn("parsed", F.from_xml(xml, schema))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of text files below a folder, whole."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
