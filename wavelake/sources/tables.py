"""Event tables as tab-separated files, and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, nullValue="n/a", schema="onset double, duration double, trial_type string, channel string, value double, detector string, attrs string")


def write_events_tsv(events: DataFrame, path: str) -> None:
    """Seven columns in order of onset, rounded to milliseconds, range-sorted so that the parts follow each other."""
    cols = [F.round(F.col("onset"), 3).alias("onset"), *[F.col(c) for c in ("duration", "trial_type", "channel", "value", "detector", "attrs")]]
    events.select(*cols).orderBy("onset", "channel", "trial_type").write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="n/a")


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key a plain Parquet folder does not hold yet. For one writer at a time; ``ledger`` has tables for several."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(key).distinct(), key, "left_anti")
    rows.dropDuplicates([key]).write.mode("append").parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): lines that do not parse are kept apart, not lost."""
    raw = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("_bad is null").drop("_bad"), raw.where("_bad is not null").select(F.col("_bad").alias("line"))


def read_aggregates(spark: SparkSession, path: str, needed: dict[str, str]) -> DataFrame:
    """Rows of a multi-line JSON file of aggregates. A file without one of the ``needed`` fields, or with one of another
    kind ("number", "string" or "array"), is refused as a whole."""
    df = spark.read.option("multiLine", True).json(path)
    kinds = {"bigint": "number", "double": "number", "string": "string"}
    found = {f.name: kinds.get(f.dataType.simpleString(), f.dataType.typeName()) for f in df.schema.fields}
    wrong = sorted(c for c, k in needed.items() if found.get(c) != k)
    if wrong:
        raise ValueError(f"aggregates of another shape: {', '.join(wrong)}")
    return df
