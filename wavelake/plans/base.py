"""Registration of queries and the frames that several of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Length of an epoch of the event tables, and the stages that stand in for a hypnogram.
EPOCH_US = 1_800_000_000
STAGES = ("W", "N1", "N2", "N3", "N2", "REM")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)  # kernels run wherever the executors are
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a long table of samples: recording (user), channel (type), place in time, epoch."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("rec"), F.col("event_type").alias("ch"), "value", micros().alias("us"), "props").withColumn(
        "t_s", F.col("us") / F.lit(1e6)).withColumn("epoch", F.floor(F.col("us") / F.lit(EPOCH_US)))


#: Stored sample blocks: a vector of embeddings is a block of 64 samples; eight blocks make an epoch of 8 s at 64 Hz.
FS, UV = 64.0, 400.0


#: Samples of a whole epoch.
PER_EPOCH = 512


def stored_epochs(spark: SparkSession, sf_dir: str, loud: int | None = None) -> DataFrame:
    """embeddings as stored epochs: rec, ch, epoch, samples (µV). Recording, channel and epoch follow from a block's id,
    so an epoch holds eight blocks and a recording 16 epochs of four channels, whatever the size of the table.

    With ``loud``, a block whose label is that or more is ten times as large: events for detectors."""
    blocks = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 512").alias("rec"), F.concat(F.lit("C"), F.col("vec_id") % 4).alias("ch"), F.expr("(vec_id div 32) % 16").alias("epoch"), "vec_id", "embedding" if loud is None else F.transform("embedding", lambda x: x * F.when(F.col("label") >= loud, 10).otherwise(1)).alias("embedding"))
    held = blocks.groupBy("rec", "ch", "epoch").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("b"))
    return held.select("rec", "ch", "epoch", F.transform(F.flatten("b.embedding"), lambda x: x.cast("double") * UV).alias("samples"))


E = f"""e AS (SELECT vec_id // 512 AS rec, 'C' || (vec_id % 4) AS ch, (vec_id // 32) % 16 AS epoch,
  list_transform(flatten(list(embedding ORDER BY vec_id)), lambda x: CAST(x AS DOUBLE) * {UV}) AS samples FROM embeddings GROUP BY ALL)"""


def stage_of(epoch):
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.pmod(epoch, F.lit(len(STAGES))) + 1).cast("int"))


#: The same frames in SQL, to start a query with.
S = f"""s AS (SELECT event_id, user_id AS rec, event_type AS ch, value, epoch_us(ts) AS us, props, epoch_us(ts) / 1e6 AS t_s,
  CAST(epoch_us(ts) // {EPOCH_US} AS BIGINT) AS epoch FROM events)"""
_CASES = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STAGES))


def stage_sql(epoch: str) -> str:
    return f"(CASE {epoch} % {len(STAGES)} {_CASES} END)"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to five digits."""
    return df.select(*[F.round(f.name, 5).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])
