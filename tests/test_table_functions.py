"""Table functions give what the DataFrame detectors give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import wavelake.catalog as catalog
from wavelake.functions.tables import register_table_functions
from wavelake.operators import detectors

SF = "/root/testdata/sf0.01"


def test_spindles_of_both_ways(spark):
    a, b = (sorted(map(tuple, catalog.queries()[n](spark, SF).collect())) for n in ("spindles", "spindles_in_sql"))
    assert [r[:6] for r in a] == [r[:6] for r in b] and len(a) > 10 and np.allclose([r[6] for r in a], [r[6] for r in b], rtol=1e-3)


def test_slow_waves_with_keys_of_other_types_gaps_and_nulls(spark):
    rng, per = np.random.default_rng(6), 512
    t = np.arange(12 * per) / 64
    x = 60 * np.sin(2 * np.pi * 0.7 * t) + 5 * rng.standard_normal(len(t))
    rows = [(1, "A", e, [float(v) for v in x[e * per: (e + 1) * per]]) for e in range(12) if e != 5] + [(1, "B", 3, [0.0] * per), (2, None, 0, None), (1, "A", None, [1.0])]
    df = spark.createDataFrame(rows, "rec long, ch string, epoch long, samples array<double>")
    want = sorted(map(tuple, detectors.slow_waves(df, 64.0, per, F.lit(40), core=4).collect()))
    register_table_functions(spark)
    df.withColumn("day", F.lit("2020-01-02").cast("date")).createOrReplaceTempView("traces_of_test")
    out = spark.sql("SELECT * FROM slow_waves(TABLE(traces_of_test) PARTITION BY (rec, ch, day), 64.0D, 512, 40)")
    assert out.schema["day"].dataType.typeName() == "date" and out.schema["rec"].dataType.typeName() == "long"
    got = sorted(map(tuple, out.drop("day").collect()))
    assert len(got) == len(want) > 40 and [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-3)


@pytest.mark.parametrize("call", ["TABLE(SELECT 1 AS rec, array(1D) AS samples) PARTITION BY rec, 64.0D, 512", "TABLE(SELECT 1 AS rec, 2 AS epoch, array(1D) AS samples) PARTITION BY rec, -1.0D, 512",
                                  "TABLE(SELECT 1 AS start_s, 2 AS epoch, array(1D) AS samples) PARTITION BY start_s, 64.0D, 512"])
def test_tables_of_another_shape_are_refused(spark, call):
    register_table_functions(spark)
    with pytest.raises(Exception, match="table|positive"):
        spark.sql(f"SELECT * FROM spindles({call})").collect()
