"""Longitudinal and registry queries: orders as dated recordings, lineitem as measurements, customers as a cohort."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavelake.functions import text as phi
from wavelake.operators import cohort, graph, joins, longitudinal, sequences
from wavelake.plans.base import S, query, samples, table

PIVOT = "1995-06-17"


def _visits(spark, d):
    return table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderkey", F.col("o_totalprice").alias("price"), "o_orderpriority")


@query("asof_before_after", f"""
WITH v AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey, o_totalprice AS price FROM orders),
b AS (SELECT o_custkey, max(struct_pack(d := d, k := o_orderkey, p := price)) AS x FROM v WHERE d < DATE '{PIVOT}' GROUP BY o_custkey),
a AS (SELECT o_custkey, min(struct_pack(d := d, k := o_orderkey, p := price)) AS x FROM v WHERE d >= DATE '{PIVOT}' GROUP BY o_custkey)
SELECT c.o_custkey, b.x.k AS before_key, a.x.k AS after_key, b.x.p AS before_price, a.x.p AS after_price, CAST(date_diff('day', b.x.d, a.x.d) AS INTEGER) AS gap_days
FROM (SELECT DISTINCT o_custkey FROM v) c LEFT JOIN b ON b.o_custkey = c.o_custkey LEFT JOIN a ON a.o_custkey = c.o_custkey""")
def asof_before_after(spark, d):
    """The last visit before a pivot and the first from it on."""
    v = _visits(spark, d).drop("o_orderpriority")
    out = joins.before_after_at(v, F.lit(PIVOT).cast("date"), ["o_custkey"], "d", "o_orderkey")
    return out.select("o_custkey", F.col("before.o_orderkey").alias("before_key"), F.col("after.o_orderkey").alias("after_key"), F.col("before.price").alias("before_price"),
                      F.col("after.price").alias("after_price"), F.datediff("after.d", "before.d").alias("gap_days"))


_METRICS = (("price", -1, 10.0), ("items", 1, 10.0), ("quantity", 0, 5.0))


@query("treatment_response", f"""
WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey, o_totalprice AS price, count(*) AS items, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT o_custkey, d, o_orderkey, 'price' AS metric, price AS v FROM o UNION ALL SELECT o_custkey, d, o_orderkey, 'items', items FROM o UNION ALL SELECT o_custkey, d, o_orderkey, 'quantity', quantity FROM o),
g AS (SELECT o_custkey, metric, max(struct_pack(d := d, k := o_orderkey, v := v)) FILTER (WHERE d < DATE '{PIVOT}') AS b, min(struct_pack(d := d, k := o_orderkey, v := v)) FILTER (WHERE d >= DATE '{PIVOT}') AS a FROM m GROUP BY ALL),
x AS (SELECT *, CASE WHEN b.v <> 0 THEN (a.v - b.v) / abs(b.v) * 100 END AS pct, CASE metric WHEN 'price' THEN -1 WHEN 'items' THEN 1 ELSE 0 END AS pol, CASE metric WHEN 'quantity' THEN 5.0 ELSE 10.0 END AS band FROM g)
SELECT o_custkey, metric, round(a.v - b.v, 4) AS delta, round(pct, 4) AS pct, date_diff('day', b.d, a.d) < 14 AS short_gap,
  CASE WHEN pct IS NULL THEN 'not_evaluable' WHEN abs(pct) < band THEN 'unchanged' WHEN pol = 0 THEN 'changed' WHEN pct * pol > 0 THEN 'improved' ELSE 'worsened' END AS label FROM x""")
def treatment_response(spark, d):
    """Every metric before and after the pivot, labelled by its polarity and dead band."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("double").alias("items"), F.sum("l_quantity").alias("quantity"))
    m = _visits(spark, d).join(li, "o_orderkey").unpivot(["o_custkey", "d", "o_orderkey"], ["price", "items", "quantity"], "metric", "v")
    out = joins.before_after_at(m, F.lit(PIVOT).cast("date"), ["o_custkey", "metric"], "d", "o_orderkey")
    dim = spark.createDataFrame([(n, p, b) for n, p, b in _METRICS], "metric string, polarity int, band double")
    pct = longitudinal.percent_change(F.col("before.v"), F.col("after.v"))
    label = F.when(pct.isNull(), "not_evaluable").when(F.abs(pct) < F.col("band"), "unchanged").otherwise(longitudinal.direction(pct, F.col("polarity"), 0.0))
    return out.join(F.broadcast(dim), "metric").select("o_custkey", "metric", F.round(F.col("after.v") - F.col("before.v"), 4).alias("delta"), F.round(pct, 4).alias("pct"),
                                                       (F.datediff("after.d", "before.d") < 14).alias("short_gap"), label.alias("label"))


@query("trend_long", f"""
WITH {S}, k AS (SELECT rec, epoch // 48 AS day, count(*) AS n, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS k, avg(value) AS value FROM s GROUP BY ALL)
SELECT rec, day, metric, round(v, 6) AS v FROM (SELECT rec, day, 'n' AS metric, CAST(n AS DOUBLE) AS v FROM k UNION ALL SELECT rec, day, 'k', k FROM k UNION ALL SELECT rec, day, 'value', value FROM k) WHERE v IS NOT NULL""")
def trend_long(spark, d):
    """Values read from nested documents by path, one row per metric and day."""
    s = samples(spark, d).withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "double"))
    k = s.groupBy("rec", F.floor(F.col("epoch") / 48).alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("k").alias("k"), F.avg("value").alias("value"))
    return k.unpivot(["rec", "day"], ["n", "k", "value"], "metric", "v").where("v is not null").withColumn("v", F.round("v", 6))


@query("spearman_rank", """
WITH v AS (SELECT o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS x, o_totalprice AS y FROM orders),
r AS (SELECT o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY x) + (count(*) OVER (PARTITION BY o_custkey, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY o_custkey ORDER BY y) + (count(*) OVER (PARTITION BY o_custkey, y) - 1) / 2.0::DOUBLE AS ry FROM v)
SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 4 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rx, ry), 6) + 0 END AS rho FROM r GROUP BY o_custkey""")
def spearman_rank(spark, d):
    """Rank correlation of value with time."""
    v = _visits(spark, d).select("o_custkey", "o_orderkey", F.datediff("d", F.lit("1990-01-01").cast("date")).alias("x"), F.col("price").alias("y"))
    return longitudinal.spearman(v, ["o_custkey"], "x", "y").withColumn("rho", F.round("rho", 6) + F.lit(0.0))


@query("slope_trajectory", """
WITH v AS (SELECT o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) / 365.25::DOUBLE AS x, o_totalprice / 1000 AS y, o_orderpriority FROM orders)
SELECT o_custkey, count(*) AS n, CASE WHEN var_pop(x) > 0 THEN round(regr_slope(y, x), 4) END AS slope, CASE WHEN var_pop(x) > 0 IS NOT TRUE THEN 'not_evaluable' WHEN abs(regr_slope(y, x)) < 5 THEN 'stable' WHEN regr_slope(y, x) > 0 THEN 'rising' ELSE 'falling' END AS label,
  count(DISTINCT o_orderpriority) > 1 AS mixed_channels FROM v GROUP BY o_custkey""")
def slope_trajectory(spark, d):
    """Least-squares slope over time, and a warning where parameters differ."""
    v = _visits(spark, d).select("o_custkey", (F.datediff("d", F.lit("1990-01-01").cast("date")) / F.lit(365.25)).alias("x"), (F.col("price") / 1000).alias("y"), "o_orderpriority")
    slope = F.when(F.var_pop("x") > 0, F.regr_slope("y", "x"))
    g = v.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), slope.alias("s"), F.countDistinct("o_orderpriority").alias("k"))
    return g.select("o_custkey", "n", F.round("s", 4).alias("slope"), longitudinal.slope_label(F.col("s"), 5.0).alias("label"), (F.col("k") > 1).alias("mixed_channels"))


@query("pre_post_delta_verdict", """
WITH m AS (SELECT l_suppkey, CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN 'pre' ELSE 'post' END AS side, avg(l_quantity) AS q, avg(l_discount) AS dc, avg(l_tax) AS tx FROM lineitem GROUP BY ALL),
u AS (SELECT l_suppkey, side, 'q' AS metric, q AS v FROM m UNION ALL SELECT l_suppkey, side, 'dc', dc FROM m UNION ALL SELECT l_suppkey, side, 'tx', tx FROM m),
p AS (SELECT a.l_suppkey, a.metric, (b.v - a.v) / abs(a.v) * 100 AS pct, CASE a.metric WHEN 'q' THEN 1 ELSE -1 END AS pol FROM u a JOIN u b ON a.l_suppkey = b.l_suppkey AND a.metric = b.metric AND a.side = 'pre' AND b.side = 'post'),
c AS (SELECT l_suppkey, count(*) FILTER (WHERE abs(pct) >= 5 AND pct * pol > 0) AS i, count(*) FILTER (WHERE abs(pct) >= 5 AND pct * pol < 0) AS w, count(*) FILTER (WHERE abs(pct) < 5) AS n FROM p GROUP BY l_suppkey)
SELECT l_suppkey, i AS improved, w AS worsened, n AS unchanged, CASE WHEN i + w + n = 0 THEN 'no_data' WHEN i > 0 AND w = 0 THEN 'improved' WHEN w > 0 AND i = 0 THEN 'worsened' WHEN i > w THEN 'mostly_improved' WHEN w > i THEN 'mostly_worsened'
  WHEN i + w = 0 THEN 'unchanged' ELSE 'mixed' END AS verdict FROM c""")
def pre_post_delta_verdict(spark, d):
    """Each metric before and after, counted into a verdict."""
    side = F.when(F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ'1995-06-17 00:00:00'"), "pre").otherwise("post")
    m = table(spark, d, "lineitem").groupBy("l_suppkey", side.alias("side")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("dc"), F.avg("l_tax").alias("tx"))
    u = m.unpivot(["l_suppkey", "side"], ["q", "dc", "tx"], "metric", "v")
    p = u.groupBy("l_suppkey", "metric").agg(F.max(F.when(F.col("side") == "pre", F.col("v"))).alias("a"), F.max(F.when(F.col("side") == "post", F.col("v"))).alias("b")).where("a is not null and b is not null")
    # a change from 0 is infinite and one from 0 to 0 NaN in SQL: both count as 5 % or more, and NaN as over 0
    gap, none = F.col("b") - F.col("a"), F.when(F.col("b") > 0, F.lit(float("inf"))).when(F.col("b") < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    pct = F.when(F.col("a") != 0, gap / F.abs(F.col("a")) * 100).otherwise(none)
    good = pct * F.when(F.col("metric") == "q", 1).otherwise(-1)
    c = p.groupBy("l_suppkey").agg(F.count_if((F.abs(pct) >= 5) & (good > 0)).alias("improved"), F.count_if((F.abs(pct) >= 5) & (good < 0)).alias("worsened"), F.count_if(F.abs(pct) < 5).alias("unchanged"))
    return c.withColumn("verdict", longitudinal.verdict(F.col("improved"), F.col("worsened"), F.col("unchanged")))


@query("top5_shift", """
WITH q AS (SELECT l_returnflag AS side, l_suppkey AS ch, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY v DESC, ch) AS rn FROM q), t AS (SELECT side, ch FROM r WHERE rn <= 5),
o AS (SELECT count(*) AS overlap FROM t a JOIN t b ON a.ch = b.ch AND a.side = 'A' AND b.side = 'R'),
f AS (SELECT coalesce(a.ch, b.ch) AS ch, coalesce(b.v, 0) - coalesce(a.v, 0) AS delta FROM (SELECT * FROM q WHERE side = 'A') a FULL JOIN (SELECT * FROM q WHERE side = 'R') b ON a.ch = b.ch)
SELECT CAST((SELECT overlap FROM o) AS BIGINT) AS overlap, (SELECT overlap FROM o) >= 3 AS preserved, count(*) AS n_channels, round(sum(abs(delta)), 4) AS moved, round((SELECT stddev_pop(v) / avg(v) FROM q WHERE side = 'R'), 6) AS cv FROM f""")
def top5_shift(spark, d):
    """Overlap of the five strongest channels of two recordings, with a full outer join of all."""
    q = table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')").groupBy(F.col("l_returnflag").alias("side"), F.col("l_suppkey").alias("ch")).agg(F.sum("l_quantity").alias("v"))
    top = q.withColumn("rn", F.row_number().over(W.partitionBy("side").orderBy(F.desc("v"), "ch"))).where("rn <= 5")
    top = top.groupBy("ch").agg(F.countDistinct("side").alias("k")).agg(F.count_if(F.col("k") == 2).alias("overlap"))
    a, b = (q.where(F.col("side") == s).select("ch", F.col("v").alias(n)) for s, n in (("A", "va"), ("R", "vb")))
    f = a.join(b, "ch", "full").agg(F.count(F.lit(1)).alias("n_channels"), F.round(F.sum(F.abs(F.coalesce("vb", F.lit(0.0)) - F.coalesce("va", F.lit(0.0)))), 4).alias("moved"),
                                    F.round(F.stddev_pop("vb") / F.avg("vb"), 6).alias("cv"))
    return top.crossJoin(f).select("overlap", (F.col("overlap") >= 3).alias("preserved"), "n_channels", "moved", "cv")


_NORMS = ((-1000.0, 0.0, -500.0, 250.0, True), (0.0, 3000.0, 1500.0, 900.0, True), (3000.0, 6000.0, 4500.0, 800.0, False), (6000.0, 8000.0, 7000.0, 0.0, True))
_NORM_SQL = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {m}::DOUBLE, {s}::DOUBLE, {v})" for a, b, m, s, v in _NORMS)


@query("normative_z", f"""
WITH n AS (SELECT * FROM (VALUES {_NORM_SQL}) t(lo, hi, mean, sd, verified))
SELECT c_custkey, CASE WHEN sd > 0 THEN round((c_acctbal - mean) / sd, 6) END AS z, verified, CASE WHEN sd IS NULL THEN 'outside' WHEN sd <= 0 THEN 'no_spread' WHEN abs(c_acctbal - mean) <= 2 * sd THEN 'typical' ELSE 'unusual' END AS label
FROM customer LEFT JOIN n ON c_acctbal >= lo AND c_acctbal < hi""")
def normative_z(spark, d):
    """Distance from the norm of the half-open bin; null outside the bins or without a spread."""
    dim = spark.createDataFrame(list(_NORMS), "lo double, hi double, mean double, sd double, verified boolean")
    c = joins.lookup_bin(table(spark, d, "customer").select("c_custkey", "c_acctbal"), dim, F.col("c_acctbal"))
    off = F.col("c_acctbal") - F.col("mean")
    label = F.when(F.col("sd").isNull(), "outside").when(F.col("sd") <= 0, "no_spread").when(F.abs(off) <= 2 * F.col("sd"), "typical").otherwise("unusual")
    return c.select("c_custkey", F.when(F.col("sd") > 0, F.round(off / F.col("sd"), 6)).alias("z"), "verified", label.alias("label"))


def _cohort(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")


_COHORT = "c AS (SELECT c_custkey, n_regionkey AS region, n_nationkey AS nation, c_mktsegment AS segment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("cohort_cells_kanon", f"""
WITH {_COHORT} SELECT region, nation, segment, CAST(grouping(region, nation, segment) AS BIGINT) AS level_id, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd,
  round(quantile_cont(c_acctbal, 0.1), 4) AS p10, round(quantile_cont(c_acctbal, 0.25), 4) AS p25, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS p75, round(quantile_cont(c_acctbal, 0.9), 4) AS p90, min(c_acctbal) AS lo, max(c_acctbal) AS hi
FROM c GROUP BY GROUPING SETS ((region, nation, segment), (region, nation), (region), ()) HAVING count(c_acctbal) >= 5""")
def cohort_cells_kanon(spark, d):
    """Statistics of every cohort cell of four levels; small cells are withheld."""
    out = cohort.cells(_cohort(spark, d), [["region", "nation", "segment"], ["region", "nation"], ["region"], []], ["region", "nation", "segment"], "c_acctbal")
    return out.select("region", "nation", "segment", F.col("level_id").cast("bigint").alias("level_id"), "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "p10", "p25", "median", "p75", "p90")], "lo", "hi")


@query("percentile_rank_interp", f"""
WITH {_COHORT}, a AS (SELECT nation, min(c_acctbal) AS v0, quantile_cont(c_acctbal, 0.1) AS v1, quantile_cont(c_acctbal, 0.25) AS v2, quantile_cont(c_acctbal, 0.5) AS v3, quantile_cont(c_acctbal, 0.75) AS v4, quantile_cont(c_acctbal, 0.9) AS v5, max(c_acctbal) AS v6 FROM c GROUP BY nation HAVING count(*) >= 5),
p AS (SELECT c_custkey, c_acctbal AS x, v0, v1, v2, v3, v4, v5, v6 FROM c JOIN a USING (nation))
SELECT c_custkey, round(CASE WHEN x <= v1 THEN CASE WHEN v1 = v0 THEN 5.0 ELSE (x - v0) / (v1 - v0) * 10 END WHEN x <= v2 THEN 10 + (x - v1) / (v2 - v1) * 15 WHEN x <= v3 THEN 25 + (x - v2) / (v3 - v2) * 25
  WHEN x <= v4 THEN 50 + (x - v3) / (v4 - v3) * 25 WHEN x <= v5 THEN 75 + (x - v4) / (v5 - v4) * 15 ELSE 90 + (x - v5) / (v6 - v5) * 10 END, 4) AS pct FROM p""")
def percentile_rank_interp(spark, d):
    """Percentile of each member inside its cell, linear between published anchors."""
    c = _cohort(spark, d)
    q = F.percentile("c_acctbal", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    a = c.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), q.alias("q")).where("n >= 5")
    x = c.join(a, "nation")
    anchors = [(F.col("lo"), 0.0), *[(F.element_at("q", i + 1), p) for i, p in enumerate((10.0, 25.0, 50.0, 75.0, 90.0))], (F.col("hi"), 100.0)]
    return x.select("c_custkey", F.round(cohort.percentile_rank(F.col("c_acctbal"), anchors), 4).alias("pct"))


@query("cohort_best_cell", f"""
WITH {_COHORT}, f AS (SELECT nation, segment, count(*) AS n, median(c_acctbal) AS m FROM c GROUP BY ALL HAVING count(*) >= 14), g AS (SELECT nation, count(*) AS n, median(c_acctbal) AS m FROM c GROUP BY ALL HAVING count(*) >= 60),
h AS (SELECT region, count(*) AS n, median(c_acctbal) AS m FROM c GROUP BY ALL HAVING count(*) >= 5)
SELECT c_custkey, CASE WHEN f.n IS NOT NULL THEN 0 WHEN g.n IS NOT NULL THEN 1 WHEN h.n IS NOT NULL THEN 2 END AS level, coalesce(f.n, g.n, h.n) AS cell_n, round(coalesce(f.m, g.m, h.m), 4) AS cell_stat
FROM c LEFT JOIN f ON f.nation = c.nation AND f.segment = c.segment LEFT JOIN g ON g.nation = c.nation LEFT JOIN h ON h.region = c.region""")
def cohort_best_cell(spark, d):
    """The finest published cell that a member falls into."""
    c = _cohort(spark, d)
    levels = [(["nation", "segment"], 14), (["nation"], 60), (["region"], 5)]
    cells = None
    for rank, (keys, least) in enumerate(levels):
        g = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("c_acctbal").alias("stat")).where(F.col("n") >= least)
        g = g.select(F.lit(rank).alias("level"), *[(F.col(k) if k in keys else F.lit(None).cast(c.schema[k].dataType)).alias(k) for k in ("region", "nation", "segment")], "n", "stat")
        cells = g if cells is None else cells.unionByName(g)
    out = joins.first_cell(c, cells, [k for k, _ in levels], "c_custkey")
    return out.select("c_custkey", "level", "cell_n", F.round("cell_stat", 4).alias("cell_stat"))


@query("bucketize_balance", """
SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN '0' WHEN c_acctbal < 0 THEN '<0' WHEN c_acctbal < 1000 THEN '0-1k' WHEN c_acctbal < 5000 THEN '1k-5k' ELSE '5k+' END AS bucket FROM customer""")
def bucketize_balance(spark, d):
    """2.13: half-open buckets with a label of its own for an exact zero."""
    return table(spark, d, "customer").select("c_custkey", cohort.bucket(F.col("c_acctbal"), [0, 1000, 5000], ["<0", "0-1k", "1k-5k", "5k+"], zero="0").alias("bucket"))


@query("phi_scan", phi.PHI_SQL)
def phi_scan(spark, d):
    """2.13: which identifier patterns a text holds, over all documents."""
    return phi.scan(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.array_join("findings", ",").alias("findings"), "clean")


@query("validate_errors", """
SELECT o_orderkey, concat_ws(',', CASE WHEN NOT (o_orderstatus IN ('O', 'F')) THEN 'status' END, CASE WHEN NOT (o_totalprice BETWEEN 1000 AND 400000) THEN 'price_range' END,
  CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-') THEN 'priority' END, CASE WHEN NOT (o_orderdate >= TIMESTAMP '1993-01-01') THEN 'too_early' END) AS errors FROM orders""")
def validate_errors(spark, d):
    """A list of every rule that a row breaks."""
    rules = {"status": F.col("o_orderstatus").isin("O", "F"), "price_range": F.col("o_totalprice").between(1000, 400000), "priority": F.col("o_orderpriority").rlike("^[1-3]-"),
             "too_early": F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ'1993-01-01 00:00:00'")}
    return table(spark, d, "orders").select("o_orderkey", F.array_join(phi.broken_rules(rules), ",").alias("errors"))


@query("pair_edges_corr", """
WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id < 60)
SELECT a.vec_id AS ch_i, b.vec_id AS ch_j, round(corr(a.x, b.x), 6) AS w FROM v a JOIN v b ON a.i = b.i AND a.label = b.label AND a.vec_id < b.vec_id GROUP BY ALL""")
def pair_edges_corr(spark, d):
    """Correlation of all channel pairs of one montage (the 60 channels with the lowest numbers), as edges."""
    v = table(spark, d, "embeddings").where("vec_id < 60").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    a, b = v.alias("a"), v.alias("b")
    j = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") < F.col("b.vec_id")))
    x, y = F.col("a.x").cast("double"), F.col("b.x").cast("double")
    return j.groupBy(F.col("a.vec_id").alias("ch_i"), F.col("b.vec_id").alias("ch_j")).agg(F.round(F.corr(x, y), 6).alias("w"))


@query("pair_edges_montages")
def pair_edges_montages(spark, d):
    """Correlation of all channel pairs of every montage, as edges; a montage is a label's channels of one run of 60 numbers."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 60).alias("m"), F.posexplode("embedding").alias("i", "x"))
    a, b = v.alias("a"), v.alias("b")
    j = a.join(b, (F.col("a.m") == F.col("b.m")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") < F.col("b.vec_id")))
    x, y = F.col("a.x").cast("double"), F.col("b.x").cast("double")
    return j.groupBy(F.col("a.vec_id").alias("ch_i"), F.col("b.vec_id").alias("ch_j")).agg(F.round(F.corr(x, y), 6).alias("w"))


@query("graph_strength_clustering", """
WITH e0 AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100 + 1) AS i, greatest(l_suppkey, l_partkey % 100 + 1) AS j FROM lineitem WHERE l_suppkey <> l_partkey % 100 + 1 AND l_quantity > 45),
e AS (SELECT i, j FROM e0 UNION ALL SELECT j, i FROM e0), deg AS (SELECT i, count(*) AS k FROM e GROUP BY i),
t AS (SELECT a.i, count(*) AS tri FROM e a JOIN e b ON a.j = b.i JOIN e c ON b.j = c.j AND c.i = a.i WHERE b.j <> a.i GROUP BY a.i)
SELECT deg.i AS node, k AS degree, CASE WHEN k >= 2 THEN round(coalesce(tri, 0) / (k * (k - 1))::DOUBLE, 6) ELSE 0.0::DOUBLE END AS clustering FROM deg LEFT JOIN t ON t.i = deg.i""")
def graph_strength_clustering(spark, d):
    """Degree and clustering of each node, from edges that point to the larger degree."""
    other = F.col("l_partkey") % 100 + 1
    e0 = table(spark, d, "lineitem").where((F.col("l_suppkey") != other) & (F.col("l_quantity") > 45)).select(F.least("l_suppkey", other).alias("i"), F.greatest("l_suppkey", other).alias("j")).distinct()
    tri = graph.triangles(e0).select(F.col("node").alias("i"), (2 * F.col("triangles")).alias("tri"))
    deg = e0.select(F.explode(F.array("i", "j")).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("k")).join(tri, "i", "left")
    share = F.coalesce("tri", F.lit(0)) / (F.col("k") * (F.col("k") - 1))
    return deg.select(F.col("i").alias("node"), F.col("k").alias("degree"), F.when(F.col("k") >= 2, F.round(share, 6)).otherwise(0.0).alias("clustering"))


@query("network_mean_top3", """
WITH p AS (SELECT p_partkey % 10 AS ch, p_retailprice AS v FROM part), m AS (SELECT ch, median(v) AS med FROM p GROUP BY ch), n AS (SELECT ch, med, 'net' || (ch % 4) AS net FROM m UNION ALL SELECT ch, med, 'net' || (ch % 3 + 2) FROM m),
a AS (SELECT net, avg(med) AS score, count(*) AS n FROM n GROUP BY net) SELECT net, round(score, 6) AS score, n, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, net) AS rn FROM a) WHERE rn <= 3""")
def network_mean_top3(spark, d):
    """A channel belongs to several networks; the three of highest mean."""
    m = table(spark, d, "part").groupBy((F.col("p_partkey") % 10).alias("ch")).agg(F.median("p_retailprice").alias("med"))
    nets = F.array(F.concat(F.lit("net"), (F.col("ch") % 4).cast("string")), F.concat(F.lit("net"), (F.col("ch") % 3 + 2).cast("string")))
    a = m.withColumn("net", F.explode(nets)).groupBy("net").agg(F.avg("med").alias("score"), F.count(F.lit(1)).alias("n"))
    return a.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "net"))).where("rank <= 3").select("net", F.round("score", 6).alias("score"), "n", "rank")


@query("homologous_asymmetry", """
WITH m AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY ALL) SELECT l.k AS left_key, r.k AS right_key, round((r.v - l.v) / (r.v + l.v), 6) AS asymmetry FROM m l JOIN m r ON r.k = l.k + 1 AND l.k % 2 = 0""")
def homologous_asymmetry(spark, d):
    """(R - L) / (R + L) of paired channels."""
    m = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    r = m.select((F.col("k") - 1).alias("k"), F.col("k").alias("right_key"), F.col("v").alias("vr"))
    return m.where("k % 2 = 0").join(r, "k").select(F.col("k").alias("left_key"), "right_key", F.round((F.col("vr") - F.col("v")) / (F.col("vr") + F.col("v")), 6).alias("asymmetry"))


@query("pattern_score_gated", """
WITH f AS (SELECT l_orderkey, sum(l_quantity) AS q, avg(l_discount) AS dc, max(l_tax) AS tx, count(*) AS n FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, 'bulk' AS pattern, 2.0 AS w, TRUE AS req, q > 100 AS ok FROM f UNION ALL SELECT l_orderkey, 'bulk', 1.0, FALSE, n >= 4 FROM f UNION ALL SELECT l_orderkey, 'bulk', 1.0, FALSE, dc > 0.05 FROM f
  UNION ALL SELECT l_orderkey, 'taxed', 1.0, TRUE, tx > 0.05 FROM f UNION ALL SELECT l_orderkey, 'taxed', 1.0, FALSE, dc < 0.04 FROM f),
g AS (SELECT l_orderkey, pattern, bool_and(ok OR NOT req) AS gate, sum(CASE WHEN ok THEN w ELSE 0 END) / sum(w)::DOUBLE AS score FROM c GROUP BY ALL)
SELECT l_orderkey, pattern, round(CASE WHEN gate THEN score ELSE 0 END, 6) AS confidence, CASE WHEN NOT gate OR score < 0.3 THEN 'none' WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.5 THEN 'moderate' ELSE 'weak' END AS label FROM g""")
def pattern_score_gated(spark, d):
    """Weighted criteria with required ones as gates."""
    t = table(spark, d, "lineitem")
    # many means are 0.05 or 0.04 to the last digit, which hangs on the order of addition: that of the rows, however the files are cut
    at = [*([F.col("_metadata.file_path").alias("file")] if len(t.inputFiles()) > 1 else []), F.col("_metadata.row_index").alias("row")]
    t = t.select("l_orderkey", "l_quantity", "l_tax", F.when(F.col("l_discount").isNotNull(), F.struct(*at, F.col("l_discount").alias("v"))).alias("dc"))
    f = t.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.array_sort(F.collect_list("dc")).alias("dc"), F.max("l_tax").alias("tx"), F.count(F.lit(1)).alias("n"))
    f = f.withColumn("dc", F.try_divide(F.aggregate("dc.v", F.lit(0.0), lambda a, b: a + b), F.size("dc")))
    rules = [("bulk", 2.0, True, F.col("q") > 100), ("bulk", 1.0, False, F.col("n") >= 4), ("bulk", 1.0, False, F.col("dc") > 0.05), ("taxed", 1.0, True, F.col("tx") > 0.05), ("taxed", 1.0, False, F.col("dc") < 0.04)]
    c = f.select("l_orderkey", F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(w).alias("w"), F.lit(r).alias("req"), ok.alias("ok")) for p, w, r, ok in rules])).alias("c")).select("l_orderkey", "c.*")
    g = c.groupBy("l_orderkey", "pattern").agg(F.bool_and(F.col("ok") | ~F.col("req")).alias("gate"), (F.sum(F.when(F.col("ok"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("score"))
    label = F.when(~F.col("gate") | (F.col("score") < 0.3), "none").when(F.col("score") >= 0.75, "strong").when(F.col("score") >= 0.5, "moderate").otherwise("weak")
    return g.select("l_orderkey", "pattern", F.round(F.when(F.col("gate"), F.col("score")).otherwise(0.0), 6).alias("confidence"), label.alias("label"))


@query("full_outer_channels", """
WITH a AS (SELECT s_nationkey AS k, sum(s_acctbal) AS v FROM supplier GROUP BY ALL), b AS (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer WHERE c_nationkey < 15 GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS k, round(coalesce(a.v, 0), 4) AS va, round(coalesce(b.v, 0), 4) AS vb FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_channels(spark, d):
    """Channels of either recording, a missing one as 0."""
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("va"))
    b = table(spark, d, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("vb"))
    return a.join(b, "k", "full").select("k", F.round(F.coalesce("va", F.lit(0.0)), 4).alias("va"), F.round(F.coalesce("vb", F.lit(0.0)), 4).alias("vb"))


@query("full_outer_all_channels")
def full_outer_all_channels(spark, d):
    """Channels of either recording with all customers, a missing one as 0."""
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("va"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("vb"))
    return a.join(b, "k", "full").select("k", F.round(F.coalesce("va", F.lit(0.0)), 4).alias("va"), F.round(F.coalesce("vb", F.lit(0.0)), 4).alias("vb"))


@query("table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts(spark, d):
    """Rows of each table."""
    one = lambda t: table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n")
    return one("orders").unionByName(one("events")).unionByName(one("documents"))


@query("permutation_p")
def permutation_p(spark, d):
    """Exact or seeded permutation test of the rank correlation, one group per customer."""
    v = _visits(spark, d).select("o_custkey", "o_orderkey", F.datediff("d", F.lit("1990-01-01").cast("date")).alias("x"), F.col("price").alias("y"))
    few = v.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return longitudinal.permutation_p(v.join(few.where("n >= 8"), "o_custkey"), ["o_custkey"], "x", "y", order="o_orderkey").withColumn("p", F.round("p", 8))


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    """Seeded percentile bootstrap of the mean value of each recording, its epochs drawn as blocks."""
    out = longitudinal.block_bootstrap_ci(samples(spark, d), ["rec"], "epoch", "value", draws=500)
    return out.select("rec", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")])


@query("bootstrap_median_ci")
def bootstrap_median_ci(spark, d):
    """The same for the median, exact for every draw."""
    out = longitudinal.block_bootstrap_ci(samples(spark, d), ["rec"], "epoch", "value", draws=200, aggregate="median")
    return out.select("rec", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")])
