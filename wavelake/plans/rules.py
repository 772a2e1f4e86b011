"""Rule and registry queries: activation, ensembles, screens, terminology, submissions, scans and record keeping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavelake.functions import registry
from wavelake.functions import text as texts
from wavelake.operators import sequences
from wavelake.plans.base import S, query, samples, stage_of, stage_sql, table
from wavelake.session import shared_dir
from wavelake.sources.ledger import Ledger


@query("submission_scan", f"""
WITH f AS (SELECT doc_id, {texts.SUBMISSION_SQL.format(t='text')} AS findings FROM documents)
SELECT doc_id, findings, findings = '' AS clean FROM f""")
def submission_scan(spark, d):
    """2.13: all identifier patterns, the length rule and letters beyond ASCII, on whole texts."""
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", texts.submission_findings(F.col("text"))).alias("findings")).withColumn("clean", F.col("findings") == "")


@query("document_scan", f"""
WITH d AS (SELECT conv_id, turn, to_json({{'id': conv_id, 'said': {{'role': role, 'parts': [{{'text': text}}]}}}}) AS doc FROM conversations),
l AS (SELECT conv_id, turn, j.fullkey AS path, j.atom ->> '$' AS text FROM d, json_tree(d.doc) j WHERE j.type = 'VARCHAR'),
f AS (SELECT conv_id, turn, path, {texts.SUBMISSION_SQL.format(t='text')} AS findings FROM l)
SELECT conv_id, turn, path, findings FROM f WHERE findings <> ''""")
def document_scan(spark, d):
    """2.13: every string of nested documents, by its path, and what it should not hold."""
    part = F.struct(F.col("role"), F.array(F.struct("text")).alias("parts"))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.col("conv_id").alias("id"), part.alias("said"))).alias("doc"))
    return registry.scan_documents(c, ["conv_id", "turn"], "doc", fold=False).withColumn("findings", F.concat_ws(",", "findings"))


RATES = f"""{S}, e AS (SELECT rec, epoch, {stage_sql('epoch')} AS stage, count(*) FILTER (WHERE value > 50) AS hits FROM s GROUP BY ALL),
r AS (SELECT rec, coalesce(sum(hits) FILTER (WHERE stage = 'W') / nullif(30.0::DOUBLE * count(*) FILTER (WHERE stage = 'W'), 0), 0) AS wake,
  coalesce(sum(hits) FILTER (WHERE stage IN ('N2', 'N3')) / nullif(30.0::DOUBLE * count(*) FILTER (WHERE stage IN ('N2', 'N3')), 0), 0) AS nrem,
  coalesce(100.0::DOUBLE * count(*) FILTER (WHERE stage = 'N3' AND hits > 0) / nullif(count(*) FILTER (WHERE stage = 'N3'), 0), 0) AS n3,
  coalesce(100.0::DOUBLE * count(*) FILTER (WHERE stage IN ('N2', 'N3') AND hits > 0) / nullif(count(*) FILTER (WHERE stage IN ('N2', 'N3')), 0), 0) AS deep FROM e GROUP BY rec)"""


@query("sleep_activation", f"""
WITH {RATES}, a AS (SELECT *, CASE WHEN wake < 0.01::DOUBLE THEN 0 ELSE nrem / wake END AS ratio FROM r),
k AS (SELECT *, least(0.5::DOUBLE, ratio / 20) + least(0.3::DOUBLE, n3 / 85 * 0.3::DOUBLE) + least(0.2::DOUBLE, deep / 50 * 0.2::DOUBLE) AS risk FROM a)
SELECT rec, round(ratio, 5) AS ratio, CASE WHEN wake < 0.01::DOUBLE THEN 'indeterminate' WHEN ratio < 0.7::DOUBLE THEN 'wake_dominant' WHEN ratio < 1.5::DOUBLE THEN 'none' WHEN ratio < 3 THEN 'mild' WHEN ratio < 10 THEN 'moderate' ELSE 'strong' END AS activation,
  round(least(1.0::DOUBLE, CASE WHEN n3 >= 85 THEN greatest(risk, 0.85::DOUBLE) ELSE risk END), 5) AS risk FROM k""")
def sleep_activation(spark, d):
    """R2: rate in sleep over rate awake, its class, and the risk score of its three parts (0.85 at least if the criterion is met)."""
    e = samples(spark, d).groupBy("rec", "epoch").agg(F.count_if(F.col("value") > 50).alias("hits")).withColumn("stage", stage_of(F.col("epoch")))
    deep, wake, n3 = F.col("stage").isin("N2", "N3"), F.col("stage") == "W", F.col("stage") == "N3"
    some = lambda on: F.nullif(F.count_if(on), F.lit(0))
    rate = lambda on: F.coalesce(F.sum(F.when(on, F.col("hits"))) / (30.0 * some(on)), F.lit(0.0))
    share = lambda on: F.coalesce(100.0 * F.count_if(on & (F.col("hits") > 0)) / some(on), F.lit(0.0))
    r = e.groupBy("rec").agg(rate(wake).alias("wake"), rate(deep).alias("nrem"), share(n3).alias("n3"), share(deep).alias("deep"))
    r = r.withColumn("ratio", F.when(F.col("wake") < 0.01, 0.0).otherwise(F.col("nrem") / F.col("wake")))
    risk = F.least(F.lit(0.5), F.col("ratio") / 20) + F.least(F.lit(0.3), F.col("n3") / 85 * 0.3) + F.least(F.lit(0.2), F.col("deep") / 50 * 0.2)
    kind = F.when(F.col("wake") < 0.01, "indeterminate")
    for limit, name in ((0.7, "wake_dominant"), (1.5, "none"), (3, "mild"), (10, "moderate")):
        kind = kind.when(F.col("ratio") < limit, name)
    return r.select("rec", F.round("ratio", 5).alias("ratio"), kind.otherwise("strong").alias("activation"),
                    F.round(F.least(F.lit(1.0), F.when(F.col("n3") >= 85, F.greatest(risk, F.lit(0.85))).otherwise(risk)), 5).alias("risk"))


#: Upper edges of the frequency bands of rhythmic activity, in Hz.
BANDS = ((0.5, "sub-delta"), (4.0, "delta"), (8.0, "theta"), (13.0, "alpha"), (30.0, "beta"))


@query("rhythm_terms", f"""
WITH {S} SELECT ch, CASE {' '.join(f"WHEN value / 4 < {b} THEN '{n}'" for b, n in BANDS)} ELSE 'high-frequency' END AS term, count(*) AS n FROM s GROUP BY ALL""")
def rhythm_terms(spark, d):
    """Frequencies named by band."""
    term = F.when(F.col("value") / 4 < BANDS[0][0], BANDS[0][1])
    for edge, name in BANDS[1:]:
        term = term.when(F.col("value") / 4 < edge, name)
    return samples(spark, d).groupBy("ch", term.otherwise("high-frequency").alias("term")).agg(F.count(F.lit(1)).alias("n"))


@query("metadata_lines", """
WITH m AS (SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey % 5 = 0 THEN ' ' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer),
u AS (SELECT c_custkey, 'name' AS label, name AS value FROM m UNION ALL SELECT c_custkey, 'segment', segment FROM m UNION ALL SELECT c_custkey, 'nation', nation FROM m)
SELECT c_custkey, label, value FROM u WHERE trim(value) <> ''""")
def metadata_lines(spark, d):
    """Label and value of each field that is not blank."""
    m = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("segment"),
                                           F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string")).alias("nation"))
    return m.unpivot("c_custkey", ["name", "segment", "nation"], "label", "value").where("trim(value) <> ''")


IED = f"""{S}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY rec ORDER BY us, event_id) > 7200000000 THEN 1 ELSE 0 END AS jump FROM s),
c AS (SELECT *, sum(jump) OVER (PARTITION BY rec ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM g),
i AS (SELECT rec, cluster, min(us) AS at, min(epoch) AS epoch, list_sort(list_distinct(list(ch))) AS chans, max(value) > 60 AS sharp, avg(CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.15::DOUBLE AS fast FROM c GROUP BY ALL),
k AS (SELECT *, CAST(sharp AS INTEGER) + CAST(fast AS INTEGER) + CAST(len(chans) <= 4 AS INTEGER) AS passed FROM i)"""


def _discharges(spark, d):
    """Groups of samples of one recording less than two hours apart, with the rules that each passes."""
    w = W.partitionBy("rec").orderBy("us", "event_id")
    jump = F.coalesce((F.col("us") - F.lag("us").over(w) > 7_200_000_000).cast("int"), F.lit(0))
    c = samples(spark, d).withColumn("jump", jump).withColumn("cluster", F.sum("jump").over(w.rowsBetween(W.unboundedPreceding, 0)))
    i = c.groupBy("rec", "cluster").agg(F.min("epoch").alias("epoch"), F.array_sort(F.collect_set("ch")).alias("chans"), (F.max("value") > 60).alias("sharp"),
                                        (F.avg((F.col("value") > 30).cast("double")) >= 0.15).alias("fast"))
    return i.withColumn("passed", F.col("sharp").cast("int") + F.col("fast").cast("int") + (F.size("chans") <= 4).cast("int"))


@query("ied_ensemble", f"""
WITH {IED} SELECT rec, count(*) AS n, count(*) FILTER (WHERE passed = 3) AS n_high, count(*) FILTER (WHERE passed = 2) AS n_medium, count(*) FILTER (WHERE passed = 1) AS n_low,
  round(100.0::DOUBLE * count(*) FILTER (WHERE sharp = fast) / count(*), 5) AS agreement_pct, count(*) FILTER (WHERE {stage_sql('epoch')} IN ('N2', 'N3')) AS n_nrem FROM k WHERE passed > 0 GROUP BY rec""")
def ied_ensemble(spark, d):
    """How many discharges pass three, two and one of the rules, and how far two rules agree."""
    k = _discharges(spark, d).where("passed > 0")
    level = lambda p: F.count_if(F.col("passed") == p)
    return k.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), level(3).alias("n_high"), level(2).alias("n_medium"), level(1).alias("n_low"),
                                F.round(100.0 * F.count_if(F.col("sharp") == F.col("fast")) / F.count(F.lit(1)), 5).alias("agreement_pct"),
                                F.count_if(stage_of(F.col("epoch")).isin("N2", "N3")).alias("n_nrem"))


@query("ied_channel_rates", f"""
WITH {IED}, u AS (SELECT rec, unnest(chans) AS ch FROM k WHERE passed > 0) SELECT rec, ch, round(count(*) / 43200.0::DOUBLE, 8) AS per_min FROM u GROUP BY ALL""")
def ied_channel_rates(spark, d):
    """Each discharge counts for every channel that it involves."""
    u = _discharges(spark, d).where("passed > 0").select("rec", F.explode("chans").alias("ch"))
    return u.groupBy("rec", "ch").agg(F.round(F.count(F.lit(1)) / F.lit(43200.0), 8).alias("per_min"))


@query("ictal_screen", f"""
WITH {S}, c AS (SELECT rec, ch, row_number() OVER (PARTITION BY rec ORDER BY ch) AS k FROM (SELECT DISTINCT rec, ch FROM s)),
n AS (SELECT s.*, row_number() OVER (PARTITION BY s.rec, s.ch ORDER BY us, event_id) - 1 AS i FROM s JOIN c ON s.rec = c.rec AND s.ch = c.ch AND k <= 4),
m AS (SELECT rec, ch, median(value) AS med FROM n GROUP BY ALL), a AS (SELECT n.rec, n.ch, any_value(med) AS med, median(abs(value - med)) AS mad FROM n JOIN m USING (rec, ch) GROUP BY ALL),
z AS (SELECT n.*, value > med + 0.5::DOUBLE * 1.4826::DOUBLE * mad AS up FROM n JOIN a USING (rec, ch)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY rec, ch, up ORDER BY i) AS isl FROM z),
r AS (SELECT rec, ch, min(i) AS start, max(i) + 1 AS stop, arg_max(value, i) - arg_min(value, i) AS drift FROM g WHERE up GROUP BY rec, ch, isl HAVING count(*) >= 2)
SELECT rec, ch, start, stop, round(drift, 4) AS drift, CASE WHEN abs(drift) >= 10 THEN 'moderate' ELSE 'low' END AS confidence FROM r""")
def ictal_screen(spark, d):
    """Runs above half a robust deviation on a recording's first four channels; a drift raises confidence."""
    w, value = W.partitionBy("rec", "ch"), F.col("value")
    # dealt by recording once: ranks, numbers, medians and runs all find their rows together
    n = samples(spark, d).withColumn("k", F.dense_rank().over(W.partitionBy("rec").orderBy("ch"))).where("k <= 4").withColumn("i", F.row_number().over(w.orderBy("us", "event_id")) - 1)
    z = n.withColumn("med", F.median("value").over(w)).withColumn("mad", F.median(F.abs(value - F.col("med"))).over(w))
    z = z.withColumn("up", value > F.col("med") + 0.5 * sequences.MAD_SCALE * F.col("mad"))
    g = sequences.islands(z, ["rec", "ch"], "i", "up").where("up")
    r = g.groupBy("rec", "ch", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), (F.max_by("value", "i") - F.min_by("value", "i")).alias("drift")).where("stop - start >= 2")
    return r.select("rec", "ch", "start", "stop", F.round("drift", 4).alias("drift"), F.when(F.abs("drift") >= 10, "moderate").otherwise("low").alias("confidence"))


#: Fixed value: the version of consent that a submission must carry.
CONSENT_VERSION = 2
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY")


@query("submissions", f"""
WITH c AS (SELECT c_custkey, c_nationkey AS age, c_mktsegment AS kind, c_acctbal AS score, c_name AS name, c_custkey % 4 AS version, c_acctbal > -500 AS given FROM customer),
e AS (SELECT *, concat_ws(',', CASE WHEN NOT given THEN 'no_consent' END, CASE WHEN version < {CONSENT_VERSION} THEN 'old_consent' END, CASE WHEN age NOT BETWEEN 1 AND 20 THEN 'age' END,
  CASE WHEN kind NOT IN {_SEGMENTS} THEN 'kind' END) AS errors FROM c)
SELECT c_custkey, errors = '' AS accepted, errors, CASE WHEN errors = '' THEN '{{"age_band":"' || CASE WHEN age < 6 THEN '1-5' WHEN age < 13 THEN '6-12' ELSE '13-20' END || '","kind":"' || kind || '"}}' END AS doc FROM e""")
def submissions(spark, d):
    """Consent and input rules, then a document of allowed fields only, in bands; broken rules are listed."""
    c = table(spark, d, "customer")
    version, given = F.col("c_custkey") % 4, F.col("c_acctbal") > -500
    errors = texts.broken_rules({"no_consent": given, "old_consent": version >= CONSENT_VERSION, "age": F.col("c_nationkey").between(1, 20), "kind": F.col("c_mktsegment").isin(*_SEGMENTS)})
    band = F.when(F.col("c_nationkey") < 6, "1-5").when(F.col("c_nationkey") < 13, "6-12").otherwise("13-20")
    doc = F.to_json(F.struct(band.alias("age_band"), F.col("c_mktsegment").alias("kind")))
    out = c.select("c_custkey", F.concat_ws(",", errors).alias("errors"), doc.alias("doc"))
    return out.select("c_custkey", (F.col("errors") == "").alias("accepted"), "errors", F.when(F.col("errors") == "", F.col("doc")).alias("doc"))


@query("submission_lines", """
SELECT c_custkey, '{"id":' || c_custkey || ',"kind":"' || c_mktsegment || '"}' AS line, 'https://example.org/new?title=' || url_encode('Report ' || c_custkey || ' & ' || c_mktsegment) AS url,
  '**id** ' || c_custkey || chr(10) || '**kind** ' || c_mktsegment AS preview FROM customer""")
def submission_lines(spark, d):
    """K9: a JSON line, an escaped address and a preview of each document."""
    c = table(spark, d, "customer")
    title = F.url_encode(F.concat_ws(" ", F.lit("Report"), F.col("c_custkey").cast("string"), F.lit("&"), F.col("c_mktsegment")))
    return c.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))).alias("line"),
                    F.concat(F.lit("https://example.org/new?title="), F.replace(title, F.lit("+"), F.lit("%20"))).alias("url"),
                    F.concat(F.lit("**id** "), F.col("c_custkey"), F.lit("\n**kind** "), F.col("c_mktsegment")).alias("preview"))


@query("latest_values", f"""
WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY rec, ch ORDER BY us DESC, event_id DESC) AS k FROM s) SELECT rec, ch, value FROM r WHERE k = 1""")
def latest_values(spark, d):
    """K3: an upsert as a grouped maximum: the last value written under each key."""
    return samples(spark, d).groupBy("rec", "ch").agg(F.max_by("value", F.struct("us", "event_id")).alias("value"))


@query("rows_after_delete", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderpriority LIKE '1-%') AND o_orderkey NOT IN (1, 2, 3) GROUP BY o_orderpriority""")
def rows_after_delete(spark, d):
    """K2: orders as a table of commits, deleted from by date with a label's prefix and by id; what it then holds."""
    t = Ledger(spark, f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}")
    t.insert_new(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"), "o_orderkey")
    t.delete((F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00'")) & F.col("o_orderpriority").like("1-%"))
    t.delete(F.col("o_orderkey").isin(1, 2, 3))
    return t.read().groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("trend_wide", """
SELECT o_custkey, year(o_orderdate) AS yr, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
  max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS max_f, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS max_o FROM orders GROUP BY ALL""")
def trend_wide(spark, d):
    """L1: one row per recording and year with a column per metric, as filtered aggregates of one pass."""
    o, status = table(spark, d, "orders"), F.col("o_orderstatus")
    count = lambda s: F.count_if(status == s).alias(f"n_{s.lower()}")
    top = lambda s: F.max(F.when(status == s, F.col("o_totalprice"))).alias(f"max_{s.lower()}")
    return o.groupBy("o_custkey", F.year("o_orderdate").cast("bigint").alias("yr")).agg(count("F"), count("O"), count("P"), top("F"), top("O"))


@query("diary_pairs", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders),
p AS (SELECT a.o_orderkey AS rec_key, b.o_orderkey AS diary_key, b.day - a.day AS days, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(b.day - a.day), b.day, b.o_orderkey) AS k
  FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'O' AND b.o_orderstatus = 'F' AND abs(b.day - a.day) <= 45)
SELECT rec_key, diary_key, days FROM p WHERE k = 1""")
def diary_pairs(spark, d):
    """A recording's nearest diary entry within 45 days, the earlier on a tie; days are met in bins, so no key's rows meet all of another's."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", day.alias("day"))
    bin_of = F.floor(F.col("day") / 46)
    a = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("rec_key"), F.col("day").alias("at"), F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("bin"))
    b = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("diary_key"), "day", bin_of.alias("bin"))
    days = (F.col("day") - F.col("at")).alias("days")
    p = a.join(b, ["o_custkey", "bin"]).select("rec_key", "diary_key", days).where("abs(days) <= 45")
    best = p.groupBy("rec_key").agg(F.min(F.struct(F.abs("days").alias("far"), "days", "diary_key")).alias("m"))
    return best.select("rec_key", F.col("m.diary_key").alias("diary_key"), F.col("m.days").alias("days"))


@query("negative_findings", f"""
WITH {S}, g AS (SELECT rec, max(value) AS top, count(*) FILTER (WHERE ch = 'error') AS errors, count(DISTINCT ch) AS chans, stddev_pop(value) AS sd FROM s GROUP BY rec)
SELECT rec, concat_ws('; ', CASE WHEN top < 250 THEN 'no large deflection' END, CASE WHEN errors = 0 THEN 'no artefact' END, CASE WHEN chans >= 5 THEN 'no missing channel' END, CASE WHEN sd < 45 THEN 'no excess spread' END) AS findings FROM g""")
def negative_findings(spark, d):
    """Sentences for what was looked for and not found."""
    g = samples(spark, d).groupBy("rec").agg(F.max("value").alias("top"), F.count_if(F.col("ch") == "error").alias("errors"), F.countDistinct("ch").alias("chans"), F.stddev_pop("value").alias("sd"))
    said = {"no large deflection": F.col("top") < 250, "no artefact": F.col("errors") == 0, "no missing channel": F.col("chans") >= 5, "no excess spread": F.col("sd") < 45}
    return g.select("rec", F.concat_ws("; ", *[F.when(ok, F.lit(t)) for t, ok in said.items()]).alias("findings"))
