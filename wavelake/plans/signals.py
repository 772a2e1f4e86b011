"""Signal-level queries over events read as samples (recording = user, channel = event type)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavelake.operators import joins, sequences
from wavelake.plans.base import S, query, samples, stage_of, stage_sql


@query("robust_event_rate_bins", f"""
WITH {S}, m AS (SELECT rec, median(value) AS med FROM s GROUP BY rec),
d AS (SELECT s.rec, any_value(m.med) AS med, median(abs(value - m.med)) AS mad FROM s JOIN m USING (rec) GROUP BY s.rec)
SELECT s.rec AS user_id, epoch AS bin, count(*) FILTER (WHERE abs(value - med) > 2 * 1.4826 * mad) AS n_events, count(*) AS n_samples,
  round(count(*) FILTER (WHERE abs(value - med) > 2 * 1.4826 * mad) / 30.0::DOUBLE, 6) AS rate_per_min
FROM s JOIN d ON s.rec = d.rec GROUP BY s.rec, epoch""")
def robust_event_rate_bins(spark, d):
    s = samples(spark, d)
    hit = F.abs(F.col("value") - F.col("med")) > 2 * 1.4826 * F.col("mad")
    return (s.join(sequences.median_mad(s, ["rec"], "value"), "rec").groupBy(F.col("rec").alias("user_id"), F.col("epoch").alias("bin"))
            .agg(F.count_if(hit).alias("n_events"), F.count(F.lit(1)).alias("n_samples"))
            .withColumn("rate_per_min", F.round(F.col("n_events") / F.lit(30.0), 6)))


@query("channel_kurtosis_topography", f"""
WITH {S}, k AS (SELECT ch, rec, kurtosis_pop(value) + 3 AS kurt FROM s GROUP BY ch, rec HAVING count(*) >= 4 AND stddev_pop(value) > 0),
a AS (SELECT ch, median(kurt) AS med, quantile_cont(kurt, 0.9) AS p90, avg(CASE WHEN kurt > 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS frac, count(*) AS n FROM k GROUP BY ch)
SELECT ch, round(med, 6) AS median_kurtosis, round(p90, 6) AS p90_kurtosis, round(frac, 6) AS frac_above, n AS n_epochs,
  CAST(row_number() OVER (ORDER BY med DESC, ch) AS INTEGER) AS rank FROM a""")
def channel_kurtosis_topography(spark, d):
    """A1: spread of the kurtosis of each channel, highest median first."""
    k = samples(spark, d).groupBy("ch", "rec").agg((F.kurtosis("value") + 3).alias("kurt"), F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("sd")).where("n >= 4 and sd > 0")
    a = k.groupBy("ch").agg(F.median("kurt").alias("med"), F.percentile("kurt", 0.9).alias("p90"), F.avg((F.col("kurt") > 3).cast("double")).alias("frac"), F.count(F.lit(1)).alias("n_epochs"))
    return a.select("ch", F.round("med", 6).alias("median_kurtosis"), F.round("p90", 6).alias("p90_kurtosis"), F.round("frac", 6).alias("frac_above"), "n_epochs",
                    F.row_number().over(W.orderBy(F.desc("med"), "ch")).alias("rank"))


@query("quality_grade", f"""
WITH {S}, c AS (SELECT rec, ch, stddev_pop(value) AS sigma, max(value) - min(value) AS ptp, max(abs(value)) AS peak, count(*) AS n FROM s GROUP BY rec, ch),
m AS (SELECT *, median(sigma) OVER (PARTITION BY rec) AS cohort FROM c),
g AS (SELECT *, CASE WHEN sigma < 1.5 THEN 'flat' WHEN peak > 3150 THEN 'saturated' WHEN ptp > 1500 THEN 'extreme' WHEN sigma > 4 * cohort THEN 'noisy' ELSE 'good' END AS status FROM m)
SELECT rec, count(*) AS n_channels, count(*) FILTER (WHERE status <> 'good') AS n_bad,
  CASE WHEN avg(CASE WHEN status <> 'good' THEN 1.0 ELSE 0.0 END) = 0 THEN 'A' WHEN avg(CASE WHEN status <> 'good' THEN 1.0 ELSE 0.0 END) <= 0.2 THEN 'B'
    WHEN avg(CASE WHEN status <> 'good' THEN 1.0 ELSE 0.0 END) <= 0.4 THEN 'C' ELSE 'D' END AS grade FROM g GROUP BY rec""")
def quality_grade(spark, d):
    """Channel flags in order of priority, and a grade from the share of flagged channels."""
    c = samples(spark, d).groupBy("rec", "ch").agg(F.stddev_pop("value").alias("sigma"), (F.max("value") - F.min("value")).alias("ptp"), F.max(F.abs("value")).alias("peak"))
    c = c.join(c.groupBy("rec").agg(F.median("sigma").alias("cohort")), "rec")
    status = (F.when(F.col("sigma") < 1.5, "flat").when(F.col("peak") > 3150, "saturated").when(F.col("ptp") > 1500, "extreme")
              .when(F.col("sigma") > 4 * F.col("cohort"), "noisy").otherwise("good"))
    g = c.withColumn("bad", (status != "good").cast("int")).groupBy("rec").agg(F.count(F.lit(1)).alias("n_channels"), F.sum("bad").alias("n_bad"), F.avg("bad").alias("share"))
    return g.select("rec", "n_channels", "n_bad", F.when(F.col("share") == 0, "A").when(F.col("share") <= 0.2, "B").when(F.col("share") <= 0.4, "C").otherwise("D").alias("grade"))


@query("epoch_rejection", f"""
WITH {S}, p AS (SELECT rec, ch, epoch // 48 AS day, max(value) - min(value) AS ptp FROM s GROUP BY ALL),
m AS (SELECT rec, ch, median(ptp) AS med FROM p GROUP BY ALL), a AS (SELECT p.rec, p.ch, any_value(m.med) AS med, median(abs(ptp - m.med)) AS mad FROM p JOIN m USING (rec, ch) GROUP BY ALL),
b AS (SELECT p.rec, p.day, CASE WHEN ptp > greatest(med + 5 * 1.4826 * mad, 150) THEN 1.0 ELSE 0.0 END AS bad FROM p JOIN a USING (rec, ch))
SELECT rec, day, count(*) AS n_channels, round(avg(bad), 6) AS bad_share, avg(bad) > 0.25 AS rejected FROM b GROUP BY rec, day""")
def epoch_rejection(spark, d):
    """Peak-to-peak limits of each channel by median and MAD, then epochs by their share of bad channels."""
    p = samples(spark, d).groupBy("rec", "ch", F.floor(F.col("epoch") / 48).alias("day")).agg((F.max("value") - F.min("value")).alias("ptp"))
    lim = sequences.median_mad(p, ["rec", "ch"], "ptp")
    bad = (F.col("ptp") > F.greatest(F.col("med") + 5 * 1.4826 * F.col("mad"), F.lit(150.0))).cast("double")
    return (p.join(lim, ["rec", "ch"]).groupBy("rec", "day").agg(F.count(F.lit(1)).alias("n_channels"), F.avg(bad).alias("x"))
            .select("rec", "day", "n_channels", F.round("x", 6).alias("bad_share"), (F.col("x") > 0.25).alias("rejected")))


def _spine(spark, d):
    """Every epoch of every recording from its first to its last, with its stage."""
    ends = samples(spark, d).groupBy("rec").agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))
    return ends.select("rec", F.explode(F.sequence("lo", "hi")).alias("epoch")).withColumn("stage", stage_of(F.col("epoch")))


_SPINE = f"""ends AS (SELECT rec, min(epoch) AS lo, max(epoch) AS hi FROM s GROUP BY rec),
sp0 AS (SELECT rec, unnest(range(lo, hi + 1)) AS epoch FROM ends), sp AS (SELECT rec, epoch, {stage_sql('epoch')} AS stage FROM sp0)"""


@query("state_rate_split", f"""
WITH {S}, {_SPINE}, e AS (SELECT sp.stage, sp.rec, count(s.event_id) FILTER (WHERE s.ch = 'error') AS n FROM sp LEFT JOIN s ON s.rec = sp.rec AND s.epoch = sp.epoch GROUP BY sp.rec, sp.epoch, sp.stage),
g AS (SELECT rec, CASE WHEN stage = 'W' THEN 'wake' WHEN stage = 'REM' THEN 'rem' ELSE 'nrem' END AS state, sum(n) / (count(*) * 30.0::DOUBLE) AS rate FROM e GROUP BY ALL),
w AS (SELECT rec, max(rate) FILTER (WHERE state = 'wake') AS wake, max(rate) FILTER (WHERE state = 'nrem') AS nrem, max(rate) FILTER (WHERE state = 'rem') AS rem FROM g GROUP BY rec)
SELECT rec, round(wake, 8) AS wake_rate, round(nrem, 8) AS nrem_rate, round(rem, 8) AS rem_rate, CASE WHEN wake >= 0.001 THEN round(nrem / wake, 6) END AS activation,
  CASE WHEN wake IS NULL OR wake < 0.001 THEN 'indeterminate' WHEN nrem / wake >= 10 THEN 'very_high' WHEN nrem / wake >= 3 THEN 'high' WHEN nrem / wake >= 1.5 THEN 'moderate' ELSE 'low' END AS label FROM w""")
def state_rate_split(spark, d):
    """A5: rates per state over all epochs, those without events included; no factor without a waking rate."""
    err = samples(spark, d).where("ch = 'error'").groupBy("rec", "epoch").agg(F.count(F.lit(1)).alias("n"))
    e = _spine(spark, d).join(err, ["rec", "epoch"], "left").na.fill(0, ["n"])
    state = F.when(F.col("stage") == "W", "wake").when(F.col("stage") == "REM", "rem").otherwise("nrem")
    g = e.groupBy("rec", state.alias("state")).agg((F.sum("n") / (F.count(F.lit(1)) * 30.0)).alias("rate"))
    w = g.groupBy("rec").agg(*[F.max(F.when(F.col("state") == k, F.col("rate"))).alias(k) for k in ("wake", "nrem", "rem")])
    f = F.col("nrem") / F.col("wake")
    label = (F.when(F.col("wake").isNull() | (F.col("wake") < 0.001), "indeterminate").when(f >= 10, "very_high").when(f >= 3, "high").when(f >= 1.5, "moderate").otherwise("low"))
    return w.select("rec", *[F.round(k, 8).alias(f"{k}_rate") for k in ("wake", "nrem", "rem")], F.when(F.col("wake") >= 0.001, F.round(f, 6)).alias("activation"), label.alias("label"))


@query("spike_wave_index", f"""
WITH {S}, l AS (SELECT rec, t_s, event_id, epoch, t_s - lag(t_s) OVER (PARTITION BY rec ORDER BY us, event_id) AS dt FROM s),
c AS (SELECT *, sum(CASE WHEN dt > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY t_s, event_id ROWS UNBOUNDED PRECEDING) AS k FROM l),
g AS (SELECT rec, k, min(t_s) AS a, max(t_s) AS b, count(*) AS n FROM c GROUP BY rec, k HAVING max(t_s) - min(t_s) >= 3600),
r AS (SELECT rec, max(t_s) - min(t_s) AS span FROM s GROUP BY rec)
SELECT r.rec, count(g.k) AS n_clusters, round(coalesce(sum(g.b - g.a), 0) / span * 100, 6) AS coverage_pct FROM r LEFT JOIN g ON r.rec = g.rec GROUP BY r.rec, span""")
def spike_wave_index(spark, d):
    """Share of the time that lies in clusters of close events with a least span."""
    s = samples(spark, d)
    w = W.partitionBy("rec").orderBy("us", "event_id")
    c = s.withColumn("new", F.coalesce((F.col("t_s") - F.lag("t_s").over(w) > 7200).cast("int"), F.lit(0))).withColumn("k", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = c.groupBy("rec", "k").agg((F.max("t_s") - F.min("t_s")).alias("span_k")).where("span_k >= 3600")
    g = g.groupBy("rec").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("span_k").alias("covered"))
    r = s.groupBy("rec").agg((F.max("t_s") - F.min("t_s")).alias("span"))
    return r.join(g, "rec", "left").select("rec", F.coalesce("n_clusters", F.lit(0)).cast("bigint").alias("n_clusters"),
                                           F.round(F.coalesce("covered", F.lit(0.0)) / F.when(F.col("span") > 0, F.col("span")) * 100, 6).alias("coverage_pct"))


_NIGHT = f"{S}, b AS (SELECT rec, epoch, avg(value) AS v FROM s GROUP BY rec, epoch), n AS (SELECT rec, epoch, v > 50 AS flag, CAST(row_number() OVER (PARTITION BY rec ORDER BY epoch) AS BIGINT) AS i FROM b)"


def _night(spark, d):
    """One row per epoch that has samples, numbered, with a flag for a high mean."""
    b = samples(spark, d).groupBy("rec", "epoch").agg(F.avg("value").alias("v"))
    return b.select("rec", "epoch", (F.col("v") > 50).alias("flag"), F.row_number().over(W.partitionBy("rec").orderBy("epoch")).cast("bigint").alias("i"))


@query("gaps_islands_runs", f"""
WITH {_NIGHT}, l AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END AS new FROM n WINDOW w AS (PARTITION BY rec ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY i) AS k FROM l)
SELECT rec, flag, min(i) AS start, max(i) + 1 AS stop, count(*) AS length FROM g GROUP BY rec, k, flag""")
def gaps_islands_runs(spark, d):
    """Half-open runs of equal flags."""
    return sequences.runs(_night(spark, d), ["rec"], "i", "flag")


@query("bridge_gaps", f"""
WITH {_NIGHT}, l AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END AS new FROM n WINDOW w AS (PARTITION BY rec ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY i) AS k FROM l), c AS (SELECT *, count(*) OVER (PARTITION BY rec, k) AS len, max(k) OVER (PARTITION BY rec) AS top FROM g)
SELECT rec, i, flag OR (len <= 2 AND k > 1 AND k < top) AS bridged FROM c""")
def bridge_gaps(spark, d):
    """Short gaps between two runs are filled."""
    return sequences.bridge(_night(spark, d), ["rec"], "i", "flag", 2).select("rec", "i", "bridged")


@query("sleep_cycles", f"""
WITH {S}, {_SPINE}, f AS (SELECT rec, epoch, CASE WHEN stage = 'REM' THEN 'REM' ELSE 'NREM' END AS st FROM sp WHERE stage <> 'W'),
l AS (SELECT *, lag(st) OVER (PARTITION BY rec ORDER BY epoch) AS before FROM f)
SELECT rec, count(*) FILTER (WHERE st = 'REM' AND before = 'NREM') AS n_cycles, count(*) FILTER (WHERE st = 'NREM') AS nrem_epochs, count(*) FILTER (WHERE st = 'REM') AS rem_epochs FROM l GROUP BY rec""")
def sleep_cycles(spark, d):
    """NREM followed by REM, waking left out."""
    f = _spine(spark, d).where("stage <> 'W'").withColumn("st", F.when(F.col("stage") == "REM", "REM").otherwise("NREM"))
    f = f.withColumn("before", F.lag("st").over(W.partitionBy("rec").orderBy("epoch")))
    return f.groupBy("rec").agg(F.count_if((F.col("st") == "REM") & (F.col("before") == "NREM")).alias("n_cycles"), F.count_if(F.col("st") == "NREM").alias("nrem_epochs"),
                                F.count_if(F.col("st") == "REM").alias("rem_epochs"))


@query("stage_totals", f"""
WITH {S}, {_SPINE} SELECT rec, count(*) AS n_epochs, count(*) FILTER (WHERE stage = 'W') * 30 AS wake_min, count(*) FILTER (WHERE stage = 'N2') * 30 AS n2_min,
 count(*) FILTER (WHERE stage = 'N3') * 30 AS n3_min, count(*) FILTER (WHERE stage = 'REM') * 30 AS rem_min, round(count(*) FILTER (WHERE stage <> 'W') / greatest(count(*), 1)::DOUBLE, 6) AS efficiency FROM sp GROUP BY rec""")
def stage_totals(spark, d):
    """A10: minutes per stage and sleep efficiency."""
    minutes = lambda s: (F.count_if(F.col("stage") == s) * 30).alias(f"{'wake' if s == 'W' else s.lower()}_min")
    return _spine(spark, d).groupBy("rec").agg(F.count(F.lit(1)).alias("n_epochs"), *[minutes(s) for s in ("W", "N2", "N3", "REM")],
                                               F.round(F.count_if(F.col("stage") != "W") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("efficiency"))


@query("stage_transitions", f"""
WITH {_NIGHT}, l AS (SELECT rec, CASE WHEN flag THEN 'high' ELSE 'low' END AS from_state, lead(CASE WHEN flag THEN 'high' ELSE 'low' END) OVER (PARTITION BY rec ORDER BY i) AS to_state FROM n)
SELECT rec, from_state, to_state, count(*) AS n FROM l WHERE to_state IS NOT NULL AND to_state <> from_state GROUP BY ALL""")
def stage_transitions(spark, d):
    """Counts of state changes."""
    n = _night(spark, d).withColumn("state", F.when(F.col("flag"), "high").otherwise("low"))
    return sequences.transitions(n, ["rec"], "i", "state")


@query("fragmentation", f"""
WITH {_NIGHT}, l AS (SELECT rec, i, epoch, flag <> lag(flag) OVER (PARTITION BY rec ORDER BY i) AS ch FROM n)
SELECT rec, count(*) FILTER (WHERE ch) AS n_transitions, round(count(*) FILTER (WHERE ch) / (count(*) * 0.5::DOUBLE), 6) AS per_hour FROM l GROUP BY rec""")
def fragmentation(spark, d):
    """Changes per hour."""
    n = _night(spark, d).withColumn("ch", F.col("flag") != F.lag("flag").over(W.partitionBy("rec").orderBy("i")))
    return n.groupBy("rec").agg(F.count_if("ch").alias("n_transitions"), F.round(F.count_if("ch") / (F.count(F.lit(1)) * 0.5), 6).alias("per_hour"))


@query("first_last_where", f"""
WITH {_NIGHT}, f AS (SELECT rec, min(i) FILTER (WHERE flag) AS onset, max(i) FILTER (WHERE flag) AS final FROM n GROUP BY rec)
SELECT n.rec, onset, final, count(*) FILTER (WHERE NOT flag AND i > onset AND i < final) AS low_within FROM n JOIN f USING (rec) GROUP BY n.rec, onset, final""")
def first_last_where(spark, d):
    """First and last place of a predicate, and what lies between."""
    n = _night(spark, d)
    f = n.groupBy("rec").agg(F.min(F.when(F.col("flag"), F.col("i"))).alias("onset"), F.max(F.when(F.col("flag"), F.col("i"))).alias("final"))
    return n.join(f, "rec").groupBy("rec", "onset", "final").agg(F.count_if(~F.col("flag") & (F.col("i") > F.col("onset")) & (F.col("i") < F.col("final"))).alias("low_within"))


@query("sliding_line_length", f"""
WITH {S}, o AS (SELECT rec, us, event_id, abs(value - lag(value) OVER (PARTITION BY rec ORDER BY us, event_id)) AS step, row_number() OVER (PARTITION BY rec ORDER BY us, event_id) AS i FROM s)
SELECT rec, CAST(i AS BIGINT) AS i, round(sum(step) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS line_length FROM o WHERE i > 1""")
def sliding_line_length(spark, d):
    """Line length over sliding windows of steps."""
    w = W.partitionBy("rec").orderBy("us", "event_id")
    o = samples(spark, d).select("rec", F.abs(F.col("value") - F.lag("value").over(w)).alias("step"), F.row_number().over(w).cast("bigint").alias("i")).where("i > 1")
    return o.select("rec", "i", F.round(F.sum("step").over(W.partitionBy("rec").orderBy("i").rowsBetween(-4, 0)), 4).alias("line_length"))


@query("time_of_night_peak", f"""
WITH {S}, h AS (SELECT rec, (epoch // 2) % 24 AS hour, count(*) AS n FROM s GROUP BY ALL), sp AS (SELECT r.rec, g.range AS hour FROM (SELECT DISTINCT rec FROM s) r, range(24) g),
f AS (SELECT sp.rec, CAST(sp.hour AS BIGINT) AS hour, coalesce(n, 0) AS n FROM sp LEFT JOIN h ON sp.rec = h.rec AND sp.hour = h.hour),
k AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY n DESC, hour) AS rn, sum(n) OVER (PARTITION BY rec) AS total FROM f)
SELECT rec, hour AS peak_hour, n AS peak_n, round(n / total::DOUBLE, 6) AS peak_share FROM k WHERE rn = 1""")
def time_of_night_peak(spark, d):
    """Histogram over a spine of bins; the first of the largest."""
    s = samples(spark, d).withColumn("hour", F.floor(F.col("epoch") / 2) % 24)
    spine = s.select("rec").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))))
    f = spine.join(s.groupBy("rec", "hour").agg(F.count(F.lit(1)).alias("n")), ["rec", "hour"], "left").na.fill(0, ["n"])
    top = sequences.first_max(f.withColumn("total", F.sum("n").over(W.partitionBy("rec"))), ["rec"], "n", "hour")
    return top.select("rec", F.col("hour").alias("peak_hour"), F.col("n").alias("peak_n"), F.round(F.col("n") / F.col("total"), 6).alias("peak_share"))


@query("morphology_mix", f"""
WITH {S}, l AS (SELECT rec, value, t_s - lag(t_s) OVER (PARTITION BY rec ORDER BY us, event_id) AS iei FROM s)
SELECT rec, count(*) AS n, round(avg(CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS spike_share, round(avg(CASE WHEN value >= 20 AND value < 80 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS sharp_share,
  round(avg(CASE WHEN value >= 80 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS slow_share, round(count(*) FILTER (WHERE iei < 900) / count(*)::DOUBLE, 6) AS poly_share,
  round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75 FROM l GROUP BY rec""")
def morphology_mix(spark, d):
    """Shares of width classes, quartiles, and the share of events close behind another."""
    l = samples(spark, d).withColumn("iei", F.col("t_s") - F.lag("t_s").over(W.partitionBy("rec").orderBy("us", "event_id")))
    v, q = F.col("value"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    share = lambda c, n: F.round(F.avg(c.cast("double")), 6).alias(n)
    out = l.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), share(v < 20, "spike_share"), share((v >= 20) & (v < 80), "sharp_share"), share(v >= 80, "slow_share"),
                               F.round(F.count_if(F.col("iei") < 900) / F.count(F.lit(1)), 6).alias("poly_share"), q.alias("q"))
    return out.select("rec", "n", "spike_share", "sharp_share", "slow_share", "poly_share", *[F.round(F.element_at("q", i + 1), 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


@query("nearest_within_exists", f"""
WITH {S} SELECT event_id, rec, round(value, 6) AS value, EXISTS (SELECT 1 FROM s b WHERE b.rec = a.rec AND b.ch = 'click' AND abs(a.t_s - b.t_s) <= 1800 + 1e-9) AS spike_coupled FROM s a WHERE ch = 'error'""")
def nearest_within_exists(spark, d):
    """Whether an event has one of another kind nearby."""
    s = samples(spark, d)
    a = s.where("ch = 'error'")
    hit = joins.exists_within(a, s.where("ch = 'click'"), ["rec"], "t_s", "t_s", 1800.0).select("event_id", F.lit(True).alias("hit"))
    return a.join(hit, "event_id", "left").select("event_id", "rec", F.round("value", 6).alias("value"), F.coalesce("hit", F.lit(False)).alias("spike_coupled"))


@query("nearest_within_signed", f"""
WITH {S}, p AS (SELECT a.event_id, a.rec, b.us AS other_us, abs(a.us - b.us) AS gap, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.us - b.us), b.us) AS rn
  FROM s a JOIN s b ON a.rec = b.rec AND a.ch = 'error' AND b.ch = 'click' AND abs(a.us - b.us) <= 7200000000) SELECT event_id, rec, other_us, gap AS gap_us FROM p WHERE rn = 1""")
def nearest_within_signed(spark, d):
    """The nearest partner within a tolerance, the earlier on ties."""
    s = samples(spark, d)
    b = s.where("ch = 'click'").select("rec", F.col("us").alias("other_us"))
    out = joins.nearest_within(s.where("ch = 'error'"), b, ["rec"], "us", "other_us", 7_200_000_000, "event_id")
    return out.select("event_id", "rec", "other_us", F.col("gap").cast("bigint").alias("gap_us"))


@query("hfo_two_stage", f"""
WITH {S}, z AS (SELECT rec, median(value) AS med FROM s GROUP BY rec), e AS (SELECT a.event_id, a.rec, a.value, a.value / 0.4 AS freq, a.t_s, z.med,
  EXISTS (SELECT 1 FROM s b WHERE b.rec = a.rec AND b.ch = 'click' AND abs(a.t_s - b.t_s) <= 1800 + 1e-9) AS near FROM s a JOIN z ON a.rec = z.rec WHERE ch = 'error')
SELECT event_id, CASE WHEN freq < 80 OR freq > 500 THEN 'artifact' WHEN abs(value - med) > 60 THEN 'artifact' WHEN near THEN 'real_spike_coupled' ELSE 'real' END AS class,
  CASE WHEN freq < 80 OR freq > 500 THEN 'band' WHEN abs(value - med) > 60 THEN 'amplitude' WHEN near THEN 'coupled' ELSE 'isolated' END AS reason FROM e""")
def hfo_two_stage(spark, d):
    """Ordered rules over a ripple's band, size and neighbours."""
    s = samples(spark, d)
    a = nearest_within_exists(spark, d).select("event_id", F.col("spike_coupled").alias("near"))
    e = s.where("ch = 'error'").join(a, "event_id").join(s.groupBy("rec").agg(F.median("value").alias("med")), "rec")
    f = F.col("value") / F.lit(0.4)
    band, big = (f < 80) | (f > 500), F.abs(F.col("value") - F.col("med")) > 60
    return e.select("event_id", F.when(band | big, "artifact").when(F.col("near"), "real_spike_coupled").otherwise("real").alias("class"),
                    F.when(band, "band").when(big, "amplitude").when(F.col("near"), "coupled").otherwise("isolated").alias("reason"))


@query("stage_containment", f"""
WITH {S} SELECT rec, {stage_sql('epoch')} AS stage, count(*) AS n, round(sum(value), 4) AS total FROM s WHERE {stage_sql('epoch')} IN ('N2', 'N3') GROUP BY ALL""")
def stage_containment(spark, d):
    """Events inside epochs of given stages, by an equi-join on the epoch."""
    hit = joins.contained(samples(spark, d).drop("epoch"), _spine(spark, d), ["rec"], "t_s", "epoch", 1800.0, ["N2", "N3"])
    return hit.groupBy("rec", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("channel_involvement", f"""
WITH {S}, m AS (SELECT rec, ch, median(abs(value)) AS med FROM s GROUP BY ALL),
p AS (SELECT a.event_id, b.ch, max(abs(b.value)) AS peak, any_value(m.med) AS med FROM s a JOIN s b ON a.rec = b.rec AND a.ch = 'error' AND abs(a.us - b.us) <= 3600000000 JOIN m ON m.rec = b.rec AND m.ch = b.ch GROUP BY a.event_id, b.ch)
SELECT event_id, count(*) FILTER (WHERE peak > 1.2 * med) AS n_involved, CASE WHEN count(*) FILTER (WHERE peak > 1.2 * med) >= 4 THEN 'generalized' WHEN count(*) FILTER (WHERE peak > 1.2 * med) <= 2 THEN 'focal' ELSE 'regional' END AS spread FROM p GROUP BY event_id""")
def channel_involvement(spark, d):
    """Channels that exceed their own threshold around an event."""
    s = samples(spark, d)
    med = s.groupBy("rec", "ch").agg(F.median(F.abs("value")).alias("med"))
    width = 3_600_000_000
    a = s.where("ch = 'error'").select("event_id", "rec", F.col("us").alias("at"), F.floor(F.col("us") / width).alias("bin"))
    b = s.select("rec", "ch", "value", "us", F.explode(F.array(*[F.floor(F.col("us") / width) + k for k in (-1, 0, 1)])).alias("bin"))
    p = a.join(b, ["rec", "bin"]).where(F.abs(F.col("at") - F.col("us")) <= width).groupBy("event_id", "rec", "ch").agg(F.max(F.abs("value")).alias("peak"))
    g = p.join(med, ["rec", "ch"]).groupBy("event_id").agg(F.count_if(F.col("peak") > 1.2 * F.col("med")).alias("n_involved"))
    return g.withColumn("spread", F.when(F.col("n_involved") >= 4, "generalized").when(F.col("n_involved") <= 2, "focal").otherwise("regional"))


@query("event_union_sorted", f"""
WITH {S}, u AS (SELECT rec, 'spike' AS label, t_s, event_id FROM s WHERE ch = 'click' AND value > 60 UNION ALL SELECT rec, 'ripple', t_s, event_id FROM s WHERE ch = 'error' AND value > 40
  UNION ALL SELECT rec, 'burst', t_s, event_id FROM s WHERE ch = 'view' AND value > 80) SELECT rec, label, round(t_s, 3) AS onset, CAST(row_number() OVER (PARTITION BY rec ORDER BY t_s, event_id) AS INTEGER) AS ordinal FROM u""")
def event_union_sorted(spark, d):
    """K8: events of several detectors as one list in order of onset."""
    s = samples(spark, d)
    one = lambda label, cond: s.where(cond).select("rec", F.lit(label).alias("label"), "t_s", "event_id")
    u = one("spike", "ch = 'click' and value > 60").unionByName(one("ripple", "ch = 'error' and value > 40")).unionByName(one("burst", "ch = 'view' and value > 80"))
    return u.select("rec", "label", F.round("t_s", 3).alias("onset"), F.row_number().over(W.partitionBy("rec").orderBy("t_s", "event_id")).alias("ordinal"))


@query("phasor_plv", f"""
WITH {S}, p AS (SELECT ch, 2 * pi() * (us % 86400000000) / 86400000000.0::DOUBLE AS phi FROM s), a AS (SELECT ch, count(*) AS n, avg(cos(phi)) AS c, avg(sin(phi)) AS s FROM p GROUP BY ch)
SELECT ch, n, round(sqrt(c * c + s * s), 6) AS plv, round(degrees(atan2(s, c)), 4) AS preferred_deg, round(n * (c * c + s * s), 4) AS rayleigh_z FROM a WHERE n >= 10""")
def phasor_plv(spark, d):
    """Mean phasor length and direction, and the Rayleigh statistic, from ten events on."""
    phi = 2 * F.pi() * (F.col("us") % 86_400_000_000) / F.lit(86_400_000_000.0)
    a = samples(spark, d).groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.avg(F.cos(phi)).alias("c"), F.avg(F.sin(phi)).alias("s")).where("n >= 10")
    r2 = F.col("c") * F.col("c") + F.col("s") * F.col("s")
    return a.select("ch", "n", F.round(F.sqrt(r2), 6).alias("plv"), F.round(F.degrees(F.atan2("s", "c")), 4).alias("preferred_deg"), F.round(F.col("n") * r2, 4).alias("rayleigh_z"))


@query("permutation_entropy", f"""
WITH {S}, o AS (SELECT rec, value AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY rec ORDER BY us, event_id)),
p AS (SELECT rec, (CASE WHEN a <= b THEN 1 ELSE 0 END) + (CASE WHEN b <= c THEN 2 ELSE 0 END) + (CASE WHEN a <= c THEN 4 ELSE 0 END) AS pat FROM o WHERE c IS NOT NULL),
n AS (SELECT rec, pat, count(*) AS k FROM p GROUP BY ALL), t AS (SELECT *, sum(k) OVER (PARTITION BY rec) AS total FROM n)
SELECT rec, round(-sum(k / total::DOUBLE * log2(k / total::DOUBLE)) / log2(6.0::DOUBLE), 6) AS entropy FROM t GROUP BY rec""")
def permutation_entropy(spark, d):
    """Entropy of the order patterns of three samples."""
    w = W.partitionBy("rec").orderBy("us", "event_id")
    o = samples(spark, d).select("rec", F.col("value").alias("a"), F.lead("value").over(w).alias("b"), F.lead("value", 2).over(w).alias("c")).where("c is not null")
    pat = (F.col("a") <= F.col("b")).cast("int") + 2 * (F.col("b") <= F.col("c")).cast("int") + 4 * (F.col("a") <= F.col("c")).cast("int")
    n = o.groupBy("rec", pat.alias("pat")).agg(F.count(F.lit(1)).alias("k"))
    p = F.col("k") / F.sum("k").over(W.partitionBy("rec"))
    return n.withColumn("h", -p * F.log2(p)).groupBy("rec").agg(F.round(F.sum("h") / F.log2(F.lit(6.0)), 6).alias("entropy"))


@query("hjorth", f"""
WITH {S}, a AS (SELECT rec, us, event_id, value AS x, value - lag(value) OVER (PARTITION BY rec ORDER BY us, event_id) AS d1 FROM s), b AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY rec ORDER BY us, event_id) AS d2 FROM a),
v AS (SELECT rec, var_pop(x) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM b GROUP BY rec)
SELECT rec, round(v0, 4) AS activity, CASE WHEN v0 > 0 THEN round(sqrt(v1 / v0), 6) END AS mobility, CASE WHEN v0 > 0 AND v1 > 0 THEN round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) END AS complexity FROM v""")
def hjorth(spark, d):
    """Activity, mobility and complexity."""
    w = W.partitionBy("rec").orderBy("us", "event_id")
    a = samples(spark, d).withColumn("d1", F.col("value") - F.lag("value").over(w))
    b = a.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    v = b.groupBy("rec").agg(F.var_pop("value").alias("v0"), F.var_pop("d1").alias("v1"), F.var_pop("d2").alias("v2"))
    return v.select("rec", F.round("v0", 4).alias("activity"), F.when(F.col("v0") > 0, F.round(F.sqrt(F.col("v1") / F.col("v0")), 6)).alias("mobility"),
                    F.when((F.col("v0") > 0) & (F.col("v1") > 0), F.round(F.sqrt(F.col("v2") / F.col("v1")) / F.sqrt(F.col("v1") / F.col("v0")), 6)).alias("complexity"))


@query("robust_clip", f"""
WITH {S}, f AS (SELECT *, row_number() OVER (PARTITION BY rec, ch ORDER BY us, event_id) AS i FROM s), c AS (SELECT rec, ch, median(value) AS med FROM f WHERE i <= 10 GROUP BY ALL),
m AS (SELECT f.rec, f.ch, any_value(c.med) AS med, median(abs(value - c.med)) AS mad FROM f JOIN c USING (rec, ch) WHERE i <= 10 GROUP BY ALL)
SELECT event_id, round(greatest(least(value, med + 2 * 1.4826 * mad), med - 2 * 1.4826 * mad), 6) AS clipped FROM f JOIN m USING (rec, ch)""")
def robust_clip(spark, d):
    """P10: limits from a calibration stretch, applied to the whole channel."""
    f = samples(spark, d).withColumn("i", F.row_number().over(W.partitionBy("rec", "ch").orderBy("us", "event_id")))
    m = sequences.median_mad(f.where("i <= 10"), ["rec", "ch"], "value")
    r = 2 * 1.4826 * F.col("mad")
    return f.join(m, ["rec", "ch"]).select("event_id", F.round(F.greatest(F.least("value", F.col("med") + r), F.col("med") - r), 6).alias("clipped"))


@query("even_decimation", f"""
WITH {S}, n AS (SELECT event_id, rec, row_number() OVER (PARTITION BY rec ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM s)
SELECT event_id, rec FROM n WHERE i % CAST(ceil(n / 20.0) AS BIGINT) = 0""")
def even_decimation(spark, d):
    """At most 20 rows of a recording, evenly spread and the same on each run."""
    return sequences.thin(samples(spark, d).withColumn("at", F.struct("us", "event_id")), ["rec"], "at", 20).select("event_id", "rec")


@query("robust_z_scores", f"""
WITH {S}, m AS (SELECT rec, median(value) AS med, stddev_pop(value) AS sd FROM s GROUP BY rec), a AS (SELECT s.rec, any_value(med) AS med, any_value(sd) AS sd, median(abs(value - med)) AS mad FROM s JOIN m USING (rec) GROUP BY s.rec)
SELECT event_id, round((value - med) / (CASE WHEN mad > 0 THEN mad * 1.4826 WHEN sd > 0 THEN sd ELSE 1.0 END), 6) AS z FROM s JOIN a USING (rec)""")
def robust_z_scores(spark, d):
    """Distance from the median in units of the scaled MAD."""
    return sequences.robust_z(samples(spark, d), ["rec"], "value").select("event_id", F.round("z", 6).alias("z"))


@query("moving_mean_zero_padded", f"""
WITH {S} SELECT event_id, round(sum(value) OVER (PARTITION BY rec ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE, 6) AS smoothed FROM s""")
def moving_mean_zero_padded(spark, d):
    """Moving mean with zeros beyond the edges."""
    s = samples(spark, d).withColumn("at", F.struct("us", "event_id"))
    return s.select("event_id", F.round(sequences.moving_sum("value", ["rec"], "at", 2, 2, 5), 6).alias("smoothed"))


@query("triggered_average", f"""
WITH {S}, t AS (SELECT rec, epoch AS e0 FROM s WHERE ch = 'error'), x AS (SELECT s.ch, s.epoch - t.e0 AS lag, s.value FROM s JOIN t ON s.rec = t.rec AND s.epoch BETWEEN t.e0 - 3 AND t.e0 + 3)
SELECT ch, lag, round(avg(value), 6) AS mean, count(*) AS n FROM x GROUP BY ch, lag""")
def triggered_average(spark, d):
    """Mean of each channel by distance from the triggers; an equi-join on the reached epochs."""
    s = samples(spark, d)
    t = s.where("ch = 'error'").select("rec", F.col("epoch").alias("e0"), F.explode(F.sequence(F.col("epoch") - 3, F.col("epoch") + 3)).alias("epoch"))
    return s.join(t, ["rec", "epoch"]).groupBy("ch", (F.col("epoch") - F.col("e0")).alias("lag")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
