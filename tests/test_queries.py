"""Every query with an SQL twin gives the same rows on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import wavelake.catalog as catalog
from wavelake.plans import kernels

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def rows_of(columns, rows):
    def plain(v):
        if v is None or v != v:
            return "null"
        return str(float(v) + 0.0) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    cur = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["user_id", "bin", "n_events", "n_samples", "rate_per_min"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["band_powers", "wpli", "graph_metrics", "microstates", "bootstrap_ci"])
def test_kernel_queries_do_not_depend_on_partitions(spark, name):
    run = lambda: sorted(map(str, catalog.queries()[name](spark, SF).collect()))
    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert run() == first and first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def stored(duck):
    """(rec, ch, epoch) -> samples, put together without Spark."""
    out = {}
    for i, v in duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall():
        out.setdefault((i // 512, f"C{i % 4}", i // 32 % 16), []).extend(400.0 * x for x in v)
    return {k: np.array(v) for k, v in out.items()}


def test_spectra_and_entropies_against_plain_sums(spark, duck):
    """Band powers from a Fourier sum written out, sample entropy from two loops."""
    data = stored(duck)
    bands = {(r.rec, r.ch, r.epoch): r for r in catalog.queries()["band_powers"](spark, SF).collect()}
    assert bands.keys() == data.keys()
    n = 256
    win = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / n) for i in range(n)])
    for key in sorted(data)[:3]:
        x, power = data[key], np.zeros(n // 2 + 1)
        for start in range(0, len(x) - n + 1, n // 2):
            part = (x[start: start + n] - x[start: start + n].mean()) * win
            for k in range(n // 2 + 1):
                turn = 2 * np.pi * k * np.arange(n) / n
                power[k] += (part @ np.cos(turn)) ** 2 + (part @ np.sin(turn)) ** 2
        f = np.arange(n // 2 + 1) * 64 / n
        share = [power[(f >= a) & (f < b)].sum() for a, b in ((0.5, 4), (4, 8), (8, 13), (13, 30))]
        r = bands[key]
        assert np.allclose([r.delta_pct, r.theta_pct, r.alpha_pct, r.beta_pct], [100 * v / sum(share) for v in share], atol=1e-3)
        m, tol, hits = len(x) - 2, 0.2 * x.std(), [0, 0]
        for i in range(m):
            for j in range(i + 1, m):
                if abs(x[i] - x[j]) <= tol and abs(x[i + 1] - x[j + 1]) <= tol:
                    hits[0] += 1
                    hits[1] += abs(x[i + 2] - x[j + 2]) <= tol
        want = -np.log(hits[1] / hits[0]) if hits[0] and hits[1] else None
        got = kernels.entropy_rows(x)[0][1]
        assert got is want is None or abs(got - want) < 1e-9
    medians = {(r.rec, r.ch): r for r in catalog.queries()["entropies"](spark, SF).collect()}
    for rec, ch in medians:
        rows = [kernels.entropy_rows(x)[0] for k, x in data.items() if k[:2] == (rec, ch)]
        assert abs(medians[rec, ch].spectral - np.median([r[0] for r in rows])) < 1e-4 and medians[rec, ch].n_epochs == len(rows)


def test_phase_lag_index_against_a_plain_loop(spark, duck):
    data = stored(duck)
    for r in catalog.queries()["wpli"](spark, SF).collect():
        im = []
        for rec, ch, epoch in data:
            if (rec, ch) == (r.rec, r.ch_i) and (rec, r.ch_j, epoch) in data:
                x, y = data[rec, ch, epoch], data[rec, r.ch_j, epoch]
                for s in range(0, min(len(x), len(y)) - 127, 128):
                    for k in range(16, 26):  # bins of 8 Hz to under 13 Hz at half a hertz each
                        turn = np.exp(-2j * np.pi * k * np.arange(128) / 128)
                        im.append((((x[s: s + 128] - x[s: s + 128].mean()) @ turn) * np.conj((y[s: s + 128] - y[s: s + 128].mean()) @ turn)).imag)
        im = np.array(im)
        s, q, m = im.sum(), (im**2).sum(), np.abs(im).sum()
        assert abs(r.w - min(1, max(0, (s * s - q) / (m * m - q)))) < 1e-4


def test_permutation_p_takes_all_draws(spark):
    p = [r.p for r in catalog.queries()["permutation_p"](spark, SF).collect() if r.p is not None]
    # 8 pairs have 40,320 permutations, more have 20,000 draws
    assert p and all(min(abs(x * n - round(x * n)) for n in (40_320, 20_001)) < 1e-3 for x in p)


def test_edges_of_every_montage_and_all_channels(spark, duck):
    import numpy as np

    rows = duck.execute("SELECT vec_id, label, embedding FROM embeddings").fetchall()
    want = {(i, j): np.corrcoef(x, y)[0, 1] for i, m, x in rows for j, n, y in rows if i < j and m == n and i // 60 == j // 60}
    got = {(r.ch_i, r.ch_j): r.w for r in catalog.queries()["pair_edges_montages"](spark, SF).collect()}
    assert got.keys() == want.keys() and max(i for i, _ in want) >= 60 and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    sums = {k: [0.0, 0.0] for k in range(-1, 100)}
    for side, (t, c) in enumerate((("supplier", "s"), ("customer", "c"))):
        for k, v in duck.execute(f"SELECT {c}_nationkey, {c}_acctbal FROM {t}").fetchall():
            sums[k][side] += float(v)
    got = {r.k: (float(r.va), float(r.vb)) for r in catalog.queries()["full_outer_all_channels"](spark, SF).collect()}
    assert got and all(abs(a - sums[k][0]) < 1e-3 and abs(b - sums[k][1]) < 1e-3 for k, (a, b) in got.items()) and any(k >= 15 and b for k, (_, b) in got.items())
    assert got.keys() == {k for k, v in sums.items() if any(v)}


def same_as_sql_on(spark, duck, tmp_path, name, table, columns):
    """A query against its SQL on a changed copy of one table, the others as they are."""
    duck.execute(f"COPY (SELECT * REPLACE ({columns}) FROM read_parquet('{SF}/{table}.parquet')) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    df = catalog.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    cur = c.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_sleep_window_of_values_without_a_logarithm(spark, duck, tmp_path):
    same_as_sql_on(spark, duck, tmp_path, "sleep_window", "events", "CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 17 = 0 THEN -5.0 ELSE value + 30 END AS value")


def test_pre_post_verdict_of_baselines_of_zero(spark, duck, tmp_path):
    early = "l_shipdate < TIMESTAMP '1995-06-17'"
    same_as_sql_on(spark, duck, tmp_path, "pre_post_delta_verdict", "lineitem",
                   f"CASE WHEN l_suppkey % 2 = 0 AND {early} THEN 0.0 ELSE l_discount END AS l_discount, CASE WHEN l_suppkey % 3 = 0 THEN 0.0 ELSE l_tax END AS l_tax, "
                   f"CASE WHEN l_suppkey % 5 = 0 AND {early} THEN 0.0 ELSE l_quantity END AS l_quantity")


def test_pattern_score_adds_in_the_order_of_rows(spark, duck, tmp_path):
    """Discounts that sum to a limit in one order and beyond it in another, with the rows of an order dealt over tasks and files."""
    duck.execute(f"""COPY (SELECT i % 1000 AS l_orderkey, 40.0::DOUBLE AS l_quantity, (hash(i) % 11)::DOUBLE / 100 AS l_discount, 0.06::DOUBLE AS l_tax FROM range(12000) r(i))
                     TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)""")
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    cur = c.execute(catalog.oracle_sql()["pattern_score_gated"])
    columns = [x[0] for x in cur.description]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = catalog.queries()["pattern_score_gated"](spark, str(tmp_path))
        got = rows_of(df.columns, df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == rows_of(columns, cur.fetchall())
