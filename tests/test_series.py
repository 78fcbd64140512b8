import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import pearson_p
from tidemark.operators import series

D = dt.date


def months(n, start=2020):
    return [D(start + k // 12, k % 12 + 1, 1) for k in range(n)]


def table(spark, values, key="a"):
    return spark.createDataFrame([(key, m, float(v)) for m, v in zip(months(len(values)), values, strict=True)], "substance string, period date, v double")


def test_a_window_of_three_never_spikes(spark):
    rows = series.centered_z(table(spark, [0, 0, 1e9, 0, 0]), keys=["substance"], value="v").orderBy("period").collect()
    assert not any(r["is_spike"] for r in rows)
    assert rows[2]["z"] == pytest.approx(2 / math.sqrt(3)) and rows[0]["z"] is None


def test_even_windows_reach_one_further_back():
    assert series.centered_frame(12) == (-6, 5) and series.centered_frame(3) == (-1, 1)


def test_trailing(spark):
    rows = series.trailing_z(table(spark, [1, 2, 1, 2, 1, 2, 10]), keys=["substance"], value="v").orderBy("period").collect()
    assert rows[-1]["z"] == pytest.approx((10 - 1.5) / 0.5477225575, rel=1e-6) and rows[-1]["is_spike"]
    assert rows[0]["z"] is None and rows[1]["z"] is None and not rows[2]["is_spike"]


def test_global_without_spread(spark):
    assert {r["z"] for r in series.global_z(table(spark, [3, 3, 3]), keys=["substance"], value="v", flat=1.0).collect()} == {1.0}


def test_gaps_are_filled_by_key(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1), 5), ("a", D(2024, 4, 1), 7), ("b", D(2024, 2, 1), 1)], "k string, period date, n long")
    got = [(r["k"], r["period"].month, r["n"]) for r in series.fill_gaps(df, keys=["k"], value="n").orderBy("k", "period").collect()]
    assert got == [("a", 1, 5), ("a", 2, 0), ("a", 3, 0), ("a", 4, 7), ("b", 2, 1)]
    weeks = spark.createDataFrame([("a", D(2024, 1, 1), 5), ("a", D(2024, 1, 22), 7)], "k string, period date, n long")
    assert series.fill_gaps(weeks, keys=["k"], value="n", unit="week").count() == 4


def test_leads(spark):
    rng = random.Random(1)
    social = [rng.random() for _ in range(40)]
    official = [0, 0, 0, *social[:-3]]  # official[t + 3] = social[t]
    got = series.lead_lag(table(spark, social), table(spark, official).withColumnRenamed("v", "o"), keys=["substance"], social_value="v", official_value="o")
    best = max(got.collect(), key=lambda r: r["r"])
    assert best["shift_lag"] == -3 and best["lead_months"] == 3 and best["r"] == pytest.approx(1, abs=1e-9)
    assert series.best_lead(got, keys=["substance"]).first()["lead_months"] == 3
    assert series.best_lead(got, keys=["substance"], by="surest").first()["lead_months"] == 3
    rows = series.lead_lag(table(spark, social), table(spark, official).withColumnRenamed("v", "o"), keys=["substance"], social_value="v", official_value="o", calendar=False)
    assert {(r["shift_lag"], round(r["r"], 9)) for r in rows.collect()} == {(r["shift_lag"], round(r["r"], 9)) for r in got.collect()}


def test_no_lead_without_pairs(spark):
    few = series.lead_lag(table(spark, [1, 2, 3]), table(spark, [1, 2, 3]).withColumnRenamed("v", "o"), keys=["substance"], social_value="v", official_value="o")
    assert few.count() == 0


@pytest.mark.parametrize(("r", "n", "p"), [(0.471, 33, 0.0057), (0.421, 34, 0.0132), (0.358, 35, 0.0347), (0.241, 36, 0.1568), (0.115, 35, 0.5106)])
def test_p_values(r, n, p):
    assert pearson_p(r, n) == pytest.approx(p, abs=6e-5)


def test_p_value_equals_an_integral():
    for r, n in ((0.3, 10), (-0.8, 6), (0.05, 100), (0.0, 9)):
        df = n - 2
        t = abs(r) * math.sqrt(df / (1 - r * r))
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        # the density from t on, with u = 1 / (1 + x)
        steps = 200_000
        total = 0.0
        for k in range(steps):
            x = t + (lambda u: u / (1 - u))((k + 0.5) / steps)
            total += c * (1 + x * x / df) ** (-(df + 1) / 2) / (1 - (k + 0.5) / steps) ** 2 / steps
        assert pearson_p(r, n) == pytest.approx(2 * total, abs=2e-4)
    assert pearson_p(1.0, 5) == 0.0 and pearson_p(0.5, 2) is None and pearson_p(None, 9) is None


def spikes(spark, rows):
    return spark.createDataFrame(rows, "substance string, period date")


def test_range_joins_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = sorted({(rng.choice("abcd"), D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 700))) for _ in range(80)})
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("d", "b")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = {(r["substance"], r["period"]): r["related"] for r in series.spillover(spikes(spark, rows), edges).collect()}
    for s, p in rows:
        want = sorted({b for a, b in pairs if a == s for s2, p2 in rows if s2 == b and abs((p2 - p).days) <= 35})
        assert got[s, p] == want


def test_lags_and_ranks_equal_all_pairs(spark):
    rng = random.Random(8)
    sp = sorted({(rng.choice("ab"), rng.choice(months(30))) for _ in range(20)})
    al = sorted({(rng.choice(months(34, 2019)), t, round(rng.uniform(1.5, 4), 2)) for t in "xyz" for _ in range(8)})
    alerts = spark.createDataFrame([(p, t, z, "watch") for p, t, z in al], "period date, topic string, z_score double, alert_level string")
    shift = lambda p, k: D(p.year + (p.month - 1 + k) // 12, (p.month - 1 + k) % 12 + 1, 1)
    got = {(r["substance"], r["spike_period"]): (r["alert_period"], r["lag_days"]) for r in series.detection_lag(spikes(spark, sp), alerts).collect()}
    want = {}
    for s, p in sp:
        near = [a for a, _, _ in al if shift(p, -12) <= a <= shift(p, 3)]
        if near:
            want[s, p] = (min(near), (min(near) - p).days)
    assert got == want
    leads = spark.createDataFrame([("a", 2), ("b", 0)], "substance string, lead_months int")
    topics = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "substance string, topic string")
    ranks = {(r["substance"], r["spike_period"]): r["reciprocal_rank"] for r in series.reciprocal_ranks(spikes(spark, sp), alerts, leads, topics).collect()}
    top = defaultdict(dict)
    for p, t, z in al:
        top[p][t] = max(z, top[p].get(t, 0))
    for s, p in sp:
        order = sorted(top[shift(p, -2 if s == "a" else 0)].items(), key=lambda x: (-x[1], x[0]))
        hits = [k + 1 for k, (t, _) in enumerate(order) if t in ("xy" if s == "a" else "z")]
        assert ranks[s, p] == pytest.approx(1 / min(hits) if hits else 0)


def test_rates(spark):
    from tidemark.sources.readers import death_rates, denominators, prevalence

    assert prevalence(spark).count() == death_rates(spark).count() == 32
    rates, pivoted = denominators(spark)
    assert {r["substance"]: r["rate"] for r in rates.collect()}["alcohol"] == 9.8
    assert pivoted.where("year = 2015").first()["opioid"] == 1.5
    signal = spark.createDataFrame([("alcohol", 49), ("other", 7)], "substance string, n long")
    got = {r["substance"]: r["normalized"] for r in series.normalize_by_rate(signal, rates, key="substance", value="n").collect()}
    assert got["alcohol"] == pytest.approx(500) and got["other"] == 7


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.binning import bin_stream, spikes_in_batch

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(dt.datetime(2030, 1, 1), "end")], "ts timestamp, event_type string")
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = bin_stream(stream, time="ts", keys=["event_type"]).writeStream.format("memory").queryName("binned").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    out.processAllAvailable()
    out.stop()
    got = {tuple(r) for r in spark.table("binned").where("event_type <> 'end'").select("period", "event_type", "post_count").collect()}
    want = {tuple(r) for r in series.bin_signal(events, time="ts", keys=["event_type"], unit="week").select("period", "event_type", "post_count").collect()}
    assert got == want and all(p.weekday() == 0 for p, _, _ in got)
    assert spikes_in_batch(spark.table("binned"), keys=["event_type"]).count() == len(got) + 1
