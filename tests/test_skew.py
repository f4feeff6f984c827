"""Skew-safe helpers against brute force, on data in which one key holds most rows."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import START, at
from wirelake.operators import anomaly, arp, flow, tcp
from wirelake.operators.slices import (interval_stats, match_first, sequential_share, sums_and_distincts, value_stats,
                                       with_previous)


@pytest.fixture(scope="module")
def events():
    """(key, second); key 'hot' has two thirds of the rows, with bursts, ties and long silences."""
    rng, out = random.Random(3), []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{rng.randrange(40)}"
        out.append((key, rng.choice([rng.uniform(0, 60), rng.uniform(0, 90000), float(rng.randrange(300))])))
    return [(k, round(t, 6)) for k, t in out]


def test_interval_stats(spark, events):
    frame = spark.createDataFrame([(k, at(t)) for k, t in events], "key string, timestamp timestamp_ntz")
    for keys in (["key"], []):
        groups = defaultdict(list)
        for k, t in events:
            groups[k if keys else "all"].append(t)
        for width in ("1m", "1h"):
            got = {(r.key if keys else "all"): r for r in interval_stats(frame, keys, width).collect()}
            assert set(got) == set(groups)
            for key, times in groups.items():
                times.sort()
                gaps = [b - a for a, b in zip(times, times[1:])]
                row = got[key]
                assert (row.packets, row.n_intervals) == (len(times), len(gaps))
                if len(gaps) > 1:
                    assert row.avg == pytest.approx(statistics.mean(gaps))
                    assert row.std == pytest.approx(statistics.stdev(gaps))
                    assert (row.min, row.max) == (pytest.approx(min(gaps), abs=1e-6), pytest.approx(max(gaps)))


def test_constant_gaps_have_no_spread(spark):
    frame = spark.createDataFrame([(at(60 * i),) for i in range(500)], "timestamp timestamp_ntz")
    row = interval_stats(frame, [], "5m").first()
    assert (row.avg, row.std) == (60.0, 0.0)


def test_with_previous(spark, events):
    rows = [(k, int(t * 1e6), i) for i, (k, t) in enumerate(events)]
    frame = spark.createDataFrame(rows, "key string, _us long, id int")
    got = {r.id: (r._prev.id if r._prev else None) for r in
           with_previous(frame, ["key"], ["_us", "id"], ["id"], "1m").collect()}
    last = {}
    for key, us, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        assert got.pop(i) == last.get(key)
        last[key] = i
    assert not got


def test_value_stats(spark):
    rng = random.Random(4)
    for numbers in ([5], [-7, 3], [rng.randrange(-50, 50) for _ in range(501)],
                    [int(rng.lognormvariate(12, 3)) for _ in range(2000)] + [10 ** 12] * 900):
        frame = spark.createDataFrame([(n,) for n in numbers], "v long")
        row = value_stats(frame, F.col("v"), {"a": 0.0, "q": 0.25, "m": 0.5, "p": 0.99, "z": 1.0}).first()
        ordered = sorted(numbers)

        def quantile(q):
            place = q * (len(ordered) - 1)
            low = int(place)
            high = min(low + 1, len(ordered) - 1)
            return ordered[low] + (ordered[high] - ordered[low]) * (place - low)

        assert (row["count"], row["min"], row["max"]) == (len(numbers), min(numbers), max(numbers))
        assert row["avg"] == pytest.approx(statistics.fmean(numbers))
        for name, q in (("a", 0), ("q", 0.25), ("m", 0.5), ("p", 0.99), ("z", 1)):
            assert row[name] == pytest.approx(quantile(q)), (name, len(numbers))
    assert value_stats(frame.where("v is null"), F.col("v"), {"m": 0.5}).count() == 0


def test_sequential_share(spark):
    numbers = list(range(65_530, 65_545)) + [70_000, 200_000, 200_001] + [65_540] * 50
    frame = spark.createDataFrame([("a", n) for n in numbers] + [("b", 5)], "k string, v long")
    got = {r.k: (r.n, r.sequential_share) for r in sequential_share(frame, ["k"], F.col("v")).collect()}
    assert got == {"a": (18, pytest.approx(15 / 17)), "b": (1, 0.0)}


def test_match_first(spark):
    rng, rows = random.Random(6), []
    for i in range(4000):
        rows.append((rng.choice(["hot", "hot", "hot", f"k{rng.randrange(50)}"]), rng.randrange(0, 600_000_000),
                     rng.random() < 0.5, i))
    frame = spark.createDataFrame(rows, "key string, _us long, _is_reply boolean, id int")
    got = {r.id: (None if r._reply is None else r._reply._us) for r in
           match_first(frame, ["key"], ["id"], [], "5s", "1m").collect()}
    replies = defaultdict(list)
    for key, us, is_reply, _ in rows:
        if is_reply:
            replies[key].append(us)
    for key, us, is_reply, i in rows:
        if not is_reply:
            near = [r for r in replies[key] if us <= r <= us + 5_000_000]
            assert got.pop(i) == (min(near) if near else None)
    assert not got


def test_sums_and_distincts(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "x"]), rng.choice(["p", "q", None]), rng.choice([1, 2, 3, None]),
             rng.choice([1, None]), rng.randrange(9)) for _ in range(900)]
    frame = spark.createDataFrame(rows, "k string, s string, a int, b int, n int")
    got = sums_and_distincts(frame, ["k"], {"rows": ("sum", F.lit(1)), "total": ("sum", F.col("n")), "top": ("max", F.col("n"))},
                             {"ss": "s", "as_": "a", "bs": "b"}).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.k]
        assert (r.rows, r.total, r.top) == (len(mine), sum(x[4] for x in mine), max(x[4] for x in mine))
        assert (r.ss, r.as_, r.bs) == tuple(len({x[i] for x in mine} - {None}) for i in (1, 2, 3))


def test_sessions_match_gaps(spark):
    rng = random.Random(8)
    times = sorted(rng.choice([rng.uniform(0, 4000), float(rng.randrange(4000))]) for _ in range(400)) + [9000.0, 9300.0, 9600.000001]
    frame = spark.createDataFrame([(at(t), "1.1.1.1", "2.2.2.2", 6, 10, 1, 2) for t in times],
                                  "timestamp timestamp_ntz, IP_src string, IP_dst string, IP_proto int, IP_len int, TCP_sport int, TCP_dport int")
    for limit in (5, 10, 300):
        sizes, last = [], None
        for t in times:
            if last is None or round((t - last) * 1e6) > limit * 1_000_000:
                sizes.append(0)
            sizes[-1] += 1
            last = t
        got = [r.packet_count for r in flow.create_flows(frame, limit).orderBy("flow_seq").collect()]
        assert got == sizes


def test_positions_of_long_sequences(spark):
    rows = [(at(i * 0.01), "9.9.9.9", "8.8.8.8", 6, 40, 1, i % 70, "SA"[i % 2]) for i in range(1000)]
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, IP_src string, IP_dst string, IP_proto int, IP_len int, "
                                        "TCP_sport int, TCP_dport int, TCP_flags string").withColumn("TCP_seq", F.lit(1).cast("long"))
    scan = tcp.detect_port_scanning(frame, "balanced").orderBy("position").collect()
    assert [(r.position, r.port) for r in scan] == [(i + 1, i % 70) for i in range(1000)]
    flags = tcp.analyze_flag_sequences(frame.withColumn("TCP_dport", F.lit(5))).orderBy("position").collect()
    assert [(r.position, r.TCP_flags, r.packet_count) for r in flags] == [(i + 1, "SA"[i % 2], 1000) for i in range(1000)]


def test_one_second_of_a_hot_connection_is_spread_over_tasks(spark):
    from wirelake.operators.slices import with_position

    frame = spark.range(1_000_000).select(F.lit("x").alias("key"), (F.col("id") + 1_700_000_000_000_000).alias("_us"), F.col("id"))
    placed = with_position(frame, ["key"], ["_us"])
    assert placed.where("position <> id + 1 or _total <> 1000000").isEmpty()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few bytes would be put together again
    try:
        shares = placed.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) > 1 and max(r["count"] for r in shares) < 600_000


def test_period_of_a_beacon(spark):
    rows = [(at(45 * i), "1.1.1.1") for i in range(200)] + [(at(7.3 * i * i % 8000), "2.2.2.2") for i in range(150)]
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, IP_src string").withColumn("IP_dst", F.lit("x"))
    for width in ("10m", "7d"):
        got = flow.detect_periodic_patterns(frame, slice_width=width).collect()
        assert [(r.src_ip, r.period_s) for r in got if r.src_ip == "1.1.1.1"] == [("1.1.1.1", 45.0)]
    slow = spark.createDataFrame([(at(600 * i), "3.3.3.3", "x") for i in range(50)], "timestamp timestamp_ntz, IP_src string, IP_dst string")
    assert [(r.src_ip, r.period_s) for r in flow.detect_periodic_patterns(slow).collect()] == [("3.3.3.3", 600.0)]


def test_lag_products_of_dense_and_sparse_slices():
    """By transform, by neighbours and straight: the same whole numbers, for slices of any density in one batch."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.RandomState(3)
    rows, want = [], {}
    for source, n, span, top in (("a", 700, 900, 3), ("b", 5, 4000, 9), ("c", 900, 901, 1 << 21), ("d", 1, 1, 2), ("e", 400, 30_000, 5)):
        t = np.sort(rnd.choice(span, n, replace=False)) - 50
        x = rnd.randint(1, top + 1, n).astype(float)
        mine = rnd.rand(n) < 0.8
        rows += [(source, 0, 0, int(a), float(b), bool(c)) for a, b, c in zip(t, x, mine)]
        for i in range(n):
            for j in range(i + 1, n):
                if mine[i] and t[j] - t[i] <= 300:
                    want[source, int(t[j] - t[i])] = want.get((source, int(t[j] - t[i])), 0.0) + x[i] * x[j]
    table = pa.table(dict(zip(("src_ip", "level", "slice", "t", "x", "mine"), zip(*rows))))
    for dense in (1, 600, 10_000):
        parts = [flow.lag_products(part, 300, dense) for part in flow.whole_groups(iter(table.to_batches(max_chunksize=333)), 3)]
        got = [(s, k, c) for p in parts for s, k, c in zip(*(p.column(i).to_pylist() for i in (0, 2, 3)))]
        assert len(got) == len(want) and {(s, k): c for s, k, c in got} == want


def test_result_does_not_depend_on_partitioning(spark, small_dir):
    from wirelake.operators.summary import behavioral_summary
    from wirelake.sources.events_view import packets_from_folder

    packets = packets_from_folder(spark, small_dir)
    for build in (lambda p: behavioral_summary(p, "1h"), lambda p: flow.create_flows(p, "protocol"),
                  lambda p: anomaly.detect_port_scanning(p, threshold=20, time_window="5m")):
        one, many = build(packets.coalesce(1)), build(packets.repartition(7, F.rand(1)))
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert START
