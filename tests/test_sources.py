from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.conftest import at
from wirelake.errors import InvalidValueError
from wirelake.operators import summary
from wirelake.schema import NESTED_SCHEMA, PACKET_SCHEMA
from wirelake.sources import nested, parquet
from wirelake.sources.events_view import packets_from_folder


@pytest.fixture
def frame(spark):
    rows = [(at(0), "a", "b", 6, 100), (at(86400), "a", "b", 17, 200), (None, "c", "d", 1, 5)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, IP_src string, IP_dst string, IP_proto int, raw_size bigint")


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("codec", parquet.CODECS)
def test_round_trip(spark, frame, tmp_path, codec):
    path = str(tmp_path / "t")
    parquet.save_packets(frame, path, codec)
    back = parquet.load_landed(spark, path)
    assert rows(back, frame.columns) == rows(frame, frame.columns)
    assert set(PACKET_SCHEMA.names) <= set(back.columns) and "event_date" in back.columns
    assert rows(parquet.load_packets(spark, path), frame.columns) == rows(frame, frame.columns)


def test_codec_and_errors(spark, frame, tmp_path):
    with pytest.raises(InvalidValueError):
        parquet.save_packets(frame, str(tmp_path / "x"), "brotli")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        parquet.load_packets(spark, str(tmp_path / "absent"))


def test_append_merges_columns(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    parquet.save_packets(frame, path)
    parquet.append_packets(frame.select("timestamp", F.lit(53).alias("UDP_dport")), path)
    both = parquet.load_packets(spark, path)
    assert both.count() == 6 and both.where("UDP_dport = 53 and IP_src is null").count() == 3
    parquet.save_packets(frame, path)
    assert parquet.load_packets(spark, path).count() == 3


def test_day_filter_prunes_folders(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    parquet.save_packets(frame, path)
    plan = parquet.load_landed(spark, path).where("event_date = '2024-01-02' and IP_proto = 17").select("IP_src")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in text and "EqualTo(IP_proto,17)" in text
    assert plan.count() == 1


def test_foreign_types(spark, tmp_path):
    path = str(tmp_path / "foreign.parquet")
    pq.write_table(pa.table({
        "timestamp": [1704110400.5, None], "IP_proto": pa.array([6, 17], pa.int64()), "TCP_dport": ["80", "x"],
        "IP_src": ["a", "b"], "custom": [1, 2]}), path)
    df = parquet.load_packets(spark, path)
    first = df.orderBy("IP_src").first()
    assert first.timestamp == datetime(2024, 1, 1, 12, 0, 0, 500000) and first.TCP_dport == 80 and first.custom == 1
    assert [r.TCP_dport for r in df.orderBy("IP_src").collect()] == [80, None]
    zoned = str(tmp_path / "zoned.parquet")
    pq.write_table(pa.table({"timestamp": pa.array([datetime(2024, 1, 1, 12, tzinfo=timezone.utc)], pa.timestamp("us", "UTC"))}), zoned)
    assert parquet.load_packets(spark, zoned).first().timestamp == datetime(2024, 1, 1, 12)


def test_validate_and_info(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    parquet.save_packets(frame, path)
    assert parquet.validate_parquet(spark, path)
    assert not parquet.validate_parquet(spark, str(tmp_path / "absent"))
    (tmp_path / "bad.parquet").write_bytes(b"not parquet at all")
    assert not parquet.validate_parquet(spark, str(tmp_path / "bad.parquet"))
    info = parquet.get_file_info(spark, path).first()
    assert info["name"] == "t" and info["files"] == 3 and info["size_bytes"] > 0 and info["size_formatted"].endswith("KB")
    assert ("IP_src", "string") in [tuple(r) for r in parquet.get_schema(spark, path).collect()]
    assert parquet.save_to_parquet(frame, str(tmp_path), "cap").startswith(str(tmp_path) + "/cap_")
    found = summary.generate_summary(frame, path).where("category = 'file_info'").count()
    assert found == 4


def test_flatten_last_layer_wins(spark):
    layers = [("Ether", {"src_mac": "aa"}), ("IP", {"src": "1.1.1.1", "len": "60", "proto": "6"}),
              ("IP", {"src": "2.2.2.2", "odd": "x"}), ("GRE", {"key": "7"}), ("TCP", {"dport": "many", "flags": "SA"})]
    df = spark.createDataFrame([(1704110400.25, layers, 99), (0.0, [], 1), (1.0, None, 2)], NESTED_SCHEMA)
    flat = nested.flatten_packets(df)
    assert flat.schema.names == PACKET_SCHEMA.names
    row = flat.where("raw_size = 99").first()
    assert (row.IP_src, row.IP_len, row.IP_proto, row.TCP_dport, row.TCP_flags) == ("2.2.2.2", 60, 6, None, "SA")
    assert row.Ethernet_src_mac == "aa" and row.extras == {"GRE_key": "7", "IP_odd": "x"}
    assert row.timestamp == datetime(2024, 1, 1, 12, 0, 0, 250000)
    assert flat.where("raw_size < 3 and extras is null and IP_src is null").count() == 2
    stats = {r.layer_name: (r.packets, r.percentage) for r in nested.show_stats(df).collect()}
    assert stats["IP"] == (2, pytest.approx(200 / 3)) and stats["TCP"] == (1, pytest.approx(100 / 3))
    assert df.where(nested.has_layer("GRE")).count() == 1
    assert df.select(nested.get_layer("IP").alias("x")).where("x is not null").first().x.fields["src"] == "1.1.1.1"


def test_json_files(spark, frame, tmp_path):
    nested.write_json(nested.nest_packets(frame.where("timestamp is not null")), str(tmp_path / "j"))
    back = nested.flatten_packets(nested.read_nested(spark, str(tmp_path / "j")))
    assert rows(back, frame.columns) == rows(frame.where("timestamp is not null"), frame.columns)


@pytest.mark.parametrize("kind", ["json", "csv", "parquet"])
def test_summary_export(spark, frame, tmp_path, kind):
    summary.export_summary_report(frame.withColumn("IP_len", F.lit(1)), kind, str(tmp_path / kind))
    reader = spark.read.option("header", True).format(kind).schema("category string, metric string, value string")
    got = {(r.category, r.metric): r.value for r in reader.load(str(tmp_path / kind)).collect()}
    assert got["packet_counts", "total"] == "3" and got["general", "unique_hosts"] == "4" and got["protocols", "6"] == "1"


def test_layers_without_fields_take_nothing_away(spark):
    from wirelake.schema import NESTED_SCHEMA

    rows = [(0.0, [("TCP", {"sport": "1", "weird": "w"}), ("X", {"a": "b"}), ("Y", None)], 1),
            (0.0, [("TCP", {"sport": "1", "dport": "2"}), ("TCP", None)], 2),
            (0.0, [("TCP", {"x_y": "known"}), ("TCP_x", {"y": "unknown"}), ("TCP", {"x_y": "later"})], 3), (0.0, None, 4)]
    df = spark.createDataFrame(rows, "timestamp double, layers array<struct<layer_name string, fields map<string,string>>>, raw_size int")
    flat = {r.raw_size: r for r in nested.flatten_packets(df.select(*[f.name for f in NESTED_SCHEMA])).collect()}
    assert flat[1].extras == {"TCP_weird": "w", "X_a": "b"} and flat[1].TCP_sport == 1
    assert (flat[2].TCP_sport, flat[2].TCP_dport) == (1, 2) and flat[3].extras == {"TCP_x_y": "later"} and flat[4].extras is None


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from wirelake.session import scratch_path

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(far, "x")
    far.conf.get = lambda *_: "hdfs://shared"
    assert scratch_path(far, "x").startswith("hdfs://shared/x-")


def test_describe_takes_every_column(spark, small_dir, tmp_path):
    from wirelake.operators.filters import describe

    parquet.save_packets(packets_from_folder(spark, small_dir), str(tmp_path / "p"))
    packets = parquet.load_landed(spark, str(tmp_path / "p"))
    rows = {r["column"]: r for r in describe(packets).collect()}
    assert set(rows) == set(packets.columns) and rows["timestamp"].p25 < rows["timestamp"].p75
    odd = spark.createDataFrame([(True, 0.5), (False, 1.5), (None, None)], "b boolean, d double")
    rows = {r["column"]: r for r in describe(odd).collect()}
    assert (rows["d"].mean, rows["d"].p50, rows["b"].mean, rows["b"].null_count) == (1.0, 1.0, 0.5, 1)


def test_describe_takes_doubles_of_any_size(spark):
    from wirelake.operators.filters import describe

    nan, inf = float("nan"), float("inf")
    odd = spark.createDataFrame([(nan, 1e13, inf), (1e13, 1e-9, -inf), (1e-9, -3e300, 5e-324), (None, 0.0, -0.0)], "d double, e double, f double")
    rows = {r["column"]: r for r in describe(odd).collect()}
    d, e, f = (rows[c] for c in "def")
    assert (d["count"], d.null_count, d.min, d.p50) == (3, 1, 1e-9, 1e13) and d.mean != d.mean and d.max != d.max
    assert (e["count"], e.null_count, e.min, e.max, e.p50, e.mean) == (4, 0, -3e300, 1e13, 5e-10, -7.5e299)
    assert (f.min, f.max, f.p50) == (-inf, inf, 0.0)
    import random
    import statistics

    rnd = random.Random(1)
    values = [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.randint(-300, 300) for _ in range(999)]
    row = describe(spark.createDataFrame([(v,) for v in values], "x double")).head()
    assert [row.p25, row.p50, row.p75] == statistics.quantiles(values, n=4, method="inclusive")
