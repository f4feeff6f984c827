"""Shape of the plans: what must reach the scan, and what must not appear."""

import __spark_entry__ as contract
from wirelake.sources import parquet
from wirelake.sources.events_view import packets_from_folder

QUERIES = contract.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, small_dir, tmp_path):
    from wirelake.operators import anomaly, tcp
    from wirelake.operators.flow import get_flow_by_id

    path = str(tmp_path / "p")
    parquet.save_packets(packets_from_folder(spark, small_dir), path)
    packets = parquet.load_landed(spark, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    text = plan_of(tcp.get_syn_count(packets))
    assert "EqualTo(IP_proto,6)" in text and "ReadSchema: struct<IP_proto:int,TCP_flags:string>" in text
    text = plan_of(anomaly.detect_port_scanning(packets, ports_contacted=False).where("scanner_ip = '10.0.9.9'"))
    assert "IP_src" in text.split("ReadSchema")[1] and "raw_size" not in text
    from wirelake.plans import workflows

    for check in (workflows.check_scanning_behavior, workflows.check_attack_patterns):
        text = plan_of(check(packets, "10.0.9.9"))
        for scan in text.split("FileScan")[1:]:
            assert "EqualTo(IP_src,10.0.9.9)" in scan.split("PushedFilters")[1].split("ReadSchema")[0]
    text = plan_of(get_flow_by_id(packets, "10.0.8.8:20501->93.184.216.34:443:TCP"))
    pushed = text.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "EqualTo(IP_src,10.0.8.8)" in pushed and "EqualTo(TCP_sport,20501)" in pushed


def test_percentiles_share_one_count_of_values(spark, small_dir):
    df = QUERIES["flow_duration_stats"](spark, small_dir)
    df.collect()
    assert "ReusedExchange" in plan_of(df) or "ReusedExchange" in df._jdf.queryExecution().executedPlan().treeString()


def test_the_audit_scans_the_table_three_times(spark, small_dir, tmp_path, monkeypatch):
    """Two scans when the facts are gathered, one for beacons when the report runs; all other scans are of written facts."""
    from pyspark.sql import DataFrameWriter
    from wirelake.plans import facts, workflows

    path = str(tmp_path / "packets")
    parquet.save_packets(packets_from_folder(spark, small_dir), path)
    packets, written, plain = parquet.load_landed(spark, path), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, to, *a, **k: (written.append(plan_of(self._df)), plain(self, to, *a, **k))[1])
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    report = workflows.daily_audit(packets)
    assert not written  # nothing is gathered before the report is looked at
    plans = [*map(plan_of, report.checks), plan_of(report.sections)] + written
    assert len(written) == 2 and sum(p.count(path) for p in plans) == 3
    assert facts.gather(packets.limit(0)).totals().head()["n"] == 0
    assert workflows.daily_audit(packets.limit(0)).run().count() == 1


def test_the_summary_scans_the_table_once(spark, small_dir, tmp_path):
    from wirelake.operators import summary

    path = str(tmp_path / "packets")
    parquet.save_packets(packets_from_folder(spark, small_dir), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    assert plan_of(summary.generate_summary(parquet.load_landed(spark, path))).count(path) == 1


def test_a_host_is_found_in_few_row_groups(spark, tmp_path):
    from wirelake.operators.filters import find_ip_information

    rows = spark.range(200_000).selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 86400) as timestamp",
        "concat('10.', (id * 7919) % 50, '.', (id * 104729) % 60, '.1') as IP_src", "concat('11.', (id * 31) % 40, '.', (id * 17) % 70, '.1') as IP_dst",
        "cast(id % 3 as int) as IP_proto", "id as raw_size")
    path = str(tmp_path / "clustered")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 30))
    parquet.save_clustered(rows, path, group_bytes=64 << 10)
    table = parquet.load_landed(spark, path)
    assert table.count() == 200_000

    def read(df):
        df.collect()
        node = df._jdf.queryExecution().executedPlan()
        stack = [node]
        while stack:
            node = stack.pop()
            if node.nodeName().startswith("Scan parquet"):
                return node.metrics().apply("numOutputRows").value()
            stack += [node.children().apply(i) for i in range(node.children().size())]
            if "AdaptiveSparkPlan" in node.nodeName():
                stack.append(node.executedPlan())
    host = rows.orderBy("raw_size").head()["IP_src"]
    found = find_ip_information(table, host).select("raw_size")
    want = rows.where(f"IP_src = '{host}' or IP_dst = '{host}'").count()
    assert 0 < want == found.count() and read(found) < 0.2 * 200_000
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
