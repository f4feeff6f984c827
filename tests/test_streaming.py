
import os
import random
import statistics
import time

import pyarrow.parquet as pq

from tests.conftest import at
from wirelake.catalog import streams
from wirelake.operators import arp, flow
from wirelake.streaming import alerts, detectors, ingest, late, stateful
from wirelake.streaming.core import run_available, run_to_end, state_session, with_event_time, with_last_packets, write_parquet

SCHEMA = ("timestamp timestamp_ntz, IP_src string, IP_dst string, IP_proto int, IP_len int, TCP_sport int, TCP_dport int, "
          "TCP_flags string, ARP_sender_ip string, ARP_sender_mac string, ARP_target_ip string, raw_size bigint")


def stream_of(spark, folder, *batches):
    """A stream that takes one file per micro-batch, in the order given."""
    spark = state_session(spark, 4)
    for i, rows in enumerate(batches):
        path = f"{folder}/part{i}.parquet"
        pq.write_table(spark.createDataFrame(rows, SCHEMA).toArrow(), path)
        os.utime(path, (time.time() - 100 + i,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def tcp_row(t, src="a", dst="b", sport=1, dport=80, flags="S", size=10):
    return (at(t), src, dst, 6, size, sport, dport, flags, None, None, None, size)


def test_late_rows_are_dropped(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [tcp_row(0), tcp_row(30)], [tcp_row(600)], [tcp_row(601)], [tcp_row(5)], [tcp_row(1200)])
    got = run_available(detectors.live_packet_rate(stream, "1m", "1m"), "t").orderBy("window_start").collect()
    assert [(r.window_start, r.packet_count) for r in got] == [(at(0), 2), (at(600), 2)]


def test_scan_over_batches(spark, tmp_path):
    ports = [[tcp_row(b * 10 + i, dport=b * 10 + i) for i in range(10)] for b in range(3)]
    stream = stream_of(spark, tmp_path, *ports, [tcp_row(5000)], [tcp_row(5001)])
    got = run_available(detectors.live_port_scans(stream, threshold=25, time_window="5m", delay="1m"), "t").collect()
    assert [(r.scanner_ip, r.unique_ports, r.total_packets) for r in got] == [("a", 30, 30)]


def test_flows_equal_batch(spark, tmp_path):
    rows = [tcp_row(t) for t in (0, 100, 400.5, 800, 1100, 1400)] + [tcp_row(9000, src="z")]
    stream = stream_of(spark, tmp_path, rows[:3], rows[3:])
    got = run_available(stateful.live_flows(stream, "5m", "1m"), "t").orderBy("start_time").collect()
    want = flow.create_flows(spark.createDataFrame(rows[:-1], SCHEMA), "5m").orderBy("start_time").collect()
    assert [(r.packet_count, r.start_time, r.end_time) for r in got] == [(r.packet_count, r.start_time, r.end_time) for r in want]
    assert [r.packet_count for r in got] == [2, 1, 3]  # 300.5 s splits, 300 s does not


def arp_row(t, mac, ip="1.1.1.1", target="1.1.1.2"):
    return (at(t), None, None, None, None, None, None, None, ip, mac, target, 60)


ARP_COLUMNS = ["ip_address", "old_mac", "new_mac", "changed_at", "is_gratuitous"]


def arp_changes(spark, folder, batches, **how):
    folder.mkdir()
    end = f"{folder}-end"
    stream = with_last_packets(stream_of(spark, folder, *batches), end)
    return sorted(tuple(r) for r in run_to_end(stateful.live_arp_changes(stream, **how), end, "t").select(ARP_COLUMNS).collect())


def test_arp_changes_in_any_order_of_files(spark, tmp_path):
    """One file a micro-batch, in whatever order: the changes of event time."""
    rnd = random.Random(4)
    rows = [arp_row(100, "m1"), arp_row(300, "m1"), arp_row(200, "m2")]
    rows += [arp_row(rnd.randint(0, 900), rnd.choice("ab"), f"1.1.1.{rnd.randint(1, 3)}", "1.1.1.1") for _ in range(80)]
    rows += [arp_row(450, "b", "9.9.9.9", "9.9.9.9"), arp_row(450, "a", "9.9.9.9"), arp_row(450, "a", "9.9.9.9")]
    want = sorted(tuple(r) for r in arp.detect_arp_spoofing(spark.createDataFrame(rows, SCHEMA)).select(ARP_COLUMNS).collect())
    assert len(want) > 20 and ("1.1.1.1", "m1", "m2", at(200), False) in arp_changes(spark, tmp_path / "probe", [rows[:2], rows[2:3]], delay="1h")
    for i in range(2):
        rnd.shuffle(rows)
        assert arp_changes(spark, tmp_path / f"in{i}", [rows[k::5] for k in range(5)], delay="1h") == want


def test_events_are_read_once_for_files_out_of_order(spark, small_dir, tmp_path, monkeypatch):
    packets = streams.packets_from_folder(spark, small_dir).select("timestamp", "ARP_sender_ip", "raw_size").coalesce(1)

    def seen(batches):
        (tmp_path / f"read-{time.time_ns()}-{os.getpid()}").touch()
        yield from batches

    monkeypatch.setattr(streams, "packets_from_folder", lambda *_: packets.mapInArrow(seen, packets.schema))
    stream = streams.shuffled_stream(spark, small_dir)
    assert len(list(tmp_path.glob("read-*"))) == 1
    kept = stream.selectExpr("timestamp", "raw_size", "element_at(split(_metadata.file_path, '/'), -1) AS file",
                             "_metadata.file_modification_time AS written")
    rows = run_available(kept, "t").collect()
    want = packets.where("ARP_sender_ip is not null").select("timestamp", "raw_size").collect()
    assert sorted((r.timestamp, r.raw_size) for r in rows) == sorted(map(tuple, want))
    by_file = {}
    for r in rows:
        by_file.setdefault((r.written, r.file), []).append(r.timestamp)
    files = [by_file[f] for f in sorted(by_file)]
    assert len(files) > 5 and any(max(a) > min(b) for a, b in zip(files, files[1:]))  # out of order
    assert all((max(a) - min(b)).days < 2 for i, a in enumerate(files) for b in files[i + 1:])


def test_silent_addresses_are_forgotten(spark, tmp_path):
    rows = [arp_row(0, "a"), arp_row(60, "b"), arp_row(4000, "a"), arp_row(4010, "b"), arp_row(0, "x", "2.2.2.2"), arp_row(9000, "y", "3.3.3.3")]
    for i, batches in enumerate(([rows], [[r] for r in sorted(rows, key=lambda r: r[0])])):
        got = arp_changes(spark, tmp_path / f"in{i}", batches, delay="1m", idle="30m")
        assert [(r[1], r[2], r[3]) for r in got] == [("a", "b", at(60)), ("a", "b", at(4010))]
    stream = stream_of(spark, tmp_path / "in1", *[[arp_row(t, "z", "3.3.3.3")] for t in (20000, 30000, 30001)])
    query = write_parquet(stateful.live_arp_changes(stream, delay="1m", idle="30m"), f"{tmp_path}/t", f"{tmp_path}/c")
    query.awaitTermination()
    left = [o.numRowsTotal for o in query.lastProgress.stateOperators if o.operatorName.startswith("transformWithState")]
    assert left and left[0] <= 2  # the last address and its timer


def test_late_rows_are_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = stream_of(spark, tmp_path / "in", [tcp_row(0), tcp_row(30)], [tcp_row(600)], [tcp_row(601)], [tcp_row(5), tcp_row(6, src="c")], [tcp_row(1200)])
    session = stream.sparkSession
    counter = late.watch(session, f"{tmp_path}/late")
    kept = with_event_time(stream, "1m").dropDuplicatesWithinWatermark(["timestamp", "IP_src"]).drop("event_time")
    query = write_parquet(kept, f"{tmp_path}/t", f"{tmp_path}/c")
    query.awaitTermination()
    assert counter.wait(query)
    session.streams.removeListener(counter)
    rows = late.late_rows(session, f"{tmp_path}/late").collect()
    assert [(r.batch_id, r.late_rows) for r in rows] == [(3, 2)] and rows[0].query_id == str(query.id)
    assert session.read.parquet(f"{tmp_path}/t").count() == 5


def test_bursts_are_compared_with_earlier_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    counts = [3, 4, 5, 4, 3, 4, 5, 4, 40, 4, 41, 5]
    rows = [tcp_row(60 * m + i / 100) for m, n in enumerate(counts) for i in range(n)]
    end = str(tmp_path / "end")
    stream = with_last_packets(stream_of(spark, tmp_path / "in", *[rows[i:i + 37] for i in range(0, len(rows), 37)]), end)
    got = run_to_end(detectors.live_traffic_bursts(stream, 3.0, "1m", least=5), end, "t").orderBy("window_start").collect()
    mean, std = statistics.mean(counts[:8]), statistics.stdev(counts[:8])
    assert [(r.window_start, r.packets) for r in got] == [(at(480), 40)]  # the second burst lies within what the first did to the deviation
    assert abs(got[0].mean - mean) < 1e-9 and abs(got[0].std - std) < 1e-9 and abs(got[0].z - (40 - mean) / std) < 1e-9


def test_merge_keeps_one_of_each(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    one = stream_of(spark, tmp_path / "a", [tcp_row(0), tcp_row(1)], [tcp_row(2)])
    two = stream_of(spark, tmp_path / "b", [tcp_row(1), tcp_row(2)], [tcp_row(3), tcp_row(0)])
    got = run_available(ingest.merge_captures(one, two).select("timestamp"), "t").orderBy("timestamp").collect()
    assert [r.timestamp for r in got] == [at(0), at(1), at(2), at(3)]


def detection(t, host="h", text="x"):
    return ("high", "Port Scan", at(t), host, text)


DETECTION = "severity string, category string, at timestamp_ntz, host string, description string"


def test_one_attack_is_one_alert(spark, tmp_path):
    """Opened, repeated and closed over micro-batches; a micro-batch that runs twice stores nothing twice."""
    folder = f"{tmp_path}/feed"
    batches = [[detection(0, text="b"), detection(0, text="a"), detection(300)], [], [detection(600), detection(600, "i")],
               [detection(5000, "i"), detection(5000, None)], [detection(5300, "i")]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            alerts.store(spark.createDataFrame(rows, DETECTION), number, folder, "10m")
    rows = {(r.host, r.opened_at): (r.last_at, r.detections, r.description, r.status) for r in alerts.alerts(spark, folder).collect()}
    assert rows == {("h", at(0)): (at(600), 4, "a", "closed"), ("i", at(600)): (at(600), 1, "x", "closed"), ("i", at(5000)): (at(5300), 2, "x", "open")}
    seen = sorted((r.batch, r.host, r.event) for r in alerts.events(spark, folder).collect())
    assert seen == [(0, "h", "opened"), (2, "h", "repeated"), (2, "i", "opened"), (3, "h", "closed"), (3, "i", "closed"), (3, "i", "opened"),
                    (4, "i", "repeated")]


def test_detections_of_a_micro_batch_are_made_once(spark, tmp_path):
    def seen(batches):
        (tmp_path / f"made-{time.time_ns()}-{os.getpid()}").touch()
        yield from batches

    rows = [detection(t, h) for t in range(0, 3000, 300) for h in "hi"]
    made = spark.createDataFrame(rows, DETECTION).coalesce(1).mapInArrow(seen, DETECTION)
    alerts.store(made, 0, f"{tmp_path}/feed", "10m")
    assert len(list(tmp_path.glob("made-*"))) == 1
    assert sorted((r.host, r.detections) for r in alerts.alerts(spark, f"{tmp_path}/feed").collect()) == [("h", 10), ("i", 10)]


def test_a_killed_feed_goes_on(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    scan = [tcp_row(60 * w + i, dport=i) for w in range(3) for i in range(30)]
    stream = stream_of(spark, tmp_path / "in", scan[50:], scan[:50], [tcp_row(2000)], [tcp_row(4000, src="z")])
    found = alerts.port_scan_alerts(detectors.live_port_scans(stream, threshold=25, time_window="1m"))
    store, killed = alerts.store, []

    def once_killed(batch, number, folder, gap):
        store(batch, number, folder, gap)
        if number == 3 and not killed:
            killed.append(number)
            raise RuntimeError("killed after the write")

    monkeypatch.setattr(alerts, "store", once_killed)
    for attempt in range(3):  # the first is killed, the third finds nothing new
        try:
            alerts.write_feed(found, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
        except Exception:
            assert attempt == 0 and killed == [3]
    rows = alerts.alerts(spark, f"{tmp_path}/t").collect()
    assert [(r.category, r.host, r.opened_at, r.last_at, r.detections, r.status) for r in rows] == [("Port Scan", "a", at(0), at(120), 3, "open")]


def test_the_end_of_the_input_closes_what_is_open(spark, tmp_path):
    (tmp_path / "in").mkdir()
    end = str(tmp_path / "end")
    stream = with_last_packets(stream_of(spark, tmp_path / "in", [tcp_row(70), tcp_row(5)], [tcp_row(130), tcp_row(6)]), end)
    rows = run_to_end(detectors.live_packet_rate(stream, "1m"), end, "t").orderBy("window_start").collect()
    assert [r.packet_count for r in rows] == [2, 1, 1]


def test_landing_is_exactly_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = stream_of(spark, tmp_path / "in", [tcp_row(0)], [tcp_row(86400)])
    for _ in range(2):
        ingest.land(stream, f"{tmp_path}/t", f"{tmp_path}/c", every=None).awaitTermination()
    assert sorted(r.event_date.isoformat() for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["2024-01-01", "2024-01-02"]
