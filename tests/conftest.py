import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wirelake.session import local_session  # noqa: E402

START = datetime(2024, 1, 1, 12, 0, 0)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tcp_frame(spark):
    """Two whole connections, one half-open one, one refused."""
    a, b, s = "192.168.1.100", "192.168.1.101", "1.1.1.1"
    rows = [
        (at(0), a, s, 6, 60, 50000, 80, "S", 1, 100),
        (at(1), s, a, 6, 60, 80, 50000, "SA", 9, 200),
        (at(2), a, s, 6, 52, 50000, 80, "A", 2, 300),
        (at(10.9), a, s, 6, 52, 50000, 80, "FA", 3, 400),
        (at(3), b, s, 6, 60, 50001, 443, "S", 5, 500),
        (at(4), b, s, 6, 60, 50001, 443, "S", 5, 500),
        (at(5), s, b, 6, 40, 443, 50001, "RA", 7, 0),
        (at(6), b, s, 6, 40, 50001, 443, None, 8, None),
        (at(7), b, s, 17, 90, None, None, None, None, None),
    ]
    schema = ("timestamp timestamp_ntz, IP_src string, IP_dst string, IP_proto int, IP_len int, TCP_sport int, "
              "TCP_dport int, TCP_flags string, TCP_seq bigint, TCP_window int")
    return spark.createDataFrame(rows, schema)
