from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


CALL_SCHEMA = ("save_count INT, ts_ns BIGINT, rank INT, function STRING, data_size BIGINT, stream STRING,"
               " op_count BIGINT, group_hash BIGINT, event_id BIGINT")


@pytest.fixture(scope="session")
def make_calls(spark):
    """Calls from (rank, op_count, seconds) with optional fields."""
    def build(rows):
        out = []
        for i, r in enumerate(rows):
            out.append((r.get("save_count", 1), int(round(r["t"] * 1e9)), r["rank"],
                        r.get("function", "AllReduce"), r.get("data_size", 4096),
                        r.get("stream", "0x1"), r["op"], r.get("group_hash", 7), i))
        return spark.createDataFrame(out, CALL_SCHEMA)
    return build
