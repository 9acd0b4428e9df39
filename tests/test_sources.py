"""Readers on real files and writers on real folders."""

from __future__ import annotations

import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.parsing import rank_of_file
from fleetlens.sources import feeds, links, logs, sinks

LINE = "[save_count 1] [100.5] [Rank %d] Fun Send Data 8 stream 0xab opCount 3 groupHash 9\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "sub").mkdir()
    (root / "rank_0.log").write_text(LINE % 0)
    (root / "sub" / "rank_1.LOG").write_text(LINE % 1 + "garbage\n")
    (root / "rank_2.log.gz").write_bytes(gzip.compress((LINE % 2).encode()))
    (root / "rank_3.log.bz2").write_bytes(bz2.compress((LINE % 3).encode()))
    (root / "notes.md").write_text(LINE % 9)
    (root / "broken.txt").write_bytes(b"\xff" + (LINE % 4).encode())
    return str(root)


def test_discovery_compression_and_bad_bytes(spark, folder):
    got = logs.read_calls(spark, folder).collect()
    assert sorted(r["rank"] for r in got) == [0, 1, 2, 3, 4]
    assert {r["ts_ns"] for r in got} == {100_500_000_000}


def test_detectors_run_on_what_the_reader_gives(spark, folder):
    from fleetlens.operators import hang, sequences, timing
    calls = logs.read_calls(spark, folder)
    assert hang.last_calls(calls).count() == 5
    assert sequences.sequences(calls).count() == 0
    assert timing.rank_pace(calls).count() == 5


def test_rank_from_file_name_drops_nameless_files(spark, folder):
    got = logs.read_calls(spark, folder, rank_from="file").collect()
    assert sorted(r["rank"] for r in got) == [0, 1, 2, 3]


def test_file_name_patterns(spark):
    names = ["rank_12.log", "7.log", "log_5.txt", "rank3.log", "node4.err", "app.log"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    assert [r[0] for r in df.select(rank_of_file(F.col("n"))).collect()] == [12, 7, 5, 3, 4, -1]


def test_file_checks(spark, folder):
    row = logs.file_checks(logs.discover_lines(spark, folder), 8).first()
    assert (row["files"], row["one_per_rank"], row["any_file"]) == (5, False, True)


def test_telemetry_files_overlap(spark, tmp_path):
    head = ",".join(links.TELEMETRY_COLUMNS)
    row = "20250101000000,18446744073709551605,0,1,0,4,7,10.0.0.1,10.0.0.2,3,1,2,99"
    (tmp_path / "eth0_Port1_A.log").write_text(f"{head}\n{row}\n")
    (tmp_path / "eth0_Port1_B.log").write_text(f"{head}\n{row}\n")
    (tmp_path / "other.log").write_text("x\n")
    got = links.read_telemetry(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["group_hash"] == -11


def test_feeds(spark):
    poll = '[{"fingerprint":"f","status":"active","labels":{"alertname":"A"},"startsAt":"2025-09-05T08:13:22.253Z"}]'
    rows = feeds.parse_snapshots(spark.createDataFrame([(1, poll), (2, "[]"), (3, "oops")],
                                                       "poll INT, value STRING")).orderBy("poll").collect()
    assert [(r["poll"], r["ok"], r["state"]) for r in rows][0] == (1, True, "active")
    assert [r["ok"] for r in rows] == [True, True, False]
    beats = spark.createDataFrame([('{"client_id":"c","us":5}',), ('{"status":"x"}',)], "value STRING")
    assert [r["client_id"] for r in feeds.parse_heartbeats(beats).collect()] == ["c"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "table"), (2, "phone")], "rank INT, channel STRING")
    sinks.append_outbox(df, f"{tmp_path}/out")
    sinks.append_outbox(df, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    sinks.write_matrix(df.select("rank"), f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", header=True).count() == 2
