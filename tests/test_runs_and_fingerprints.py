"""Runs that crash leave a table as it was; fingerprints follow the content."""

import os
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from loomspan.operators import scorers
from loomspan.sources.commits import RunTable
from loomspan.sources.fingerprints import content_fingerprint, file_digests


def rows_of(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_runs_replace_their_groups_and_crashes_replace_nothing(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), ["model", "k"])
    with pytest.raises(FileNotFoundError):
        table.read()
    df = lambda *rows: spark.createDataFrame(rows, "model string, k int, v double")
    assert table.write(df(("a", 1, 0.1), ("a", 1, 0.2), ("a", 2, 0.3), (None, 1, 0.4))) == 0
    first = sorted(table.read().collect(), key=str)
    assert table.write(df(("a", 2, 0.5), ("b", 1, 0.6), (None, 1, 0.7))) == 1
    now = {("a", 1, 0.1), ("a", 1, 0.2), ("a", 2, 0.5), ("b", 1, 0.6), (None, 1, 0.7)}
    assert {tuple(r) for r in table.read().collect()} == now
    assert sorted(table.read(0).collect(), key=str) == first
    # dies while it writes
    broken = df(("a", 1, 9.0), ("c", 1, 9.0)).repartition(2).withColumn("v", F.when(F.col("model") == "c", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        table.write(broken)
    # dies between the data and the log
    run = table.stage(df(("a", 1, 8.0)))
    assert {tuple(r) for r in table.read().collect()} == now and len(table.log()) == 2
    # an entry that was cut off
    (tmp_path / "t/log/000000000002.json").write_text('{"ru')
    assert {tuple(r) for r in table.read().collect()} == now
    assert table.commit(run) == 3 and table.commit(run) == 3
    assert {tuple(r) for r in table.read().collect()} == now - {("a", 1, 0.1), ("a", 1, 0.2)} | {("a", 1, 8.0)}
    table.stage(df(("z", 1, 1.0)))
    assert len(os.listdir(tmp_path / "t/data")) >= 4 and table.vacuum() >= 1
    assert len(os.listdir(tmp_path / "t/data")) == 3 and table.read().count() == 4


def test_a_killed_process_leaves_the_old_state(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), ["g"])
    table.write(spark.createDataFrame([(1, "old")], "g int, v string"))
    script = f"""
import os, sys
sys.path.insert(0, {str(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
from loomspan.sources.commits import RunTable
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
t = RunTable(spark, {str(tmp_path / "t")!r}, ["g"])
t.stage(spark.createDataFrame([(1, "new")], "g int, v string"))
os._exit(9)
"""
    assert subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=300).returncode == 9
    assert len(os.listdir(tmp_path / "t/data")) == 2
    assert [tuple(r) for r in table.read().collect()] == [(1, "old")]


def test_writers_at_the_same_time_get_versions_of_their_own(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), ["g"])
    staged = [table.stage(spark.createDataFrame([(i, i)], "g int, v int")) for i in range(4)]
    found = []
    threads = [threading.Thread(target=lambda r=r: found.append(table.commit(r))) for r in staged]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(found) == [0, 1, 2, 3] and rows_of(table) == [(i, i) for i in range(4)]


def test_fingerprints_follow_the_content(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name / "sub").mkdir(parents=True)
        (tmp_path / name / "sub/w.bin").write_bytes(bytes(range(256)) * 10)
        (tmp_path / name / "a.txt").write_text("x" * 100)
        (tmp_path / name / "empty").write_bytes(b"")
    root = content_fingerprint(spark, str(tmp_path / "one"), block=100)
    assert root == content_fingerprint(spark, f"file://{tmp_path}/two/", block=100) != content_fingerprint(spark, str(tmp_path / "one"), block=99)
    assert sorted(r["name"] for r in file_digests(spark, str(tmp_path / "one")).collect()) == ["a.txt", "sub/w.bin"]
    data = bytearray((tmp_path / "two/sub/w.bin").read_bytes())
    data[1234] ^= 1
    (tmp_path / "two/sub/w.bin").write_bytes(bytes(data))
    assert content_fingerprint(spark, str(tmp_path / "two"), block=100) != root
    data[1234] ^= 1
    data[0:200] = data[100:200] + data[0:100]  # blocks that change places
    (tmp_path / "two/sub/w.bin").write_bytes(bytes(data))
    assert content_fingerprint(spark, str(tmp_path / "two"), block=100) != root
    (tmp_path / "two/sub/w.bin").rename(tmp_path / "two/w.bin")
    assert content_fingerprint(spark, str(tmp_path / "two"), block=100) != root


def test_a_cache_of_other_weights_is_refused(spark):
    mine = scorers.Scorer("s", "root1", lambda a, b: [1.0] * len(a))
    pairs = spark.createDataFrame([("x", "y")], "a string, b string")
    cache = scorers.score_pairs(scorers.unscored(pairs, spark.createDataFrame([], "scorer string, fingerprint string, pair string, score double"), mine, "a", "b"), mine, "a", "b")
    assert scorers.unscored(pairs, scorers.own_cache(cache, mine), mine, "a", "b").count() == 0
    other = scorers.Scorer("s", "root2", mine.score)
    with pytest.raises(Exception, match="other weights: root1"):
        scorers.own_cache(cache, other).collect()
    assert scorers.own_cache(cache, scorers.Scorer("t", "root2", mine.score)).count() == 1
