"""Documents from pages that arrive late, twice, out of order or never."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest

from leafmill.streaming import assembly

T = datetime(2026, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    folder, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", assembly.PROVIDER)

    def step(rows):
        n = len(list(Path(folder).glob("*.parquet"))) if Path(folder).exists() else 0
        spark.createDataFrame([(s, p, x, k, T + timedelta(minutes=m)) for s, p, x, k, m in rows], assembly.PAGE).coalesce(1).write.parquet(f"{folder}-{n}")
        Path(folder).mkdir(exist_ok=True)
        next(Path(f"{folder}-{n}").glob("*.parquet")).rename(Path(folder) / f"{n}.parquet")
        docs = assembly.assembled(assembly.page_stream(spark, folder), wait=timedelta(hours=1), keep=timedelta(hours=5))
        docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {(r.source, r.version): (r.complete, r.n_pages, r.text) for r in spark.read.schema(assembly.DOCUMENT).parquet(out).collect()}

    yield step
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def test_late_repeated_and_missing_pages(run):
    got = run([("a", 2, "two", 3, 0), ("a", 1, "one", 3, 1), ("b", 1, "b1", None, 0), ("c", 1, "c1", 1, 2), (None, 1, "x", 1, 0)])
    assert got == {("c", 1): (True, 1, "c1")}
    # the third page completes a; repeated pages change nothing
    got = run([("a", 3, "three", 3, 20), ("a", 1, "one", 3, 21), ("c", 1, "c1", 1, 22)])
    assert got == {("c", 1): (True, 1, "c1"), ("a", 1): (True, 3, "one\ntwo\nthree")}
    # time goes on: b is given out as far as it came
    got = run([("z", 1, "z1", 2, 120)])
    assert got[("b", 1)] == (False, 1, "b1") and ("z", 1) not in got
    # a late page of b, and a changed page of a, are next versions
    got = run([("b", 2, "b2", 2, 125), ("a", 2, "TWO", 3, 126)])
    assert got[("b", 2)] == (True, 2, "b1\nb2") and got[("a", 2)] == (True, 3, "one\nTWO\nthree")
    assert len(got) == 5


def test_latest_version(spark):
    rows = [("a", 1, True, 1, "x"), ("a", 2, False, 2, "x\ny"), ("b", 1, True, 1, "b")]
    got = assembly.latest(spark.createDataFrame(rows, assembly.DOCUMENT))
    assert {r.source: (r.version, r.text) for r in got.collect()} == {"a": (2, "x\ny"), "b": (1, "b")}
