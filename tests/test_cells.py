"""Search in cells against all pairs."""

import inspect

import numpy as np
import pytest

from leafmill.operators import cells, retrieval

SCHEMA = "id long, embedding array<float>"


def slow(queries, index, k, exclude_self=False):
    out = {}
    for q, v in queries:
        scored = sorted((-round(float(np.dot(np.float64(v), np.float64(x))), 12), i) for i, x in index if not (exclude_self and i == q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def frames(spark, queries, index):
    told = lambda rows: [(int(i), [float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame(told(queries), SCHEMA).withColumnRenamed("id", "qid"), spark.createDataFrame(told(index), SCHEMA).repartition(3)


def as_dict(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append((r.id, r.score))
        assert r["rank"] == len(out[r.qid])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-9)


def grouped(rng, n, groups=12, size=8, spread=0.05):
    centres = rng.normal(size=(groups, size))
    v = (centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, size))).astype(np.float32)
    return [(k, x) for k, x in enumerate(v)]


@pytest.mark.parametrize("in_cells,exclude", [(1, True), (7, False), (7, True), (40, True)])
def test_same_rows_as_all_pairs(spark, monkeypatch, in_cells, exclude):
    monkeypatch.setattr(cells, "PACK", 5)
    monkeypatch.setattr(cells, "BLOCK", 16)
    rng = np.random.default_rng(in_cells)
    index = grouped(rng, 400)
    # a third of the index is one vector, some are zero, lengths differ
    index = [(k, index[0][1] if k % 3 == 0 else v * 0 if k % 41 == 0 else v * (1 + k % 5)) for k, v in index]
    queries = index[::13] + [(10_000, np.zeros(8, np.float32)), (10_001, -index[1][1])]
    a, b = frames(spark, queries, index)
    same(as_dict(retrieval.top_k(a, b, 9, exclude_self=exclude, in_cells=in_cells)), slow(queries, index, 9, exclude))


def test_fewer_vectors_than_wanted(spark):
    index = [(k, np.array([k, 1.0])) for k in range(4)]
    a, b = frames(spark, index[:2], index)
    for n in (1, 3):
        same(as_dict(retrieval.top_k(a, b, 9, exclude_self=True, in_cells=n)), slow(index[:2], index, 9, True))


def test_grouped_vectors_are_mostly_not_met(spark):
    rng = np.random.default_rng(5)
    index = grouped(rng, 2000, groups=30)
    a, b = frames(spark, index[::50], index)
    held = cells.dealt(b, 40)
    found = cells.search(a, held, 10)
    same(as_dict(found), slow(index[::50], index, 10))
    met = cells.share_read(a, held, 10, found).collect()
    assert len(met) == 40 and all(0 < r.share <= 1 for r in met)
    assert sum(r.share for r in met) / len(met) < 0.3


def test_empty_and_null_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], SCHEMA)
    asked = some.withColumnRenamed("id", "qid")
    assert retrieval.top_k(asked, none, 3).count() == 0
    assert retrieval.top_k(none.withColumnRenamed("id", "qid"), some, 3).count() == 0
    assert as_dict(retrieval.top_k(asked, some, 3)) == {1: [(1, 1.0)]}


def test_no_query_goes_through_the_driver(spark, capsys):
    rng = np.random.default_rng(6)
    index = grouped(rng, 300)
    a, b = frames(spark, index, index)
    held = cells.dealt(b, 10)
    assert not any(name in inspect.getsource(cells.search) for name in ("collect", "toLocalIterator", "toPandas", "toArrow"))
    cells.search(a, held, 3).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan
