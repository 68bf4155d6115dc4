import numpy as np

from veilspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10, every=100):
    use = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in use:
        if q % every == 0:
            near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in use if i != q and len(v) == len(x))
            out[q] = [i for _, i in near[:k]]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1200, 32)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000 + i, x[0].tolist(), 0) for i in range(30)]  # one very common vector
    s = ann.Settings(block_rows=300, query_rows=5)
    got = ann.nearest_of_own(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as v", "2 as dim"), settings=s).collect()
    want, found = brute(rows), {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum(len(set(found[q]) & set(w)) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert found[0] == list(range(2000, 2010))  # ties to the smaller id


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [0.0, 0.0], 0), (3, None, 0), (4, [float("nan"), 1.0], 0), (5, [None, 1.0], 0), (6, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (100, [float("inf"), 1.0], 0), (7, [], 0)]
    got = [tuple(r) for r in ann.nearest_of_own(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(0, 1, 1, 1.0)]
    assert ann.nearest_of_own(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_queries(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    rows = [(i + 1, v.tolist(), 0) for i, v in enumerate(x[:99])]
    q, other = x[200].tolist(), x[201].tolist()
    own = [(100, q, 0)] * 3 + [(100, other, 0)]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest_of_own(spark.createDataFrame(rows + own, SCHEMA), settings=ann.Settings(block_rows=30)).collect()]
    want = [(100, n + 1, i) for v, times in ((q, 3), (other, 1)) for n, i in enumerate(brute([*rows, (100, v, 0)])[100]) for _ in range(times)]
    assert len(want) == 40 and sorted(got) == sorted(want)
