import hashlib
import math

import pytest
from pyspark.sql import functions as F

from veilspark import queries
from veilspark.functions import noise, votes
from veilspark.functions.keyhash import Settings, key_hash, mixed_units, signed
from veilspark.operators.diff import summarise, utility_diff
from veilspark.operators.worlds import Agg, UnsupportedPrivateType, aggregate, check_diversity, counters
from veilspark.plans.admission import RejectedQuery
from veilspark.plans.policy import Registry
from veilspark.plans.session import PrivateSession

EXACT = Settings(mi=0)


@pytest.fixture(scope="module")
def session(spark):
    spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(60)], "id int, name string, grp int").createOrReplaceTempView("users")
    spark.createDataFrame([(i, i % 60, float(i % 7), (i // 60) % 4) for i in range(600)], "id int, user_id int, amount double, kind int").createOrReplaceTempView("buys")
    r = Registry()
    r.unit("users", ["id"], ["name"])
    r.link("buys", ["user_id"], "users", ["id"])
    return PrivateSession(spark, r, EXACT)


def test_query_hash_is_the_known_one():
    assert EXACT.query_hash == 16305503821874362565


@pytest.mark.parametrize(
    ("text", "says"),
    [
        ("SELECT name FROM users", "aggregate"),
        ("SELECT user_id, count(*) FROM buys GROUP BY user_id", "protected"),
        ("SELECT DISTINCT kind FROM buys", "DISTINCT"),
        ("SELECT kind, row_number() OVER (ORDER BY kind) FROM buys", "window"),
        ("SELECT kind FROM buys", "aggregate"),
        ("SELECT kind, stddev(amount) FROM buys GROUP BY kind", "unsupported aggregate"),
        ("SELECT count(*) FROM buys a FULL OUTER JOIN users u ON a.user_id = u.id", "joins are not supported"),
        ("SELECT count(*) FROM buys EXCEPT SELECT 1", "set operations"),
    ],
)
def test_rejections(session, text, says):
    with pytest.raises(RejectedQuery, match=says):
        session.sql(text)


def test_where_on_protected_is_allowed(session):
    assert session.sql("SELECT count(*) AS n FROM users WHERE name <> 'n1'").count() == 1


def test_counts_are_near(session):
    r = {x["kind"]: x["n"] for x in session.sql("SELECT kind, count(*) AS n FROM buys GROUP BY kind").collect()}
    assert set(r) == {0, 1, 2, 3} and all(60 < n < 260 for n in r.values())


def test_noise_off_is_exact_and_diff_is_small(spark, session):
    try:
        session.sql("SET pac_noise = false")
        assert session.sql("SELECT count(*) AS n FROM buys").first()["n"] == 600
        session.sql("SET pac_noise = true")
        session.sql("SET pac_diffcols = '1'")
        session.sql("SELECT kind, sum(amount) AS s FROM buys GROUP BY kind").collect()
        assert session.last_utility.recall == 1 and session.last_utility.utility < 100
    finally:
        session.sql("SET pac_noise = true")
        session.sql("SET pac_diffcols = 'NULL'")


def test_retries_release_the_same(spark, session):
    session.settings = Settings(mi=1 / 128, seed=3)
    try:
        df = session.sql("SELECT kind, sum(amount) AS s FROM buys GROUP BY kind")
        assert sorted(df.collect()) == sorted(df.repartition(3).collect())
    finally:
        session.settings = EXACT


def test_empty_group_is_null(session):
    assert session.sql("SELECT count(*) AS n FROM buys WHERE amount > 100").first()["n"] is None


def test_types(spark):
    df = spark.sql("select id, cast(id as byte) b, cast(id as decimal(10,2)) d, date'2020-01-01' + cast(id as int) dt, 'x' s, true t from range(50)")
    k = key_hash(F.col("id"))
    out = aggregate(df, {}, k, [Agg("b", "max", F.col("b")), Agg("d", "sum", F.col("d")), Agg("dt", "min", F.col("dt")), Agg("t", "sum", F.col("t"))], EXACT)
    assert [t for _, t in out.dtypes] == ["tinyint", "decimal(38,2)", "date", "double"]
    assert out.first()["b"] <= 49
    with pytest.raises(UnsupportedPrivateType):
        aggregate(df, {}, k, [Agg("s", "min", F.col("s"))], EXACT)
    with pytest.raises(NotImplementedError):
        Agg("x", "median")


def test_narrow_is_wide(spark):
    df = spark.range(400).withColumn("g", F.col("id") % 3).withColumn("v", (F.col("id") % 11).cast("double"))
    aggs = [Agg("s", "sum", F.col("v")), Agg("n", "count"), Agg("a", "avg", F.col("v")), Agg("m", "max", F.col("v"))]
    a = counters(df, {"g": F.col("g")}, key_hash(F.col("id") % 40), aggs, EXACT).orderBy("g").collect()
    b = counters(df, {"g": F.col("g")}, key_hash(F.col("id") % 40), aggs, EXACT, wide=True).orderBy("g").collect()
    for x, y in zip(a, b, strict=True):
        for c in "snam":
            assert len(x[c]) == 64 and all((p is None) == (q is None) and (p is None or math.isclose(p, q)) for p, q in zip(x[c], y[c], strict=True))


def test_bits_are_balanced(spark):
    r = spark.range(3000).select(F.bit_count(key_hash(F.col("id"))).alias("n")).agg(F.avg("n").alias("m"), F.variance("n").alias("v")).first()
    assert abs(r["m"] - 32) < 0.4 and abs(r["v"] - 16) < 2.5


def test_null_key_has_no_world(spark):
    df = spark.createDataFrame([(None, 1.0), (1, 2.0)], "k int, v double")
    assert df.select(key_hash(F.col("k")).alias("h")).where("h is null").count() == 1
    assert df.select(key_hash(F.col("k"), F.col("v")).alias("h")).where("h is null").count() == 1
    assert df.select(mixed_units(key_hash(F.col("v")), key_hash(F.col("k"))).alias("h")).where("h is null").count() == 1


def test_samples(spark):
    df = spark.sql("select array(42.0D, 42.0D, 42.0D, 42.0D) x, array(3, 3, 3, 3) n, array(1.0D, null) y, array(1, 1) m")
    a = lambda v, c, k: df.select(noise.aggregate_samples(F.col(v), F.col(c), 1 / 128, k).alias("r")).first()["r"]
    assert a("x", "n", 3) == 42 and a("y", "m", 1) is None and a("x", "n", 4) is None
    with pytest.raises(Exception, match="same length"):
        a("x", "m", 1)


def test_votes_of_nulls(spark):
    df = spark.sql("select cast(null as array<boolean>) l, cast(null as array<double>) w, array() e")
    r = df.select(votes.filter_list(F.col("l")).alias("a"), votes.filter_compare("gt", F.lit(1.0), F.col("w")).alias("b"), F.size(votes.coalesce_worlds(F.col("w"))).alias("n"), noise.noised(F.col("w")).alias("z"), votes.select(F.col("l")).alias("s")).first()
    assert (r["a"], r["b"], r["n"], r["z"], r["s"]) == (False, False, 64, None, None)


def _held_by_hand(name, value, worlds, settings, correction):
    """The vote of a comparison, in Python."""
    if value is None or not worlds:
        return False
    c = 1.0 if correction is None else correction
    of = {"gt": value.__gt__, "gte": value.__ge__, "lt": value.__lt__, "lte": value.__le__, "eq": value.__eq__, "neq": value.__ne__}[name]
    mask = sum(1 << j for j, w in enumerate(worlds[:64]) if w is not None and of(w))
    held = mask.bit_count()
    if settings.mi <= 0:
        return held * c >= 32
    if (span := math.floor(64 / c)) <= 0:
        return True
    text = f"{signed(settings.seed_used())}|{signed(settings.query_hash)}|{signed(mask)}"
    return held > int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % span


@pytest.mark.parametrize("settings", [EXACT, Settings(seed=5)])
def test_comparisons_by_hand(spark, settings):
    some = [None if j % 3 == 0 else float(j % 7) for j in range(64)]
    lists = [some, some + [9.0] * 40, [4.0] * 70, [4.0] * 20, [None] * 64, [], None, [float(j) for j in range(64)]]
    rows = [(i, v, w, c) for i, (v, w, c) in enumerate((v, w, c) for v in (4.0, -1.0, 31.5, None) for w in lists for c in (None, 1.0, 1.5, 2.0, 100.0))]
    df = spark.createDataFrame(rows, "i int, v double, w array<double>, c double")
    got = df.select("i", *[votes.filter_compare(n, F.col("v"), F.col("w"), settings, F.col("c")).alias(n) for n in votes.COMPARISONS]).collect()
    assert len(got) == len(rows)
    for r in got:
        _, v, w, c = rows[r["i"]]
        for n in votes.COMPARISONS:
            assert r[n] == _held_by_hand(n, v, w, settings, c), (n, v, w, c)


@pytest.mark.parametrize("settings", [EXACT, Settings(seed=5)])
def test_votes_make_their_list_once(spark, settings):
    """A list that is made again for each of its worlds costs the square of their number."""
    df = spark.sql("select 3.0D v, array(1.0D, null, 5.0D) w")
    made = F.transform("w", lambda x: x + 12345.0)
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(votes.select(F.transform("w", lambda x: x > 12345.0))).count("12345.0") == 1
    for n in votes.COMPARISONS:
        assert plan(votes.filter_compare(n, F.col("v"), made, settings, 1.5)).count("12345.0") == 1
        assert plan(votes.filter_compare(n, F.col("v") + 12345.0, F.col("w"), settings, 1.5)).count("12345.0") == 1


def test_comparisons_hash_a_key_once_and_deal_rows_over_tasks(spark, tmp_path):
    keys = [None, *range(300)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = queries.queries()["comparisons"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" in plan and "getbit(lambda" in plan and "getbit(cast" not in plan
    assert df.rdd.getNumPartitions() >= 4  # one file of one row group
    got = {r["c_custkey"]: r for r in df.collect()}
    assert set(got) == set(keys)
    for k, r in got.items():
        bits = int(hashlib.md5(str(k).encode()).hexdigest()[:16], 16)
        worlds = None if k is None else [float(k * (j + 1) % 97) if bits >> j & 1 else None for j in range(64)]
        for n in votes.COMPARISONS:
            assert r[n] == _held_by_hand(n, None if k is None else float(k % 97), worlds, EXACT, 1.5), (n, k)


def test_noise_has_the_variance_asked_for(spark):
    w = F.array(*[F.lit(float(j % 8)) for j in range(64)])
    base = spark.range(1).select(w.alias("w"))
    got = [base.select(noise.noised(F.col("w"), Settings(mi=0.5, seed=s)).alias("x")).first()["x"] for s in range(40)]
    got = [x for x in got if x is not None]
    mean = sum(got) / len(got)
    assert len(got) > 10 and 0.5 < sum((x - mean) ** 2 for x in got) / len(got) < 40


def test_diff_cells(spark):
    e = spark.createDataFrame([(1, 10, 2.0), (2, 20, None), (3, 30, 4.0)], "k int, a int, b double")
    p = spark.createDataFrame([(1, 11, 2.0), (2, 20, 1.0), (4, 1, 1.0)], "k int, a int, b double")
    d = {r["k"]: (r["a"], r["b"]) for r in utility_diff(p, e, 1).collect()}
    assert d == {1: (10, 0.0), 2: (0, 50.0), None: (0, 0.0), 4: (None, None)}
    u = summarise(utility_diff(p, e, 1), 1)
    assert (u.matched, u.missing, u.extra) == (2, 1, 1) and math.isclose(u.recall, 2 / 3)


def test_diversity_guard(spark):
    df = spark.range(400).withColumn("g", F.col("id") % 4)
    half = F.lit(signed(EXACT.query_hash ^ 0xFFFFFFFF))  # one unit, in half of the worlds
    with pytest.raises(ValueError, match="too few"):
        check_diversity(df, [F.col("g")], half, [Agg("n", "count")], EXACT)
    check_diversity(df, [F.col("g")], key_hash(F.col("id")), [Agg("n", "count")], EXACT)
