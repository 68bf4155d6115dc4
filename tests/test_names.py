import pytest
from pyspark.sql import functions as F

from veilspark.functions.keyhash import Settings, key_hash
from veilspark.operators.worlds import Agg, aggregate, counters
from veilspark.plans.admission import RejectedQuery
from veilspark.plans.policy import Registry
from veilspark.plans.session import PrivateSession

EXACT = Settings(mi=0)


@pytest.fixture(scope="module")
def session(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 17).cast("double").alias("v"), key_hash(F.col("id") % 90).alias("h"))
    df.createOrReplaceTempView("facts")
    spark.range(3).createOrReplaceTempView("plain")
    r = Registry()
    r.unit("facts", ["id"], ["id"])
    return PrivateSession(spark, r, EXACT)


def test_aggregates_by_name(spark, session):
    got = session.sql("SELECT g, pac_count(h) AS n, pac_sum(h, v) AS s, pac_avg(h, v) AS a, pac_min(h, v) AS lo, pac_max(h, v) AS hi FROM facts GROUP BY g ORDER BY g").collect()
    aggs = [Agg("n", "count"), Agg("s", "sum", F.col("v")), Agg("a", "avg", F.col("v")), Agg("lo", "min", F.col("v")), Agg("hi", "max", F.col("v"))]
    want = aggregate(spark.table("facts"), {"g": F.col("g")}, F.col("h"), aggs, EXACT).orderBy("g").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_counters_lists_and_corrections(spark, session):
    got = session.sql("SELECT pac_sum_counters(h, v) AS w, pac_count(h, 0.0) AS none, pac_count(h, 2.0) AS twice, pac_count(h) AS once FROM facts").first()
    want = counters(spark.table("facts"), {}, F.col("h"), [Agg("w", "sum", F.col("v"))], EXACT).first()["w"]
    assert got["w"] == want and got["none"] is None and got["twice"] == 2 * got["once"]
    r = session.sql("SELECT pac_max_list(w) AS w FROM (SELECT g, pac_sum_counters(h, v) AS w FROM facts GROUP BY g)").first()["w"]
    assert len(r) == 64


def test_scalars_by_name(session):
    r = session.sql("SELECT pac_filter_lt(1.0D, pac_sum_counters(h, v)) AS a, pac_filter(transform(pac_sum_counters(h, v), x -> x > 1)) AS b, pac_noised(pac_sum_counters(h, v)) IS NOT NULL AS c, pac_filter(pac_mask_not(0L)) AS d FROM facts").first()
    assert tuple(r) == (True, True, True, True)


def test_by_name_needs_a_unit(session):
    with pytest.raises(RejectedQuery):
        session.sql("SELECT pac_count(id) FROM plain")
