"""Ways to get at rows of a unit past the aggregates: each is refused, or answered privately."""

import pytest

from veilspark.functions.keyhash import Settings
from veilspark.plans.admission import RejectedQuery
from veilspark.plans.policy import PolicyError, Registry
from veilspark.plans.session import PrivateSession


@pytest.fixture(scope="module")
def session(spark):
    spark.createDataFrame([(i, f"n{i}", 100.0 + i, i % 3) for i in range(200)], "id int, name string, bal double, grp int").createOrReplaceTempView("people")
    spark.createDataFrame([(i, i % 200, float(i % 7), i % 4) for i in range(2000)], "oid int, person_id int, amount double, kind int").createOrReplaceTempView("sales")
    spark.createDataFrame([(i, f"k{i}") for i in range(4)], "kind int, label string").createOrReplaceTempView("kinds")
    r = Registry()
    r.unit("people", ["id"], ["name", "bal"])
    r.link("sales", ["person_id"], "people", ["id"])
    spark.sql("CREATE OR REPLACE TEMP VIEW v_people AS SELECT name, bal, grp FROM people")
    yield PrivateSession(spark, r, Settings(mi=1 / 128))
    for t in ("people", "sales", "kinds", "v_people"):
        spark.catalog.dropTempView(t)


TOTAL = sum(100.0 + i for i in range(200))


@pytest.mark.parametrize(
    ("text", "says"),
    [
        ("SELECT name FROM people -- pac_x(", "protected"),
        ("SELECT name, 'pac_sum(' FROM people", "protected"),
        ("SELECT * FROM v_people", "protected"),
        ("SELECT v.name FROM v_people v", "protected"),
        ("SELECT grp FROM v_people", "aggregate"),
        ("WITH t AS (SELECT name AS x FROM people) SELECT a.x FROM t a JOIN t b ON a.x = b.x", "protected"),
        ("SELECT max(bal) FROM people GROUP BY id", "aggregate"),
        ("SELECT count(*) FROM people GROUP BY name", "protected"),
        ("SELECT count(*) FROM people GROUP BY substr(name, 1, 2)", "protected"),
        ("SELECT max(m) FROM (SELECT name, max(bal) AS m FROM people GROUP BY name)", "protected"),
        ("SELECT x FROM people LATERAL VIEW explode(array(name)) e AS x", "protected"),
        ("SELECT x, count(*) FROM people LATERAL VIEW explode(array(name)) e AS x GROUP BY x", "protected"),
        ("SELECT (SELECT max(bal) FROM people GROUP BY id LIMIT 1) AS x", "aggregate"),
        ("SELECT label FROM kinds WHERE EXISTS (SELECT 1 FROM people WHERE bal > 250)", "aggregate"),
        ("SELECT label FROM kinds WHERE kind IN (SELECT grp FROM people WHERE name = 'n7')", "aggregate"),
        ("SELECT label FROM kinds LEFT SEMI JOIN sales ON kinds.kind = sales.kind", "aggregate"),
        ("SELECT label, (SELECT count(*) FROM people) AS n FROM kinds JOIN sales ON kinds.kind = sales.kind", "aggregate"),
        ("SELECT label, (SELECT sum(amount) FROM sales WHERE sales.kind = kinds.kind) AS s FROM kinds", "correlated"),
        ("SELECT label FROM kinds WHERE EXISTS (SELECT count(*) FROM sales WHERE sales.kind = kinds.kind HAVING count(*) > 3)", "correlated|subquery"),
        ("SELECT grp, count(*) FROM people GROUP BY grp WITH ROLLUP", "grouping sets|Expand"),
        ("SELECT grp, collect_list(bal) FROM people GROUP BY grp", "unsupported aggregate"),
        ("SELECT grp, sum(bal) OVER (PARTITION BY grp) FROM people", "window"),
        ("CREATE TABLE stolen USING parquet AS SELECT name FROM people", "not supported over"),
        ("CREATE TABLE stolen USING parquet AS SELECT name FROM v_people", "not supported over"),
        ("CREATE PAC TABLE stolen (PAC_KEY (id)) USING parquet AS SELECT id, name FROM people", "not supported over|does not exist"),
        ("CREATE TABLE stolen USING parquet PARTITIONED BY (grp) AS WITH t AS (SELECT name, grp FROM v_people) SELECT * FROM t", "not supported over"),
        ("INSERT OVERWRITE DIRECTORY '/tmp/stolen' USING parquet SELECT name FROM people", "not supported over"),
        ("EXPLAIN SELECT name FROM people", "protected"),
        ("SELECT max(bal) AS x, pac_count(cast(grp as bigint)) AS n FROM people", "must not aggregate"),
        ("SELECT name, pac_select(array(bal > 5)) AS m FROM people", "protected"),
        ("SELECT grp, pac_select(array(grp > 5)) AS m FROM people", "aggregate"),
    ],
)
def test_refused(session, text, says):
    with pytest.raises(PolicyError, match=says):
        session.sql(text).collect()


@pytest.mark.parametrize(
    "text",
    [
        "SELECT (SELECT sum(bal) FROM people) AS x",
        "SELECT sum(bal) AS x FROM v_people",
        "WITH t AS (SELECT bal FROM people) SELECT sum(bal) AS x FROM t",
        "SELECT x FROM (SELECT sum(bal) AS x FROM people) WHERE x IS NOT NULL",
        "SELECT sum(m) AS x FROM (SELECT id, max(bal) AS m FROM people GROUP BY id)",
    ],
)
def test_noised(session, text):
    got = [session.sql(text).first()["x"] for _ in range(3)]
    assert all(x != TOTAL for x in got) and len(set(got)) > 1  # another query, another draw


def test_membership_is_of_the_released_value(session):
    session.settings = Settings(mi=0)
    try:
        n = session.sql("SELECT count(*) AS n FROM people").first()["n"]
        assert n != 200
        hits = session.sql(f"SELECT label FROM kinds WHERE 200 IN (SELECT count(*) FROM people) OR {n} IN (SELECT count(*) FROM people WHERE grp > 5)").count()
        assert hits == 0
        assert session.sql(f"SELECT label FROM kinds WHERE {n} IN (SELECT count(*) FROM people)").count() == 4
    finally:
        session.settings = Settings(mi=1 / 128)


def test_two_private_subqueries_are_compared_world_by_world(session):
    session.settings = Settings(mi=0)
    try:
        where = "SELECT label FROM kinds WHERE (SELECT sum(bal) FROM people) {} (SELECT sum(bal) FROM people WHERE grp < 2)"
        assert session.sql(where.format(">")).count() == 4 and session.sql(where.format("<")).count() == 0
    finally:
        session.settings = Settings(mi=1 / 128)


def test_explain_shows_the_private_plan(session):
    shown = session.sql("EXPLAIN SELECT sum(bal) AS x FROM people").first()["plan"]
    assert "MapInArrow" in shown and "md5" in shown


def test_views_may_be_made_and_dropped(spark, session):
    session.sql("CREATE OR REPLACE TEMP VIEW v2 AS SELECT name FROM people")
    with pytest.raises(RejectedQuery):
        session.sql("SELECT name FROM v2")
    session.sql("DROP VIEW v2")
    assert session.sql("SELECT label FROM kinds ORDER BY kind").first()["label"] == "k0"


def test_units_without_a_key_are_rows(spark):
    spark.range(300).selectExpr("id", "id % 3 AS g", "cast(null as string) AS z").createOrReplaceTempView("loose")
    r = Registry()
    r.unit("loose", [], ["z"])
    got = PrivateSession(spark, r, Settings(mi=0)).sql("SELECT g, count(*) AS n FROM loose GROUP BY g")
    with pytest.raises(RejectedQuery):
        PrivateSession(spark, r, Settings(mi=0)).sql("SELECT z FROM loose")
    assert [40 < x["n"] < 160 for x in got.collect()] == [True] * 3


def test_without_join_elimination_the_unit_is_joined(spark, session):
    spark.sql("SELECT * FROM people WHERE id < 100").createOrReplaceTempView("half_people")
    r = Registry()
    r.unit("half_people", ["id"], ["name"])
    r.link("sales", ["person_id"], "half_people", ["id"])
    p = PrivateSession(spark, r, Settings(mi=0))
    whole = p.sql("SELECT count(*) AS n FROM sales").first()["n"]
    p.sql("SET pac_join_elimination = false")
    assert p.sql("SELECT count(*) AS n FROM sales").first()["n"] < 0.75 * whole


def test_composite_keys_do_not_collide(spark):
    from veilspark.functions.keyhash import key_hash

    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert df.select(key_hash(df.x, df.y).alias("h")).distinct().count() == 2
