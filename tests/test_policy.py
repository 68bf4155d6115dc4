import pytest

from veilspark.plans import ddl
from veilspark.plans.policy import Link, PolicyError, Registry, delete_unit_list, read_unit_list

COLUMNS = {"users": ["id", "name"], "orders": ["id", "user_id", "amount"], "items": ["id", "order_id"]}


def run(r, text):
    s = ddl.parse(text, lambda t: COLUMNS.get(t))
    s.then(r)
    return s


def test_create_unit_strips_clauses():
    r = Registry()
    s = run(r, "CREATE PAC TABLE users (id INT, name STRING, PAC_KEY (id), PROTECTED (name))")
    assert s.plain == "CREATE TABLE users (id INT, name STRING)"
    assert r.get("users").is_unit and r.get("USERS").key == ("id",) and r.get("users").protected == ("name",)


def test_unit_needs_key():
    with pytest.raises(PolicyError):
        ddl.parse("CREATE PAC TABLE t (a INT)", COLUMNS.get)


def test_links_are_idempotent_and_exclusive():
    r = Registry()
    r.unit("users", ["id"])
    run(r, "ALTER PAC TABLE orders ADD PAC_LINK (user_id) REFERENCES users(id)")
    run(r, "ALTER PAC TABLE orders ADD PAC_LINK (user_id) REFERENCES users(id)")
    assert len(r.get("orders").links) == 1
    with pytest.raises(PolicyError):
        run(r, "ALTER PAC TABLE orders ADD PAC_LINK (user_id) REFERENCES items(id)")
    run(r, "ALTER PAC TABLE orders DROP PAC_LINK (user_id)")
    assert not r.get("orders").links


def test_unknown_columns_change_nothing():
    r = Registry()
    with pytest.raises(PolicyError):
        run(r, "ALTER PAC TABLE orders ADD PROTECTED (amount, nothing)")
    assert not r.get("orders").protected


def test_protected_twice_and_drop():
    r = Registry()
    run(r, "ALTER PAC TABLE orders ADD PROTECTED (amount)")
    with pytest.raises(PolicyError):
        run(r, "ALTER PAC TABLE orders ADD PROTECTED (amount)")
    run(r, "ALTER PAC TABLE orders DROP PROTECTED (amount)")
    with pytest.raises(PolicyError):
        run(r, "ALTER PAC TABLE orders DROP PROTECTED (amount)")


def test_arity_units_and_cycles():
    with pytest.raises(PolicyError):
        ddl.parse("CREATE TABLE t (a INT, PAC_LINK (a) REFERENCES users(id, name))", COLUMNS.get)
    r = Registry()
    r.unit("users", ["id"])
    with pytest.raises(PolicyError):
        r.unit("orders", ["id"], links=[Link(("user_id",), "users", ("id",))])
    c = Registry()
    c.link("a", ["x"], "b", ["x"])
    c.link("b", ["x"], "a", ["x"])
    with pytest.raises(PolicyError):
        c.check_cycles()


def test_paths_and_json(tmp_path):
    r = Registry()
    r.unit("users", [])
    r.link("orders", ["user_id"], "users", ["id"])
    r.link("items", ["order_id"], "orders", ["id"])
    assert [x.table for x in r.paths("items")["users"]] == ["orders", "users"]
    assert r.key_of("users") == ("id",)
    r.save(str(tmp_path / "m.json"))
    assert Registry.load(str(tmp_path / "m.json")).tables == r.tables
    r.drop("users")
    assert not r.get("orders").links


def test_unit_list(tmp_path):
    f = tmp_path / "units"
    f.write_text("Users\n\norders\n")
    assert read_unit_list(str(f)) == ["users", "orders"]
    assert "deleted" in delete_unit_list(str(f)) and "not exist" in delete_unit_list(str(f))


def test_settings_and_toggles():
    r = Registry()
    assert ddl.parse("SET pac_mi = 0", COLUMNS.get).setting == ("pac_mi", "0")
    assert ddl.parse("PRAGMA save_pac_metadata('x')", COLUMNS.get).pragma == ("save", "x")
    run(r, "ALTER TABLE users SET PAC")
    assert r.get("users").is_unit
    run(r, "ALTER TABLE users UNSET PAC")
    assert not r.get("users").is_unit
    assert ddl.parse("SELECT 1", COLUMNS.get) is None


def test_clauses_are_told_from_strings_comments_and_types():
    r = Registry()
    text = "CREATE PAC TABLE t (id INT PRIMARY KEY, `PROTECTED` DECIMAL(10, 2), note STRING COMMENT 'PAC_KEY (x), it''s', /* PROTECTED (note) */ s STRUCT<a: INT> -- PAC_LINK (id)\n, PROTECTED (note)) USING parquet"
    s = run(r, text)
    assert s.plain.startswith("CREATE TABLE t (id INT, `PROTECTED` DECIMAL(10, 2), note STRING COMMENT 'PAC_KEY (x), it''s', s STRUCT<a: INT>") and s.plain.endswith(") USING parquet")
    assert r.get("t").key == ("id",) and r.get("t").protected == ("note",) and not r.get("t").links


@pytest.mark.parametrize("text", ["CREATE PAC TABLE t (a INT, PAC_KEY (b))", "CREATE TABLE t (a INT, PROTECTED (b))", "CREATE TABLE t (a INT, PAC_LINK (a) REFERENCES nothing(id))", "CREATE TABLE t (a INT, PAC_LINK (a) REFERENCES users(nothing))", "CREATE TABLE t (a INT, PAC_KEY ())", "CREATE TABLE t (a INT, PAC_KEY (a"])
def test_create_checks_its_columns_and_targets(text):
    with pytest.raises(PolicyError):
        ddl.parse(text, COLUMNS.get)


def test_constraints_become_policies():
    r = Registry()
    s = run(r, "create table if not exists orders (id int, user_id int, PRIMARY KEY (id), FOREIGN KEY (user_id) REFERENCES users (id))")
    assert s.plain == "create table if not exists orders (id int, user_id int)"
    assert r.get("orders").key == ("id",) and r.get("orders").links == (Link(("user_id",), "users", ("id",)),)
    assert ddl.parse("CREATE TABLE x (a INT) USING parquet", COLUMNS.get) is None and ddl.parse("CREATE VIEW v AS SELECT 1", COLUMNS.get) is None
    assert ddl.parse("DROP TABLE IF EXISTS orders", COLUMNS.get).plain.startswith("DROP")
