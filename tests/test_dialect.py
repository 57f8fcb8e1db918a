import pytest

from lakeloom.plans import errors, store
from lakeloom.plans.dialect import Literal, parse
from lakeloom.plans.engine import Engine, run_interleaving


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def run(engine, *texts):
    s = engine.session()
    return [s.execute(t) for t in texts]


def rows(engine, text):
    return sorted(tuple(r) for r in engine.session().sql(text).rows.collect())


# Boats and their moorings: names are cut at 6 characters, harbours at 20.
BOATS = [(11, "Puffin", "North quay by the old customs house"), (12, "Kittiwake", "South mole"), (13, "Kittiwright", "South mole"), (14, "Gannet", "Inner basin, berth 4"), (14, "Puffin", "South mole")]
STORED = [(i, n[:6], h[:20]) for i, n, h in BOATS]


def filled(engine):
    made = run(engine, "create table boat (no int, name char(6), harbour char(20));", *[f"insert into boat values ({i}, '{n}', '{h}');" for i, n, h in BOATS])
    assert made == ["success"] + ["affect raw : 1"] * len(BOATS)


def test_parser():
    s = parse("SELECT a, T.b FROM t, u where t.x >= -1.5 AND y <> 'q--' order by b desc; -- end")
    assert s.tables == ("t", "u") and s.where[0].right == Literal("FLOAT", -1.5) and s.order[1] is True and s.columns[1].table == "T"
    assert parse("/* c */ select * from t order by a").order[1] is False
    for bad in ("select from t", "select a from t where 1 = a", "update t set a = b", "a", "select a from t where a != 1", "insert into t values ()", "select a from t where a = 1 or b = 2"):
        with pytest.raises(errors.SyntaxFault):
            parse(bad)


def listing(*names):
    rule = "+" + "-" * 18 + "+"
    return "\n".join([rule, f"| {'Tables':>16} |", rule, *[f"| {n:>16} |" for n in names], rule, f"Total record(s): {len(names)}", ""])


def test_definitions(engine):
    script = [
        ("create table pier (no int, depth float);", "success"), ("create table crane (pier_no int, tons float, maker char(12));", "success"), ("show tables;", listing("crane", "pier")),
        ("create table pier (no int);", "fail"), ("drop table quay;", "fail"), ("drop table pier;", "success"), ("show tables;", listing("crane")), ("create index crane (tons);", "fail"), ("help;", "fail"),
        ("drop table crane;", "success"), ("drop table crane;", "fail"), ("show tables;", listing()),
    ]
    assert run(engine, *[t for t, _ in script]) == [w for _, w in script]
    bad = ["create table a (x int, x int)", "create table a (x int, y char(1081))", "create table a (x float primary key, y int)", "create table a (x int, primary key (z))", "create table a (x int)"]
    assert run(engine, *bad) == ["fail"] * len(bad)
    assert run(engine, "create table k (id int primary key, v float)", "desc k")[1].count("PRIMARY_KEY") == 1


def test_queries_and_errors(engine):
    filled(engine)
    assert rows(engine, "select * from boat") == sorted(STORED)
    assert rows(engine, "select no from boat where no = 13") == [(13,)]
    assert rows(engine, "select no from boat where name = 'Kittiwhatever'") == [(12,), (13,)]  # literals are cut like the column
    assert rows(engine, "select name, no, name from boat where name = 'Puffin' and no > 12") == [("Puffin", 14, "Puffin")]
    assert [r[0] for r in engine.session().sql("select no from boat order by no desc").rows.collect()] == sorted((r[0] for r in STORED), reverse=True)
    line = run(engine, "select * from boat where no = 11;")[0].splitlines()[3]
    assert line == "| " + " | ".join(f"{c:>16}" for c in ("11", "Puffin", "North quay by...")) + " |"
    faults = [
        ("select colour from boat", errors.ColumnNotFound), ("select no from boat where no = 'x'", errors.TypeMismatch), ("select no from boat where no = 1.0", errors.TypeMismatch), ("select no from ship", errors.TableNotFound),
        ("insert into boat values (1, 'a')", errors.ValuesCountMismatch), ("insert into boat values (1.0, 'a', 'b')", errors.TypeMismatch), ("select no from boat, boat", errors.UnsupportedOperation),
    ]
    for text, kind in faults:
        with pytest.raises(kind):
            engine.session().sql(text)


def test_updates_and_deletes(engine):
    filled(engine)
    image = [list(r) for r in STORED]

    def change(test, **new):
        hit = [r for r in image if test(r)]
        for r in hit:
            for at, value in new.items():
                r["no name harbour".split().index(at)] = value
        return f"affect raw : {len(hit)}"

    assert run(engine, "update boat set harbour = 'Outer roads' where no = 12;", "update boat set no = 40, name = 'Ketch' where name = 'Puffin';") == [change(lambda r: r[0] == 12, harbour="Outer roads"), change(lambda r: r[1] == "Puffin", no=40, name="Ketch")]
    assert rows(engine, "select * from boat") == sorted(map(tuple, image))
    assert run(engine, "delete from boat where name = 'Gull';", "delete from boat where no = 40 and harbour = 'South mole';") == ["affect raw : 0", "affect raw : 1"]
    image = [r for r in image if not (r[0] == 40 and r[2] == "South mole")]
    assert rows(engine, "select * from boat") == sorted(map(tuple, image))
    assert run(engine, "update boat set colour = 1", "delete from boat") == ["fail", f"affect raw : {len(image)}"]


def test_joins(engine):
    run(engine, "create table boat (no int, name char(6), harbour char(20));", "create table trip (day char(3), boat_no int, miles float);")
    boats, trips = STORED[:3], [(d, i, float((7 * i + 3 * k) % 50) / 4) for i in (11, 12, 13, 15) for k, d in enumerate(("mon", "tue", "fri"))]
    run(engine, *[f"insert into boat values ({i}, '{n}', '{h}');" for i, n, h in boats], *[f"insert into trip values ('{d}', {i}, {m});" for d, i, m in trips])
    assert len(rows(engine, "select * from boat, trip")) == len(boats) * len(trips)
    assert rows(engine, "select no, name, day, miles from boat, trip where boat.no = trip.boat_no") == sorted((i, n, d, m) for i, n, _ in boats for d, b, m in trips if b == i)
    for one, two in (("boat.no = trip.boat_no", "trip.boat_no = boat.no"), ("no < boat_no", "boat_no > no"), ("no >= boat_no", "boat_no <= no")):  # sides may be swapped
        assert rows(engine, f"select no, day from boat, trip where {one}") == rows(engine, f"select no, day from boat, trip where {two}")
    assert len(rows(engine, "select no from boat join trip where no < boat_no and miles >= 5.0")) == sum(i < b and m >= 5 for i, _, _ in boats for _, b, m in trips)
    with pytest.raises(errors.UnsupportedOperation):
        engine.session().sql("select no from boat, trip, other")


def test_primary_keys(engine):
    assert run(engine, "create table k (id int primary key, v float);", "insert into k values (1, 2.5);", "insert into k values (1, 3.5);", "update k set id = 2;", "select v from k where id = 1;")[1:4] == ["affect raw : 1", "Abort", "fail"]
    assert rows(engine, "select id, v from k") == [(1, 2.5)]


TANKS = [(7, "red", 12.5), (8, "green", 40.0), (9, "blue", 3.25)]
BEGIN = ["Begin", "Begin"]


@pytest.mark.parametrize(
    ("one", "two", "order", "want"),
    [
        # a reader meets an uncommitted change; after the rollback the old value is back
        (["update tank set litres = 1.5 where no = 8;", "rollback;", "select * from tank where no = 8;"], ["select * from tank where no = 8;", "commit;"], "1a 2a 1b 2b 1c 2c 1d", [*BEGIN, "affect raw : 1", "Abort", "Abort", "Commit", 40.0]),
        # a sole reader goes on to write; a second writer aborts
        (["select * from tank where no = 9;", "update tank set litres = 6.0 where no = 9;", "commit;"], ["update tank set litres = 7.0 where no = 9;", "commit;"], "1a 1b 1c 2a 2b 1d 2c", ["Begin", 3.25, "affect raw : 1", "Begin", "Abort", "Commit", "Commit"]),
        # a writer meets a reader's row and aborts; the reader reads the same again
        (["select * from tank where no = 7;", "select * from tank where no = 7;", "commit;"], ["delete from tank where no = 7;"], "1a 2a 1b 2b 1c 1d", [*BEGIN, 12.5, "Abort", 12.5, "Commit"]),
        # no predicate locks: a row that comes to match is met as a change of another
        (["select * from tank where paint = 'red';", "select * from tank where paint = 'red';"], ["update tank set paint = 'red' where no = 8;", "abort;"], "1a 2a 1b 2b 1c", [*BEGIN, 12.5, "affect raw : 1", "Abort"]),
        # readers don't disturb each other, nor do writers of different rows
        (["select * from tank where no = 7;", "update tank set litres = 1.0 where no = 8;", "commit;"], ["select * from tank where no = 7;", "update tank set litres = 2.0 where no = 9;", "commit;"], "1a 2a 1b 2b 1c 2c 1d 2d", [*BEGIN, 12.5, 12.5, "affect raw : 1", "affect raw : 1", "Commit", "Commit"]),
    ],
)
def test_interleavings(engine, one, two, order, want):
    load = ["create table tank (no int, paint char(5), litres float);", *[f"insert into tank values ({i}, '{p}', {x});" for i, p, x in TANKS]]
    script = "\n".join([f"preload {len(load)}", *load])
    for k, body in ((1, ["begin;", *one]), (2, ["begin;", *two])):
        script += f"\ntxn{k} {len(body)} {k}\n" + "\n".join(f"{k}{'abcde'[i]} {x}" for i, x in enumerate(body))
    steps = order.split()
    got = run_interleaving(engine, script + f"\npermutation {len(steps)}\n" + "\n".join(steps))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w if isinstance(w, str) else f"{w:.6f}" in g and "Total record(s): 1" in g


def test_commits_are_seen_by_new_engines_and_closing_rolls_back(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    run(engine, "create table t (a int, b int)", "insert into t values (1, 2)")
    s = engine.session()
    assert [s.execute(x) for x in ("begin", "begin", "insert into t values (3, 4)", "select * from nope")] == ["Begin", "fail", "affect raw : 1", "fail"]
    s.close()
    assert rows(Engine(spark, str(tmp_path / "s")), "select * from t") == [(1, 2)]


@pytest.fixture
def two(spark, tmp_path):
    one = Engine(spark, str(tmp_path / "shared"))
    run(one, "create table t (a int, b int)", "create table k (id int primary key, b int)", "insert into t values (1, 10)", "insert into t values (2, 20)")
    return one, Engine(spark, str(tmp_path / "shared"))


def test_engines_see_each_others_commits_and_lose_no_update(two):
    one, other = two
    assert run(one, "insert into t values (3, 30)") == run(other, "insert into t values (4, 40)") == ["affect raw : 1"]
    assert rows(one, "select a from t") == rows(other, "select a from t") == [(1,), (2,), (3,), (4,)]
    assert run(other, "update t set b = 11 where a = 1", "delete from t where a = 2") == ["affect raw : 1"] * 2
    assert rows(one, "select * from t") == [(1, 11), (3, 30), (4, 40)]
    assert run(other, "drop table k") == ["success"] and run(one, "select * from k") == ["fail"]


def test_the_first_committer_wins_between_engines(two):
    one, other = two
    a, b = one.session(), other.session()
    assert [a.execute(x) for x in ("begin", "update t set b = 99 where a = 1")] == ["Begin", "affect raw : 1"]
    assert [b.execute(x) for x in ("begin", "update t set b = 77 where a = 1")] == ["Begin", "affect raw : 1"]
    assert (b.execute("commit"), a.execute("commit")) == ("Commit", "Abort")
    assert rows(one, "select b from t where a = 1") == [(77,)]
    a.execute("begin")
    assert a.execute("insert into t values (5, 50)") == "affect raw : 1"
    assert run(one, "update t set b = 21 where a = 2") == ["affect raw : 1"]  # another row, in a session of the same engine
    assert a.execute("commit") == "Commit"
    assert rows(other, "select * from t") == [(1, 77), (2, 21), (5, 50)]


def test_a_key_is_taken_once_between_engines(two):
    one, other = two
    a = one.session()
    assert [a.execute(x) for x in ("begin", "insert into k values (1, 1)")] == ["Begin", "affect raw : 1"]
    assert run(other, "insert into k values (1, 2)") == ["affect raw : 1"]
    assert a.execute("commit") == "Abort" and rows(one, "select b from k") == [(2,)]


def test_many_commits_are_compacted_and_old_data_goes(engine, monkeypatch):
    monkeypatch.setattr(store, "MOST_GENERATIONS", 5)
    monkeypatch.setattr(store, "MOST_CHANGES", 2)
    run(engine, "create table t (a int, b int)")
    want = {}
    for i in range(9):
        run(engine, f"insert into t values ({i}, 0)", f"update t set b = {i} where a = {i // 2}")
        want = {k: v for k, v in want.items()} | {i: 0}
        want[i // 2] = i
    assert rows(engine, "select * from t") == sorted(want.items())
    data = engine.store.tables["t"]["data"]
    assert len(data) <= 6 and data[0][0] == "base"
    assert engine.store.vacuum() > 5 and rows(engine, "select * from t") == sorted(want.items())
    assert run(engine, "drop table t") == ["success"] and engine.store.vacuum() == 0


def test_bulk_load_is_sorted_and_numbered(engine, spark):
    run(engine, "create table t (a int, b float)", "insert into t values (5, 0.5)")
    df = spark.range(0, 1000, 1, 7).selectExpr("int(997 * id % 1000) a", "id / 4.0 b")
    assert engine.store.load("t", df, "a") == 1000
    assert len(rows(engine, "select a from t")) == 1001
    kept = engine.store.committed("t")
    assert kept.select(store.ROW_ID).distinct().count() == 1001 and kept.agg({store.ROW_ID: "max"}).first()[0] == 1000
    assert rows(engine, "select b from t where a = 997") == [(0.25,)]


def test_scripts(engine):
    from lakeloom.shell import run as replies

    script = ["create table t (a int,", " b char(4));insert into t values (1, 'x;y');", "begin; update t set b = 'z'; exit; show tables"]
    assert list(replies(engine.session(), script)) == ["success", "affect raw : 1", "Begin", "affect raw : 1", "Bye."]
    assert rows(engine, "select b from t") == [("x;y",)]
    assert list(replies(engine.session(), ["select b from t"]))[0].count("x;y") == 1
