import pytest

from quern.plans import server
from quern.plans.batch import run_batch
from quern.plans.estimate import cheapest_first, share
from quern.plans.parser import parse
from quern.plans.session import Session, fields
from quern.plans.shell import Shell
from quern.sources import results, store

USERS = 'vietinfo users [{name: "Alice", age: 20, city: "HN"}, {name: "Bob", age: 25, city: "HCM"}, {name: "Carol", age: 18, city: "HN"}, {name: "Dave", age: 30, city: "DN"}]'


@pytest.fixture
def session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/store")
    assert s.execute(USERS).info == "inserted 4 documents"
    return s


def names(session, where):
    return sorted(r["name"] for r in session.sql(f"funden users {where}").collect())


@pytest.mark.parametrize(
    "where, want",
    [
        ("haar $vnot age $bh 20", ["Alice", "Carol"]),
        ('haar city $tg "HN"', ["Alice", "Carol"]),
        ('haar city $ktg ["HN", "DN"]', ["Bob"]),
        ("haar age $tg [20, 30]", ["Alice", "Dave"]),
        ('haar name $xau "a"', ["Carol", "Dave"]),
        ("orange bi age desc lime 2", ["Dave", "Bob"]),
        ("orange bi age asc lime 2 skopan 1", ["Alice", "Bob"]),
        ("orange bi city desc, age", ["Carol", "Alice", "Bob", "Dave"]),
        ('haar city $bg "HN" $vor age $bh 26 $vand age $lh 20', ["Carol"]),
    ],
)
def test_reads(session, where, want):
    got = [r["name"] for r in session.sql(f"funden users {where}").collect()]
    assert (got if "orange" in where else sorted(got)) == want


def test_lists_and_flat_paths(session):
    session.execute('cochin users haar name $bg "Bob" $don tags "admin"')
    session.execute('cochin users haar name $bg "Bob" $don tags "vip" $quy address.city "HCM"')
    assert names(session, 'haar tags $bg "admin,vip" $vand address.city $bg "HCM"') == ["Bob"]
    session.execute('cochin users haar name $bg "Bob" $loi tags "admin"')
    assert names(session, 'haar tags $bg "vip"') == ["Bob"]


def test_groups(session):
    rows = {r["city"]: (r["sep_age"], r["pou_age"], r["awr_age"]) for r in session.sql("gomail users gremb bi city sep age, pou age, awr age").collect()}
    assert rows == {"HN": (38.0, 2, 19.0), "HCM": (25.0, 1, 25.0), "DN": (30.0, 1, 30.0)}


@pytest.mark.parametrize(
    "statement, code",
    [("funden nope", "NO_COLLECTION"), ("cochin users haar id $bg 99 $quy a 1", "NOT_FOUND"), ("cochin users haar id $bg 1", "NO_SET_OP"), ("madeco users", "EXISTS"), ("gomail users", "NO_GROUP"), ("madecoidu users", "SYNTAX"), ("delecoidu users.x", "NOT_FOUND"), ("vietinfo users", "NO_PAYLOAD"), ("cometi", "NO_TX"), ("funden users $oops", "TOKEN"), ("nothing", "PARSE")],
)
def test_codes(session, statement, code):
    assert session.execute(statement).code == code


def test_delete_and_ids(session):
    assert session.execute('demlet users haar name $bg "Nobody"').ok
    assert session.execute('demlet users haar city $bg "DN"').count == 1
    assert session.execute('vietinfo users {name: "Eve"}').info == "inserted id=5"  # ids don't come back
    assert session.execute("demlet users").count == 4
    assert session.execute("funden users").text() == "ok 0 documents"


def test_two_types_in_one_field(session):
    session.execute('vietinfo users {name: "Eve", age: "old"}')
    assert names(session, 'haar age $bg "old"') == ["Eve"]
    assert names(session, "haar age $bhb 25") == ["Bob", "Dave"]
    assert names(session, "haar $vnot age $bhb 25") == ["Alice", "Carol", "Eve"]
    session.execute('cochin users haar name $bg "Alice" $quy age "young"')
    assert names(session, 'haar age $ktg ["old"]') == ["Alice", "Bob", "Carol", "Dave"]


def test_transactions(session):
    session.execute("ginan")
    session.execute('demlet users haar city $bg "HN"')
    assert names(session, "") == ["Bob", "Dave"]
    assert names(Session(session.spark, session.store.root), "") == ["Alice", "Bob", "Carol", "Dave"]
    session.execute("tulaberk")
    assert len(names(session, "")) == 4
    for s in ("ginan", 'demlet users haar city $bg "HN"', "cometi"):
        assert session.execute(s).ok
    assert names(Session(session.spark, session.store.root), "") == ["Bob", "Dave"]


def test_first_committer_wins(session):
    other = Session(session.spark, session.store.root)
    for s in ("ginan", 'cochin users haar name $bg "Bob" $quy age 1'):
        assert session.execute(s).ok
    assert other.execute('cochin users haar name $bg "Bob" $quy age 2').ok
    assert session.execute("cometi").code == "WRITE_CONFLICT"
    assert names(session, "haar age $bg 2") == ["Bob"]


def test_disjoint_writers_both_commit(session):
    other = Session(session.spark, session.store.root)
    for s in ("ginan", 'cochin users haar name $bg "Bob" $quy age 1', 'vietinfo users {name: "Eve"}'):
        assert session.execute(s).ok
    assert other.execute('cochin users haar name $bg "Dave" $quy age 2').ok
    assert session.execute("cometi").ok
    assert names(session, "haar age $lhb 2") == ["Bob", "Dave"]
    assert names(session, "haar id $bg 5") == ["Eve"]


def test_old_versions_stay_readable(session):
    version = session.store.head()
    session.execute("demlet users")
    assert session.store.frame(session.store.read(version).collections["users"]).count() == 4


def test_compaction_keeps_rows(session):
    session.execute('vietinfo users {name: "Eve", age: "old"}')
    session.compact("users")
    assert len(session.store.read().collections["users"].segments) == 1
    assert names(session, 'haar age $bg "old"') == ["Eve"]


def test_import(session, tmp_path):
    lines = ['{"name": "q\\"x\\\\y", "n": 1}', "", "# note", '{"name": "\\u00e9", "ok": true}', '{"name": "nested", "in": {"a": 1}, "list": [1]}', "{broken", '{"name": "plain", "n": 2.5, "id": 77}']
    (tmp_path / "edge.jsonl").write_text("\n".join(lines) + "\n")
    for how in ({"path": f"file://{tmp_path}/edge.jsonl"}, {"text": "\n".join(lines)}):
        name = "a" if "path" in how else "b"
        seen = session.load(name, **how)
        assert (seen.docs_inserted, seen.parse_errors) == (4, 1)
        rows = {r["name"]: r for r in session.sql(f"funden {name}").collect()}
        assert set(rows) == {'q"x\\y', "é", "nested", "plain"}
        assert sorted(r["id"] for r in rows.values()) == [1, 2, 3, 77]
        assert set(rows["plain"].asDict()) == {"id", "name", "n", "ok"}
        assert session.sql(f"funden {name} haar ok $bg true").count() == 1


def test_loads_in_a_transaction(session):
    """Alone, with statements, aborted, and while another writer commits."""
    two = '{"x": 1}\n{"x": "b"}'
    session.execute("ginan")
    session.load("c", text=two)
    assert session.sql("funden c").count() == 2 and Session(session.spark, session.store.root).execute("funden c").code == "NO_COLLECTION"
    assert session.execute("cometi").ok and session.sql("funden c").count() == 2
    session.execute("ginan")
    session.load("c", text=two)
    assert session.execute('cochin c haar x $bg "b" $quy x 5').count == 2
    assert session.execute("cometi").ok and session.sql("funden c haar x $bg 5").count() == 2
    session.execute("ginan")
    session.load("c", text=two)
    assert session.execute("tulaberk").ok and session.sql("funden c").count() == 4
    other = Session(session.spark, session.store.root)
    session.execute("ginan")
    session.load("c", text=two)
    session.execute("analyze c")
    other.load("c", text='{"x": 7}')
    other.execute('vietinfo c {x: 8}')
    assert session.execute("cometi").ok
    ids = sorted(r["id"] for r in session.sql("funden c").collect())
    assert ids == [1, 2, 3, 4, 5, 6, 7, 8] and session.statistics("c") is not None
    files = session.store._files()
    assert not [f for f in files.listStatus(session.store._path()) if f.getPath().getName().startswith("load-")]


def test_typed_import(session):
    seen = session.load("m", text='{"a": 1, "t": true}\n{"a": "x", "t": "no"}\n{"a": {"b": 1}}\n{"a": 2.5, "id": "none"}\n{"a": false, "id": 9}')
    assert (seen.docs_inserted, seen.parse_errors, seen.insert_errors) == (4, 0, 1)
    one = lambda where: [r["id"] for r in session.sql(f"funden m haar {where}").collect()]
    assert one("a $bg 1") == [1] and one('a $bg "x"') == [2] and one("a $bg false") == [9] and one("$vnot a $tntt") == [3]
    assert one("t $bg true") == [1] and one('t $bg "no"') == [2]


def test_kept_rows_are_not_older_than_the_store(session):
    session.keep("users")
    Session(session.spark, session.store.root).execute('vietinfo users {name: "Eve"}')
    assert len(names(session, "")) == 5
    session.set_mode("off")
    assert session.spark.conf.get("spark.sql.adaptive.enabled") == "false"
    session.close()
    assert session.spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_pages_and_files(session, tmp_path):
    assert '"count": 1' in server.answer(session, "POST", "/query?limit=3&offset=3", "funden users")[1]
    assert server.answer(session, "POST", "/query?limit=x", "funden users")[0] == 400
    results.save(session.sql("funden users orange bi id"), f"file://{tmp_path}/out")
    assert session.spark.read.json(f"file://{tmp_path}/out").count() == 4


def test_explain_and_indexes(session):
    assert session.execute("exepanus users haar age $bg 3").info.startswith("SCAN users")
    session.execute("madecoidu users.age")
    assert session.execute("exepanus funden users haar age $bg 3").info.startswith("INDEX SCAN users (field: age)")
    assert session.execute("madecoidu users.age").code == "EXISTS"
    assert session.execute("analyze users").df.count() == 4


def test_cache_is_dropped_on_write(session):
    session.keep("users")
    session.execute('vietinfo users {name: "Eve"}')
    assert len(names(session, "")) == 5


def test_batch(session):
    done = run_batch(session, "-- a note\nfunden users;\n\n# more\nskill\nfunden nope\nskill users;")
    assert (done.total, done.ok, done.errors) == (4, 3, 1)
    assert done.p50_ms <= done.p95_ms <= done.max_ms


def test_server_and_shell(session):
    assert '"count": 2' in server.answer(session, "POST", "/query", 'funden users haar city $bg "HN"')[1]
    assert '"name": "users"' in server.answer(session, "GET", "/collections", "")[1]
    assert server.answer(session, "GET", "/health", "")[0] == 200
    assert server.answer(session, "POST", "/import", "{}")[0] == 400
    assert '"docs_inserted": 1' in server.answer(session, "POST", "/import?coll=x", '{"a": 1}')[1]
    assert '"errors": 1' in server.answer(session, "POST", "/batch", "skill\nfunden no")[1]
    assert server.answer(session, "GET", "/no", "")[0] == 404
    shell = Shell(session.spark, session.store.root)
    assert shell.line('funden users haar name $bg "Bob"') == 'ok 1 document\n{ id: 2, name: "Bob", age: 25, city: "HCM" }'
    assert shell.line("\\timing") == "timing on" and "ms" in shell.line("skill")
    assert shell.line("\\trace") == "optimizer trace on" and "Statistics(" in shell.line('funden users haar age $bg 3')
    assert shell.line("\\close") == "closed" and shell.line("skill").startswith("err IO") and shell.line(f"\\open {session.store.root}").startswith("opened")
    assert shell.line("\\opt cost") == "optimizer cost" and shell.line("\\q") is None


def test_a_number_is_taken_once(session):
    from quern.errors import EngineError

    a, b = session.store.read().draft(), session.store.read().draft()
    session.store.publish(a)
    with pytest.raises(EngineError) as e:
        session.store.publish(b)
    assert e.value.code == "WRITE_CONFLICT" and session.store.head() == a.version + 1


def test_statistics_are_kept(session):
    assert session.statistics("users") is None
    session.execute("analyze users")
    rows = {r["field"]: r for r in Session(session.spark, session.store.root).statistics("users").collect()}
    assert (rows["age"]["low"], rows["age"]["high"], rows["city"]["distinct"]) == (18.0, 30.0, 3)


def test_statistics_order_conditions_and_say_what_to_expect(session):
    where = 'haar name $kc "Bob" $vand age $bg 25 $vand age $bh 0'
    before = [r["id"] for r in session.sql(f"funden users {where}").collect()]
    session.execute("analyze users")
    info = session.execute(f"exepanus funden users {where}").info
    assert "about 1 of 4 documents" in info
    assert [r["id"] for r in session.sql(f"funden users {where}").collect()] == before == []
    known = session._known("users")
    found = parse(f"funden users {where}").where
    assert fields(found) == ["name", "age", "age"] and fields(cheapest_first(found, known)) == ["age", "name", "age"]
    assert share(parse("funden users haar age $lh 24").where, known) == 0.5 and share(parse("funden users haar $vnot nope $tntt").where, known) == 1.0


def test_small_inserts_are_brought_together(session, monkeypatch):
    monkeypatch.setattr(store, "MOST_SEGMENTS", 4)
    for i in range(6):
        session.execute(f"vietinfo many {{n: {i}}}")
    assert len(session.store.read().collections["many"].segments) <= 4
    assert sorted(r["n"] for r in session.sql("funden many").collect()) == [0, 1, 2, 3, 4, 5]


def test_export_and_vacuum(session, tmp_path):
    session.execute("analyze users")
    session.execute('cochin users haar name $bg "Bob" $quy age 26')
    other = Session(session.spark, session.store.export(f"file://{tmp_path}/copy").root)
    assert names(other, "haar age $bg 26") == ["Bob"]
    done = session.store.vacuum()
    assert done["versions"] == session.store.head() - 1 and done["files"] == 1
    assert names(session, "") == ["Alice", "Bob", "Carol", "Dave"] and session.statistics("users").count() > 0
    assert session.store.vacuum() == {"versions": 0, "files": 0}


def test_indexed_fields_get_bloom_filters(session, tmp_path):
    import glob

    session.execute("madecoidu users.name")
    session.compact("users")
    c = session.store.read().collections["users"]
    parts = glob.glob(c.segments[0].path.removeprefix("file://") + "/*.parquet")
    jvm = session.spark._jvm
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(session.spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(parts[0]))
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    assert [x.getPath().toDotString() for x in columns if x.getBloomFilterOffset() >= 0] == ["name"]
    assert names(session, 'haar name $bg "Bob"') == ["Bob"]
