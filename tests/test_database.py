"""Writes, cascades, migrations and tools."""

import datetime as dt
import random

import pytest

from golden import PLAYERS, SCHEMA, TEAMS
from tesserae import tools
from tesserae.builder import F, where
from tesserae.database import Database
from tesserae.errors import EngineError
from tesserae.migrate import Migration
from tesserae.model import Collection, DateType, Embedded, Field, Float, Index, Int, Link, List, Schema, String
from tesserae.values import Date


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "db")


def refused(code):
    return pytest.raises(EngineError, match="") if code is None else _Refused(code)


class _Refused:
    def __init__(self, code):
        self.code = code

    def __enter__(self):
        return self

    def __exit__(self, kind, error, _):
        assert isinstance(error, EngineError), error
        assert error.code == self.code, error
        return True


USERS = Schema.of(
    1,
    Collection.of("users", Field("name", String), Field("email", String, optional=True), Field("age", Int, default=0), indexes=(Index.on("email", unique=True), Index.on("name", "age", unique=True))),
    Collection.of("posts", Field("slug", String), Field("author", Link("users")), Field("tags", List(String), optional=True), key="slug"),
)


def test_inserts_and_puts(spark, root):
    db = Database.open(spark, root, USERS)
    with db.write() as txn:
        users = txn.collection("users")
        assert users.insert_many([{"name": "Ada", "email": "a"}, {"name": "Bob"}, {"name": "Cy", "id": 10}, {"name": "Di"}]) == [1, 2, 10, 11]
        assert users.count() == 4
        with refused("DUPLICATE_KEY"):
            users.insert({"name": "E", "id": 2})
        with refused("DUPLICATE_KEY"):
            users.insert({"name": "E", "email": "a"})
        with refused("DUPLICATE_KEY"):
            users.insert({"name": "Bob", "age": 0})
        with refused("INVALID_ARGUMENT"):
            users.insert({"email": "x"})
        with refused("INVALID_ARGUMENT"):
            users.insert({"name": 3})
        with refused("INVALID_ARGUMENT"):
            users.insert({"name": "E", "nothing": 3})
        assert users.put({"id": 1, "name": "Ada", "email": "a", "age": 30}) == 1
        assert users.put({"name": "Ed"}) == 12
    with db.read() as txn:
        users = txn.collection("users")
        assert [r.id for r in users.find().collect()] == [1, 2, 10, 11, 12]
        assert users.get(1) == {"id": 1, "name": "Ada", "email": "a", "age": 30}


def test_dataframe_inserts(spark, root):
    db = Database.open(spark, root, USERS)
    with db.write() as txn:
        users = txn.collection("users")
        users.insert_many(spark.range(1000).repartition(7).selectExpr("concat('n', id) as name"))
        assert users.insert({"name": "last"}) == 1001
        with refused("INVALID_ARGUMENT"):
            users.insert_many(spark.range(2).selectExpr("cast(null as string) as name"))
        users.put_many(spark.range(5, 10).selectExpr("id", "'p' as name", "cast(id as int) as age"))
    users = db.read().collection("users")
    assert sorted(r.id for r in users.find().collect()) == list(range(1, 1002)) and users.count('name == "p"') == 5


def test_updates_and_transactions(spark, root):
    db = Database.open(spark, root, USERS)
    with db.write() as txn:
        txn.collection("users").insert_many([{"name": f"u{k}", "email": f"e{k}"} for k in range(6)])
    before = db.read()
    with db.write() as txn:
        users = txn.collection("users")
        assert users.update(1, {"age": 5}) and not users.update(99, {"age": 5})
        assert users.update_where("id > 2 SORT BY id DESC LIMIT 2", {"age": 7}) == 2
        assert users.update_where(F.age == 7, {"email": None, "age": None}) == 2
        with refused("INVALID_ARGUMENT"):
            users.update(1, {"id": 3})
        with refused("INVALID_ARGUMENT"):
            users.update(1, {"name": None})
        with refused("DUPLICATE_KEY"):
            users.update_where(F.id <= 2, {"email": "same"})
        assert users.change(key=2, age=9) == 1
    assert before.collection("users").sum("age") == 0
    now = db.read().collection("users")
    assert now.sum("age") == 14 and now.count("email IS NULL") == 2
    with pytest.raises(RuntimeError), db.write() as txn:
        txn.collection("users").delete_where()
        raise RuntimeError
    assert db.read().collection("users").count() == 6
    first = Database.open(spark, root)
    with refused("BUSY"), first.write() as txn:
        txn.collection("users").update(1, {"age": 1})
        with db.write() as other:
            other.collection("users").update(2, {"age": 1})
    assert db.read().collection("users").get(2)["age"] == 1
    with refused("CLOSED"):
        txn.collection("users")


LIBRARY = Schema.of(
    1,
    Collection.of("authors", Field("name", String)),
    Collection.of("books", Field("title", String), Field("author", Link("authors"), optional=True, cascade=True), Field("sequel", Link("books"), optional=True, cascade=True)),
    Collection.of("reviews", Field("book", Link("books"), optional=True, cascade=True)),
    Collection.of("notes", Field("book", Link("books"), optional=True)),
)


@pytest.mark.parametrize("seed", [1, 2])
def test_cascades_equal_a_model(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = {
        "authors": {k: {"name": f"a{k}"} for k in range(1, 5)},
        "books": {k: {"title": f"b{k}", "author": rng.choice([None, *range(1, 6)]), "sequel": rng.choice([None, *range(1, 13)])} for k in range(1, 13)},
        "reviews": {k: {"book": rng.choice([None, *range(1, 14)])} for k in range(1, 16)},
        "notes": {k: {"book": rng.choice([None, *range(1, 13)])} for k in range(1, 6)},
    }
    db = Database.open(spark, str(tmp_path / "db"), LIBRARY)
    links = {"books": [("author", "authors"), ("sequel", "books")], "reviews": [("book", "books")]}
    gone = {n: set() for n in rows}
    with db.write() as txn:
        for n, objects in rows.items():
            txn.collection(n).insert_many([{"id": k, **o} for k, o in objects.items()])
        lost = {k for k in rows["authors"] if k <= 2}
        assert txn.collection("authors").delete_where("id <= 2") == len(lost)
    gone["authors"] = lost
    changed = True
    while changed:
        changed = False
        for n, own in links.items():
            for k, o in rows[n].items():
                if k not in gone[n] and any(o[f] in gone[t] for f, t in own if o[f] is not None):
                    gone[n].add(k)
                    changed = True
    for n in rows:
        assert {r.id for r in db.read().collection(n).find().collect()} == rows[n].keys() - gone[n], n
    with db.write() as txn:
        assert txn.collection("authors").delete(3) and not txn.collection("authors").delete(3)


def test_migrations(spark, root):
    db = Database.open(spark, root, USERS)
    with db.write() as txn:
        txn.collection("users").insert_many([{"name": "Ada", "email": "a", "age": 3}, {"name": "Bob"}])
        txn.collection("posts").insert({"slug": "s", "author": 1, "tags": ["x"]})

    def shout(old, new):
        assert old.collection("users").count() == 2
        new.collection("people").update_where("full == $0", {"full": "ADA"}, "Ada")

    people = Collection.of("people", Field("full", String), Field("email", String, optional=True), Field("age", Float, default=1.5), Field("home", Embedded(Field("city", String, optional=True)), optional=True))
    posts = Collection.of("posts", Field("slug", String), Field("author", Link("people")), Field("tags", List(String), optional=True), Field("likes", Int, default=4), key="slug")
    step = Migration(2, {"users": "people"}, {("people", "name"): "full"}, replaced=(("people", "age"),), run=shout)
    second = Schema.of(2, people, posts)
    refusals = [
        (second, []), (second, [step, step]), (second, [Migration(2, {"nobody": "people"})]), (second, [Migration(2, {"users": "posts"})]),
        (second, [Migration(2, {"users": "people"}, {("people", "nothing"): "full"})]), (second, [Migration(2, {"users": "people"}, replaced=(("people", "id"),))]),
        (second, [Migration(2, {"users": "people"}, {("people", "name"): "full"})]), (Schema.of(2, USERS.find("users")), []),
        (Schema.of(2, USERS.find("users"), Collection.of("posts", Field("slug", String), Field("author", Link("users")), Field("new", Int), key="slug")), []),
        (Schema.of(2, USERS.find("users"), Collection.of("posts", Field("author", Link("users")))), []),
        (Schema.of(2, Collection.of("users", Field("name", String), Field("email", String), Field("age", Int, default=0)), USERS.find("posts")), []),
        (Schema.of(2, Collection.of("users", Field("name", String), Field("email", String, optional=True), Field("age", Int)), USERS.find("posts")), []),
    ]
    for schema, migrations in refusals:
        with refused("INVALID_ARGUMENT"):
            Database.open(spark, root, schema, migrations)

    def fails(old, new):
        raise ValueError("no")

    with refused("MIGRATION_FAILED"):
        Database.open(spark, root, second, [Migration(2, step.renamed_collections, step.renamed_fields, replaced=step.replaced, run=fails)])
    assert db.read().collection("users").count() == 2
    new = Database.open(spark, root, second, [step])
    found = [r.asDict(True) for r in new.read().collection("people").find().collect()]
    assert found == [{"id": 1, "full": "ADA", "email": "a", "age": 1.5, "home": None}, {"id": 2, "full": "Bob", "email": None, "age": 1.5, "home": None}]
    assert new.read().collection("posts").find_one('author.full == "ADA"') == {"slug": "s", "author": 1, "tags": ["x"], "likes": 4}
    for run in (db.read, lambda: Database.open(spark, root, Schema.of(2, people))):
        with refused("SCHEMA_MISMATCH"):
            run()
    with refused("SCHEMA_TOO_NEW"):
        Database.open(spark, root, USERS)
    with new.write() as txn:
        assert txn.collection("people").insert({"full": "Cy"}) == 3
    with refused("NOT_FOUND"):
        Database.open(spark, root + "x")


def test_tools(spark, root, tmp_path):
    db = Database.open(spark, root, SCHEMA)
    with db.write() as txn:
        txn.collection("teams").insert_many(TEAMS)
        txn.collection("players").insert_many(PLAYERS)
    with db.write() as txn:
        txn.collection("players").update_where("score == 3", {"motto": "x"})
    assert tools.check(db) == []
    assert [(p.collection, p.where, p.count) for p in tools.check(db, dangling=True)] == [("players", "team", 1), ("players", "friends", 1)]
    tools.backup(db, str(tmp_path / "copy"))
    with refused("INVALID_ARGUMENT"):
        tools.backup(db, str(tmp_path / "copy"))
    copy = Database.open(spark, str(tmp_path / "copy"))
    assert [r.id for r in copy.read().collection("players").find('motto == "x"').collect()] == [1, 3]
    assert tools.compact(db) > 0 and db.read().collection("players").count() == 4 and len(db.store.listed("data")) == 2
    with db.write() as txn:
        w = txn.collection("players")
        txn.append("players", w.frame().where("id < 3"))
    assert {(p.kind, p.count) for p in tools.check(db)} == {("repeated_key", 2), ("repeated_value", 1)}
    assert tools.salvage(spark, root, str(tmp_path / "saved")) == {"teams": 1, "players": 4}
    saved = Database.open(spark, str(tmp_path / "saved"))
    assert tools.check(saved) == []
    with saved.write() as txn:
        assert txn.collection("players").insert({}) == 5


def test_dates_and_embedded_lists(spark, root):
    schema = Schema.of(1, Collection.of("trips", Field("at", DateType), Field("due", DateType, default=Date(0)), Field("seen", List(DateType), optional=True), Field("stops", List(Embedded(Field("city", String), Field("mins", Int, optional=True))), optional=True)))
    db = Database.open(spark, root, schema)
    with db.write() as txn:
        txn.collection("trips").insert_many(
            [
                {"at": dt.datetime(2026, 10, 30, 12), "seen": [dt.date(2026, 1, 1)], "stops": [{"city": "Seoul", "mins": 3}, {"city": "Busan"}]},
                {"at": dt.datetime(1969, 12, 31, 23, 59, 59, 999999), "stops": []},
                {"at": dt.date(2000, 2, 29)},
            ]
        )
    trips = db.read().collection("trips")
    ids = lambda q, *v: [r.id for r in trips.find(q, *v).collect()]
    assert ids('at >= DATE "2000-02-29"') == [1, 3] and ids("at < $0", dt.datetime(1970, 1, 1)) == [2] and ids('due == DATE "1970-01-01"') == [1, 2, 3]
    assert ids('seen == DATE "2026-01-01"') == [1] and ids('stops.city == "Busan"') == [1] and ids("stops.mins >= 3") == [1]
    assert ids("stops.mins IS NULL") == [1, 3] and ids("NOT stops.mins IS NULL") == [2] and ids('stops.city != "Seoul"') == [1] and ids("SORT BY at") == [2, 3, 1]
    assert trips.min("at") == Date(-1) and trips.max("at") == Date(1_793_361_600_000_000)


def test_find_returns_lazy_frames(spark, root):
    db = Database.open(spark, root, USERS)
    with db.write() as txn:
        txn.collection("users").insert_many([{"name": "Ada"}])
    assert db.read().collection("users").find(where(F.name == "Ada")).columns == ["id", "name", "email", "age"]


def test_changes_rewrite_only_the_files_they_touch(spark, root):
    schema = Schema.of(1, Collection.of("a", Field("x", Int), Field("y", Int, default=0), Field("name", String, optional=True), key="x", indexes=(Index.on("name", unique=True),)))
    db = Database.open(spark, root, schema)
    with db.write() as txn:
        for k in range(0, 800, 100):
            txn.append("a", spark.range(k, k + 100, 1, 2).selectExpr("id as x", "0L as y", "concat('n', id) as name"))

    def files():
        commit = db.store.latest()
        return {f for e in commit.tables["a"] for f in db.store.files(e)}

    def kept_after(change):
        before = files()
        with db.write() as txn:
            change(txn.collection("a"))
        return len(before) - len(before & files())

    assert len(files()) > 4
    assert kept_after(lambda a: a.update(5, {"y": 1})) == 1
    assert kept_after(lambda a: a.delete(799)) == 1
    assert kept_after(lambda a: a.put({"x": 700, "name": "p", "y": 2})) == 1
    assert kept_after(lambda a: a.put({"x": 9000})) == 0 and kept_after(lambda a: a.update(-4, {"y": 1})) == 0 and kept_after(lambda a: a.delete_where("x < 0")) == 0
    assert 1 <= kept_after(lambda a: a.update_where("x IN [6, 7]", {"y": 3})) <= 2
    assert kept_after(lambda a: a.update_where(None, {"y": 4, "name": None})) > 4
    a = db.read().collection("a")
    assert len(a) == 800 and a.sum("y") == 3200 and a.count("name IS NULL") == 800
    with db.write() as txn:
        txn.collection("a").update(1, {"name": "one"})
    with refused("DUPLICATE_KEY"), db.write() as txn:
        txn.collection("a").update(2, {"name": "one"})
    assert tools.check(db) == []


def test_many_keys_are_found_by_a_join(spark, root, monkeypatch):
    monkeypatch.setattr("tesserae.database.FEW_KEYS", 2)
    db = Database.open(spark, root, Schema.of(1, Collection.of("a", Field("x", Int), Field("y", Int, default=0), key="x")))
    with db.write() as txn:
        a = txn.collection("a")
        a.insert_many(spark.range(0, 50, 1, 5).selectExpr("id as x"))
        assert a.update_where("x >= 40", {"y": 1}) == 10 and a.delete_where("x < 10") == 10
        a.put_many(spark.range(20, 60).selectExpr("id as x", "2 as y"))
    a = db.read().collection("a")
    assert len(a) == 50 and a.sum("y") == 80


def test_ends_leave_no_folders_behind(spark, root):
    db = Database.open(spark, root, USERS)
    folders = lambda: {f"data/{f}" for f in db.store.listed("data")}
    with db.write() as txn:
        users = txn.collection("users")
        users.insert_many([{"name": f"u{k}"} for k in range(5)])
        users.update(1, {"age": 5})
        users.delete(2)
    used = {"/".join(e.split("/")[:2]) for e in db.store.latest().tables["users"]}
    assert folders() == used
    with pytest.raises(RuntimeError), db.write() as txn:
        txn.collection("users").delete_where()
        raise RuntimeError
    assert folders() == used and db.read().collection("users").count() == 4
    with refused("BUSY"), db.write() as txn:
        txn.collection("users").update(1, {"age": 1})
        with db.write() as other:
            other.collection("users").update(3, {"age": 7})
    assert folders() == {"/".join(e.split("/")[:2]) for e in db.store.latest().tables["users"]} and db.store.listed("drafts") == []


def test_a_claim_that_was_left_behind_is_taken_over(spark, root):
    db = Database.open(spark, root, USERS)
    left = db.store.path("commits", f".claim-{2:010d}.json")
    db.store._write(left, "a writer that died")
    with refused("BUSY"), db.write() as txn:
        txn.collection("users").insert({"name": "a"})
    db.store.claim_seconds = 0
    with db.write() as txn:
        txn.collection("users").insert({"name": "b"})
    assert [r.name for r in db.read().collection("users").find().collect()] == ["b"] and not db.store.fs.exists(left)


def test_failures_of_the_store_are_not_reported_as_conflicts(spark, root, monkeypatch):
    from py4j.protocol import Py4JJavaError

    db = Database.open(spark, root, USERS)
    plain = db.store._write

    def full(path, text):
        if path.getName().startswith(".claim"):
            db.store.fs.open(db.store.path("nothing"))  # fails as a store may, with another error than that of a conflict
        plain(path, text)

    monkeypatch.setattr(db.store, "_write", full)
    with pytest.raises(Py4JJavaError) as e, db.write() as txn:
        txn.collection("users").insert({"name": "a"})
    assert "AlreadyExists" not in e.value.java_exception.getClass().getName()
    monkeypatch.undo()
    with db.write() as txn:
        txn.collection("users").insert({"name": "a"})
    assert db.read().collection("users").count() == 1


def test_stored_indexes_change_what_is_read_and_not_what_is_found(spark, root):
    schema = Schema.of(
        1,
        Collection.of(
            "a", Field("x", Int), Field("n", Int, default=0), Field("text", String, optional=True), Field("tags", List(String), optional=True), Field("next", Link("a"), optional=True), key="x",
            indexes=(Index.on("n"), Index.on("text", text=True), Index.on("tags")),
        ),
    )
    db = Database.open(spark, root, schema)
    with db.write() as txn:
        for k in range(5):
            txn.append("a", spark.range(k * 10, k * 10 + 10).selectExpr("id as x", "id div 5 as n", f"if(id % 3 = 0, null, concat('word{k} The Same ', id)) as text", "if(id % 4 = 0, null, array(concat('t', id), 'all')) as tags", "(id + 1) % 50 as next"))
    questions = [
        "n == 3", "n IN [0, 9]", "n >= 9", "n < 1 AND text MATCHES \"same\"", 'text MATCHES "word2 the"', 'text MATCHES "word*"', 'text MATCHES "nothing"', "n BETWEEN 2 AND 4 OR x == 0",
        'tags CONTAINS "t7"', 'tags CONTAINS "T7" IGNORE CASE', 'NOT text MATCHES "word1"', "n == 3 AND next.n == 3", "n == 9 AND ANY a.next (n == 0)", "text IS NULL AND n == 2", "n != 4", "n == 3 SORT BY x DESC LIMIT 2",
    ]

    def answers():
        a = db.read().collection("a")
        return [([r.x for r in a.find(q).collect()], a.count(q), a.sum("x", q)) for q in questions]

    plain = answers()
    tools.index(db)
    assert answers() == plain
    read = lambda q: db.read().collection("a").find(q).inputFiles()
    everything = len(read("x >= 0"))
    assert len(read("n == 3")) < everything and len(read('text MATCHES "word2"')) < everything and len(read('text MATCHES "nothing"')) == 0 and len(read('NOT text MATCHES "word1"')) == everything
    with db.write() as txn:
        a = txn.collection("a")
        a.update_where("n == 3", {"n": 4})
        a.insert({"x": 100, "n": 3, "text": "word2 the new"})
        a.delete_where('text MATCHES "word4" AND n == 9')
        assert a.count("n == 3") == 1
    now = answers()
    assert now != plain
    tools.compact(db)
    assert answers() == now and "a" in db.store.latest().indexes
    assert [r.x for r in db.read().collection("a").find('text MATCHES "word2 new"').collect()] == [100]


def test_asynchronous_twins(spark, root):
    import asyncio

    from tesserae.aio import AsyncDatabase, rows

    async def run():
        db = await AsyncDatabase.open(spark, root, USERS)
        async with db.write() as txn:
            users = txn.collection("users")
            assert await users.insert_many([{"name": "Ada"}, {"name": "Bob", "age": 4}]) == [1, 2]
            assert await users.update(1, {"age": 30}) and await users.count("age > 3") == 2
        with pytest.raises(RuntimeError):
            async with db.write() as txn:
                await txn.collection("users").delete_where()
                raise RuntimeError
        with refused("BUSY"):
            async with db.write() as txn:
                await txn.collection("users").delete(1)
                async with db.write() as other:
                    await other.collection("users").insert({"name": "Cy"})
        users = (await db.read()).collection("users")
        found, total = await asyncio.gather(users.find("age == 30"), users.sum("age"))
        return [r.name for r in await rows(found)], total, await users.length(), [o["name"] async for o in users.iter()]

    assert asyncio.run(run()) == (["Ada"], 34, 3, ["Ada", "Bob", "Cy"])
