"""Random queries against a plain interpreter of the rules, over rows with every awkward value."""

import datetime as dt
import functools
import math
import random

import pytest

from golden import SCHEMA
from tesserae.builder import where
from tesserae.database import Reader
from tesserae.declare import Link, collection, embedded, field, objects, schema_of, values_of
from tesserae.functions.text import folded
from tesserae.model import Index, struct_type
from tesserae.operators.changes import complete, rows_of
from tesserae.plans import ir
from tesserae.plans.resolve import resolve_path
from tesserae.values import Date

HANDLES = ["", "a\0b", "é", "AceK", "BÉAN", "ace", "Zed", None]
FLOATS = [-1.0, -0.0, 0.0, 0.5, 2.0, math.inf, math.nan, None]
DATES = [None, Date(-86_400_000_001), Date(-1), Date(0), Date(1), Date(1_793_361_600_000_000)]
TAGS = ["red", "blue", "Green", ""]
TEXTS = [None, "", "?!", "The QUICK brown fox.", "A slow fox, quickly.", "빠른 검색을 한다", "東京都に住む"]
SEARCHES = ["fox", "quick fox", "qui*", "", "*", "東京", "京都", "む", "검색*", "slow quickly"]
SCALARS = {"score": [0, 1, 2, 3], "rating": FLOATS, "handle": HANDLES, "tags": TAGS, "team": ["north", "south", "gone"], "friends": [1, 2, 3, 99], "active": [True, False], "address.city": TAGS, "address.zip": [1, 2], "note": [b"", b"\0", b"ab"], "born": DATES, "seen": DATES, "visits.city": TAGS, "visits.n": [1, 2], "team.city": ["Seoul", "seoul", "Busan"], "team.name": ["north", "south"], "friends.score": [0, 1, 2, 3], "friends.handle": HANDLES, "friends.team.city": ["Seoul", "Busan"], "friends.tags": TAGS, "bio": HANDLES, "id": [1, 5, 9]}


def random_rows(rng):
    some = lambda pool, n=3: rng.choice([None, [rng.choice([x for x in pool if x is not None]) for _ in range(rng.randint(0, n))]])
    rows = []
    for _ in range(40):
        rows.append(
            {
                "score": rng.randint(0, 3), "rating": rng.choice(FLOATS), "handle": rng.choice(HANDLES), "tags": some(TAGS), "team": rng.choice([None, "north", "south", "gone"]),
                "friends": some(range(1, 45)), "active": rng.random() < 0.5, "address": rng.choice([None, {"city": rng.choice([None, *TAGS]), "zip": rng.choice([None, 1, 2])}]),
                "note": rng.choice([None, b"", b"\0", b"ab"]), "born": rng.choice(DATES), "seen": some(DATES), "bio": rng.choice(TEXTS), "lines": some(TEXTS),
                "visits": rng.choice([None, [{"city": rng.choice(TAGS), "n": rng.choice([None, 1, 2])} for _ in range(rng.randint(0, 3))]]),
            }
        )
    return [complete(SCHEMA, "players", SCHEMA.find("players").all_fields, {"id": k + 1} | r) for k, r in enumerate(rows)]


TEAMS = [{"name": "north", "city": "Seoul"}, {"name": "south", "city": None}]


@functools.total_ordering
class Float:
    """NaN equals NaN and is greatest."""

    def __init__(self, x):
        self.key = (math.isnan(x), 0.0 if math.isnan(x) else x)

    def __eq__(self, other):
        return self.key == other.key

    def __lt__(self, other):
        return self.key < other.key


def comparable(v):
    return Float(v) if isinstance(v, float) else v.encode() if isinstance(v, str) else v


class Model:
    """The rules, one object at a time."""

    def __init__(self, rows):
        self.rows = {"players": {r["id"]: r for r in rows}, "teams": {t["name"]: t for t in TEAMS}}

    def values(self, collection, row, names):
        """Every value that the path reaches; one null where it reaches none but through an empty list."""
        fields, values, kind = SCHEMA.find(collection).all_fields, [row], None
        for name in names:
            if kind is not None and kind.kind == "link":
                values = [self.rows[kind.target].get(v) for v in values]
                fields = SCHEMA.find(kind.target).all_fields
            elif kind is not None:
                fields = kind.fields
            f = next(x for x in fields if x.name == name)
            values = [None if v is None else v[name] for v in values]
            if f.type.kind == "list":
                values = [x for v in values for x in ([None] if v is None else v)]
            kind = f.type.item or f.type
        return values

    def holds(self, e, collection, row):
        match e:
            case ir.And(items):
                return all(self.holds(x, collection, row) for x in items)
            case ir.Or(items):
                return any(self.holds(x, collection, row) for x in items)
            case ir.Not(item):
                return not self.holds(item, collection, row)
            case ir.Linked(other, path, inner):
                key = row[SCHEMA.find(collection).key_name]
                return any(key in self.values(other, r, path) and (inner is None or self.holds(inner, other, r)) for r in self.rows[other].values())
        path = resolve_path(SCHEMA, SCHEMA.find(collection), e.path)
        return any(self.meets(e, v, path.list_leaf) for v in self.values(collection, row, e.path))

    def meets(self, t, v, in_list):
        if t.op == "IS NULL" or v is None:
            return t.op == "IS NULL" and v is None
        if t.op == "MATCHES":
            return self.found(v, t.values[0])
        wanted = [float(x) if isinstance(v, float) and not isinstance(x, float) else x for x in t.values]
        if t.fold:
            v, wanted = folded(v), [folded(x) for x in wanted]
        if t.op == "CONTAINS" and not in_list:
            return wanted[0] in v
        if t.op in ("STARTSWITH", "ENDSWITH"):
            return v.startswith(wanted[0]) if t.op == "STARTSWITH" else v.endswith(wanted[0])
        v, w = comparable(v), [comparable(x) for x in wanted]
        match t.op:
            case "==" | "CONTAINS":
                return v == w[0]
            case "!=":
                return v != w[0]
            case "<":
                return v < w[0]
            case "<=":
                return v <= w[0]
            case ">":
                return v > w[0]
            case ">=":
                return v >= w[0]
            case "BETWEEN":
                return w[0] <= v <= w[1]
            case "IN":
                return v in w
        raise AssertionError(t)

    @staticmethod
    def found(text, search):
        import regex

        def runs(s):
            for m in regex.finditer(r"(?V1)([\p{Han}\p{Hiragana}\p{Katakana}ーｰ]+)|([[\p{Alphabetic}\p{Nd}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}ーｰ]]+)(\*?)", folded(s)):
                yield m[1], m[2], bool(m[3])

        terms = set()
        for run, word, _ in runs(text):
            terms |= {word[:64]} if word else {run[k : k + 2] for k in range(len(run))}
        wanted = list(runs(search))
        for run, word, star in wanted:
            needs = [(word[:64], star)] if word else [(run, True)] if len(run) == 1 else [(run[k : k + 2], False) for k in range(len(run) - 1)]
            if not all(any(t.startswith(w) for t in terms) if prefix else w in terms for w, prefix in needs):
                return False
        return bool(wanted)


def random_filter(rng, depth, collection="players"):
    pick = rng.random()
    if depth and pick < 0.45:
        parts = [random_filter(rng, depth - 1, collection) for _ in range(rng.randint(1, 3))]
        return rng.choice([ir.every, ir.some])(*parts) if pick < 0.3 else ir.Not(parts[0])
    if pick < 0.55:
        inner = rng.choice([None, random_filter(rng, max(0, depth - 1), "players")])
        return ir.Linked("players", ("friends",) if collection == "players" else ("team",), inner)
    paths = list(SCALARS) if collection == "players" else ["name", "city"]
    if collection == "players" and pick < 0.62:
        return ir.test(rng.choice(["bio", "lines"]), "MATCHES", rng.choice(SEARCHES))
    path = rng.choice(paths)
    pool = [x for x in (SCALARS[path] if collection == "players" else ["north", "Seoul", "x"]) if x is not None]
    strings = isinstance(pool[0], str) and path not in ("team",)
    ops = ["==", "!=", "<", "<=", ">", ">=", "IN", "BETWEEN", "IS NULL"] + (["STARTSWITH", "ENDSWITH", "CONTAINS"] if strings else []) + (["CONTAINS"] if path in ("friends", "seen", "tags") else [])
    op = rng.choice(ops)
    n = {"IN": rng.randint(0, 13), "BETWEEN": 2, "IS NULL": 0}.get(op, 1)
    fold = strings and op in ir.FOLDING and rng.random() < 0.3
    return ir.test(path, op, *(rng.choice(pool) for _ in range(n)), fold=fold)


@pytest.mark.parametrize("seed", range(4))
def test_random_queries_equal_the_rules(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng)
    model = Model(rows)
    frames = {"players": rows_of(spark, SCHEMA, SCHEMA.find("players"), rows).coalesce(2).cache(), "teams": rows_of(spark, SCHEMA, SCHEMA.find("teams"), TEAMS).coalesce(1).cache()}
    for _ in range(40):
        name = rng.choice(["players", "players", "players", "teams"])
        reader = Reader(SCHEMA, frames.__getitem__, name)
        e = random_filter(rng, 3, name)
        key = SCHEMA.find(name).key_name
        expected = sorted(k for k, r in model.rows[name].items() if model.holds(e, name, r))
        found = [r[0] for r in reader.find(where(e), ordered=False).select(key).collect()]
        assert sorted(found) == expected, e


def test_random_sorts_and_pages(spark):
    rng = random.Random(9)
    rows = random_rows(rng)
    model = Model(rows)
    frames = {"players": rows_of(spark, SCHEMA, SCHEMA.find("players"), rows).coalesce(2).cache(), "teams": rows_of(spark, SCHEMA, SCHEMA.find("teams"), TEAMS).coalesce(1).cache()}
    reader = Reader(SCHEMA, frames.__getitem__, "players")
    assert frames["players"].schema == struct_type(SCHEMA.find("players"), SCHEMA)
    for _ in range(25):
        sort = tuple(((*p.split("."),), rng.random() < 0.5) for p in rng.sample(["score", "rating", "handle", "team.city", "address.zip", "born", "note", "active"], rng.randint(0, 3)))
        q = ir.Query(random_filter(rng, 1), sort, rng.choice([0, 0, 3, 50]), rng.choice([None, 0, 5, 20]))
        expected = [r for r in rows if q.filter is None or model.holds(q.filter, "players", r)]
        for names, descending in reversed(sort):
            value = lambda r, names=names: model.values("players", r, names)[0]
            expected.sort(key=lambda r, value=value: (value(r) is not None, comparable(value(r)) if value(r) is not None else 0), reverse=descending)
        expected = [r["id"] for r in expected][q.offset :][: q.limit if q.limit is not None else None]
        assert [r.id for r in reader.find(q).collect()] == expected, q
        assert reader.count(q) == len(expected)
        scores = [model.rows["players"][k]["score"] for k in expected]
        assert reader.sum("score", q) == sum(scores) and reader.min("score", q) == min(scores, default=None)


def test_declared_classes(spark, tmp_path):
    from tesserae.database import Database

    @embedded
    class Address:
        city: str
        zip: int | None

    @collection("people", indexes=[Index.on("address.city")])
    class Person:
        name: str
        email: str | None = field(unique=True, name="mail")
        age: int = field(default=0, index=True)
        at: dt.datetime | None
        friends: list[Link["people"]] | None  # noqa: F821
        best: Link["people"] | None  # noqa: F821
        address: Address | None

    schema = schema_of(1, Person)
    c = schema.find("people")
    assert [f.name for f in c.fields] == ["name", "mail", "age", "at", "friends", "best", "address"] and c.auto and len(c.indexes) == 3
    db = Database.open(spark, str(tmp_path / "db"), schema)
    with db.write() as txn:
        txn.collection("people").insert_many([values_of(Person(name="Ada", email="a", address=Address(city="Seoul"))), values_of(Person(name="Bob", age=3, best=1, friends=[1]))])
    people = db.read().collection("people")
    (bob,) = objects(people.find('best.address.city == "Seoul"'), Person)
    assert (bob.id, bob.name, bob.age, bob.best, bob.friends, bob.email) == (2, "Bob", 3, 1, [1], None)


def test_stream_filters(spark, tmp_path):
    from tesserae.errors import EngineError
    from tesserae.streaming.filters import filtered

    rows = random_rows(random.Random(1))
    rows_of(spark, SCHEMA, SCHEMA.find("players"), rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(struct_type(SCHEMA.find("players"), SCHEMA)).parquet(str(tmp_path / "in"))
    q = filtered(stream, SCHEMA, "players", "NOT score >= $0", 2).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("found").count() == sum(r["score"] < 2 for r in rows)
    with pytest.raises(EngineError):
        filtered(stream, SCHEMA, "players", "SORT BY score")
