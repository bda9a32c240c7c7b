"""The rules of conditions, lists, links, order and aggregates on the golden dataset."""

import math
import struct

import pytest

from golden import PLAYERS, SCHEMA, TEAMS
from tesserae.builder import F, ignore_case, linked, tree_of, where
from tesserae.database import Database, prepare
from tesserae.errors import EngineError
from tesserae.plans import ir


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    db = Database.open(spark, str(tmp_path_factory.mktemp("golden") / "db"), SCHEMA)
    with db.write() as txn:
        txn.collection("teams").insert_many(TEAMS)
        assert txn.collection("players").insert_many(PLAYERS) == [1, 2, 3, 4]
    return db


@pytest.fixture(scope="module")
def players(db):
    return db.read().collection("players")


def ids(players, query, *values):
    found = [r.id for r in players.find(query, *values).collect()]
    assert players.count(query, *values) == len(found)
    tree = tree_of(query, values)
    assert repr(ir.from_dict(ir.to_dict(tree))) == repr(tree)
    return found


#: Queries and the keys they find, in order.
CASES = [
    (F.handle != "ace", [3]),
    (F.handle.is_null(), [2, 4]),
    (F.handle == None, [2, 4]),  # noqa: E711
    (~F.handle.is_null(), [1, 3]),
    ("handle != null", [1, 3]),
    (~(F.handle == "ace"), [2, 3, 4]),
    (~(F.handle != "ace"), [1, 2, 4]),
    (~(F.score < 3), [1, 3]),
    (~(F.rating < 1.0), [3, 4]),
    (F.tags == "red", [1]),
    (F.tags.contains("re"), []),
    (F.tags.starts_with("re"), [1]),
    ((F.tags >= "red") & (F.tags <= "blue"), [1]),
    (F.tags != "red", [1]),
    (~(F.tags == "red"), [2, 3, 4]),
    (F.tags.is_null(), [3, 4]),
    (~F.tags.is_null(), [1, 2]),
    (F.rating == 0.0, [1, 2]),
    (F.rating == math.nan, [3]),
    (F.rating > math.inf, [3]),
    (F.rating == 0, [1, 2]),
    (F.rating.is_in([0.0] + [float(k) for k in range(5, 20)]), [1, 2]),
    (F.rating.is_in([math.nan] + [float(k) for k in range(5, 20)]), [3]),
    ("rating < 1 AND rating >= 0", [1, 2]),
    ("score IN []", []),
    ("NOT score IN []", [1, 2, 3, 4]),
    ("score BETWEEN 1 AND 2", [2]),
    ("score BETWEEN 2 AND 1", []),
    (F.handle.starts_with("a"), [1, 3]),
    (F.handle.starts_with("a\0"), [3]),
    (F.handle < "ab", [3]),
    (F.handle.ends_with("b"), [3]),
    (F.handle.contains("c"), [1]),
    (F.team.city == "Seoul", [1]),
    (F.team.city.is_null(), [2, 3, 4]),
    (~(F.team.city == "Seoul"), [2, 3, 4]),
    (F.team == "gone", [2]),
    (F.friends.score == 3, [3]),
    (F.friends.score.is_null(), [1, 2, 3, 4]),
    (~F.friends.score.is_null(), []),
    (~(F.friends.score == 3), [1, 2, 4]),
    ((F.friends.score == 3) | (F.score == 1), [2, 3]),
    (F.friends.team.city == "Seoul", [3]),
    (F.friends == 9, [3]),
    (F.friends.contains(1), [3]),
    (F.address.city == "Busan", [2]),
    (F.address.city.is_null(), [1, 3, 4]),
    (F.active == False, [4]),  # noqa: E712
    (linked("players", "friends"), [1]),
    (~linked("players", "friends"), [2, 3, 4]),
    (linked("players", "friends", F.handle == "a\0b"), [1]),
    (linked("players", "friends", F.handle == "ace"), []),
    (linked("players", "friends", (F.score == 3) & (F.handle == "ace")), []),
    (linked("players", "friends") & (F.handle == "ace"), [1]),
    (linked("players", "friends") | (F.score == 0), [1, 4]),
    (~(linked("players", "friends") | (F.score == 0)), [2, 3]),
    (ir.every(), [1, 2, 3, 4]),
    (ir.some(), []),
    (F.handle == "ACE", []),
    (ignore_case(F.handle == "ACE"), [1]),
    (ignore_case(F.handle != "Ace"), [3]),
    (ignore_case(F.handle.is_in(["X", "aCe"])), [1]),
    (ignore_case(F.handle.contains("C")), [1]),
    (ignore_case(F.handle.starts_with("A")), [1, 3]),
    (ignore_case(F.handle.ends_with("CE")), [1]),
    (ignore_case(F.tags.contains("BLUE")), [1]),
    (ignore_case(F.tags.starts_with("Bl")), [1]),
    (ignore_case(F.team.city == "seoul"), [1]),
    (ignore_case(F.address.city == "BUSAN"), [2]),
    (ignore_case(((F.handle == "ACE") | (F.address.city == "busan")) & (F.score >= 1)), [1, 2]),
    (~ignore_case(F.handle == "ACE"), [2, 3, 4]),
    (ignore_case(F.handle == None), [2, 4]),  # noqa: E711
    ('handle == "ACE" IGNORE CASE', [1]),
    ('handle in ["x", "AcE"] ignore case', [1]),
    ('tags CONTAINS "RED" IGNORE CASE AND score > 0', [1]),
    (where().sort_by("handle"), [2, 4, 3, 1]),
    (where().sort_by(F.handle.desc()), [1, 3, 2, 4]),
    ("SORT BY score DESC", [1, 3, 2, 4]),
    ("SORT BY score DESC LIMIT 2 OFFSET 1", [3, 2]),
    ("SORT BY team.city DESC, id DESC", [1, 4, 3, 2]),
    (where().sort_by(F.score.desc()).first(), [1]),
    (where().limit(0).first(), []),
    (where().offset(9), []),
    (where().offset(1).limit(2), [2, 3]),
]


@pytest.mark.parametrize(("query", "expected"), CASES, ids=range(len(CASES)))
def test_conditions(players, query, expected):
    assert ids(players, query) == expected


def test_backlinks_of_teams(db):
    teams = db.read().collection("teams")
    names = lambda q, *v: [r.name for r in teams.find(q, *v).collect()]
    assert names(linked("players", "team")) == ["north"]
    assert names("ANY players.team (score >= 3)") == ["north"]
    assert names("NOT any players.team (score > $0)", 5) == ["north"]
    prepared = prepare("ANY players.team (score == $0)")
    assert names(prepared.bind(3)) == ["north"] and names(prepared.bind(2)) == []
    for broken in (prepared, "ANY players.score", "ANY nothing.team", "ANY players.friends", "ANY players.team (nothing == 1)"):
        with pytest.raises(EngineError) as e:
            teams.find(broken)
        assert e.value.code == "INVALID_QUERY"


BROKEN = [
    F.score == "three", F.score == 3.5, F.rating == 1 << 60, F.missing == 1, F.address == 1, F.handle > None, F.score.starts_with("1"), F.score.value == 1,
    F.tags == ["red"], where().sort_by("tags"), where().sort_by("friends.score"), ir.Test(("friends",) * 33, "IS NULL"), F.score == True, F.note == "x", F.born == 1,
    F.score.matches("1"), F.team.matches("north"), "bio MATCHES 1", "bio MATCHES null", 'bio MATCHES "x" IGNORE CASE', "score == $0", 'score == 1 IGNORE CASE',
    F.bio.contains(1), F.team == 1,
]


@pytest.mark.parametrize("query", BROKEN, ids=range(len(BROKEN)))
def test_refusals(players, query):
    for run in (players.find, players.count):
        with pytest.raises(EngineError) as e:
            run(query)
        assert e.value.code == "INVALID_QUERY"


def test_depth_is_bounded(players):
    def nested(n):
        e = F.score == 1
        for _ in range(n - 1):
            e = ~e
        return e

    assert players.count(nested(24)) == 3
    with pytest.raises(EngineError):
        players.find(nested(25))


def bits(x):
    return struct.pack("<d", x)


def test_aggregates(players):
    assert [players.sum("score"), players.min("score"), players.max("score"), players.avg("score")] == [7, 0, 3, 1.75]
    assert math.isnan(players.sum("rating")) and math.isnan(players.max("rating")) and bits(players.min("rating")) == bits(0.0)
    assert players.sum("rating", F.rating < 1.0) == 0.0 and players.avg("rating", F.rating < 1.0) == 0.0
    assert (players.min("handle"), players.max("handle")) == ("a\0b", "ace")
    assert players.min("team.city") == "Seoul" and players.max("address.city") == "Busan"
    assert [players.min("score", "score >= 1"), players.sum("score", "score >= 1")] == [1, 7]
    none = F.score > 10
    assert players.sum("score", none) == 0 and players.sum("rating", none) == 0.0
    assert players.avg("score", none) is players.min("handle", none) is players.max("score", none) is None
    assert players.sum("score", "SORT BY score DESC LIMIT 2") == 6
    assert players.sum("score", "SORT BY score DESC LIMIT 2 OFFSET 1") == 4
    assert players.min("score", "SORT BY score DESC LIMIT 2") == 3 and players.max("score", "SORT BY score DESC OFFSET 3") == 0
    for function, path in [("sum", "handle"), ("avg", "note"), ("sum", "tags"), ("min", "tags"), ("max", "friends.score"), ("sum", "team"), ("min", "active"), ("max", "address"), ("min", "nothing")]:
        with pytest.raises(EngineError) as e:
            players.aggregate(function, path)
        assert e.value.code == "INVALID_QUERY"


def test_lookups(players):
    assert players.get(1)["handle"] == "ace" and players.get(9) is None
    assert [(r.position, r.id) for r in players.get_many([3, 9, 1, 3]).collect()] == [(0, 3), (1, None), (2, 1), (3, 3)]
    assert [r.id for r in players.range(2, 3, descending=True).collect()] == [3, 2]
    assert len(players) == 4 and not players.is_empty() and [o["id"] for o in players.iter()] == [1, 2, 3, 4]
    assert players.find_one("score == 3 SORT BY handle")["id"] == 3 and players.find_one("score == 9") is None


def test_pushdown(players, capsys):
    for query, pushed in (("score == 3", "EqualTo(score,3)"), ("NOT score == 3", "Not(EqualNullSafe(score,3))"), ("NOT score < 3", "Or(IsNull(score),GreaterThanOrEqual(score,3))"), ('handle STARTSWITH "a"', "StringStartsWith(handle,a)")):
        players.find(query, ordered=False).explain("formatted")
        plan = capsys.readouterr().out
        assert pushed in plan and "Python" not in plan
