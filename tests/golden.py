"""The small linked dataset that the rules are tested on."""

import math

from tesserae.model import Bool, Bytes, Collection, DateType, Embedded, Field, Float, Index, Int, Link, List, Schema, String

SCHEMA = Schema.of(
    1,
    Collection.of("teams", Field("name", String), Field("city", String, optional=True), key="name", indexes=(Index.on("city"), Index.on("city", text=True))),
    Collection.of(
        "players",
        Field("score", Int, default=0),
        Field("rating", Float, optional=True),
        Field("handle", String, optional=True),
        Field("tags", List(String), optional=True),
        Field("team", Link("teams"), optional=True),
        Field("friends", List(Link("players")), optional=True),
        Field("active", Bool, default=True),
        Field("address", Embedded(Field("city", String, optional=True), Field("zip", Int, optional=True)), optional=True),
        Field("note", Bytes, optional=True),
        Field("born", DateType, optional=True),
        Field("seen", List(DateType), optional=True),
        Field("visits", List(Embedded(Field("city", String), Field("n", Int, optional=True))), optional=True),
        Field("bio", String, optional=True),
        Field("lines", List(String), optional=True),
        Field("motto", String, optional=True),
        indexes=(Index.on("score"), Index.on("handle", unique=True), Index.on("visits.city"), Index.on("bio", text=True)),
    ),
)

#: The rows that the rules' expected results belong to.
TEAMS = [{"name": "north", "city": "Seoul"}]
PLAYERS = [
    {"score": 3, "rating": 0.0, "handle": "ace", "tags": ["red", "blue"], "team": "north"},
    {"score": 1, "rating": -0.0, "tags": [], "team": "gone", "address": {"city": "Busan"}},
    {"score": 3, "rating": math.nan, "handle": "a\0b", "friends": [1, 9]},
    {"active": False},
]
