"""The reference's operators, each applied to whole benchmark tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tools
from .builder import F as f
from .builder import ignore_case
from .database import Database, Reader, prepare
from .errors import EngineError
from .migrate import Migration
from .model import Collection, Embedded, Field, Float, Index, Int, Link, List, Schema, String
from .operators.textindex import index_terms, search
from .sources.adapter import Tables
from .sources.trees import TREES, Trees
from .sources.workspace import shared_dir

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}
#: The tables that a table's links lead to, for queries that follow them.
NEAR = {"orders": ("orders", "customer", "nation", "region"), "customer": ("customer", "nation", "region"), "lineitem": ("lineitem", "orders", "customer", "nation", "region", "part", "supplier"), "supplier": ("supplier", "nation", "region"), "nation": ("nation", "region"), "documents": ("documents", "labels")}


def reader(spark: SparkSession, sf_dir: str, name: str, *more: str) -> Reader:
    tables = Tables(spark, sf_dir, tuple(dict.fromkeys((*NEAR.get(name, (name,)), *more))))
    return Reader(tables.schema, tables.frame, name)


def found(name: str, collection: str, query: object, columns: str, where: str, *more: str, source: str | None = None) -> None:
    """Register a query that finds objects, and its SQL: the columns of the table (or source) with the condition."""
    picked = columns.split(", ")
    QUERIES[name] = lambda spark, d: reader(spark, d, collection, *more).find(query, ordered=False).select(*picked)
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c.endswith(("key", "_size", "label")) else c for c in picked)
    SQL[name] = f"SELECT {casts} FROM {source or collection} WHERE {where}"


def ranked(name: str, collection: str, query: str, columns: str, order: str, tail: str, where: str = "TRUE") -> None:
    """A sorted page, with each row's place in it."""
    picked = columns.split(", ")

    def run(spark: SparkSession, d: str) -> DataFrame:
        page = reader(spark, d, collection).find(query)
        # The page is cut by then: the window sorts no more rows than it has.
        keys = [F.expr(k.rsplit(" ", 1)[0]).desc() if k.endswith(" DESC") else F.expr(k).asc() for k in order.split(", ")]
        return page.select(*picked, F.row_number().over(Window.orderBy(*keys)).cast("long").alias("place"))

    QUERIES[name] = run
    over = ", ".join(k + (" NULLS LAST" if k.endswith("DESC") else " NULLS FIRST") for k in order.split(", "))
    SQL[name] = f"SELECT {', '.join(picked)}, row_number() OVER (ORDER BY {over}) AS place FROM (SELECT * FROM {collection} WHERE {where} ORDER BY {over} {tail})"


def scalar(name: str, run: Callable[[SparkSession, str], object], kind: str, sql: str) -> None:
    """A query of one value."""
    QUERIES[name] = lambda spark, d: spark.createDataFrame([(run(spark, d),)], f"value {kind}")
    SQL[name] = sql


found("s1_scan", "orders", None, "o_orderkey, o_custkey, o_orderstatus, o_totalprice", "TRUE")
found("s2_get", "orders", "o_orderkey == 42", "o_orderkey, o_custkey, o_totalprice", "o_orderkey = 42")
found("s5_key_range", "orders", "o_orderkey BETWEEN 100 AND 199", "o_orderkey, o_orderstatus", "o_orderkey BETWEEN 100 AND 199")
found("f1_eq", "customer", 'c_mktsegment == "BUILDING"', "c_custkey, c_name", "c_mktsegment = 'BUILDING'")
found("f2_ne", "customer", 'c_mktsegment != "BUILDING"', "c_custkey, c_name", "c_mktsegment <> 'BUILDING'")
found("f3_lt", "orders", "o_totalprice < 50000", "o_orderkey, o_totalprice", "o_totalprice < 50000")
found("f4_le", "part", "p_size <= 5", "p_partkey, p_size", "p_size <= 5")
found("f5_gt", "part", "p_size > 45", "p_partkey, p_size", "p_size > 45")
found("f6_ge", "customer", "c_acctbal >= 9000.0", "c_custkey, c_acctbal", "c_acctbal >= 9000")
found("f7_between", "lineitem", "l_quantity BETWEEN 10 AND 12", "l_orderkey, l_partkey, l_quantity, l_extendedprice", "l_quantity BETWEEN 10 AND 12")
found("f7_dates", "orders", 'o_orderdate >= DATE "1997-01-01" AND o_orderdate < DATE "1997-02-01"', "o_orderkey, o_orderdate", "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'")
found("f8_in", "orders", 'o_orderpriority IN ["1-URGENT", "2-HIGH"]', "o_orderkey, o_orderpriority", "o_orderpriority IN ('1-URGENT', '2-HIGH')")
found("f9_contains", "part", 'p_name CONTAINS "ring"', "p_partkey, p_name", "contains(p_name, 'ring')")
found("f10_list_contains", "embeddings", f.embedding.contains(0.5) | (f.label == 3), "vec_id, label", "list_contains(embedding, 0.5) OR label = 3")
found("f11_starts", "part", 'p_name STARTSWITH "small"', "p_partkey, p_name", "starts_with(p_name, 'small')")
found("f12_ends", "part", 'p_name ENDSWITH "ring"', "p_partkey, p_name", "ends_with(p_name, 'ring')")
found("f14_not_null", "region", "r_name IS NOT NULL", "r_regionkey, r_name", "r_name IS NOT NULL")
found("f15_eq_fold", "part", 'p_name == "SMALL Ring" IGNORE CASE', "p_partkey, p_name", "lower(p_name) = 'small ring'")
found("f16_ne_fold", "customer", 'c_mktsegment != "building" IGNORE CASE', "c_custkey, c_mktsegment", "lower(c_mktsegment) <> 'building'")
found("f17_in_fold", "customer", 'c_mktsegment IN ["building", "machinery"] IGNORE CASE', "c_custkey, c_mktsegment", "lower(c_mktsegment) IN ('building', 'machinery')")
found("f18_contains_fold", "part", 'p_name CONTAINS "RING" IGNORE CASE', "p_partkey, p_name", "contains(lower(p_name), 'ring')")
found("f20_starts_fold", "part", 'p_name STARTSWITH "SMALL" IGNORE CASE', "p_partkey, p_name", "starts_with(lower(p_name), 'small')")
found("f21_ends_fold", "part", 'p_name ENDSWITH "RING" IGNORE CASE', "p_partkey, p_name", "ends_with(lower(p_name), 'ring')")
TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}\p{M}]+')"
found("f22_matches", "documents", 'text MATCHES "the and"', "doc_id", f"list_has_all({TERMS}, ['the', 'and'])")
found("f22_prefix", "documents", 'text MATCHES "ein*"', "doc_id", f"len(list_filter({TERMS}, lambda x: starts_with(x, 'ein'))) > 0")
found("f23_and", "orders", 'o_orderstatus == "F" AND o_totalprice >= 100000.0 AND o_custkey < 500', "o_orderkey", "o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_custkey < 500")
found("f24_or", "orders", 'o_orderstatus == "P" OR o_totalprice > 400000.0', "o_orderkey", "o_orderstatus = 'P' OR o_totalprice > 400000")
found("f25_not", "customer", 'NOT c_nationkey.n_regionkey.r_name == "ASIA"', "c_custkey", "NOT coalesce((SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey) = 'ASIA', FALSE)")
ANY = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)"
found("f26_any", "orders", "ANY lineitem.l_orderkey (l_quantity >= 49)", "o_orderkey", ANY, "lineitem", "part", "supplier")
found("f26_any_or", "orders", "ANY lineitem.l_orderkey (l_quantity >= 49) OR o_totalprice < 2000.0", "o_orderkey", f"{ANY} OR o_totalprice < 2000", "lineitem", "part", "supplier")
found("f27_not_any", "orders", "NOT ANY lineitem.l_orderkey", "o_orderkey", "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "lineitem", "part", "supplier")
found("f27_unlabelled", "documents", "NOT ANY labels.doc", "doc_id, lang", "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
found("f29_link", "orders", 'o_custkey.c_mktsegment == "BUILDING"', "o_orderkey", "(SELECT c_mktsegment FROM customer WHERE c_custkey = o_custkey) = 'BUILDING'")
found("f30_list", "embeddings", "embedding > 0.3", "vec_id", "len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.3)) > 0")
found("f30_not_list", "embeddings", "NOT embedding > 0.3", "vec_id", "NOT len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.3)) > 0")
found("f31_link_key", "orders", "o_custkey == 7", "o_orderkey, o_custkey", "o_custkey = 7")
found("f32_ignore_case", "part", ignore_case((f.p_name == "SMALL RING") | f.p_brand.ends_with("#1") & (f.p_size > 10)), "p_partkey", "lower(p_name) = 'small ring' OR ends_with(lower(p_brand), '#1') AND p_size > 10")
found("f33_prepared", "part", prepare("p_size BETWEEN $0 AND $1 AND p_type CONTAINS $2").bind(10, 12, "PROMO"), "p_partkey, p_size", "p_size BETWEEN 10 AND 12 AND contains(p_type, 'PROMO')")
found("f_events", "events", 'event_type == "purchase" AND value >= 200 AND ts >= DATE "2024-01-10"', "event_id, value", "event_type = 'purchase' AND value >= 200 AND ts >= TIMESTAMP '2024-01-10'")
ASIA = "o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"
found("j1_one_link", "lineitem", 'l_orderkey.o_orderpriority == "1-URGENT" AND l_quantity > 45', "l_orderkey, l_quantity", "l_quantity > 45 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
found("j2_three_links", "orders", 'o_custkey.c_nationkey.n_regionkey.r_name == "ASIA"', "o_orderkey", ASIA)
ranked("o1_sort", "nation", "SORT BY n_regionkey DESC, n_name", "n_name", "n_regionkey DESC, n_name, n_nationkey", "")
ranked("o3_topk", "orders", "SORT BY o_totalprice DESC LIMIT 10", "o_totalprice", "o_totalprice DESC, o_orderkey", "LIMIT 10")
ranked("o4_page", "orders", "SORT BY o_orderdate LIMIT 50 OFFSET 1000", "o_orderdate", "o_orderdate, o_orderkey", "LIMIT 50 OFFSET 1000")
ranked("o5_flagship", "orders", 'o_custkey.c_nationkey.n_regionkey.r_name == "ASIA" AND o_totalprice >= 100000.0 SORT BY o_totalprice DESC LIMIT 20', "o_totalprice", "o_totalprice DESC, o_orderkey", "LIMIT 20", f"{ASIA} AND o_totalprice >= 100000")
ranked("o6_first", "customer", "SORT BY c_acctbal LIMIT 1", "c_name, c_acctbal", "c_acctbal, c_custkey", "LIMIT 1")
scalar("s7_len", lambda s, d: len(reader(s, d, "orders")), "long", "SELECT count(*) AS value FROM orders")
scalar("a1_count", lambda s, d: reader(s, d, "orders").count('o_orderstatus == "F" LIMIT 5000 OFFSET 100'), "long", "SELECT least(greatest(count(*) - 100, 0), 5000) AS value FROM orders WHERE o_orderstatus = 'F'")
scalar("a2_sum_int", lambda s, d: reader(s, d, "part").sum("p_size", 'p_type CONTAINS "PROMO"'), "long", "SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS value FROM part WHERE contains(p_type, 'PROMO')")
scalar("a3_sum_float", lambda s, d: reader(s, d, "lineitem").sum("l_extendedprice"), "double", "SELECT fsum(l_extendedprice) AS value FROM lineitem")
scalar("a4_min", lambda s, d: reader(s, d, "orders").min("o_totalprice", 'o_orderstatus == "O"'), "double", "SELECT min(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'O'")
scalar("a5_max", lambda s, d: reader(s, d, "part").max("p_name"), "string", "SELECT max(p_name) AS value FROM part")
scalar("a6_avg", lambda s, d: reader(s, d, "part").avg("p_size"), "double", "SELECT sum(p_size) / count(*) AS value FROM part")
scalar("a7_through_link", lambda s, d: reader(s, d, "orders").max("o_custkey.c_acctbal"), "double", "SELECT max(c_acctbal) AS value FROM orders JOIN customer ON o_custkey = c_custkey")
scalar("a8_agg_page", lambda s, d: reader(s, d, "part").sum("p_size", "SORT BY p_retailprice DESC LIMIT 100 OFFSET 10"), "long", "SELECT CAST(sum(p_size) AS BIGINT) AS value FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100 OFFSET 10)")


def registered(sql: str | None) -> Callable[[Run], Run]:
    def keep(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return keep


@registered("SELECT k.position, p.p_name FROM (VALUES (0, 7), (1, -1), (2, 3), (3, 7)) k(position, key) LEFT JOIN part p ON p_partkey = key")
def s3_get_many(spark: SparkSession, d: str) -> DataFrame:
    return reader(spark, d, "part").get_many([7, -1, 3, 7]).select(F.col("position").cast("int").alias("position"), "p_name")


@registered(f"SELECT doc_id FROM documents WHERE list_has_all({TERMS}, ['the', 'of'])")
def r20_text_index(spark: SparkSession, d: str) -> DataFrame:
    docs = reader(spark, d, "documents")
    return search(index_terms(docs.frame(), docs.schema, docs.collection, "text"), "of THE").select(F.col("key").alias("doc_id"))


SHOP = Schema.of(
    1,
    Collection.of("customer", Field("c_custkey", Int), Field("c_name", String), Field("c_acctbal", Float, default=0.0), Field("c_mktsegment", String, optional=True), key="c_custkey", indexes=(Index.on("c_name", unique=True),)),
    Collection.of("orders", Field("o_orderkey", Int), Field("o_custkey", Link("customer"), cascade=True), Field("o_totalprice", Float), Field("o_orderstatus", String, optional=True), key="o_orderkey"),
    Collection.of("lines", Field("l_orderkey", Link("orders"), cascade=True), Field("l_quantity", Float)),
    TREES,
)


def shop(spark: SparkSession, d: str, *names: str) -> Database:
    """A new database with the tables' rows."""
    db = Database.open(spark, f"{shared_dir(spark)}/shop-{uuid.uuid4().hex}", SHOP)
    with db.write() as txn:
        for n in names:
            table = Tables(spark, d, ({"lines": "lineitem"}.get(n, n), *(() if n == "lines" else NEAR[n][1:])))
            columns = [f.name for f in SHOP.find(n).fields]
            txn.collection(n).insert_many(table.raw[{"lines": "lineitem"}.get(n, n)].select(*columns))
    return db


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal FROM customer UNION ALL VALUES (CAST(-1 AS BIGINT), 'new', CAST(0 AS DOUBLE))")
def w1_insert(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    with db.write() as txn:
        txn.collection("customer").insert({"c_custkey": -1, "c_name": "new"})
    return db.read().frame("customer").select("c_custkey", "c_name", "c_acctbal")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'put ' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def w2_put(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    with db.write() as txn:
        w = txn.collection("customer")
        w.put_many(w.frame().where("c_custkey % 10 = 0").selectExpr("c_custkey", "concat('put ', c_custkey) as c_name"))
    return db.read().frame("customer").select("c_custkey", "c_name", "c_acctbal")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey = 5 THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer")
def w3_update(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    with db.write() as txn:
        txn.collection("customer").update(5, {"c_acctbal": 1.5})
    return db.read().frame("customer").select("c_custkey", "c_acctbal")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_custkey <> 5")
def w4_delete(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    with db.write() as txn:
        txn.collection("customer").delete(5)
    return db.read().frame("customer").select("c_custkey")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def w5_update_where(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    update_in_debt(db)
    return db.read().frame("customer").select("c_custkey", "c_mktsegment")


@registered("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE NOT o_totalprice < 100000")
def w6_delete_where(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer", "orders")
    with db.write() as txn:
        txn.collection("orders").delete_where("o_totalprice < 100000")
    return db.read().frame("orders").select("o_orderkey")


def update_in_debt(db: Database) -> None:
    with db.write() as txn:
        txn.collection("customer").update_where('c_mktsegment == "BUILDING" AND c_acctbal < 0', {"c_mktsegment": "debt"})


def delete_poor(db: Database) -> None:
    with db.write() as txn:
        txn.collection("customer").delete_where("c_acctbal < 1000.0")


#: Changes of databases with these collections, for timing them without loading.
CHANGES = {"w5_update_where": (("customer",), update_in_debt), "w7_cascade": (("customer", "orders", "lines"), delete_poor)}


@registered("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 1000)")
def w7_cascade(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer", "orders", "lines")
    delete_poor(db)
    return db.read().frame("lines").select("l_orderkey", "l_quantity")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 'DUPLICATE_KEY' AS code FROM customer WHERE c_custkey < 3 UNION ALL SELECT -1 - count(*), 'OK' FROM customer")
def w9_unique(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of new objects with a taken name, and of one with a free name."""
    db = shop(spark, d, "customer")
    codes = []
    with db.write() as txn:
        w = txn.collection("customer")
        taken = [(o["c_custkey"], {"c_custkey": -1 - o["c_custkey"], "c_name": o["c_name"]}) for o in map(w.get, range(3))]
        free = -1 - len(w)
        for key, obj in [*taken, (free, {"c_custkey": free, "c_name": "free"})]:
            try:
                w.insert(obj)
                codes.append((key, "OK"))
            except EngineError as e:
                codes.append((key, e.code))
    return spark.createDataFrame(codes, "c_custkey long, code string")


@registered("SELECT count(*) AS inside, 0 AS after FROM customer WHERE c_acctbal > 0")
def w10_transaction(spark: SparkSession, d: str) -> DataFrame:
    """What a transaction sees of its own deletes, and what is left of them after an abort."""
    db = shop(spark, d, "customer")
    before = db.read().collection("customer").count()
    with db.write() as txn:
        w = txn.collection("customer")
        w.delete_where("c_acctbal <= 0.0")
        inside = w.count()
        txn.abort()
    return spark.createDataFrame([(inside, before - db.read().collection("customer").count())], "inside long, after int")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name AS full_name, 4 AS stars FROM customer")
def m2_migrate(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    new = Schema.of(2, Collection.of("clients", Field("c_custkey", Int), Field("full_name", String), Field("c_acctbal", Float, default=0.0), Field("c_mktsegment", String, optional=True), Field("stars", Int, default=4), key="c_custkey"), TREES)
    step = Migration(2, {"customer": "clients"}, {("clients", "c_name"): "full_name"}, deleted=("lines", "orders"))
    return Database.open(spark, db.store.root, new, [step]).read().frame("clients").select("c_custkey", "full_name", F.col("stars").cast("int").alias("stars"))


@registered("SELECT 'customer' AS collection, 'repeated_key' AS kind, count(*) AS number FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'customer', 'repeated_value', count(*) FROM customer WHERE c_custkey % 7 = 0")
def t1_check(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    with db.write() as txn:
        txn.append("customer", txn.frame("customer").where("c_custkey % 7 = 0"))
    return spark.createDataFrame([(p.collection, p.kind, p.count) for p in tools.check(db)], "collection string, kind string, number long")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_acctbal FROM customer")
def t2_backup(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    tools.backup(db, f"{db.store.root}-copy")
    return Database.open(spark, f"{db.store.root}-copy").read().frame("customer").select("c_custkey", "c_acctbal")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 2.5 * CAST(1 AS DOUBLE) AS c_acctbal FROM customer")
def t3_compact(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    with db.write() as txn:
        txn.collection("customer").update_where(None, {"c_acctbal": 2.5})
    tools.compact(db)
    return db.read().frame("customer").select("c_custkey", "c_acctbal")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_acctbal FROM customer")
def t4_salvage(spark: SparkSession, d: str) -> DataFrame:
    """A database one of whose folders is gone."""
    db = shop(spark, d, "customer")
    with db.write() as txn:
        txn.collection("customer").insert({"c_custkey": -1, "c_name": "lost"})
    db.store.fs.delete(db.store.path(db.store.latest().tables["customer"][-1]), True)
    tools.salvage(spark, db.store.root, f"{db.store.root}-saved")
    return Database.open(spark, f"{db.store.root}-saved").read().frame("customer").select("c_custkey", "c_acctbal")


@registered("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE n_name >= 'NATION_1' AND n_name < 'NATION_3'")
def s9_trees(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d)
    nations = reader(spark, d, "nation")
    with db.write() as txn:
        trees = Trees(txn)
        trees.insert_many("names", {o["n_name"].encode(): str(o["n_nationkey"]).encode() for o in nations.iter()})
        trees.insert("other", b"D", b"x")
    return Trees(db.read()).range("names", b"NATION_1", b"NATION_3").select(F.col("key").cast("string").alias("name"), F.col("value").cast("string").alias("value"))


ARCHIVE = Schema.of(1, Collection.of("articles", Field("doc_id", Int), Field("text", String, optional=True), Field("n_chars", Int), key="doc_id", indexes=(Index.on("text", text=True), Index.on("n_chars"))))


def archive(spark: SparkSession, d: str) -> Reader:
    """The documents as a collection with stored indexes of their words and lengths, and some rows that came later."""
    db = Database.open(spark, f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}", ARCHIVE)
    rows = Tables(spark, d, ("documents",)).raw["documents"].select("doc_id", "text", "n_chars")
    with db.write() as txn:
        txn.append("articles", rows.where("doc_id % 10 <> 0").selectExpr("doc_id", "text", "cast(n_chars as bigint) as n_chars"))
    tools.index(db)
    with db.write() as txn:
        txn.append("articles", rows.where("doc_id % 10 = 0").selectExpr("doc_id", "text", "cast(n_chars as bigint) as n_chars"))
    return db.read().collection("articles")


@registered(f"SELECT doc_id FROM documents WHERE list_has_all({TERMS}, ['the', 'and'])")
def f22_indexed(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).find('text MATCHES "the and"', ordered=False).select("doc_id")


@registered("SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars FROM documents WHERE n_chars BETWEEN 100 AND 400")
def s6_index_scan(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).find("n_chars BETWEEN 100 AND 400", ordered=False).select("doc_id", "n_chars")


def derived(spark: SparkSession, d: str, name: str) -> Reader:
    """Collections with what plain tables lack: embedded objects, lists of strings, embedded objects and links, self-links."""
    raw = Tables(spark, d, ("documents", "orders", "lineitem", "part", "nation", "customer", "region", "supplier")).raw
    frames = {
        "articles": lambda: raw["documents"].selectExpr("doc_id", "struct(lang, source) as meta", "array(lang, source) as tags", "array(struct(lang as word, cast(n_chars as bigint) as n), struct(source as word, nullif(cast(n_chars % 3 as bigint), 0) as n)) as marks", "nullif(lang, 'en') as foreign_lang"),
        "parts": lambda: raw["part"].selectExpr("cast(p_partkey as bigint) as p_partkey", "p_name", "cast(p_size as bigint) as p_size"),
        "baskets": lambda: raw["lineitem"].groupBy(F.col("l_orderkey").cast("long").alias("o_orderkey")).agg(F.array_distinct(F.collect_list(F.col("l_partkey").cast("long"))).alias("parts")),
        "nations": lambda: raw["nation"].selectExpr("cast(n_nationkey as bigint) as n_nationkey", "n_name", "cast((n_nationkey + 1) % 25 as bigint) as neighbour"),
    }
    schema = Schema.of(
        1,
        Collection.of("articles", Field("doc_id", Int), Field("meta", Embedded(Field("lang", String), Field("source", String)), optional=True), Field("tags", List(String), optional=True), Field("marks", List(Embedded(Field("word", String), Field("n", Int, optional=True))), optional=True), Field("foreign_lang", String, optional=True), key="doc_id"),
        Collection.of("parts", Field("p_partkey", Int), Field("p_name", String), Field("p_size", Int), key="p_partkey"),
        Collection.of("baskets", Field("o_orderkey", Int), Field("parts", List(Link("parts")), optional=True), key="o_orderkey"),
        Collection.of("nations", Field("n_nationkey", Int), Field("n_name", String), Field("neighbour", Link("nations"), optional=True), key="n_nationkey"),
    )
    return Reader(schema, lambda n: frames[n](), name)


def derived_query(name: str, collection: str, query: object, column: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: derived(spark, d, collection).find(query, ordered=False).select(column)
    SQL[name] = sql


derived_query("f19_list_fold", "articles", 'tags CONTAINS "SRC3" IGNORE CASE', "doc_id", "SELECT doc_id FROM documents WHERE lower(source) = 'src3' OR lower(lang) = 'src3'")
derived_query("f28_embedded", "articles", 'meta.lang == "de" AND NOT meta.source STARTSWITH "src1"', "doc_id", "SELECT doc_id FROM documents WHERE lang = 'de' AND NOT starts_with(source, 'src1')")
derived_query("f30_embedded_list", "articles", 'marks.n > 5000 OR marks.word == "src7"', "doc_id", "SELECT doc_id FROM documents WHERE n_chars > 5000 OR source = 'src7' OR lang = 'src7'")
derived_query("f30_null_in_list", "articles", "marks.n IS NULL", "doc_id", "SELECT doc_id FROM documents WHERE n_chars % 3 = 0")
derived_query("f13_is_null", "articles", "foreign_lang IS NULL", "doc_id", "SELECT doc_id FROM documents WHERE lang = 'en'")
BASKETS = "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS o_orderkey FROM lineitem"
derived_query("j6_to_many", "baskets", "parts.p_size == 50", "o_orderkey", f"{BASKETS} JOIN part ON p_partkey = l_partkey WHERE p_size = 50")
derived_query("j6_to_many_not", "baskets", 'NOT parts.p_name STARTSWITH "small"', "o_orderkey", f"{BASKETS} WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE starts_with(p_name, 'small'))")
derived_query("j4_backlink_list", "parts", "ANY baskets.parts (o_orderkey < 100)", "p_partkey", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey < 100)")
derived_query("j7_self_link", "nations", "neighbour.neighbour.n_nationkey < 5", "n_nationkey", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE (n_nationkey + 2) % 25 < 5")
derived_query("j5_self_anti", "nations", "NOT ANY nations.neighbour (n_nationkey >= 10)", "n_nationkey", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE (n_nationkey + 24) % 25 < 10")
found("s4_point", "customer", "c_custkey == 77", "c_custkey, c_name", "c_custkey = 77")
found("s6_ranges", "part", "(p_size >= 48 OR p_size < 3) AND p_retailprice > 905", "p_partkey, p_size", "(p_size >= 48 OR p_size < 3) AND p_retailprice > 905")
found("j3_key_set", "orders", 'o_custkey.c_name IN ["Customer#000000007", "Customer#000000010"] OR o_custkey IN [1, 4]', "o_orderkey, o_custkey", "o_custkey IN (1, 4) OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_name IN ('Customer#000000007', 'Customer#000000010'))")
found("j8_two_sets", "lineitem", "l_partkey.p_size > 40 AND l_suppkey.s_acctbal > 5000.0", "l_orderkey, l_partkey", "l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
ranked("o2_key_order", "customer", "LIMIT 20 OFFSET 5", "c_name", "c_custkey", "LIMIT 20 OFFSET 5")
ranked("o7_reverse", "part", "SORT BY p_size DESC LIMIT 40", "p_name, p_retailprice", "p_size DESC, p_partkey", "LIMIT 40")
scalar("a9_one_column", lambda s, d: reader(s, d, "lineitem").avg("l_quantity"), "double", "SELECT fsum(l_quantity) / count(*) AS value FROM lineitem")


@registered("SELECT count(*) AS value FROM orders WHERE o_orderstatus = 'F'")
def s8_visit(spark: SparkSession, d: str) -> DataFrame:
    """Rows visited where they are, counted with an accumulator."""
    seen = spark.sparkContext.accumulator(0)
    reader(spark, d, "orders").visit(lambda rows: [seen.add(1) for _ in rows] and None, 'o_orderstatus == "F"')
    return spark.createDataFrame([(seen.value,)], "value long")


@registered("SELECT 'first' AS reader, CAST(2 AS BIGINT) AS number, c_acctbal FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'later', 3, c_acctbal + 0.5 FROM customer WHERE c_custkey = 1")
def s10_commits(spark: SparkSession, d: str) -> DataFrame:
    """A reader keeps its commit while another comes; what each sees of a customer."""
    db = shop(spark, d, "customer")
    first = db.read()
    with db.write() as txn:
        w = txn.collection("customer")
        w.update(1, {"c_acctbal": w.get(1)["c_acctbal"] + 0.5})
    rows = [(n, t.commit.number, t.collection("customer").get(1)["c_acctbal"]) for n, t in (("first", first), ("later", db.read()))]
    return spark.createDataFrame(rows, "reader string, number long, c_acctbal double")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey < 10 THEN 'x' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def w8_typed_change(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    with db.write() as txn:
        txn.collection("customer").change(query=f.c_custkey < 10, c_mktsegment="x")
    return db.read().frame("customer").select("c_custkey", "c_mktsegment")


@registered("SELECT 'declared' AS declared, 'SCHEMA_MISMATCH' AS outcome, CAST(NULL AS BIGINT) AS number UNION ALL SELECT 'older', 'SCHEMA_TOO_NEW', NULL UNION ALL SELECT 'same', 'OPEN', count(*) FROM customer")
def m1_resolve(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of opening with a schema of the same version, an older one and the stored one, and how many customers are seen."""
    root = shop(spark, d, "customer").store.root
    two = Schema.of(2, *SHOP.collections)
    Database.open(spark, root, two)
    rows = []
    for name, schema in (("declared", Schema.of(2, *SHOP.collections[:-1])), ("older", SHOP), ("same", two)):
        try:
            rows.append((name, "OPEN", Database.open(spark, root, schema).read().collection("customer").count()))
        except EngineError as e:
            rows.append((name, e.code, None))
    return spark.createDataFrame(rows, "declared string, outcome string, number long")


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE c_name END AS c_name FROM customer")
def m3_migration_function(spark: SparkSession, d: str) -> DataFrame:
    db = shop(spark, d, "customer")
    old = SHOP.find("customer")

    def mark(before, now):
        assert before.schema.version == 1
        now.collection("customer").update_where("c_acctbal < 0.0", {"c_name": "debtor"})

    new = Schema.of(2, Collection.of("customer", *old.fields, key=old.key), *SHOP.collections[1:])
    return Database.open(spark, db.store.root, new, [Migration(2, run=mark)]).read().frame("customer").select("c_custkey", "c_name")


@registered("SELECT 'BUSY' AS code, count(*) AS number, CAST(min(c_custkey) AS BIGINT) AS least FROM customer WHERE c_custkey <> 2")
def t6_conflict(spark: SparkSession, d: str) -> DataFrame:
    """The code that the later of two writers gets, and the customers that are left: those of the first writer."""
    db = shop(spark, d, "customer")
    code = "none"
    try:
        with db.write() as txn:
            txn.collection("customer").delete(0)
            with db.write() as other:
                other.collection("customer").delete(2)
    except EngineError as e:
        code = e.code
    now = db.read().collection("customer")
    return spark.createDataFrame([(code, now.count(), now.min("c_custkey"))], "code string, number long, least long")


def queries() -> dict[str, Run]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


