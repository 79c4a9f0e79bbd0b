"""Readers, writers and their option maps."""

import pytest
from pyspark.sql import functions as F

from shopwake import session
from shopwake.functions import users as U
from shopwake.sources import sinks, streams, tables
from shopwake.sources.staging import staged


def test_topic_options():
    options = streams.kafka_options("h:1", "t", "latest", per_trigger=5)
    assert options["subscribe"] == "t" and options["startingOffsets"] == "latest"
    assert options["maxOffsetsPerTrigger"] == "5" and options["kafka.metadata.max.age.ms"] == "10000"
    with pytest.raises(ValueError):
        streams.kafka_options("h:1", "t", "middle")
    sink = sinks.kafka_sink_options("h:1", "t")
    assert sink["kafka.acks"] == "all" and sink["kafka.enable.idempotence"] == "true"


def test_relational_options():
    plain = tables.jdbc_options("jdbc:x", query="select 1", user="u")
    assert plain == {"url": "jdbc:x", "user": "u", "query": "select 1"}
    split = tables.jdbc_options("jdbc:x", query="select 1", partition_column="id", bounds=(0, 9), partitions=3)
    assert split["dbtable"] == "(select 1) AS q" and split["numPartitions"] == "3"
    for bad in ({}, {"query": "q", "table": "t"}, {"table": "t", "partition_column": "id"}):
        with pytest.raises(ValueError):
            tables.jdbc_options("jdbc:x", **bad)


def test_camel_names(spark):
    assert tables.lower_camel("USER_LOGIN_NAME") == "userLoginName"
    assert tables.renamed_lower_camel(spark.range(1).toDF("ORDER_ID")).columns == ["orderId"]


def test_snapshot_rows_open_a_feed(spark):
    feed = tables.snapshot(spark.range(2), {"db": "d", "schema": "s", "table": "t"})
    assert feed.filter("op = 'r' and after is not null and before is null").count() == 2


def test_user_csv(spark, tmp_path):
    path = tmp_path / "users.csv"
    path.write_text('id,user_id,uname,phone_num,birthday,gender,address,ts\n1,u-1,甲,1,1990-05-20,0,"x, y",2025-07-08 08:28:52.4\n', encoding="utf8")
    row = U.enrich(tables.user_csv(spark, str(path))).first()
    assert (row["id"], row["address"], row["age_group"], row["constellation"], row["ts"]) == (1, "x, y", "90后", "金牛", None)


def test_keyed_table_is_repeatable(spark, tmp_path):
    table = sinks.KeyedTable(str(tmp_path / "t"), ["k"])

    def batch(rows):
        return spark.createDataFrame(rows, "k string, v int")

    table.upsert(batch([("a", 1), ("b", 1)]), 0)
    table.upsert(batch([("a", 2)]), 1)
    table.upsert(batch([("a", 3)]), 1)  # the same batch again
    assert {tuple(r) for r in table.read(spark).collect()} == {("a", 3), ("b", 1)}


def test_keyed_table_keeps_the_newest_row_and_removes_keys(spark, tmp_path):
    table = sinks.KeyedTable(str(tmp_path / "t"), ["k"], order=["ts"], deleted="gone")

    def batch(rows):
        return spark.createDataFrame(rows, "k string, ts int, v int, gone boolean")

    table.upsert(batch([("a", 2, 20, False), ("a", 1, 10, True), ("b", 1, 1, None), ("c", 5, 5, True), ("c", None, 6, False)]), 0)
    assert {tuple(r) for r in table.read(spark).collect()} == {("a", 2, 20), ("b", 1, 1)}
    for _ in range(2):
        table.upsert(batch([("b", 2, None, True), ("c", 1, 7, False)]), 1)
    assert {tuple(r) for r in table.read(spark).collect()} == {("a", 2, 20), ("c", 1, 7)}


def test_lines_and_columns(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, n int, s string")
    assert sinks.to_lines(df, "k").first().asDict() == {"key": "a", "value": '{"k":"a","n":1}'}
    assert sinks.ordered_columns(df, ["n", "k"]).columns == ["n", "k"]
    assert sinks.counted(df, "tap").count() == 1


def test_staged_table_reads_back(spark):
    df = spark.range(5).withColumn("s", F.struct(F.lit(1).alias("x")))
    again = staged(df, "t")
    assert [f.dataType.typeName() for f in again.schema] == ["long", "struct"]
    assert again.count() == 5


class Named:
    """A session as a cluster would configure it."""

    def __init__(self, master, root=None):
        self.sparkContext, self.conf = self, self
        self.master, self.root, self.applicationId = master, root, f"app-{master}"

    def get(self, key, default):
        return self.root or default


def test_shared_folder_comes_from_the_session():
    assert session.shared_dir(Named("yarn", "/shared/x/"), "t").startswith("/shared/x/t-")
    assert session.shared_dir(Named("local[2]"), "t").startswith("/tmp/spark-")
    with pytest.raises(RuntimeError):
        session.shared_dir(Named("yarn"), "t")


def test_keyed_table_is_compacted(spark, tmp_path):
    table = sinks.KeyedTable(str(tmp_path / "t"), ["k"], order=["ts"], deleted="gone")

    def put(n, *rows):
        table.upsert(spark.createDataFrame(rows, "k string, ts int, v int, gone boolean"), n)

    def now(**at):
        return {tuple(r) for r in table.read(spark, **at).select("k", "v").collect()}

    put(0, ("a", 1, 1, False), ("b", 1, 1, False), (None, 1, 9, False))
    put(1, ("a", 2, 2, False), ("a", 1, 0, False), ("b", 2, 2, True))
    want = {("a", 2), (None, 9)}
    assert now() == want and now(before=1) == {("a", 1), ("b", 1), (None, 9)}
    table.compact(spark)
    plan = table.read(spark)._jdf.queryExecution().toString()
    assert now() == want and table.merged(spark) == 1 and "Aggregate" not in plan and "batch=" not in plan
    put(0, ("a", 9, 8, False))  # merged already: a repetition changes nothing
    table.vacuum(spark)
    assert now() == want and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("batch=")]
    put(2, ("b", 1, 5, False), ("a", 1, 0, True))
    assert now() == {("b", 5), (None, 9)}
    table.compact(spark)
    table.vacuum(spark)
    assert now() == {("b", 5), (None, 9)} and [p.name for p in (tmp_path / "t" / "_levels").iterdir()] == ["2"]
    with pytest.raises(ValueError):
        table.read(spark, before=2)
    put(4, ("c", 1, 1, False))
    table.most_batches = 1
    put(5, ("c", 1, 2, False))
    put(5, ("c", 1, 2, False))
    assert table.merged(spark) == 4 and now(before=5) == {("b", 5), (None, 9), ("c", 1)} and now() == {("b", 5), (None, 9), ("c", 2)}
