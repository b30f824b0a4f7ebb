import uuid

import pytest
from pyspark.sql import functions as F

from holdfast.operators.featurize import FeatureSpec
from holdfast.operators.lookup import FeatureLookup, lookup_features
from holdfast.plans import jobs
from holdfast.session import shared_path
from holdfast.sources.feature_tables import (
    create_feature_table,
    drop_feature_table,
    get_feature_table,
    read_feature_table,
    refresh_feature_table,
)
from holdfast.sources.files import read_csv, read_csv_pandas
from holdfast.sources.online import publish_table
from holdfast.sources.tables import save_table, snapshot_table, swap_table


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")


@pytest.fixture
def csv_dir(spark):
    path = shared_path(spark, "csv")
    rows = spark.createDataFrame([("id,amount",), ("1,1.5",), ("2, ",), ("3,2",)], "value string")
    rows.coalesce(1).write.text(path)
    return path


def test_a_blank_makes_an_inferred_column_a_string(spark, csv_dir):
    assert dict(read_csv(spark, csv_dir).dtypes) == {"id": "int", "amount": "string"}
    typed = read_csv(spark, csv_dir, "id long, amount string")
    assert dict(typed.dtypes)["id"] == "bigint" and typed.where("trim(amount) = ''").count() == 1


def test_pandas_api_reader(csv_dir, spark):
    assert len(read_csv_pandas(csv_dir)) == 3


def test_overwrite_may_read_its_target(spark, database, people):
    name = f"{database}.people"
    save_table(people, name)
    save_table(spark.table(name).where("id > 1"), name)
    assert spark.table(name).count() == 2
    assert [t.name for t in spark.catalog.listTables(database)] == ["people"]


def test_failed_overwrite_keeps_the_old_table(spark, database, people):
    name = f"{database}.people"
    save_table(people, name)
    broken = people.withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        save_table(broken, name)
    assert spark.table(name).count() == 3
    assert [t.name for t in spark.catalog.listTables(database)] == ["people"]


def test_overwrite_in_place(spark, database, people):
    name = f"{database}.people"
    save_table(people, name)
    save_table(people.limit(1), name, swap=False)
    assert spark.table(name).count() == 1


def test_snapshot_is_independent_and_written_once(spark, database, people):
    source, copy = f"{database}.people", f"{database}.copy"
    save_table(people, source)
    snapshot_table(spark, source, copy)
    save_table(people.limit(1), source)
    snapshot_table(spark, source, copy)
    assert spark.table(copy).count() == 3


def test_feature_table_life(spark, database, people):
    name = f"{database}.people_features"
    made = create_feature_table(name, ["id"], people, "people's features")
    assert made == get_feature_table(spark, name)
    assert made.primary_keys == ("id",) and made.features == ("id", "name")
    assert made.description == "people's features"
    assert read_feature_table(spark, name).count() == 3
    with pytest.raises(ValueError, match="exists"):
        create_feature_table(name, "id", people)
    drop_feature_table(spark, name)
    drop_feature_table(spark, name)
    assert not spark.catalog.tableExists(name)


@pytest.mark.parametrize("extra", [(1, "again"), (None, "nobody")])
def test_feature_table_refuses_bad_keys(spark, database, people, extra):
    name = f"{database}.bad"
    bad = people.union(spark.createDataFrame([extra], people.schema))
    with pytest.raises(ValueError, match="not unique"):
        create_feature_table(name, "id", bad)
    assert not spark.catalog.tableExists(name)


def test_plain_tables_are_not_feature_tables(spark, database, people):
    name = f"{database}.plain"
    save_table(people, name)
    for action in (get_feature_table, read_feature_table, drop_feature_table):
        with pytest.raises(ValueError):
            action(spark, name)


def test_bucketed_features_are_looked_up_without_shuffling_them(spark, database):
    wide = spark.range(2000).select(F.col("id"), (F.col("id") * 2).alias("double"))
    name = f"{database}.bucketed"
    create_feature_table(name, "id", wide, buckets=4)
    keys = spark.range(3000).select((F.col("id") % 2500).alias("id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_features(keys, [FeatureLookup(name, "id")])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.where("double is not null").count() == 2500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 1


def test_lookup_by_another_name_uses_the_stored_keys(spark, database, people):
    name = f"{database}.keyed"
    create_feature_table(name, "id", people)
    rows = spark.createDataFrame([(10, 2)], "event int, person int")
    assert lookup_features(rows, [FeatureLookup(name, "person")]).first() == (10, 2, "b")


def test_publish_round_trip(spark, people):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    jdbc = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    assert publish_table(people, jdbc, "PEOPLE", connections=2) == 3
    assert publish_table(people.where("id < 3"), jdbc, "PEOPLE") == 2
    assert publish_table(people.where("id = 3"), jdbc, "PEOPLE", mode="append") == 1
    assert publish_table(people, jdbc, "NAMES", columns=["name"]) == 3
    stored = spark.read.format("jdbc").options(**jdbc, dbtable="PEOPLE").load()
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, people.collect()))


def test_a_refresh_keeps_keys_description_and_saved_lookups(spark, database):
    name = f"{database}.refreshed"
    first = spark.range(20).withColumn("v", F.col("id") * 2)
    created = create_feature_table(name, "id", first, "numbers", buckets=4)
    refreshed = refresh_feature_table(name, spark.table(name).withColumn("v", F.col("v") + 1))
    assert refreshed == created
    assert sorted(tuple(r) for r in read_feature_table(spark, name).collect()) == [(i, 2 * i + 1) for i in range(20)]
    with pytest.raises(ValueError, match="not unique"):
        refresh_feature_table(name, first.union(first))
    assert read_feature_table(spark, name).count() == 20
    assert [r["tableName"] for r in spark.sql(f"SHOW TABLES IN {database} LIKE 'refreshed*'").collect()] == ["refreshed"]


def test_a_failed_swap_is_taken_back(spark, database):
    name = f"{database}.swapped"
    save_table(spark.range(3), name)
    with pytest.raises(Exception):
        swap_table(spark, name, f"{database}.missing")
    assert spark.table(name).count() == 3


def test_features_can_be_built_twice(spark, database):
    source, name = f"{database}.raw_rows", f"{database}.built"
    save_table(spark.createDataFrame([("a", 1), ("b", 0)], "k string, flag int"), source)
    spec = FeatureSpec(flags={"flag": 1})
    jobs.build_features(spark, source, spec, name, "k", "built from rows")
    save_table(spark.createDataFrame([("a", 0), ("c", 1)], "k string, flag int"), source)
    again = jobs.build_features(spark, source, spec, name, "k")
    assert again.primary_keys == ("k",) and again.description == "built from rows"
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [("a", False), ("c", True)]
    with pytest.raises(ValueError, match="primary keys"):
        jobs.build_features(spark, source, spec, name, "flag")
