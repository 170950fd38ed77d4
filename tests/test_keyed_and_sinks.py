import json
import os
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

from pyspark.sql import functions as F

from skyroll.functions.decimals import decimalise_columns
from skyroll.operators.setops import (
    dedup_last, read_row_texts, union_headers, union_row_headers,
)
from skyroll.sinks.csv_out import write_csv
from skyroll.sinks.json_out import write_json_output
from skyroll.sinks.keyed import KeyedStore, keyed_items, merge_items
from skyroll.sources.json_lines import read_json_output

from support import rows


def test_keyed_items_skip_null_keys_and_use_decimals(spark):
    df = spark.createDataFrame([("AA", 10, 1.234567891), (None, 5, 2.0)],
                               "AIRLINE string, flights bigint, arrival_delay double")
    items = keyed_items(df, "AIRLINE")
    assert items.columns[0] == "item_key"
    assert dict(items.dtypes)["arrival_delay"] == "decimal(38,6)"
    assert dict(items.dtypes)["flights"] == "bigint"
    got = items.collect()
    assert len(got) == 1 and got[0].item_key == "AA"
    assert got[0].arrival_delay == Decimal("1.234568")


def test_month_key_format_and_null_parts(spark):
    df = spark.createDataFrame([(2015, 3, 1), (None, 4, 2), (2016, None, 3)],
                               "YEAR int, MONTH int, flights bigint")
    assert [r.item_key for r in keyed_items(df, "YEAR-MONTH").collect()] == ["2015-03"]


def test_decimal_walk_is_recursive(spark):
    df = spark.createDataFrame([([1.5, 2.25], (3.125, "x"))],
                               "a array<double>, s struct<v: double, t: string>")
    out = df.select(*decimalise_columns(df))
    assert out.dtypes == [("a", "array<decimal(38,6)>"),
                          ("s", "struct<v:decimal(38,6),t:string>")]


def test_merge_keeps_old_items_and_replaces_matching(spark):
    old = spark.createDataFrame([("A", 1), ("B", 1)], "item_key string, v int")
    new = spark.createDataFrame([("B", 2), ("C", 2), (None, 9)], "item_key string, v int")
    assert rows(merge_items(old, new)) == [("A", 1), ("B", 2), ("C", 2)]


def test_last_write_wins_within_a_batch(spark):
    batch = spark.createDataFrame([("A", 1, 0), ("A", 2, 5), ("A", 3, 2), ("B", 4, 1)],
                                  "item_key string, v int, ord int")
    assert rows(merge_items(None, batch, ordinal="ord")) == [("A", 2), ("B", 4)]


def test_dedup_last_with_a_hot_key(spark):
    n = 20000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot"))
                               .otherwise(F.col("id").cast("string")).alias("k"),
                               F.col("id").alias("ord"), (F.col("id") * 2).alias("v"))
    out = {r.k: r.v for r in dedup_last(df, "k", "ord").collect()}
    assert out["hot"] == 2 * max(i for i in range(n) if i % 3 == 0)
    assert len(out) == 1 + sum(1 for i in range(n) if i % 3)


def test_store_snapshots_commit_and_ignore_partial(spark, tmp_dir):
    store = KeyedStore(spark, tmp_dir, "t")
    assert store.read() is None
    v1 = store.upsert(spark.createDataFrame([("A", 1)], "item_key string, v int"))
    v2 = store.upsert(spark.createDataFrame([("A", 2), ("B", 2)], "item_key string, v int"))
    assert (v1, v2) == (1, 2) and store.current_version() == 2
    # a half-written snapshot (no _SUCCESS) is invisible to readers
    os.makedirs(store.snapshots.marker(3))
    assert store.current_version() == 2
    assert rows(store.read()) == [("A", 2), ("B", 2)]
    v4 = store.upsert(spark.createDataFrame([("C", 3)], "item_key string, v int"))
    assert v4 == 4 and rows(store.read()) == [("A", 2), ("B", 2), ("C", 3)]


def test_repeated_keys_in_a_batch_keep_the_last_row(spark, tmp_dir):
    batch = spark.createDataFrame([("A", 3), ("B", 1), ("A", 1), ("A", 2)], "item_key string, v int")
    store = KeyedStore(spark, tmp_dir, "t")
    store.upsert(batch.coalesce(1))
    assert rows(store.read()) == [("A", 2), ("B", 1)]


def test_dedup_last_null_and_equal_ordinals(spark):
    df = spark.createDataFrame([("A", None, 1, [1]), ("A", 2, 5, [2]), ("A", 2, 7, [0]),
                                ("B", None, 4, [1]), ("B", None, 3, [9])],
                               "k string, ord int, v int, a array<int>")
    for part in (df, df.repartition(5), df.orderBy("v")):
        got = sorted(dedup_last(part, "k", "ord").collect())
        assert [(r.k, r.ord, r.v) for r in got] == [("A", 2, 7), ("B", None, 4)]


def test_two_upserts_at_once_lose_nothing(spark, tmp_dir):
    def write(k):
        batch = spark.createDataFrame([(f"own{k}", k), ("shared", k)], "item_key string, v int")
        return KeyedStore(spark, tmp_dir, "t").upsert(batch)

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(write, range(4)))
    assert sorted(versions) == [1, 2, 3, 4]
    got = dict(rows(KeyedStore(spark, tmp_dir, "t").read()))
    assert {k: v for k, v in got.items() if k != "shared"} == {f"own{k}": k for k in range(4)}
    assert got["shared"] == versions.index(4)


def test_a_lost_claim_leaves_no_marker_behind(spark, tmp_dir):
    store = KeyedStore(spark, tmp_dir, "t")
    store.upsert(spark.createDataFrame([("A", 1)], "item_key string, v int"))
    folder = store.snapshots.new_folder()
    spark.createDataFrame([("B", 1)], "item_key string, v int").write.parquet(folder)
    assert not store.snapshots.commit(folder, 1)
    store.snapshots.discard(folder)
    assert sorted(n for n in os.listdir(store.path) if not n.startswith("data-")) == ["v=000001"]
    assert rows(store.read()) == [("A", 1)]


def test_pages_cover_one_snapshot_and_push_their_bound(spark, tmp_dir):
    store = KeyedStore(spark, tmp_dir, "t")
    assert store.page() is None and list(store.pages(3)) == []
    store.upsert(spark.createDataFrame([(f"k{i:02d}", i) for i in range(10)], "item_key string, v int"))
    seen = []
    for page in store.pages(4):
        seen.append([r.v for r in page.orderBy("item_key").collect()])
        store.upsert(spark.createDataFrame([(f"z{len(seen)}", 99)], "item_key string, v int"))
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    plan = store.page("k05", 2)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(item_key,k05)" in plan and "TakeOrderedAndProject" in plan
    assert [r.item_key for r in store.page("k05", 2).collect()] == ["k06", "k07"]


def test_uneven_rows_keep_their_keys_in_order(spark, tmp_dir):
    put = ['{"b": 1, "a": "x,y"}', "", '{"c": {"d": [1, "q"]}, "a": null}', "{}",
           '{"z e": "say \\"hi\\"\\nbye", "b": true}']
    with open(f"{tmp_dir}/rows.txt", "w") as f:
        f.write("\n".join(put))
    out = union_row_headers(read_row_texts(spark, f"{tmp_dir}/rows.txt"))
    assert out.columns == ["b", "a", "c", "z e"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        ("1", "x,y", None, None), (None, None, '{"d":[1,"q"]}', None), (None, None, None, None),
        ("true", None, None, 'say "hi"\nbye')], key=str)


def test_json_output_single_file_and_null_fields(spark, tmp_dir):
    df = spark.createDataFrame([("AA", 1.5), (None, None)], "AIRLINE string, x double")
    write_json_output(df, f"{tmp_dir}/out")
    parts = [p for p in os.listdir(f"{tmp_dir}/out") if p.startswith("part-")]
    assert len(parts) == 1
    with open(f"{tmp_dir}/out/{parts[0]}") as f:
        lines = [json.loads(line) for line in f if line.strip()]
    assert {} in lines                    # null fields are dropped by the writer
    back = read_json_output(spark, f"{tmp_dir}/out", df.schema)
    assert rows(back) == rows(df)
    write_json_output(df.limit(1).filter(F.col("AIRLINE").isNotNull()), f"{tmp_dir}/out")
    assert rows(read_json_output(spark, f"{tmp_dir}/out", df.schema)) == [("AA", 1.5)]


def test_csv_export_quoting(spark, tmp_dir):
    df = spark.createDataFrame(
        [("a,b", 'say "hi"', "line\nbreak", "", None, [1, 2])],
        "c1 string, c2 string, c3 string, c4 string, c5 string, c6 array<int>")
    write_csv(df, f"{tmp_dir}/csv")
    part = [p for p in os.listdir(f"{tmp_dir}/csv") if p.startswith("part-")][0]
    text = open(f"{tmp_dir}/csv/{part}").read()
    header, body = text.split("\n", 1)
    assert header == "c1,c2,c3,c4,c5,c6"
    assert body.startswith('"a,b","say ""hi""","line\nbreak",,,"[1,2]"')


def test_header_union(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)], "y int, z int")
    u = union_headers([a, b])
    assert u.columns == ["x", "y", "z"]
    assert rows(u) == [(1, 2, None), (None, 3, 4)]
