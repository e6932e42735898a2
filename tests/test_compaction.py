import datetime as dt

from pyspark.sql import functions as F

from quillwork.operators import compaction as c

SCHEMA = "record_id bigint, file_path string, file_bytes bigint, written_at timestamp_ntz, name string, status int, cids array<string>, _name string"
T0, T1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def test_repeats_and_ties(spark):
    df = rows(
        spark,
        (1, "a", 10, T1, "Alpha  x", 200, ["1", "2"], "clash"),
        (2, "b", 10, T0, " alpha X", 200, ["2", "1", "1", None], "clash"),  # same record, earlier
        (3, "b", 10, T0, "ALPHA x", 200, ["1", "2"], None),  # tie in time, larger id
        (4, "c", None, T0, "é", None, None, None),
        (5, None, 10, None, "É", None, [], None),  # same record, NULL time is latest
        (6, "d", 5, T0, None, None, ["9"], None),  # holds no record
        (7, "d", 5, T0, None, 404, None, None),
        (8, "d", 5, T0, "", 404, None, None),
    )
    done = c.compact(df, 12)
    assert {r.record_id for r in c.dropped(df, done.written).collect()} == {1, 3, 5}
    assert {r.record_id for r in done.written.collect()} == {2, 4, 7, 8}
    r = done.report.first()
    assert r.balanced and (r.n_rows, r.n_empty, r.n_repeats, r.n_written) == (8, 1, 3, 4)
    assert "_name" not in done.written.columns


def test_groups_follow_cumulative_size(spark):
    df = spark.range(500).select(F.col("id").alias("record_id"), F.format_string("f%04d", "id").alias("file_path"), (F.col("id") % 7).alias("file_bytes"), F.lit(T0).alias("written_at"), F.format_string("n%d", "id").alias("name"), F.lit(200).alias("status"), F.array(F.lit("1")).alias("cids"))
    plan = sorted((r.start_byte, r.bytes, r.group_id) for r in c.plan_groups(c.manifest(df), 100).collect())
    at = 0
    for start, size, group in plan:
        assert start == at and group == start // 100
        at += size
    assert len({g for *_, g in plan}) == -(-at // 100) or at % 100 < 7
    done = c.compact(df, 100)
    files = {r[0] for r in done.written.select(F.input_file_name()).distinct().collect()}
    assert len(files) == done.written.select("group_id").distinct().count()
    assert done.report.first().balanced


def test_lines_delivered_again(spark):
    one = (1, "a", 10, T0, "x", 200, ["1"], None)
    df = rows(spark, one, one, (2, "a", 10, T1, "X", 200, ["1"], None), (None, "a", 10, T0, "y", 200, [], None), (3, "a", 10, T0, "x", 404, None, None))
    done = c.compact(df, 100)
    assert sorted(r.record_id for r in done.written.collect()) == [1, 3]
    assert [r.record_id for r in c.dropped(df, done.written).collect()] == [2]
    r = done.report.first()
    assert r.balanced and (r.n_again, r.n_empty, r.n_repeats) == (1, 1, 1)


def test_empty_table(spark):
    df = rows(spark)
    done = c.compact(df, 100)
    assert done.written.count() == 0 and c.dropped(df, done.written).count() == 0 and done.plan.count() == 0
    assert done.report.first().balanced


def test_hot_record(spark):
    df = spark.range(3000).select(F.col("id").alias("record_id"), F.format_string("f%d", F.col("id") % 50).alias("file_path"), F.lit(3).alias("file_bytes").cast("bigint"), F.lit(T0).alias("written_at"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("n%d", "id")).alias("name"), F.lit(200).alias("status"), F.array(F.lit("1")).alias("cids"))
    found = c.dropped(df, c.compact(df, 1000).written)
    assert found.count() == 999 and found.agg(F.min("record_id")).first()[0] == 3


def test_oversized_files_and_rows_without_one_are_spread(spark):
    path = F.when(F.col("id") < 2000, "big").when(F.col("id") < 4000, F.lit(None)).otherwise(F.format_string("f%d", "id"))
    size = F.when(F.col("id") < 2000, 2000).when(F.col("id") < 4000, F.lit(None)).otherwise(1)
    df = spark.range(5000).select(F.col("id").alias("record_id"), path.alias("file_path"), size.cast("bigint").alias("file_bytes"), F.lit(T0).alias("written_at"), F.format_string("n%d", "id").alias("name"), F.lit(200).alias("status"), F.array(F.lit("1")).alias("cids"))
    done = c.compact(df, 250)
    sizes = [r["count"] for r in done.written.groupBy("group_id").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 700 and len(sizes) >= 15 and done.report.first().balanced
    files = done.written.select(F.input_file_name()).distinct().count()
    assert files == len(sizes)


def test_a_line_delivered_in_versions_is_the_earliest(spark):
    df = rows(spark, (1, "a", 10, T1, "late", 200, ["1"], None), (1, "a", 10, T0, "early", 200, ["1"], None), (1, "a", 10, None, "none", 200, ["1"], None))
    assert [r.name for r in c.compact(df, 100).written.collect()] == ["early"]


def test_folder_of_real_files(spark, tmp_path):
    folder = tmp_path / "in" / "a b%"
    folder.mkdir(parents=True)
    for i in range(300):
        (folder / f"r{i:03d}.json").write_text('{"id": %d, "x": "%s"}\n' % (i, "y" * 80) * (2 if i == 7 else 1))
    (folder / "note.txt").write_text("no record")
    assert c.list_files(spark, f"file://{tmp_path}/in", "*.json").count() == 300
    written, report = c.compact_folder(spark, f"file://{tmp_path}/in", "json", 5000, pattern="*.json")
    r = report.first()
    assert r.balanced and (r.n_rows, r.n_written, r.n_files_before) == (301, 301, 300)
    assert written.select("id").distinct().count() == 300 and written.select(F.input_file_name()).distinct().count() <= r.bytes_before // 5000 + 1
