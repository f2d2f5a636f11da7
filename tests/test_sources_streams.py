"""Readers, registry, leaderboard edges and streaming."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rowmill.operators import board as B
from rowmill.sources import readers, registry
from rowmill.sources.records import ends_inside, read_records
from rowmill.streaming.serving import alerts, event_stream, run_to_table, serving_metrics, watch_jobs


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_separators(spark, tmp_path, sep):
    df = readers.load_table(spark, write(tmp_path / "t.csv", f"a{sep}b\n1{sep}x\n2{sep}y\n"))
    assert df.columns == ["a", "b"] and df.count() == 2


def test_csv_latin1(spark, tmp_path):
    df = readers.load_table(spark, write(tmp_path / "t.csv", "a,b\n1,café\n".encode("latin-1")))
    assert df.first()["b"] == "café"


def test_csv_quotes_breaks_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'id,"a;b",x\n1,"He said ""hi"", ok",NA\n2,"two\nlines",-inf\nNA,plain,2.5\n')
    with pytest.raises(ValueError, match="multi_line"):
        readers.load_table(spark, path)
    df = readers.load_table(spark, path, multi_line=True)
    assert df.dtypes == [("id", "int"), ("a;b", "string"), ("x", "double")]
    assert [tuple(r) for r in df.collect()] == [(1, 'He said "hi", ok', None), (2, "two\nlines", float("-inf")), (None, "plain", 2.5)]
    same = readers.load_table(spark, path, multi_line=True, schema="id bigint, t string, x string")
    assert [r["id"] for r in same.collect()] == [1, 2, None]


def test_records_are_cut_by_many_tasks(spark, tmp_path):
    rnd = random.Random(1)
    cell = lambda: "".join(rnd.choice(["x", '"', ",", "\n", " ", "é"]) for _ in range(rnd.randint(0, 60)))
    rows = [(str(i), cell(), cell()) for i in range(400)]
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    text = "id,a,b\n" + "".join(",".join([i, quoted(a), quoted(b)]) + "\n" for i, a, b in rows)
    path = write(tmp_path / "t.csv", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    # Blocks far shorter than some records.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "53")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = read_records(spark, path)
        assert records.rdd.getNumPartitions() > 100
        df = readers.read_csv(spark, path, sep=",", multi_line=True, schema="id string, a string, b string", null_values=())
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(i, a, b) for i, a, b in rows]
    clean = lambda r: (r[0], r[1] or "", r[2] or "")
    assert sorted(map(clean, got)) == sorted(want)


@pytest.mark.parametrize(
    "line, out, inside",
    [
        ("a,b", False, True),
        ('5" pipe,b', False, False),
        ('"a', True, False),
        ('a,"b""', True, False),
        ('"a""b",c', False, False),
        ('"a"x"y,c', False, False),
        ('","', False, True),
        ("", False, True),
    ],
)
def test_state_behind_a_line(line, out, inside):
    assert ends_inside(line, False, ",") is out and ends_inside(line, True, ",") is inside


@pytest.mark.parametrize("multi_line", [False, True])
def test_stray_quotes_are_text(spark, tmp_path, multi_line):
    path = write(tmp_path / "t.csv", 'id,size\n1,5" pipe\n2,"7"" rod"\n\n3,x\n')
    df = readers.read_csv(spark, path, multi_line=multi_line)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, '5" pipe'), (2, '7" rod'), (3, "x")]


@pytest.mark.parametrize("multi_line", [False, True])
def test_schema_by_name_and_values_of_another_type(spark, tmp_path, multi_line):
    path = write(tmp_path / "t.csv", "b,a\nx,1\ny,2x\nz,NA\n")
    read = lambda **o: readers.read_csv(spark, path, schema="a int, b string", multi_line=multi_line, **o)
    assert [tuple(r) for r in read(rejects="bad").orderBy("b").collect()] == [(1, "x", []), (None, "y", ["a"]), (None, "z", [])]
    with pytest.raises(Exception, match="'2x' is no int"):
        read().collect()
    with pytest.raises(ValueError, match="columns"):
        readers.read_csv(spark, path, schema="q int", multi_line=multi_line)


def test_csv_types(spark, tmp_path):
    text = "i,l,d,b,day,ts,s,none\n1,1,1,true,2024-01-02,2024-01-02 03:04:05,12:30,NA\n-2,9999999999,1e3,FALSE,2024-02-03,2024-02-03,x,\n"
    df = readers.load_table(spark, write(tmp_path / "t.csv", text))
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "boolean", "date", "timestamp", "string", "string"]
    assert df.orderBy("i").first()["l"] == 9999999999


def test_separator_outside_quotes():
    assert readers.sniff_separator('"a,b";c') == ";"


@pytest.mark.parametrize(
    "text, n",
    [
        ('[{"x":1,"y":"a"},{"x":2,"z":null}]', 2),
        ('{"data":[{"x":1,"y":"a"},{"x":2,"y":null}]}', 2),
        ('{\n "data": [\n {"x":1,"y":"a"},\n {"x":2,"y":null}]}', 2),
        ('{"x":1,"y":"a"}', 1),
        ('{"x":1,"y":"a"}\n{"x":2,"y":"b"}\n{"x":3}', 3),
    ],
)
def test_json_shapes(spark, tmp_path, text, n):
    df = readers.load_table(spark, write(tmp_path / "t.json", text))
    assert df.count() == n and "x" in df.columns and "y" in df.columns


def test_file_types():
    assert readers.detect_file_type("A.JSON") == "json" and readers.detect_file_type("x.unknown") == "csv"
    assert readers.allowed_file("a.csv") and not readers.allowed_file("a.exe") and not readers.allowed_file("csv")


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(ValueError, match="no reader"):
        readers.load_table(spark, "x.bin", "bin")
    with pytest.raises(ValueError, match="no rows"):
        readers.load_table(spark, write(tmp_path / "t.csv", "a,b\n"))


def test_registry_updates_keep_unset_fields(spark, tmp_path):
    root = str(tmp_path)
    registry.record(spark, root, "models", [{"id": "m", "name": "n", "status": "training"}], 0)
    registry.record(spark, root, "models", [{"id": "m", "status": "trained", "metrics": "{}"}], 1)
    row = registry.find(spark, root, "models", "m").first()
    assert (row["name"], row["status"], row["metrics"]) == ("n", "trained", "{}")
    assert row["created_at"] <= row["event_ts"]


def history(spark, rows):
    return spark.createDataFrame(rows, "job_id int, algorithm string, status string, metrics map<string,double>, end_time int")


def test_first_job_fixes_the_metric(spark):
    h = history(spark, [
        (1, "a", "completed", {"r2_score": 0.5}, 1),
        (2, "a", "completed", {"accuracy": 0.9, "r2_score": 0.7}, 2),
        (3, "a", "failed", {"accuracy": 1.0}, 0),
        (4, "a", "completed", {}, 0),
    ])
    got = B.best_models(h).collect()
    assert [(r["job_id"], r["metric_name"]) for r in got] == [(2, "r2_score"), (1, "r2_score")]


def test_error_metrics_rank_upwards(spark):
    scores = spark.createDataFrame([("a", "mae", 3.0), ("b", "mae", 1.0), ("c", "mae", None)], "model string, metric string, value double")
    assert [r["model"] for r in B.rank_models(scores, "mae").orderBy("rank").collect()] == ["b", "a"]


def test_tiers(spark):
    h = history(spark, [(i, "a", "completed", {"accuracy": v}, i) for i, v in enumerate((0.95, 0.9, 0.85, 0.75, 0.1))])
    got = [r["performance_tier"] for r in B.performance_summary(h).orderBy("job_id").collect()]
    assert got == ["excellent", "excellent", "good", "fair", "poor"]


def test_small_grids_are_kept_whole(spark):
    lists = spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("a"), F.array(F.lit(3)).alias("b"))
    assert sorted((r["a"], r["b"]) for r in B.parameter_grid(lists, ["a", "b"]).collect()) == [(1, 3), (2, 3)]


SCHEMA = "ts timestamp_ntz, event_type string, value double"


def feed(spark, folder, start, n, kind="ok"):
    rows = [(start + dt.timedelta(seconds=20 * i), kind, 1.0) for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    noon = dt.datetime(2024, 1, 1, 12)
    out = str(tmp_path / "out")

    def drain():
        stream = event_stream(spark, folder, SCHEMA)
        metrics = serving_metrics(stream, F.col("event_type") == "error", F.col("value"))
        return run_to_table(metrics, ["window_start"], "update", out)

    feed(spark, folder, noon, 9)
    assert drain().count() == 3
    feed(spark, folder, noon + dt.timedelta(hours=2), 3)
    drain()
    feed(spark, folder, noon, 3)  # two hours late
    rows = {r["window_start"].hour: r["request_count"] for r in drain().collect()}
    assert rows[14] == 3 and rows[12] == 3
    total = sum(r["request_count"] for r in drain().collect())
    assert total == 12


def test_streamed_metrics_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, dt.datetime(2024, 1, 1), 30)
    feed(spark, folder, dt.datetime(2024, 1, 1), 30, "error")
    args = (F.col("event_type") == "error", F.col("value"))
    stream = serving_metrics(event_stream(spark, folder, SCHEMA, files_per_trigger=1), *args)
    batch = serving_metrics(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")), *args)
    got = run_to_table(stream, ["window_start"], "update")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_batches_do_not_change_alerts(spark, tmp_path):
    whole, parts = str(tmp_path / "one"), str(tmp_path / "three")
    day = dt.datetime(2024, 1, 1)
    rows = [(day + dt.timedelta(seconds=7 * i), "error" if i % 3 else "ok", float(i % 50)) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(whole)
    df.repartition(3).write.parquet(parts)

    def run(folder, mode):
        stream = event_stream(spark, folder, SCHEMA, files_per_trigger=1)
        metrics = serving_metrics(stream, F.col("event_type") == "error", F.col("value"), lateness="1 day")
        limits = {"error_rate": 0.7, "response_time": 24.0}
        if mode == "complete":
            return sorted(map(tuple, run_to_table(alerts(metrics, limits), None, mode).collect()))
        return sorted(map(tuple, alerts(run_to_table(metrics, ["window_start"], mode), limits).collect()))

    want = run(whole, "complete")
    assert want and run(parts, "complete") == want and run(parts, "update") == want
    with pytest.raises(ValueError, match="key"):
        run_to_table(event_stream(spark, whole, SCHEMA), None, "update")


JOBS = "job string, status string, ts timestamp_ntz, n long, progress double, key string"


def test_watched_jobs_finish_stick_and_leave_the_state(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    noon = dt.datetime(2024, 1, 1, 12)
    at = lambda m: noon + dt.timedelta(minutes=m)
    batches = [
        [("a", "running", at(0), 1, 5.0, "x"), ("b", "running", at(1), 2, 5.0, "x"), ("c", None, at(2), 3, None, "x"), (None, "running", at(2), 4, 1.0, "x")],
        # Rows of one time are ordered by number; b's second row is older than its first.
        [("a", "running", at(20), 5, 50.0, "x"), ("a", "completed", at(20), 6, 100.0, "x"), ("b", "failed", at(0), 7, 0.0, "x")],
        [("z", "running", at(200), 8, 5.0, "x")],
        # Too late for the watermark: a stays completed, b stays stuck.
        [("a", "running", at(3), 9, 7.0, "x"), ("z", "running", at(201), 10, 6.0, "x")],
        # b reports again.
        [("b", "completed", at(210), 11, 100.0, "x")],
    ]

    def drain():
        stream = event_stream(spark, folder, JOBS)
        return run_to_table(watch_jobs(stream, "job", "status", "ts", "n", ["progress"]), ["job"], "update", out)

    seen = []
    for rows in batches:
        spark.createDataFrame(rows, JOBS).coalesce(1).write.mode("append").parquet(folder)
        seen.append({r["job"]: (r["status"], r["progress"]) for r in drain().collect()})
    assert seen[0] == {"a": ("running", 5.0), "b": ("running", 5.0), "c": (None, None)}
    assert seen[1]["a"] == ("completed", 100.0) and seen[1]["b"] == ("running", 5.0)
    assert seen[2] == {"a": ("completed", 100.0), "b": ("stuck", 5.0), "c": ("stuck", None), "z": ("running", 5.0)}
    assert seen[3] == {**seen[2], "z": ("running", 6.0)}
    assert seen[4]["b"] == ("completed", 100.0)
    kept = spark.read.format("statestore").load(f"{out}/state").select("key.*").collect()
    assert {r[0] for r in kept} == {"b", "z"}
    with pytest.raises(ValueError, match="silence"):
        watch_jobs(event_stream(spark, folder, JOBS), "job", "status", "ts", "n", ["progress"], silence="0 seconds")


def test_a_job_is_told_by_its_last_row_of_a_batch(spark, tmp_path):
    folder, noon = str(tmp_path / "in"), dt.datetime(2024, 1, 1, 12)
    schema = "job long, status string, ts timestamp_ntz, n long, step long"
    draw = [(j, f"s{k}", noon + dt.timedelta(seconds=k * j % 7), k * 5 % 11, k) for j in (1, 2, 3) for k in range(11)]
    spark.createDataFrame(draw, schema).coalesce(1).write.parquet(folder)
    stream = watch_jobs(event_stream(spark, folder, schema), "job", "status", "ts", "n", ["step"])
    got = {r["job"]: (r["status"], r["ts"], r["step"]) for r in run_to_table(stream, ["job"], "update").collect()}
    last = {j: max((r for r in draw if r[0] == j), key=lambda r: (r[2], r[3])) for j in (1, 2, 3)}
    assert got == {j: (r[1], r[2], r[4]) for j, r in last.items()}
