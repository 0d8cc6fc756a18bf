"""History, latest values and the streaming jobs against their batch twins."""

import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import srcgauge
from srcgauge import catalog
from srcgauge.operators import history
from srcgauge.sources import code_files
from srcgauge.sources.tables import table
from srcgauge.streaming import jobs
from srcgauge.streaming.store import LatestStore

COLUMNS = ["user_id", "ts", "event_id", "event_type"]
ORDER = ["ts", "event_id"]


@pytest.fixture
def slices(spark, sf_dir, tmp_path):
    """Events cut by time into five files that arrive one after another."""
    events = table(spark, sf_dir, "events").select(*COLUMNS, "value")
    rows = events.orderBy(*ORDER).toPandas()
    folder = tmp_path / "arriving"
    folder.mkdir()
    step = len(rows) // 5 + 1
    for i in range(5):
        part = rows.iloc[i * step : (i + 1) * step]
        part.to_parquet(folder / f"{i}.parquet", coerce_timestamps="us")
    return events, str(folder)


def stream(spark, folder):
    ddl = "user_id bigint, ts timestamp, event_id bigint, event_type string, value double"
    return jobs.stream_table(spark, folder, ddl, max_files=1)


def test_change_only_over_batches(spark, slices, tmp_path):
    events, folder = slices
    day = F.to_date("ts")
    jobs.stream_change_only(
        stream(spark, folder).select(*COLUMNS), "user_id", "event_type", ORDER, day,
        str(tmp_path / "out"), str(tmp_path / "cp"),
    ).awaitTermination()
    got = jobs.read_changes(spark, str(tmp_path / "out"), COLUMNS)
    want = history.change_only(events.select(*COLUMNS), "user_id", "event_type", ORDER, day)
    assert want.count() > 100
    assert sorted(got.collect()) == sorted(want.collect())


def test_change_only_in_order_of_arrival(spark, sf_dir, tmp_path):
    """Shuffled arrival: a late row follows what arrived before it, not what happened."""
    rows = table(spark, sf_dir, "events").select(*COLUMNS, "value").toPandas()
    rows = rows.sample(frac=1, random_state=5).reset_index(drop=True)
    folder, last, want, step = tmp_path / "arriving", {}, set(), len(rows) // 5 + 1
    folder.mkdir()
    for i in range(5):
        part = rows.iloc[i * step : (i + 1) * step]
        part.to_parquet(folder / f"{i}.parquet", coerce_timestamps="us")
        for r in part.sort_values(ORDER).itertuples():
            if r.user_id not in last or last[r.user_id] != r.event_type:
                want.add((r.user_id, r.event_id))
            last[r.user_id] = r.event_type
        time.sleep(0.02)  # files are taken by their time
    jobs.stream_change_only(
        stream(spark, str(folder)).select(*COLUMNS), "user_id", "event_type", ORDER,
        F.to_date("ts"), str(tmp_path / "out"), str(tmp_path / "cp"),
    ).awaitTermination()
    got = jobs.read_changes(spark, str(tmp_path / "out"), ["user_id", "event_id"]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_stream_without_rows_reads_as_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    arriving = stream(spark, f"{tmp_path}/in/").select(*COLUMNS)
    out = str(tmp_path / "out")
    jobs.stream_change_only(
        arriving, "user_id", "event_type", ORDER, F.to_date("ts"), out, str(tmp_path / "cp")
    ).awaitTermination()
    assert jobs.read_changes(spark, out, ["user_id"], "user_id bigint").count() == 0


def test_latest_over_batches(spark, slices, tmp_path):
    events, folder = slices
    values = ["event_type", "value"]
    out = str(tmp_path / "out")
    jobs.stream_latest(
        stream(spark, folder), "user_id", values, ORDER, out, str(tmp_path / "cp")
    ).awaitTermination()
    got = jobs.read_latest(spark, out, "user_id", values, ORDER)
    assert sorted(got.collect()) == sorted(
        history.latest(events, "user_id", values, ORDER).collect()
    )


def test_change_only_splits_a_hot_key(spark):
    """One key with a third of the rows; the bucket border must not show."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("k"),
        "id",
        F.floor(F.col("id") / 7 % 3).alias("v"),
    )
    got = history.change_only(rows, "k", "v", ["id"], F.floor(F.col("id") / 100))
    last, want = {}, set()
    for r in rows.orderBy("id").collect():
        if last.get(r.k) != r.v:
            want.add((r.k, r.id))
        last[r.k] = r.v
    assert {(r.k, r.id) for r in got.collect()} == want


def test_stream_analyze_equals_batch(spark, tmp_path):
    samples = tmp_path / "in"
    samples.mkdir()
    for name, text in {
        "a.js": "function f(a) {\n  return a ? 1 : 2;\n}\n",
        "b.py": "def g(x):\n    return x\n",
        "c.sql": "select 1",
        "d.ts": "const h = (a) => {\n};\n",
    }.items():
        (samples / name).write_text(text)
    out, stamp = str(tmp_path / "out"), F.lit("2024-05-01 00:00:00").cast("timestamp")
    arriving = code_files.stream_source_tree(spark, str(samples), max_files=1)
    jobs.stream_analyze(arriving, out, str(tmp_path / "cp"), stamp).awaitTermination()
    got = catalog.shown_history(spark.read.parquet(out))
    batch = code_files.read_source_tree(spark, str(samples))
    want = catalog.shown_history(history.history_records(srcgauge.analyze(batch), stamp))
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() == 3


def test_a_repeated_batch_leaves_no_copies(spark, tmp_path):
    df, path = spark.range(5).toDF("id"), str(tmp_path / "t")
    for _ in range(2):
        jobs._write_batch(df, 0, path)
    jobs._write_batch(df, 1, path)
    assert spark.read.parquet(path).count() == 10


def test_a_batch_repeated_on_another_day_leaves_no_copies(spark, tmp_path):
    df, path = spark.range(3).toDF("id"), str(tmp_path / "t")
    for day in ("2024-05-01", "2024-05-02"):
        jobs._write_batch(df.withColumn("day", F.lit(day).cast("date")), 7, path, ("day",))
    rows = spark.read.parquet(path).collect()
    assert sorted(r.id for r in rows) == [0, 1, 2]
    assert {(str(r.day), r.batch) for r in rows} == {("2024-05-02", 7)}


def test_history_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, f"f{i}.py", "def f(): pass") for i in range(60)], "file_id bigint, filename string, code string"
    )
    records = history.history_records(srcgauge.analyze(df), catalog.analysed_at())
    path = str(tmp_path / "h")
    history.append_history(records.filter("filename <> 'f7.py'"), path)
    history.append_history(records.filter("filename = 'f7.py'"), path)
    stored = history.read_history(spark, path)
    assert stored.count() == 60
    top = history.history_top(stored).collect()
    assert [r.filename for r in top] == [f"f{i}.py" for i in range(59, 9, -1)]
    assert (top[0].functionCount, top[0].issueCount, top[0].complexity) == (1, 0, 1)


def test_current_or_last(spark):
    ddl = "k int, v string, t int"
    stored = spark.createDataFrame([(1, "old", 1), (1, "older", 0), (2, "kept", 5)], ddl)
    current = spark.createDataFrame([(1, "live", 9)], ddl)
    rows = history.current_or_last(current, stored, "k", "v", ["t"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "live", True), (2, "kept", False)]


def test_texts_move_only_when_the_session_asks(spark, sf_dir):
    def plan() -> str:
        df = catalog.QUERIES["file_summary"](spark, sf_dir)
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan()
    spark.conf.set("spark.srcgauge.splits", "3")
    try:
        assert "RoundRobinPartitioning(3)" in plan()
    finally:
        spark.conf.unset("spark.srcgauge.splits")


# -- latest values in a bucketed store ----------------------------------------
VALUES = "k bigint, t bigint, v string"


def batch_of(spark, rows):
    return spark.createDataFrame(rows, VALUES)


def store_at(spark, tmp_path):
    return LatestStore(spark, str(tmp_path / "store"), "k", ["v"], ["t"])


def files_below(path) -> int:
    return sum(pq.read_metadata(p).num_rows for p in path.rglob("*.parquet"))


def test_store_size_follows_the_keys(spark, tmp_path):
    """Ten batches over the same keys leave about one row a key, and whole versions."""
    store, want = store_at(spark, tmp_path), {}
    for n in range(10):
        rows = [(k, n * 10 - (k % 3) * 15, f"{n}-{k}") for k in range(0, 100, 1 + n % 3)]
        rows += [(None, n, f"null {n}")]
        store.merge(batch_of(spark, rows), n, 4)
        for k, t, v in rows:
            if k not in want or want[k][0] < t:
                want[k] = (t, v)
        got = {r.k: r.v for r in store.read().collect()}
        assert got == {k: v for k, (_, v) in want.items()}
    assert files_below(tmp_path / "store") <= 2 * 2 * len(want)
    assert len(list((tmp_path / "store" / "manifest").glob("*.json"))) == 2


def test_store_touches_only_the_buckets_of_a_batch(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.merge(batch_of(spark, [(k, 0, "a") for k in range(200)]), 0, 16)
    store.merge(batch_of(spark, [(7, 1, "b")]), 1, 99)
    layers = store._read(1)["layers"]
    assert len(layers) == 16 and sum(len(ls) for ls in layers.values()) == 17
    assert len(list((tmp_path / "store" / "data" / "batch=1").glob("bucket=*"))) == 1


def test_store_survives_a_batch_that_fails_and_is_tried_again(spark, tmp_path, monkeypatch):
    """Neither a half-written batch nor a published one that is repeated shows twice."""
    store = store_at(spark, tmp_path)
    store.merge(batch_of(spark, [(k, 0, "a") for k in range(50)]), 0, 4)
    second = batch_of(spark, [(k, 1, "b") for k in range(40)])

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(LatestStore, "_publish", broken)
        with pytest.raises(OSError):
            store.merge(second, 1, 4)
    assert {r.v for r in store.read().collect()} == {"a"}
    for _ in range(3):
        store.merge(second, 1, 4)
        assert sorted(r.v for r in store.read().collect()) == ["a"] * 10 + ["b"] * 40
    early = store.read()
    store.merge(batch_of(spark, [(k, 2, "c") for k in range(50)]), 2, 4)
    assert sorted(r.v for r in early.collect()) == ["a"] * 10 + ["b"] * 40  # its files stay
    assert {r.v for r in store.read().collect()} == {"c"}


def test_an_empty_store(spark, tmp_path):
    store = store_at(spark, tmp_path)
    assert store.read() is None and store.read(VALUES).count() == 0
    store.merge(batch_of(spark, []), 0, 4)
    assert store.read(VALUES).count() == 0
    store.merge(batch_of(spark, [(1, 1, None)]), 1, 4)
    assert [tuple(r) for r in store.read(VALUES).collect()] == [(1, None)]


# -- restarts -----------------------------------------------------------------
def arrivals(folder, number: int, rows: list[tuple]) -> None:
    folder.mkdir(exist_ok=True)
    pq.write_table(
        pa.table({"k": [r[0] for r in rows], "t": [r[1] for r in rows], "v": [r[2] for r in rows]},
                 schema=pa.schema([("k", pa.int64()), ("t", pa.int64()), ("v", pa.string())])),
        folder / f"{number:03}.parquet",
    )
    time.sleep(0.02)


def changed(batches: list[list[tuple]]) -> list[tuple]:
    last, out = {}, []
    for rows in batches:
        for k, t, v in sorted(rows, key=lambda r: r[1]):
            if k not in last or last[k] != v:
                out.append((k, t, v))
            last[k] = v
    return sorted(out, key=str)


def run_changes(spark, tmp_path):
    arriving = jobs.stream_table(spark, str(tmp_path / "in"), VALUES, max_files=1)
    jobs.stream_change_only(
        arriving, "k", "v", ["t"], F.floor(F.col("t") / 10), str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    got = jobs.read_changes(spark, str(tmp_path / "out"), ["k", "t", "v"], VALUES + ", batch int")
    return sorted(map(tuple, got.collect()), key=str)


def test_change_only_goes_on_after_failures(spark, tmp_path, monkeypatch):
    """A run that fails before and after its rows are written, late rows, nulls and a hot key."""
    batches = [
        [(1, 5, "a"), (2, 5, "a"), (None, 5, "n"), (3, 1, None)] + [(9, t, str(t // 50)) for t in range(300)],
        [(1, 1, "a"), (1, 9, "b"), (2, 2, "c"), (None, 6, "n"), (3, 2, None), (3, 3, "x")],
        [(1, 20, "b"), (2, 21, None), (None, 22, None)] + [(9, t, "5") for t in range(100, 200)],
        [(1, 3, "b"), (2, 1, None), (3, 9, "x"), (4, 0, "new"), (9, 0, "5")],
    ]
    write, fails = jobs._write_batch, {(1, "before"), (2, "after")}

    def failing(df, batch, path, by=()):
        if (batch, "before") in fails:
            fails.discard((batch, "before"))
            raise OSError("lost before")
        write(df, batch, path, by)
        if (batch, "after") in fails:
            fails.discard((batch, "after"))
            raise OSError("lost after")

    monkeypatch.setattr(jobs, "_write_batch", failing)
    for number, rows in enumerate(batches[:3]):
        arrivals(tmp_path / "in", number, rows)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run_changes(spark, tmp_path)
    assert run_changes(spark, tmp_path) == changed(batches[:3])
    arrivals(tmp_path / "in", 3, batches[3])
    assert run_changes(spark, tmp_path) == changed(batches)


def test_latest_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    batches = [[(k, n * (1 - 2 * (k % 2)), f"{n}") for k in range(30)] for n in range(4)]
    for number, rows in enumerate(batches):
        arrivals(tmp_path / "in", number, rows)
    publish, fails = LatestStore._publish, {2}

    def failing(self, batch, manifest):
        if batch in fails:
            fails.discard(batch)
            raise OSError("lost")
        publish(self, batch, manifest)

    monkeypatch.setattr(LatestStore, "_publish", failing)

    def run():
        arriving = jobs.stream_table(spark, str(tmp_path / "in"), VALUES, max_files=1)
        jobs.stream_latest(
            arriving, "k", ["v"], ["t"], str(tmp_path / "out"), str(tmp_path / "cp"), buckets=4
        ).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    assert {r.v for r in jobs.read_latest(spark, str(tmp_path / "out"), "k", ["v"], ["t"]).collect()} == {"0", "1"}
    run()
    got = {r.k: r.v for r in jobs.read_latest(spark, str(tmp_path / "out"), "k", ["v"], ["t"]).collect()}
    assert got == {k: "0" if k % 2 else "3" for k in range(30)}


def test_the_session_keeps_its_state_store_settings(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    arrivals(tmp_path / "in", 0, [(1, 1, "a")])
    assert run_changes(spark, tmp_path) == [(1, 1, "a")]
    assert spark.conf.get(name, None) == before


def test_newest_history_reads_the_newest_days(spark, tmp_path):
    """The same rows as a scan of all days, from the files of the last ones."""
    path = str(tmp_path / "h")
    rows = [
        (f"{day:02}-{i}", f"f{i}.py", "python", 1, 1, 1.0, 1, 0, f"2024-01-{day:02} 00:00:{i:02}")
        for day in range(1, 31) for i in range(day % 4 + 1)
    ]
    ddl = "id string, filename string, language string, loc int, complexity int, maintainability double, functionCount int, issueCount int, t string"
    records = spark.createDataFrame(rows, ddl).withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    history.append_history(records, path)
    for n in (1, 3, 7, 50, 500):
        newest = history.newest_history(spark, path, n)
        want = history.history_top(history.read_history(spark, path), n)
        assert [r.id for r in newest.collect()] == [r.id for r in want.collect()]
    few = history.newest_history(spark, path, 3).inputFiles()
    assert {f.split("day=")[1][:10] for f in few} <= {"2024-01-30", "2024-01-29", "2024-01-28"}
    dateless = records.limit(2).withColumn("timestamp", F.lit(None).cast("timestamp"))
    history.append_history(dateless, path)
    assert history.newest_history(spark, path, 500).count() == len(rows) + 2
    streamed = str(tmp_path / "s")
    for number, day in enumerate(("2024-03-02", "2024-03-01")):
        stamped = records.limit(4).withColumn("timestamp", F.lit(day).cast("timestamp"))
        jobs._write_batch(stamped.withColumn("day", F.to_date("timestamp")), number, streamed, ("day", "language"))
    top = history.newest_history(spark, streamed, 4).collect()
    assert {str(r.day) for r in top} == {"2024-03-02"}
    (tmp_path / "none").mkdir()
    assert history.newest_history(spark, str(tmp_path / "none")).count() == 0


def test_even_buckets_split_one_hot_key(spark):
    """All rows of one key within a second; nulls and equal times stay in order."""
    rows = spark.range(6000).select(
        F.lit(1).alias("k"),
        F.when(F.col("id") >= 50, F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.floor(F.col("id") / 3))).alias("t"),
        "id",
        F.floor(F.col("id") / 7 % 3).alias("v"),
    )
    bucket = history.even_buckets(rows, "t", 16)
    sizes = [r["count"] for r in rows.groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 6000 / 16
    got = history.change_only(rows, "k", "v", ["t", "id"], bucket)
    last, want = None, set()
    for r in rows.orderBy("t", "id").collect():
        if r.v != last:
            want.add(r.id)
        last = r.v
    assert {r.id for r in got.collect()} == want
    none = rows.limit(0)
    assert history.change_only(none, "k", "v", ["t", "id"], history.even_buckets(none, "t", 8)).count() == 0
