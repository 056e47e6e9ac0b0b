"""Carried values, joins in time, merged sketches and progress, against plain code."""

import random

from pyspark.sql import functions as F

from quillspark.operators import carry, sketches
from quillspark.operators.checkpoints import ensure_checkpoint_dir
from quillspark.streaming.progress import BatchProgress, run_phases


def test_asof_join_with_a_hot_key(spark):
    ensure_checkpoint_dir(spark)
    rng = random.Random(1)
    user = lambda: None if rng.random() < 0.02 else 1 if rng.random() < 0.5 else rng.randint(2, 40)
    left = [(k, user(), rng.choice([None, *range(60)] if rng.random() < 0.1 else range(2_000))) for k in range(3_000)]
    right = [(k, user(), rng.choice([None, *range(60)] if rng.random() < 0.1 else range(2_000)), rng.choice([None, k])) for k in range(700)]
    a = spark.createDataFrame(left * 2, "id int, user int, ts int")  # repeated rows stay
    b = spark.createDataFrame(right, "rid int, user int, at int, price int")
    want = []
    for k, u, t in left * 2:
        fits = [r for r in right if u is not None and t is not None and r[1] == u and r[2] is not None and r[2] <= t]
        want.append((k, u, t, max(fits, key=lambda r: (r[2], r[0]))[0] if fits else None))
    got = carry.asof_join(a, b, ["user"], "ts", "at", ["rid"])
    assert sorted(((r.id, r.user, r.ts, r.asof and r.asof.rid) for r in got.collect()), key=str) == sorted(want, key=str)
    empty = carry.asof_join(a.limit(3), b.where("false"), ["user"], "ts", "at", ["rid"]).collect()
    assert len(empty) == 3 and all(r.asof is None for r in empty)
    assert carry.asof_join(a.where("false"), b, ["user"], "ts", "at", ["rid"]).collect() == []


def test_a_value_crosses_partitions(spark):
    ensure_checkpoint_dir(spark)
    rows = [(1, k, "first" if k == 0 else "late" if k == 900 else None) for k in range(1_000)] + [(None, k, "none" if k == 5 else None) for k in range(50)] + [(2, 0, None)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.k): r.out for r in carry.carry_last(spark.createDataFrame(rows, "g int, k int, v string"), ["g"], ["k"], F.col("v"), "out").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len(rows) and all(got[1, k] == ("first" if k < 900 else "late") for k in range(1_000))
    assert all(got[None, k] == (None if k < 5 else "none") for k in range(50)) and got[2, 0] is None


def test_merged_sketches_hold_their_bounds(spark):
    n = 400_000
    df = spark.range(n).select((F.col("id") % 7).cast("string").alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") * 7919 % 300_007).alias("item"), (F.col("id") * 31 % n).cast("double").alias("number"))
    cells = sketches.sketch_cells(df, ["a", "b"], "item", "number")
    rows = sketches.estimates(sketches.merged(cells, [["a"], []], ["a", "b"]), {"median": 0.5}).collect()
    exact = {r.a: r.n for r in df.groupBy("a").agg(F.count_distinct("item").alias("n")).collect()} | {None: df.select(F.count_distinct("item")).first()[0]}
    assert len(rows) == 8
    for r in rows:
        assert abs(r.distinct - exact[r.a]) <= 4 * exact[r.a] / 256 and abs(r.median / n - 0.5) < 0.003 and r.n == (n if r.a is None else df.where(F.col("a") == r.a).count())
    nothing = sketches.estimates(sketches.merged(sketches.sketch_cells(df.where("false"), ["a", "b"], "item", "number"), [["a"]], ["a", "b"]), {})
    assert nothing.collect() == []
    nulls = spark.createDataFrame([("x", 1, None, None), ("x", 1, 5, 2.0), (None, 1, 5, None)], "a string, b int, item long, number double")
    found = {(r.a, r.grouping): (r.n, r.distinct) for r in sketches.estimates(sketches.merged(sketches.sketch_cells(nulls, ["a", "b"], "item", "number"), [["a"], []], ["a", "b"]), {}).collect()}
    assert found == {("x", 0): (2, 1), (None, 0): (1, 1), (None, 1): (3, 1)}


def test_progress_of_phases(spark):
    ensure_checkpoint_dir(spark)
    df = spark.createDataFrame([(k if k % 5 else None, k) for k in range(100)], "key int, v int").repartition(4)
    result, progress = run_phases(df, [("read", lambda d: d), ("some", lambda d: d.where("v < 40")), ("again", lambda d: d.join(d.select("v").distinct(), "v"))], "key")
    assert [tuple(r) for r in progress.orderBy("place").collect()] == [("read", 0, 100, 20), ("some", 1, 40, 8), ("again", 2, 40, 8)] and result.count() == 40
    result, progress = run_phases(df.where("false"), [("none", lambda d: d)], "key")
    assert [tuple(r) for r in progress.collect()] == [("none", 0, 0, 0)] and result.count() == 0


def test_progress_of_a_stream(spark, tmp_path):
    import time

    seen = BatchProgress()
    spark.streams.addListener(seen)
    try:
        for k in range(3):
            spark.range(10 * (k + 1)).repartition(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema("id long, part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        running = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        running.awaitTermination(120)
        until = time.time() + 30
        while str(running.id) not in seen.ended and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    rows = [r for r in seen.table(spark).collect() if r.query == str(running.id)]
    assert sum(r.n_input for r in rows) == 60 == spark.read.parquet(f"{tmp_path}/out").count() and len({r.batch for r in rows}) >= 3
    assert seen.ended[str(running.id)] is None
