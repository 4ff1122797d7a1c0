"""Feedback in batches, late and repeated; streams with restarts; sinks with interrupted runs."""

import glob
import random
import shutil

import pytest
from pyspark.sql import functions as F

from receiptlake.operators import learning
from receiptlake.sources import io, model_store
from receiptlake.streaming import jobs

TEXT = ", ".join(f"{c} string" for c in io.FEEDBACK_COLUMNS)
CAUSES = {"otro": -2.0, "ruido_imagen": -7.0, "mala_segmentacion": -10.0, "x": 0.0}


def feedback(n, seed, days=range(1, 20), raws=("", "a", "b", "c")):
    rng = random.Random(seed)
    return [(f"i{rng.randint(0, 30)}", rng.choice(["monto", "fecha"]), rng.choice(raws), rng.choice(["v", "w"]), rng.choice([*CAUSES]), f"2024-01-{rng.choice(days):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00") for _ in range(n)]


def plain_fold(rows):
    out = {}
    for i, f, raw, v, cause, at in sorted(rows, key=lambda r: (r[5], *r[:5])):
        if CAUSES[cause]:
            n, a = out.get((f, raw), (0, 0.0))
            out[f, raw] = (n + 1, (a + CAUSES[cause]) / 2)
    return out


def timed(spark, rows):
    return spark.createDataFrame(rows, TEXT).withColumn("timestamp_feedback", F.to_timestamp("timestamp_feedback"))


@pytest.mark.parametrize("n", [0, 1, 700])
def test_fold_by_segments(spark, n):
    rows = feedback(n, 1)
    got = {(r["field"], r["raw"]): (r["n"], r["adjustment"]) for r in learning.confidence_fold(timed(spark, rows).repartition(3), None).collect()}
    want = plain_fold(rows)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_a_hot_key_is_dealt_out_and_keeps_its_order(spark):
    n = 50_000
    f = spark.range(n).selectExpr("'i' AS id_unico_imagen", "'monto' AS campo_nombre", "'' AS raw_ocr_output", "'v' AS valor_corregido", f"if(id >= {n - 3}, 'ruido_imagen', 'otro') AS causa_raiz", "timestamp_seconds(id) AS timestamp_feedback", "id AS seq").repartition(7)
    r = learning.confidence_fold(f).first()
    assert r["n"] == n and r["adjustment"] == pytest.approx(-2 / 8 - 7 * 7 / 8)
    order = learning.order_columns()
    parts = f.repartitionByRange(4, "campo_nombre", "raw_ocr_output", *order).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(p["count"] for p in parts) < n / 2


def test_segments_of_days_combine_in_any_grouping(spark):
    rows = feedback(400, 2)
    f = timed(spark, rows)
    a, b = (learning.fold_segments(f.filter(c), None) for c in ("day(timestamp_feedback) % 2 = 0", "day(timestamp_feedback) % 2 = 1"))
    got = {(r["field"], r["raw"]): (r["n"], round(r["adjustment"], 9)) for r in learning.combine_segments(b.unionByName(a)).collect()}
    assert got == {k: (n, round(v, 9)) for k, (n, v) in plain_fold(rows).items()}


def run(spark, tmp_path, rows, buckets=8):
    at = {x: str(tmp_path / x) for x in ("fb", "model", "archive", "state")}
    if rows:
        spark.createDataFrame(rows, TEXT).write.mode("append").options(**io.CSV).csv(at["fb"])
    jobs.retrain_stream(spark, at["fb"], at["model"], at["archive"], at["state"], buckets).awaitTermination()
    return at


def checked(spark, at, rows):
    want, totals = plain_fold(rows), {}
    for _, f, raw, *_ in rows:
        totals[f, raw] = totals.get((f, raw), 0) + 1
    entries, corrections = jobs.current_model(spark, at["model"])
    got = {(r["field"], r["raw"]): (r["total"], r["adjustment"]) for r in entries.collect()}
    assert {k: v[0] for k, v in got.items()} == totals
    assert all(v[1] == pytest.approx(want.get(k, (0, 0.0))[1]) for k, v in got.items())
    assert corrections.agg(F.sum("count")).first()[0] == len(rows)
    assert spark.read.options(**io.CSV).csv(at["archive"]).count() == len(rows)


def test_late_rows_take_their_place(spark, tmp_path):
    """Every batch but the last brings rows older than those already merged, on days that are there and on days that are not."""
    rows = []
    for seed, days in ((1, range(5, 12)), (2, range(5, 9)), (3, range(1, 20)), (4, [6])):
        new = feedback(60, seed, days)
        rows += new
        at = run(spark, tmp_path, new)
        checked(spark, at, rows)


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    rows = feedback(200, 5, raws=[f"r{k}" for k in range(40)])
    at = run(spark, tmp_path, rows)
    before = model_store.manifest(spark, at["model"], 0)
    assert len(before) == 8
    one = [("i", "monto", "r1", "v", "otro", "2024-01-03 00:00:00")]
    at = run(spark, tmp_path, one)
    checked(spark, at, rows + one)
    for table in model_store.TABLES:
        assert len(glob.glob(f"{at['model']}/batch=1/{table}/bucket=*")) == 1
    now = model_store.manifest(spark, at["model"], 1)
    assert sum(now[b] != before[b] for b in now) == 1 and now.keys() == before.keys()
    # the bucket that both later batches replaced is taken away, the others stay
    more = [("i", "monto", "r1", "w", "otro", "2024-01-04 00:00:00")]
    at = run(spark, tmp_path, more)
    checked(spark, at, rows + one + more)
    assert len(glob.glob(f"{at['model']}/batch=0/entries/bucket=*")) == 7 and len(glob.glob(f"{at['model']}/batch=1/entries/bucket=*")) == 1


def test_an_interrupted_batch_runs_again(spark, tmp_path, monkeypatch):
    first, second = feedback(80, 6), feedback(50, 7)
    at = run(spark, tmp_path, first)

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(model_store, "remove_superseded", broken)
        m.setattr(model_store, "upsert", broken)
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path, second)
    checked_model = jobs.current_model(spark, at["model"])[0].agg(F.sum("total")).first()[0]
    assert checked_model == len(first)  # the archive is ahead, the model is the last whole one
    at = run(spark, tmp_path, [])
    checked(spark, at, first + second)
    shutil.rmtree(f"{at['state']}/commits")  # all batches once more
    at = run(spark, tmp_path, [])
    checked(spark, at, first + second)


def test_recent_corrections_as_a_stream(spark, tmp_path):
    """Late rows inside the delay count, rows behind the watermark don't; restarts neither lose nor repeat a window."""
    source, out, state = (str(tmp_path / x) for x in ("fb", "out", "state"))
    at = lambda day, n=1: [("i", "monto", "a", "v", "otro", f"2024-01-{day:02d} 12:00:00")] * n

    def arrive(rows):
        spark.createDataFrame(rows, TEXT).coalesce(1).write.mode("append").options(**io.CSV).csv(source)
        jobs.recent_corrections_stream(spark, source, out, state).awaitTermination()

    def shown():
        return {str(r["window_start"].date()): r["corrections"] for r in spark.read.parquet(out).collect()}

    arrive(at(1, 3) + at(3))
    arrive(at(9))  # the watermark goes to the 8th
    arrive(at(8, 2) + at(2, 5))  # inside the delay; the 2nd is behind the windows that end by the 8th, not behind those that are open
    jobs.recent_corrections_stream(spark, source, out, state).awaitTermination()
    early = shown()
    arrive(at(25))
    arrive(at(10) + at(26))  # the 10th is behind the watermark
    arrive(at(31))
    got = shown()
    assert early.items() <= got.items() and spark.read.parquet(out).count() == len(got)
    live = timed(spark, at(1, 3) + at(3) + at(9) + at(8, 2) + at(2, 5) + at(25) + at(26) + at(31))
    want = {str(r["window_start"].date()): r["corrections"] for r in jobs.recent_corrections(live).collect() if str(r["window_end"]) <= "2024-01-30 00:00:00"}
    late = {k: v for k, v in want.items() if got.get(k) != v}
    # windows that had ended before the five late rows of the 2nd came are without them
    assert got.keys() == want.keys() and all(want[k] - got[k] == 5 and k <= "2024-01-01" for k in late)


def test_corrections_through_a_key_filter(spark, monkeypatch):
    """Broadcast, or filtered with hot keys dealt out: the same rows."""
    rows = feedback(500, 11, raws=["", "", "", *[f"r{k}" for k in range(30)]])
    model = learning.build_model(timed(spark, rows), None)
    fields = spark.createDataFrame([(f, v, 50.0 + k) for k in range(3) for f in ("monto", "fecha", "other", None) for v in ["", None, "never", *[f"r{k}" for k in range(30)]]], "field string, value string, confidence double").repartition(3)
    want = sorted(map(str, learning.apply_corrections(fields, model).collect()))
    assert len(want) == fields.count()
    for share in (100, 1):
        monkeypatch.setattr(learning, "HOT_SHARE", share)
        assert sorted(map(str, learning.apply_corrections(fields, model, broadcast_keys=0).collect())) == want
    assert learning._hot(model) == [] and sorted(map(str, learning.apply_corrections(fields.limit(0), model, 0).collect())) == []


@pytest.mark.parametrize("keys", [1, 500])
def test_key_filter(spark, keys):
    some = spark.range(keys).select(F.lit("f").alias("field"), F.concat(F.lit("v"), "id").alias("value"))
    size = 1 << (keys * 10 - 1).bit_length()
    told = spark.range(keys * 40).select(F.lit("f").alias("field"), F.concat(F.lit("v"), "id").alias("value"), "id").crossJoin(F.broadcast(learning.key_filter(some, size)))
    got = told.select("id", learning.may_hold(F.col("field"), F.col("value"), size).alias("may")).filter("may")
    assert got.filter(F.col("id") < keys).count() == keys and got.count() < keys * 3


def test_new_files_only(spark, tmp_path):
    """A second run reads new files; a replaced result and a new one are told, and no others."""
    import os

    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def put(name, at):
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w") as f:
            f.write("{}")
        os.utime(f"{folder}/{name}", (at, at))

    def run():
        jobs.latest_results_stream(spark, folder, out, state, "3650d").awaitTermination()
        return {r["stem"]: r["path"].rsplit("/in/")[1] for r in jobs.latest_results(spark, out).collect()}

    put("a.json", 1_700_000_000), put("b.json", 1_700_000_000), put("x/a.json", 1_600_000_000)
    assert run() == {"a": "a.json", "b": "b.json"}
    put("y/a.json", 1_750_000_000), put("c.json", 1_700_000_000), put("z/b.json", 1_650_000_000)
    assert run() == {"a": "y/a.json", "b": "b.json", "c": "c.json"}
    last = spark.read.parquet(f"{out}/batch=1")
    assert {r["stem"] for r in last.collect()} <= {"a", "b", "c"} and last.count() <= 3
    # the manifest of images, the same way
    for name in ("p.png", "q.JPG", "r.txt"):
        put(name, 1_700_000_000)
    q = lambda: jobs.manifest_stream(spark, folder, "3650d").writeStream.format("parquet").option("path", f"{out}-m").option("checkpointLocation", f"{state}-m").trigger(availableNow=True).start().awaitTermination()
    q()
    put("s.bmp", 1_700_000_000)
    q()
    assert sorted(r["stem"] for r in spark.read.parquet(f"{out}-m").collect()) == ["p", "q", "s"]


RESULT = "stem string, value string, processed_at timestamp"


def some_results(spark, lo, hi):
    return spark.range(lo, hi).select(F.concat(F.lit("s"), "id").alias("stem"), F.lit("v").alias("value"), F.timestamp_seconds(F.col("id") * 40_000).alias("processed_at"))


def test_results_are_written_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    schema = f"{RESULT}, record string, processing_date date"
    assert io.read_committed(spark, path, schema).count() == 0
    io.write_results(some_results(spark, 0, 20), path, "one")
    io.write_results(some_results(spark, 0, 20), path, "one")  # a retry
    assert io.read_committed(spark, path, schema).count() == 20
    # a run that stops between its files and its mark, with a day that it won't write again
    named = io.named_results(some_results(spark, 15, 40))
    named.write.mode("overwrite").partitionBy("processing_date").json(f"{path}/data/run=two")
    assert io.read_committed(spark, path, schema).count() == 20
    io.write_results(some_results(spark, 20, 30), path, "two")
    got = io.read_committed(spark, path, schema)
    assert sorted(r["stem"] for r in got.collect()) == sorted(f"s{k}" for k in range(30))
    assert {r["run"] for r in got.filter("stem = 's25'").collect()} == {"two"} and got.filter("record is null or processing_date is null").count() == 0


def test_reports_are_written_once(spark, tmp_path):
    f = timed(spark, feedback(50, 9))
    report = io.retraining_report(learning.processing_stats(f), learning.top_problem(f, None), learning.build_model(f, None)[0])
    for _ in range(2):
        io.write_report(report, str(tmp_path), "2024-02-01")
    io.write_report(report, str(tmp_path), "2024-02-02")
    got = io.read_committed(spark, str(tmp_path), "total_processed long, adjustments long, top_field string, top_cause string, model_size long").collect()
    assert sorted(r["run"] for r in got) == ["2024-02-01", "2024-02-02"] and {r["total_processed"] for r in got} == {50} and got[0]["model_size"] == 2
