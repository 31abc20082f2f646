import json

from pyspark.sql import functions as F

from mediaquarry.sources.appendlog import log_lines
from mediaquarry.sources.tables import CATEGORIES, CREATORS, POSTS, Catalog, caption_of, message_files
from mediaquarry.streaming import jobs

DOCS = "video_id long, caption string, creator string, category string"


def run(stream, tmp_path, name):
    stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()


def test_gate_and_queue(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"msg_id": i, "path": f"/v/{i}"}) + "\n" for i in range(n, n + 5)))
    stream = jobs.gated(jobs.job_stream(spark, str(tmp_path / "in"), "msg_id BIGINT, path STRING"), "msg_id")
    jobs.push(stream, str(tmp_path / "out"), str(tmp_path / "c"), ["msg_id", "path"]).awaitTermination()
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(r["msg_id"] for r in got) == list(range(7)) and got[0]["path"].startswith("/v/")


def test_dispatch_and_log_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"model_name": "yolo"}\n{"model_name": "other"}\nbroken\n')
    run(jobs.dispatched(jobs.job_stream(spark, str(tmp_path / "in"), "model_name STRING")), tmp_path, "out")
    assert [r.report for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["YOLO loaded"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("Loading weights: 3\n50%|##\nready\n")
    run(jobs.shown_lines(log_lines(spark, str(tmp_path / "log"), True), "[ENGINE]", True), tmp_path, "shown")
    assert [r.line for r in spark.read.parquet(str(tmp_path / "shown")).collect()] == ["[ENGINE] ready"]


def test_sync_by_micro_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2], "u", i, f"text {i}") for i in range(1, 9)], "id long, category string, creator string, likes long, body string")
    all_ = rows.select("id", F.lit(False).alias("empty"), F.lit(True).alias("has_video"), caption_of(*map(F.col, ("category", "creator", "likes", "body"))).alias("caption"))
    all_.filter("id > 4").coalesce(1).write.json(str(tmp_path / "in"))
    versions = [Catalog(spark.createDataFrame([], CATEGORIES), spark.createDataFrame([], CREATORS), spark.createDataFrame([], POSTS), spark.createDataFrame([], DOCS))]

    def store(catalog, held, number):
        path = str(tmp_path / f"v{number}")
        catalog.write(path)
        versions.append(Catalog.read(spark, path))

    def go():
        jobs.sync_stream(message_files(spark, str(tmp_path / "in"), True), lambda: versions[-1], store, str(tmp_path / "check")).awaitTermination()

    go()
    all_.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    go()
    assert versions[-1].posts.count() == 8 and versions[-1].docs.count() == 8
    assert {r.name: r.id for r in versions[-1].categories.collect()} == {"a": 1, "b": 2}
