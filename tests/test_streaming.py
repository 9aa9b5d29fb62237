import os
import random
import time

from notewright.operators import review as Q
from notewright.streaming import submissions as S

SCHEMA = "index bigint, seq bigint, note string"


def test_stream_over_many_batches_equals_batch(spark, tmp_path):
    rnd = random.Random(8)
    subs = [(rnd.choice([1, 1, *range(40)]), s, f"n{s}") for s in range(1200)]
    source = tmp_path / "in"
    for i in range(6):
        part = spark.createDataFrame(subs[i * 200:(i + 1) * 200], SCHEMA).repartition(3)
        part.write.parquet(str(tmp_path / f"part{i}"))
    os.makedirs(source)
    queued = Q.id_bits(spark.range(60), "id")

    def feed(i):
        for f in (tmp_path / f"part{i}").glob("*.parquet"):
            os.link(f, source / f"{i}-{f.name}")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        S.accept_stream(stream, str(tmp_path / "log"), str(tmp_path / "state"), after=S.progress_writer(queued, str(tmp_path / "counts"))).awaitTermination()

    for i in range(6):
        feed(i)
        if i % 2 == 0:  # three runs: the stream is stopped and started again in between
            run()
            time.sleep(0.05)
    run()
    log = spark.read.schema(SCHEMA).parquet(str(tmp_path / "log")).drop("batch")
    batch = Q.accept(spark.createDataFrame(subs, SCHEMA)).where("accepted").drop("accepted")
    assert sorted(map(tuple, log.select("index", "seq", "note").collect())) == sorted(map(tuple, batch.select("index", "seq", "note").collect()))
    samples = spark.range(60).withColumnRenamed("id", "index")
    counts = spark.read.schema("batch_id bigint, accepted bigint, from_queue bigint").parquet(str(tmp_path / "counts"))
    assert tuple(S.progress_after_batches(60, counts).first()) == tuple(Q.progress(samples, log).first())
    assert counts.count() >= 3


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = S.write_batch(str(tmp_path / "log"))
    rows = spark.createDataFrame([(1, 1, "a")], SCHEMA)
    write(rows, 0)
    write(rows, 0)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_ids_logged_before_the_start_are_skipped(spark, tmp_path):
    # also after a restart, when the log has nothing new
    source, old = tmp_path / "in", str(tmp_path / "old")
    spark.createDataFrame([(7,), (7,), (None,), (9,)], "index bigint").write.parquet(old)
    for rows in ([(7, 1, "new"), (8, 2, "new"), (8, 3, "late"), (None, 4, "none")], [(9, 5, "new"), (8, 6, "again"), (10, 7, None)]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        logged = spark.readStream.schema("index bigint").parquet(old)
        S.accept_stream(stream, str(tmp_path / "log"), str(tmp_path / "state"), logged=logged).awaitTermination()
    got = spark.read.schema(SCHEMA).parquet(str(tmp_path / "log")).collect()
    assert sorted((r["index"], r["seq"], r["note"]) for r in got) == [(8, 2, "new"), (10, 7, None)]


def test_progress_by_bits(spark):
    rnd = random.Random(4)
    ids = lambda n: [(rnd.choice([rnd.randint(-40, 40), rnd.randint(0, 200_000), 2**40 + rnd.randint(0, 9)]),) for _ in range(n)]
    samples, log = sorted(set(ids(3000))), [*ids(2000), (None,), (5,), (5,)]
    a, b = (spark.createDataFrame(rows, "index bigint").repartition(5) for rows in (samples, log))
    done = {i for i, in log if i is not None}
    left = sum(i not in done for i, in samples)
    got = Q.progress(a, b).first()
    assert (got.total, got.annotated, got.remaining, got.percentage) == (len(samples), len(done), left, round(len(done) / len(samples) * 100, 1))
    assert Q.submitted_ids(b).first().n == len(done)
    assert tuple(Q.progress(a.limit(0), b.limit(0)).first()) == (0, 0, 0, 0.0)
