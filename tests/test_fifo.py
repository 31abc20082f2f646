import random
import time
from collections import deque

from mediaquarry.operators.joblog import POP, PUSH
from mediaquarry.streaming import fifo

LOG = "seq long, op string, key string"


def written(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(folder))


def follow(spark, tmp_path, **trigger):
    source = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    return fifo.replay(source, str(tmp_path / "out"), str(tmp_path / "check"), **trigger)


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    """Random commands in batches, with a restart after each: the queues are those of one loop over all."""
    rng = random.Random(4)
    log = [(i, rng.choice((PUSH, PUSH, POP, POP, "SADD")), rng.choice("pq")) for i in range(240)]
    setting = spark.conf.get(fifo._PROVIDER, None)
    for k in range(0, 240, 60):
        part = log[k : k + 60]
        rng.shuffle(part)
        written(spark, tmp_path / "in", part)
        follow(spark, tmp_path).awaitTermination()
    assert spark.conf.get(fifo._PROVIDER, None) == setting
    queues, number, want = {"p": deque(), "q": deque()}, {"p": 0, "q": 0}, []
    for seq, op, key in log:
        if op == PUSH:
            number[key] += 1
            queues[key].append(number[key])
            want.append((key, seq, op, number[key], len(queues[key]), False))
        elif op == POP:
            n = queues[key].popleft() if queues[key] else None
            want.append((key, seq, op, n, len(queues[key]), n is None))
    got = [tuple(r) for r in spark.read.schema(fifo.RESULTS).parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=lambda r: r[1]) == want and any(r[5] for r in want)


def test_a_pop_waits_for_a_push(spark, tmp_path):
    """Of three waiting pops the first gets a push that comes in time; the others are in vain when their time is over."""
    written(spark, tmp_path / "in", [(1, POP, "p"), (2, POP, "p"), (3, POP, "p"), (4, PUSH, "p"), (5, PUSH, "q")])
    query = follow(spark, tmp_path, wait=2_000, processingTime="200 milliseconds")
    try:
        for _ in range(240):
            time.sleep(0.5)
            got = sorted(map(tuple, spark.read.schema(fifo.RESULTS).parquet(str(tmp_path / "out")).collect()), key=lambda r: (r[1], r[2]))
            if len(got) >= 5 or query.exception():
                break
    finally:
        query.stop()
    assert got == [("p", 1, POP, 1, 0, False), ("p", 2, POP, None, 0, True), ("p", 3, POP, None, 0, True), ("p", 4, PUSH, 1, 1, False), ("q", 5, PUSH, 1, 1, False)]
