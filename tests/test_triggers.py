"""Keyed triggers: the stream's firings equal a fold over each key's rows, over several micro-batches and a restart."""

import random
from datetime import UTC, datetime

from tidepool.streaming import triggers

COUNT, WAIT = 4, 100


def folded(rows, end):
    """(key, time, pending, reason), one key after the other, in seconds; ``end`` is the last watermark."""
    out = []
    for key in sorted({k for k, _ in rows}):
        pending, first, last = 0, None, None
        for at in [*sorted(t for k, t in rows if k == key), None]:
            due = None if not pending else last + WAIT if pending >= COUNT and last is not None else first + WAIT
            if due is not None and due <= (end if at is None else at):
                out.append((key, due, pending, "age" if pending < COUNT else "count"))
                pending, first, last = 0, None, due
            if at is None:
                break
            pending, first = pending + 1, first if pending else at
            if pending >= COUNT and (last is None or at - last >= WAIT):
                out.append((key, at, pending, "count"))
                pending, first, last = 0, None, at
    return sorted(out)


def test_firings_equal_a_fold(spark, tmp_path):
    r = random.Random(3)
    rows = sorted(((r.choice("abcd"), t) for t in r.sample(range(0, 3000), 150)), key=lambda x: x[1])
    part = len(rows) // 3
    frame = lambda some: spark.createDataFrame([(k, datetime.fromtimestamp(t, UTC)) for k, t in some], "key string, ts timestamp").coalesce(1)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        triggers.run(stream, out, state, "key", "ts", COUNT, WAIT, "1 second")

    for some in (rows[:part], rows[part : 2 * part]):
        frame(some).write.mode("append").parquet(source)
        run()  # ends, and goes on from its state
    frame(rows[2 * part :]).write.mode("append").parquet(source)
    run()
    run()  # nothing new, nothing twice
    got = sorted((x.key, int(x.fired_at.timestamp()), x.pending, x.reason) for x in spark.read.schema(triggers.FIRED).parquet(out).collect())
    assert got == folded(rows, rows[-1][1] - 1) and {"age", "count"} == {x[3] for x in got}
