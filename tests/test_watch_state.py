"""A folder watched with state, items that fail alone, and streams that stop on too many errors."""

import os
import time

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from oddlens.streaming import watch


def works():
    """Functions that Spark's workers get by value, as they can't import this file."""

    def lengths(pdf):
        if any(b"poison" in c for c in pdf["content"]):
            raise ValueError("poisoned")
        return pd.DataFrame({"id": pdf["id"], "n": [len(c) for c in pdf["content"]]})

    def doubled(pdf):
        if (pdf["v"] < 0).any():
            raise ValueError("negative")
        return pd.DataFrame({"id": pdf["id"], "twice": pdf["v"] * 2})

    def mended(pdf):
        return doubled(pdf.assign(v=pdf["v"].abs()))

    return lengths, doubled, mended


lengths, doubled, mended = works()


def put(folder, name, text):
    (folder / name).write_text(text)
    old = time.time() - 100
    os.utime(folder / name, (old, old + len(text)))


def told(df):
    return {os.path.basename(r.path): (r.status, r.delivery_attempts) for r in df.collect()}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", "one"), ("b.txt", "poison"), ("c.txt", "three")):
        put(tmp_path / "in", name, text)
    return tmp_path


def test_rounds_restart_change_and_give_up(spark, folder):
    files = lambda: watch.settled_files(spark, str(folder / "in"), 0, ".txt")
    state = lambda: watch.WatchState(spark, str(folder / "state"))  # noqa: E731  a new one each time, as after a restart
    go = lambda **how: told(watch.watch_once(files(), state(), lengths, "n int", str(folder / "out"), attempts=2, **how))
    assert go() == {"a.txt": ("done", 1), "b.txt": ("failed", 1), "c.txt": ("done", 1)}
    out = {os.path.basename(r.id): (r.n, r.error) for r in spark.read.parquet(str(folder / "out")).collect()}
    assert out == {"a.txt": (3, None), "b.txt": (None, "ValueError: poisoned"), "c.txt": (5, None)}
    assert go() == {"b.txt": ("failed", 2)}
    assert go() == {} and told(state().read())["b.txt"] == ("failed", 2)
    put(folder / "in", "b.txt", "mended now")
    put(folder / "in", "d.txt", "new")
    assert go() == {"b.txt": ("done", 1), "d.txt": ("done", 1)}
    assert set(told(state().read()).values()) == {("done", 1)} and len(state().versions()) == 2
    # A writer that died has left a version without its mark: it isn't read, and the next one takes its place.
    (folder / "state" / f"v={state().versions()[-1] + 1}").mkdir()
    assert len(told(state().read())) == 4
    put(folder / "in", "e.txt", "poison again")
    with pytest.raises(watch.TooManyErrors):
        go(max_errors=0)
    assert told(state().read())["e.txt"] == ("failed", 1)


def test_a_poisoned_row_fails_alone(spark):
    rows = spark.createDataFrame([(i, float(i) if i != 7 else -1.0) for i in range(20)], "id long, v double").repartition(2)
    got = {r.id: (r.twice, r.error) for r in watch.guarded(rows, doubled, "twice double").collect()}
    assert got == {i: (2.0 * i, None) if i != 7 else (None, "ValueError: negative") for i in range(20)}


def test_stream_stops_on_errors_and_goes_on_after(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))

    def add(values):
        spark.createDataFrame([(v, float(v)) for v in values], "id long, v double").coalesce(1).write.mode("append").parquet(source)

    def run(work, most):
        watch.work_stream(spark.readStream.schema("id long, v double").parquet(source), work, "twice double", out, marks, most).awaitTermination()

    add([1, -2, 3])
    run(doubled, 1)
    add([-4, 5])
    with pytest.raises(StreamingQueryException, match="2 errors"):
        run(doubled, 1)
    run(mended, 1)
    got = {r.id: (r.twice, r.error is None) for r in spark.read.parquet(out).collect()}
    assert got == {1: (2.0, True), -2: (None, False), 3: (6.0, True), -4: (8.0, True), 5: (10.0, True)}
