"""Label streams: verdicts, replays, and a restart that gives the rows of one run."""

import random

import pytest

from lodestar.streaming import labelling

SCHEMA = "item long, n long, label string"


def force(files):
    state, out = {}, []
    for rows in files:
        for item, n, label in sorted(rows, key=lambda r: (r[0], r[1])):
            seen, now, accepted, broken = state.get(item, (None, None, 0, False))
            before = now
            if seen is not None and n <= seen:
                status, reason = "replayed", "seen before"
            elif label not in ("0", "1", "2"):
                status, reason, broken = "invalid", "no label" if label is None else f"unknown label {label}", True
            else:
                status, reason, now, accepted = "accepted", None, label, accepted + 1
            state[item] = (n if seen is None else max(seen, n), now, accepted, broken)
            out.append((item, n, status, reason, before, accepted, not broken))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def files():
    rng = random.Random(3)
    counters = dict.fromkeys(range(6), 0)
    out = []
    for _ in range(4):
        rows = []
        for _ in range(25):
            item = rng.choice([0, 0, 0, 1, 2, 3, 4, 5])
            counters[item] += 1
            rows.append((item, counters[item] - (2 if rng.random() < 0.1 else 0), rng.choice(["0", "1", "2", "1", "7", None])))
        out.append(rows)
    out[2] += out[1][:5]  # sent twice
    return out


def put(spark, files, folder, start=0):
    for i, rows in enumerate(files, start):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={i}")


def run(spark, folder, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    return sorted(str(tuple(r)) for r in labelling.judged(stream, "item", "n", "label", ["0", "1", "2"], out).collect())


def test_a_restart_gives_the_rows_of_one_run(spark, files, tmp_path):
    whole, halves = str(tmp_path / "whole"), str(tmp_path / "halves")
    put(spark, files, whole)
    one = run(spark, whole, str(tmp_path / "out1"))
    put(spark, files[:2], halves)
    first = run(spark, halves, str(tmp_path / "out2"))
    put(spark, files[2:], halves, 2)
    again = run(spark, halves, str(tmp_path / "out2"))
    assert len(first) == 50 and set(first) <= set(again)
    assert again == one == force(files)
    assert run(spark, halves, str(tmp_path / "out2")) == one  # nothing new, nothing twice
    assert labelling.PROVIDER not in spark.conf.getAll or spark.conf.get(labelling.PROVIDER) != labelling.ROCKS
