"""Strict JSON lines with their places, and traces from a stream that replays and comes late."""

import json
import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ragloom.sources.jsonl import checked_jsonl, read_jsonl
from ragloom.streaming.traces import merged, read_state, slots, trace_sink, traces

SCHEMA = StructType([StructField("id", LongType(), False), StructField("name", StringType(), True)])


def test_problems_carry_file_and_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "x"}\n\n# note\n{"id": "no", "name": "x"}\n{"id": 2}\n')
    (tmp_path / "b.jsonl").write_text('[1]\n{"name": "x"}\n{"id": 3, "other": 1}\n{"id": 4\n{"id": 5, "name": null}')
    rows = checked_jsonl(spark, str(tmp_path), SCHEMA).collect()
    bad = {(r.path.rsplit("/", 1)[1], r.line): r.problem for r in rows if r.problem}
    assert {k: v.split()[0] for k, v in bad.items()} == {("a.jsonl", 4): "a", ("b.jsonl", 1): "no", ("b.jsonl", 2): "no", ("b.jsonl", 3): "unknown", ("b.jsonl", 4): "no"}
    assert bad["b.jsonl", 2] == "no value for id" and bad["b.jsonl", 3] == "unknown field other"
    assert sorted((r.row.id, r.row.name) for r in rows if not r.problem) == [(1, "x"), (2, None), (5, None)]
    with pytest.raises(Exception, match=r"[ab]\.jsonl:\d+: "):
        read_jsonl(spark, str(tmp_path), SCHEMA).collect()
    assert {r.id for r in read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, name string").collect()} == {"1", "no", "2"}


def test_lines_of_a_file_in_many_blocks_keep_their_numbers(spark, tmp_path):
    n = 3000
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"id": i, "name": "x" * (i % 50)}) + "\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = checked_jsonl(spark, str(tmp_path), SCHEMA).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n and all(r.line == r.row.id and r.problem is None for r in rows)


EVENTS = [(f"t{i % 7}", kind, step, seq, f"{kind}{seq}") for seq, (i, kind, step) in enumerate((random.Random(s).randrange(7), random.Random(s + 1).choice(["create", "append", "append", "complete", "finish"]), random.Random(s + 2).randrange(3)) for s in range(0, 240, 3))]
EVENT = "trace_id string, kind string, step int, seq long, payload string"


def plain(events):
    """The events one by one, in order."""
    state = {}
    for t, kind, step, seq, payload in sorted(events, key=lambda e: e[3]):
        trace = state.setdefault(t, {"created": None, "steps": {}, "finished": None})
        if kind == "create":
            trace["created"] = trace["created"] or payload
        elif kind == "append":
            trace["steps"].setdefault(step, (False, payload))
        elif kind == "complete":
            trace["steps"][step] = (True, payload)
        else:
            trace["finished"] = payload
    return {t: (x["created"], [(s, *x["steps"][s]) for s in sorted(x["steps"])], x["finished"]) for t, x in state.items() if x["created"]}


def collected(state):
    return {r.trace_id: (r.created, [tuple(s) for s in r.steps], r.finished) for r in traces(state).collect()}


def test_any_order_and_any_repeat_end_the_same(spark):
    want = plain(EVENTS)
    assert len(want) > 3
    for seed in range(3):
        shuffled = random.Random(seed).sample(EVENTS, len(EVENTS)) + EVENTS[:9]
        half = len(shuffled) // 2
        parts = [slots(spark.createDataFrame(x, EVENT)) for x in (shuffled[:half], shuffled[half:])]
        assert collected(merged(merged(parts[0]), parts[1])) == want


def test_a_stream_of_batches_and_a_replayed_one(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    late = random.Random(5).sample(EVENTS, len(EVENTS))
    names = EVENT.replace(" string", "").replace(" int", "").replace(" long", "").split(", ")
    for n in range(3):
        (source / f"{n}.json").write_text("".join(json.dumps(dict(zip(names, e))) + "\n" for e in late[n::3]))

    def run():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(source))
        stream.writeStream.foreachBatch(trace_sink(folder)).option("checkpointLocation", str(tmp_path / "done")).trigger(availableNow=True).start().awaitTermination(120)

    run()
    assert collected(read_state(spark, folder)) == plain(EVENTS)
    last = spark.read.schema(EVENT).json(str(source / "2.json"))
    before = sorted(map(tuple, read_state(spark, folder).collect()), key=repr)
    trace_sink(folder)(last, 2)
    assert sorted(map(tuple, read_state(spark, folder).collect()), key=repr) == before
    run()
    assert sorted(map(tuple, read_state(spark, folder).collect()), key=repr) == before
    trace_sink(folder)(last.limit(0), 7)
    assert read_state(spark, str(tmp_path / "none")) is None
