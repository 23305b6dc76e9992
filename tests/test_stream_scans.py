"""Scans of text as streams against the same scans of all files."""

import json

from driftledger.sources import formats
from driftledger.streaming import flows


def test_event_log_as_a_stream(spark, tmp_path):
    schema = "sequence long, event string"
    for k in range(12):
        lines = [json.dumps({"sequence": 10 * k + i, "event": "e"}) for i in range(3)] + ["{broken %d" % k, ""]
        (tmp_path / f"{k}.json").write_text("\n".join(lines))
    batch = formats.scan_event_log(spark, str(tmp_path), schema)
    stream = flows.drained(formats.scan_event_log(spark, str(tmp_path), schema, stream=True).coalesce(1), "log").drop("batch")
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(stream) == rows(batch)
    good, broken = formats.told_apart(stream)
    assert good.count() == 36 and good.columns == ["sequence", "event"]
    assert sorted(r[0] for r in broken.collect()) == sorted("{broken %d" % k for k in range(12))


def test_counters_as_a_stream(spark, tmp_path):
    for k in range(9):
        (tmp_path / f"{k}.txt").write_text(f"# s{k} named\n rx: {k}\n tx: 2\n\n# t{k} softnet\n0a 1 2\n")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(flows.drained(formats.scan_counters(spark, str(tmp_path), stream=True), "c").drop("batch")) == rows(formats.scan_counters(spark, str(tmp_path)))


def test_presence_of_logs_is_told_as_files_arrive(spark, tmp_path):
    paths = [f"{tmp_path}/{n}" for n in ("summary", "events", "samples")]
    for path in paths:
        (tmp_path / path.rsplit("/", 1)[1]).mkdir()
    schemas = ("run long, bytes long", "run long, event string", "run long, value long")
    (tmp_path / "summary/a.csv").write_text("run,bytes\n1,5\n2,5\n")
    (tmp_path / "events/a.json").write_text('{"run": 1, "event": "x"}\n{"run": 3, "event": "x"}\n')
    (tmp_path / "samples/a.csv").write_text("run,value\n1,5\n2,6\n")
    logs = formats.logs_present(formats.scan_sched_logs(spark, *paths, schemas, stream=True))
    base = f"{tmp_path}/out"

    def drain():
        seen = []
        query = logs.writeStream.outputMode("update").option("checkpointLocation", base).trigger(availableNow=True).foreachBatch(lambda b, n: seen.extend(b.collect())).start()
        query.awaitTermination()
        return {r.run: (r.logs, r.all_present) for r in seen}

    assert drain() == {1: (7, True), 2: (5, False), 3: (2, False)}
    (tmp_path / "events/b.json").write_text('{"run": 2, "event": "y"}\n')
    assert drain() == {2: (7, True)}
    assert {r.run: r.all_present for r in formats.logs_present(formats.scan_sched_logs(spark, *paths, schemas)).collect()} == {1: True, 2: True, 3: False}
