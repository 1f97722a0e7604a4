"""Tracker readers on small stores written here."""

import hashlib
import json
import struct
import zlib

from pyspark.sql import functions as F

from tests.test_sources import put
from tracewright.sources import trackers as T


def test_sacred(spark, tmp_path):
    base = "sacred_runs/1"
    put(tmp_path, f"{base}/run.json", json.dumps({"experiment": {"name": "exp"}, "status": "COMPLETED", "start_time": "2026-01-01T00:00:00", "stop_time": "2026-01-01T00:00:30", "result": 0.5}))
    put(tmp_path, f"{base}/metrics.json", json.dumps({"loss": {"steps": [0, 10], "values": [3.0, 2.0]}, "bad": {"steps": [1], "values": [float("nan")]}, "none": {"steps": [], "values": []}}))
    put(tmp_path, f"{base}/config.json", '{"lr": 0.1}')
    put(tmp_path, "sacred_runs/2/run.json", json.dumps({"experiment": {"name": "exp"}, "status": "FAILED", "result": 1.0}))
    put(tmp_path, "sacred_runs/3/run.json", json.dumps({"experiment": {"name": "exp"}, "status": "COMPLETED", "start_time": "2026-01-01T00:00:00", "stop_time": "2026-01-01T00:00:30"}))
    rows = T.read_sacred(spark, str(tmp_path)).collect()
    assert {(r.run, r.family, r.metric, r.step, r.value) for r in rows} == {("exp/1", "exp", "loss", 10, 2.0), ("exp/1", "exp", "result", None, 0.5), ("exp/1", "exp", "wall_time_s", None, 30.0)}


def test_indented():
    text = "a: 1\nb: [x, 2]  # c\nc:\n  - one\n  - k: v\n    w: 2\n  - last:\n      deep: 1\nd:\n- p\n- q\ne:\n"
    assert T.load_indented(text) == {"a": "1", "b": ["x", "2"], "c": ["one", {"k": "v", "w": "2"}, {"last": {"deep": "1"}}], "d": ["p", "q"], "e": None}
    assert T.load_indented("") == {}


def test_dvc(spark, tmp_path):
    put(tmp_path, "p/dvc.yaml", "stages:\n  prepare:\n    cmd: x\n  train:\n    foreach: ${lr}\n    do:\n      cmd: t\n      params: [lr, epochs]\n      metrics:\n        - m/${item}.json:\n            cache: false\n  final:\n    metrics: [f.json]\n")
    put(tmp_path, "p/params.yaml", "lr: [0.1, 1, 10]\nepochs: 3\n")
    put(tmp_path, "p/m/0.1.json", '{"loss": 0.5}')
    put(tmp_path, "p/m/1.json", '{"loss": 0.7}')
    put(tmp_path, "p/f.json", '{"acc": 0.9}')
    good = hashlib.md5(b'{"loss": 0.5}').hexdigest()
    put(tmp_path, "p/dvc.lock", f"stages:\n  train@0.1:\n    params:\n      params.yaml:\n        epochs: 4\n        lr:\n        - 0.1\n        - 1\n    outs:\n    - path: m/0.1.json\n      md5: {good}\n  train@1:\n    outs:\n    - path: m/1.json\n      md5: 00\n")
    rows = {r.run: r for r in T.read_dvc(spark, str(tmp_path)).collect()}
    assert set(rows) == {"train@0.1", "train@1", "final"}
    a, b, c = rows["train@0.1"], rows["train@1"], rows["final"]
    assert (a.family, a.metric, a.value, a.changed, json.loads(a.config)) == ("train", "loss", 0.5, False, {"epochs": "4", "lr": "0.1"})
    assert (b.changed, json.loads(b.config)) == (True, {"epochs": "3", "lr": "1"}) and (c.family, c.value, c.project) == (None, 0.9, "p")


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def item(key, value):
    names = [field(2, k.encode()) for k in key] if isinstance(key, tuple) else [field(1, key.encode())]
    return field(1, b"".join(names) + field(16, json.dumps(value).encode()))


def log_of(messages):
    data = T.HEADER
    for m in messages:
        first = True
        while True:
            room = T.BLOCK - len(data) % T.BLOCK
            if room < 7:
                data += bytes(room)
                continue
            part, m = m[: room - 7], m[room - 7 :]
            kind = (T.FULL if first else T.LAST) if not m else T.FIRST if first else T.MIDDLE
            data += struct.pack("<IHB", zlib.crc32(bytes([kind]) + part), len(part), kind) + part
            first = False
            if not m:
                break
    return data


def test_wandb(spark, tmp_path):
    run = field(17, field(1, b"r1") + field(3, b"proj") + field(4, item("lr", 0.1) + item(("opt", "name"), "adam")))
    rows = [field(2, item("_step", k) + item("loss", 1.0 / (k + 1)) + item(("val", "acc"), float("nan") if k else 0.5) + item("note", "n" * 40_000)) for k in range(3)]
    data = log_of([run, *rows, field(3, item("loss", 0.25)), field(18, b"")])
    for name, body in (("ok", data), ("cut", data[:-3]), ("bad", data[:20] + b"x" + data[21:]), ("none", b"hello")):
        (tmp_path / f"{name}.wandb").write_bytes(body)
    logs = T.read_wandb(spark, str(tmp_path)).cache()
    got = {r.path.rsplit("/", 1)[1]: r for r in logs.collect()}
    assert (got["ok.wandb"].run_id, got["ok.wandb"].project, got["ok.wandb"].exit_code, got["ok.wandb"].problem) == ("r1", "proj", 0, None)
    assert json.loads(got["ok.wandb"].config) == {"lr": 0.1, "opt": {"name": "adam"}} and json.loads(got["ok.wandb"].summary) == {"loss": 0.25}
    assert got["cut.wandb"].exit_code is None and len(got["cut.wandb"].points) == 6
    assert got["bad.wandb"].problem and got["none.wandb"].problem and not got["bad.wandb"].points
    points = T.wandb_points(logs.filter("path LIKE '%ok.wandb'"))
    assert {(r.metric, r.step, r.value) for r in points.collect()} == {("loss", 0, 1.0), ("loss", 1, 0.5), ("loss", 2, 1 / 3), ("val.acc", 0, 0.5)}
    assert {(r.metric, r.value) for r in T.final_values(points, "run_id").collect()} == {("loss", 1 / 3), ("val.acc", 0.5)}


def test_duration(spark):
    rows = [("2026-01-01T00:00:00Z", "2026-01-01T00:01:00Z"), ("1000", "3500"), ("2026-01-01T00:00:00Z", None), ("5", "2026-01-01T00:00:00Z"), ("9", "1")]
    got = spark.createDataFrame(rows, "a string, b string").select(T.duration(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [60.0, 2.5, None, None, None]
