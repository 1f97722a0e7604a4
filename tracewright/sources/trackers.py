"""Readers of what run trackers leave behind: numbered observer folders, pipeline files with a lock, and binary run logs.

Files are read by Spark and joined by path, so a store of any size is one scan and one shuffle. Only formats that Spark has
no reader for (indented pipeline files, the binary log) are decoded in Arrow batches, one file at a time.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.sources.artifacts import METRIC, _parsed, finite


def _whole(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, dir, file, value of whole text files."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(path, r"([^/]*)$", 1).alias("file"), "value")


# ---- numbered observer folders (run.json, metrics.json, config.json) ---------
SERIES = "MAP<STRING, STRUCT<steps: ARRAY<BIGINT>, values: ARRAY<DOUBLE>>>"
OBSERVED = "experiment STRUCT<name: STRING>, status STRING, start_time STRING, stop_time STRING, result STRING"


def read_sacred(spark: SparkSession, folder: str) -> DataFrame:
    """run, family, started, config, metric, step, value. Completed runs only: a crash is no measurement. Of a series the last value
    counts if it is finite; the run's own result is the metric "result", and its duration wall_time_s. A run that measured
    nothing has no row."""
    files = _whole(spark, folder, "*.json").filter(F.col("dir").rlike(r"/sacred_runs/[^/]+$") & F.col("file").isin("run.json", "metrics.json", "config.json"))
    body = lambda name: F.max(F.when(F.col("file") == name, F.col("value")))
    runs = files.groupBy("dir").agg(body("run.json").alias("run"), body("metrics.json").alias("series"), body("config.json").alias("config"))
    runs = runs.select("dir", "config", F.from_json("run", OBSERVED).alias("r"), F.map_entries(F.from_json("series", SERIES)).alias("series"))
    runs = runs.filter("r.status = 'COMPLETED' AND r.experiment.name <> ''")
    cell = lambda m, k, v: F.struct(m.cast("string").alias("metric"), k.cast("long").alias("step"), finite(v).alias("value"))
    null = F.lit(None)
    points = F.transform(F.coalesce("series", F.array()), lambda e: cell(e["key"], F.try_element_at(e["value"]["steps"], F.lit(-1)), F.try_element_at(e["value"]["values"], F.lit(-1))))
    measured = F.filter(F.concat(points, F.array(cell(F.lit("result"), null, F.col("r.result").try_cast("double")))), lambda m: m["value"].isNotNull())
    seconds = F.col("r.stop_time").try_cast("timestamp").cast("double") - F.col("r.start_time").try_cast("timestamp").cast("double")
    wall = F.filter(F.array(cell(F.lit("wall_time_s"), null, F.when(seconds >= 0, seconds))), lambda m: m["value"].isNotNull())
    out = runs.withColumn("measured", measured).filter(F.size("measured") > 0).select("*", F.explode(F.concat("measured", wall)).alias("m"))
    return out.select(F.concat_ws("/", "r.experiment.name", F.regexp_extract("dir", r"([^/]+)$", 1)).alias("run"), F.col("r.experiment.name").alias("family"), F.col("r.start_time").alias("started"), "config", "m.*")


# ---- pipeline files ------------------------------------------------------------
def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [p.strip().strip("'\"") for p in text[1:-1].split(",") if p.strip()]
    return text.strip("'\"")


def load_indented(text: str):
    """Mappings, lists and scalars of an indented file as dicts, lists and text; scalars keep their spelling (1 isn't 1.0).
    Anchors, quoted colons and block scalars aren't understood."""
    lines = []
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if line.strip() and not line.lstrip().startswith("#") and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(i: int, depth: int):
        node: dict | list = [] if lines[i][1].startswith("- ") or lines[i][1] == "-" else {}
        while i < len(lines) and lines[i][0] == depth:
            line = lines[i][1]
            if isinstance(node, list):
                if not line.startswith("-"):
                    break
                item = line[1:].strip()
                inner = item.split(": ", 1) if ": " in item else [item[:-1], ""] if item.endswith(":") else None
                if inner is None:
                    node.append(_scalar(item))
                    i += 1
                else:  # a mapping that begins on the dash's own line
                    lines[i] = (depth + len(line) - len(item), item)
                    value, i = block(i, lines[i][0])
                    node.append(value)
                continue
            key, _, rest = line.partition(":")
            key, i = key.strip().strip("'\""), i + 1
            if rest.strip():
                node[key] = _scalar(rest)
            elif i < len(lines) and (lines[i][0] > depth or (lines[i][0] == depth and lines[i][1].startswith("- "))):
                node[key], i = block(i, lines[i][0])
            else:
                node[key] = None
        while i < len(lines) and lines[i][0] > depth:  # what is indented against the rules
            i += 1
        return node, i

    return block(0, lines[0][0])[0] if lines else {}


def stage_instances(pipeline: str, params: str, lock: str) -> list[dict]:
    """instance, family, metric file, settings and recorded digest of every stage with metrics; foreach stages once per item, and
    the item's setting is the item itself, as the lock repeats the whole list."""
    stages = load_indented(pipeline or "").get("stages") or {}
    top = load_indented(params or "")
    locked = load_indented(lock or "").get("stages") or {}
    top = top if isinstance(top, dict) else {}
    out = []
    for name, stage in sorted(stages.items()):
        body = (stage or {}).get("do") or stage or {}
        loop = str(stage.get("foreach") or "").strip("${}") if isinstance(stage, dict) and isinstance(stage.get("foreach"), str) else None
        items = top.get(loop, []) if loop else stage.get("foreach") if isinstance(stage, dict) and stage.get("foreach") else [None]
        files = [next(iter(m)) if isinstance(m, dict) else m for m in body.get("metrics") or []]
        for item in items if isinstance(items, list) else [items]:
            instance = name if item is None else f"{name}@{item}"
            record = locked.get(instance) or {}
            used = (record.get("params") or {}).get("params.yaml") or {}
            config = {k: v for k, v in used.items() if isinstance(v, str)}
            config = {k: top[k] for k in body.get("params") or [] if isinstance(k, str) and isinstance(top.get(k), str)} | config | ({loop: item} if loop and item is not None else {})
            digests = {o.get("path"): o.get("md5") for o in record.get("outs") or [] if isinstance(o, dict)}
            for file in files:
                file = file.replace("${item}", item or "")
                out.append({"instance": instance, "family": None if item is None else name, "file": file, "config": json.dumps(config, sort_keys=True), "md5": digests.get(file)})
    return out


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


TEXT, WHOLE, REAL = T.StringType(), T.LongType(), T.DoubleType()
INSTANCES = T.ArrayType(_struct(instance=TEXT, family=TEXT, file=TEXT, config=TEXT, md5=TEXT))


@F.pandas_udf(INSTANCES)
def _instances(pipeline: pd.Series, params: pd.Series, lock: pd.Series) -> pd.Series:
    return pd.Series([stage_instances(*row) for row in zip(pipeline, params, lock, strict=True)])


@F.pandas_udf(METRIC)
def _payload(body: pd.Series) -> pd.Series:
    return body.map(lambda b: _parsed(b)[0])


def read_dvc(spark: SparkSession, folder: str) -> DataFrame:
    """project, run, family, config, metric, step, split, value, changed: metrics that pipeline stages declare and that exist. changed:
    the file no longer has the digest that the lock recorded; its value is read all the same."""
    project = _whole(spark, folder, "{dvc.yaml,params.yaml,dvc.lock}")
    body = lambda name: F.max(F.when(F.col("file") == name, F.col("value")))
    roots = project.groupBy("dir").agg(body("dvc.yaml").alias("p"), body("params.yaml").alias("t"), body("dvc.lock").alias("k")).filter("p IS NOT NULL")
    stages = roots.select("dir", F.explode(_instances("p", "t", "k")).alias("s")).select("dir", "s.*").withColumn("path", F.concat_ws("/", "dir", "file"))
    found = _whole(spark, folder, "*.json*").select("path", "value")
    hits = stages.join(found, "path").withColumn("changed", F.coalesce(F.md5(F.col("value").cast("binary")) != F.col("md5"), F.lit(False)))
    out = hits.select(F.regexp_extract("dir", r"([^/]+)$", 1).alias("project"), F.col("instance").alias("run"), "family", "config", "changed", F.explode(_payload("value")).alias("m"))
    return out.select("project", "run", "family", "config", "m.*", "changed")


# ---- binary run logs -----------------------------------------------------------
# The log's framing (a LevelDB log with its own file header) and the field numbers of its messages.
HEADER, FRAME, BLOCK = b":W&B\xe1\xbe\x00", struct.Struct("<IHB"), 32768
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
HISTORY, SUMMARY, CONFIG, RUN, EXIT = 2, 3, 5, 17, 18
RUN_ID, RUN_PROJECT, RUN_CONFIG, RUN_SUMMARY, RUN_NAME = 1, 3, 4, 5, 8
KEY, NESTED_KEY, VALUE_JSON = 1, 2, 16


class DamagedLog(ValueError):
    """A log whose bytes can't be trusted."""


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, bytes) of the log's fragments; ends quietly where the file is cut, and raises where it is wrong."""
    if not data.startswith(HEADER):
        raise DamagedLog("no run log")
    at = len(HEADER)
    while at < len(data):
        room = BLOCK - at % BLOCK
        if room < FRAME.size:  # the rest of a block too short for a frame is zeros
            if any(data[at : at + room]):
                raise DamagedLog(f"padding at {at} isn't zero")
            at += room
            continue
        if at + FRAME.size > len(data):
            return
        check, size, kind = FRAME.unpack_from(data, at)
        part = data[at + FRAME.size : at + FRAME.size + size]
        if len(part) < size:
            return
        if not FULL <= kind <= LAST or zlib.crc32(bytes([kind]) + part) != check:
            raise DamagedLog(f"frame at {at} doesn't check")
        yield kind, part
        at += FRAME.size + size


def messages(data: bytes) -> Iterator[bytes]:
    """Whole messages; fragments must follow each other in order."""
    open_parts: list[bytes] = []
    for kind, part in frames(data):
        if (kind in (FULL, FIRST)) == bool(open_parts):
            raise DamagedLog("fragments out of order")
        open_parts.append(part)
        if kind in (FULL, LAST):
            yield b"".join(open_parts)
            open_parts = []


def wire(message: bytes) -> dict[int, list]:
    """Values of a protobuf message by field number: integers, or bytes of what has a length or a fixed width."""

    def varint(i: int) -> tuple[int, int]:
        n = 0
        for shift in range(0, 70, 7):
            if i >= len(message):
                break
            n |= (message[i] & 127) << shift
            i += 1
            if message[i - 1] < 128:
                return n, i
        raise DamagedLog("number doesn't end")

    out: dict[int, list] = {}
    i = 0
    while i < len(message):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind in (1, 2, 5):
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = message[i : i + size], i + size
            if i > len(message):
                raise DamagedLog("field runs past its message")
        else:
            raise DamagedLog(f"wire type {kind}")
        out.setdefault(tag >> 3, []).append(value)
    return out


def _items(record: bytes, field: int = 1) -> Iterator[tuple[list[str], object]]:
    """(path of keys, value) of the items of a record; a field that isn't there yields none."""
    for raw in wire(record).get(field, []):
        item = wire(raw)
        path = [k.decode() for k in item.get(NESTED_KEY, [])] or [item.get(KEY, [b""])[-1].decode()]
        text = item.get(VALUE_JSON, [b"null"])[-1]
        yield path, json.loads(text)


def _apply(target: dict, record: bytes) -> None:
    for path, value in _items(record):
        node = target
        for key in path[:-1]:
            if not isinstance(node.get(key), dict):
                node[key] = {}
            node = node[key]
        node[path[-1]] = value
    for path, _ in _items(record, 2):
        node = target
        for key in path[:-1]:
            node = node.get(key) if isinstance(node, dict) else None
        if isinstance(node, dict):
            node.pop(path[-1], None)


def numbers_of(node: dict, prefix: str = "") -> list[tuple[str, float]]:
    """Dotted names and numbers; bookkeeping (a leading underscore) and media objects (a _type) are left out."""
    out = []
    for key, value in sorted(node.items()):
        if key.startswith("_"):
            continue
        if isinstance(value, dict) and "_type" not in value:
            out += numbers_of(value, f"{prefix}{key}.")
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            out.append((prefix + key, float(value)))
    return out


def decode_log(data: bytes) -> dict:
    """run_id, project, name, config, summary (JSON), exit_code, points (metric, step, value) and problem of a log."""
    run = {"run_id": None, "project": None, "name": None, "exit_code": None, "points": [], "problem": None}
    config: dict = {}
    summary: dict = {}
    n = 0
    try:
        for message in messages(data):
            record = wire(message)
            for raw in record.get(RUN, []):
                own = wire(raw)
                for name, field in (("run_id", RUN_ID), ("project", RUN_PROJECT), ("name", RUN_NAME)):
                    run[name] = own.get(field, [b""])[-1].decode() or run[name]
                for target, field in ((config, RUN_CONFIG), (summary, RUN_SUMMARY)):
                    for part in own.get(field, []):
                        _apply(target, part)
            for target, field in ((config, CONFIG), (summary, SUMMARY)):
                for part in record.get(field, []):
                    _apply(target, part)
            for raw in record.get(HISTORY, []):
                row: dict = {}
                for path, value in _items(raw):
                    node = row
                    for key in path[:-1]:
                        node = node.setdefault(key, {})
                    node[path[-1]] = value
                given = [v for s in wire(raw).get(2, []) for v in wire(s).get(1, [0])]
                step = row["_step"] if isinstance(row.get("_step"), int) and row["_step"] >= 0 else given[-1] if given else n
                run["points"] += [{"metric": m, "step": step, "value": v} for m, v in numbers_of(row)]
                n += 1
            for raw in record.get(EXIT, []):
                run["exit_code"] = wire(raw).get(1, [0])[-1]
    except (DamagedLog, ValueError, AttributeError) as error:
        run["points"], run["problem"] = [], str(error) or type(error).__name__
    return run | {"config": json.dumps(config, sort_keys=True), "summary": json.dumps(summary, sort_keys=True)}


LOG = _struct(run_id=TEXT, project=TEXT, name=TEXT, config=TEXT, summary=TEXT, exit_code=WHOLE, points=T.ArrayType(_struct(metric=TEXT, step=WHOLE, value=REAL)), problem=TEXT)


@F.pandas_udf(LOG)
def _decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_log(bytes(b)) for b in content], columns=LOG.fieldNames()).astype({"exit_code": "Int64"})


def read_wandb(spark: SparkSession, folder: str) -> DataFrame:
    """path and the decoded log of every *.wandb file; a damaged one keeps its problem and gives no points."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wandb").load(folder)
    return files.select("path", _decoded("content").alias("l")).select("path", "l.*")


def wandb_points(logs: DataFrame) -> DataFrame:
    """path, run_id, metric, step, value of the finite points of logs."""
    return logs.select("path", "run_id", F.explode("points").alias("p")).select("path", "run_id", "p.metric", "p.step", finite(F.col("p.value")).alias("value")).filter("value IS NOT NULL")


def final_values(points: DataFrame, *keys: str) -> DataFrame:
    """The value at the greatest step of each metric."""
    return points.groupBy(*keys, "metric").agg(F.max_by("value", F.struct("step", "value")).alias("value"))


def duration(start: Column, stop: Column) -> Column:
    """Seconds between two ISO timestamps or numbers of epoch milliseconds; null where one is missing, mixed or later than the other."""

    def seconds(c):
        return F.coalesce(c.try_cast("long") / 1000.0, c.try_cast("timestamp").cast("double"))

    took = seconds(stop) - seconds(start)
    return F.when((took >= 0) & (start.try_cast("long").isNull() == stop.try_cast("long").isNull()), took)
