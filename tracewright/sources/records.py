"""Run records, job states, dataset records and histories of a project folder, and readers that users add.

Files are read whole and parsed by Spark's own JSON; what a record must hold is checked by expressions, so a bad one is a row with reasons
(``quarantined``) and never an error, nor mended.

The formats' tags are ``<prefix>.run/1`` and so on, and records may lie in a folder of that name within a run's folder: the prefix is the caller's.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.shared import settled
from tracewright.sources import artifacts, trackers

# Names, versions and members of the formats.
RUN = """schema string, run_id string, family string, arm string, status string, started_at string, finished_at string,
    producer struct<name: string, version: string>, code struct<git_sha: string, dirty: boolean, repo: string, version: string, provenance: string, evidence: string>,
    config variant, data array<struct<name: string, sha256: string, role: string>>,
    metrics array<struct<name: string, value: double, direction: string, step: bigint, split: string, unit: string, labels: map<string, string>>>,
    history struct<path: string, sha256: string, series: bigint, points: bigint>, seeds variant,
    dependencies array<struct<name: string, version: string, build_sha: string, dirty: boolean, provenance: string, evidence: string, source: string>>, ext variant"""
STATE = "schema string, run_id string, backend string, job_id string, state string, updated_at string, message string, history array<struct<state: string, at: string>>"
DATASET = """schema string, dataset_id string, name string, version string, created_at string, content_sha256 string, rows bigint, license string,
    files array<struct<path: string, bytes: bigint, media_type: string, sha256: string>>, columns array<struct<name: string, type: string, unit: string>>,
    source_runs array<struct<run_id: string, sha256: string>>"""
STAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"
SHA256 = "^[0-9a-f]{64}$"
MOVES = {"submitted": ("running", "failed", "cancelled"), "running": ("complete", "failed", "cancelled")}
STATES = ("submitted", "running", "complete", "failed", "cancelled")


def _run_dir(prefix: str) -> Column:
    return F.regexp_replace("file_path", rf"/(?:{prefix}/)?[^/]+$", "")


def _files(spark: SparkSession, root: str, prefix: str, name: str, schema: str) -> DataFrame:
    """path, run_dir, record (null where it isn't JSON of this form)."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True).select("value", "_metadata.file_path")
    folder = _run_dir(prefix)
    good = F.try_parse_json("value").isNotNull()
    return raw.select(F.col("file_path").alias("path"), folder.alias("run_dir"), F.when(good, F.from_json("value", schema)).alias("record"))


def _checked(files: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """files with reasons: what each record breaks; a file that can't be parsed breaks one."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(said)) for holds, said in rules]))
    return files.withColumn("reasons", F.when(F.col("record").isNull(), F.array(F.lit("read: no JSON object"))).otherwise(broken))


def _text(c: str) -> tuple[Column, str]:
    return F.trim(F.col(f"record.{c}")) != "", f"{c}: a text is expected"


def _all(c: str, test: Callable[[Column], Column]) -> Column:
    return F.forall(F.coalesce(F.col(f"record.{c}"), F.array()), lambda x: F.coalesce(test(x), F.lit(False)))


def run_records(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """path, run_dir, record and reasons of every run.json below root."""
    r = lambda c: F.col(f"record.{c}")
    finite = lambda m: (m["name"] != "") & ~F.isnan(m["value"]) & (F.abs(m["value"]) < float("inf"))
    rules = [
        (r("schema") == f"{prefix}.run/1", f"schema: {prefix}.run/1 is expected"),
        _text("run_id"), _text("family"), _text("arm"),
        (r("status").isNull() | r("status").isin("complete", "failed", "cancelled"), "status: complete, failed or cancelled is expected"),
        (r("started_at").rlike(STAMP) & r("finished_at").rlike(STAMP), "started_at, finished_at: UTC times are expected"),
        (r("started_at") <= r("finished_at"), "finished_at: before started_at"),
        (_all("metrics", finite), "metrics: a name and a finite value are expected"),
        (_all("metrics", lambda m: m["direction"].isNull() | m["direction"].isin("min", "max")), "metrics: direction is min, max or absent"),
        (_all("data", lambda d: d["sha256"].rlike(SHA256)), "data: a SHA-256 is expected"),
        (r("history").isNull() | r("history.sha256").rlike(SHA256), "history: a SHA-256 is expected"),
    ]
    return _checked(_files(spark, root, prefix, "run.json", RUN), rules)


def state_files(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """path, run_dir, record and reasons of every state.json: moves must be allowed, times must not go back, and the last entry is the state."""
    h = F.coalesce(F.col("record.history"), F.array())
    pairs = F.arrays_zip(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))).alias("a"), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))).alias("b"))
    allowed = lambda p: reduce(lambda x, y: x | y, [(p["a"]["state"] == a) & p["b"]["state"].isin(*b) for a, b in MOVES.items()])
    last = F.try_element_at(h, F.lit(-1))
    rules = [
        (F.col("record.schema") == f"{prefix}.state/1", f"schema: {prefix}.state/1 is expected"),
        _text("run_id"), _text("backend"), _text("job_id"),
        (F.col("record.state").isin(*STATES), "state: unknown"),
        (F.try_element_at(h, F.lit(1))["state"] == "submitted", "history: it starts at submitted"),
        (F.forall(h, lambda e: e["at"].rlike(STAMP)), "history: UTC times are expected"),
        (F.forall(pairs, lambda p: F.coalesce(allowed(p), F.lit(False))), "history: a move that isn't allowed"),
        (F.forall(pairs, lambda p: p["b"]["at"] >= p["a"]["at"]), "history: it goes back in time"),
        ((last["state"] == F.col("record.state")) & (last["at"] == F.col("record.updated_at")), "history: the last entry is the state, at updated_at"),
    ]
    return _checked(_files(spark, root, prefix, "state.json", STATE), rules)


def dataset_records(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """path, run_dir, record and reasons of every dataset.json."""
    r = lambda c: F.col(f"record.{c}")
    rules = [
        (r("schema") == f"{prefix}.dataset/1", f"schema: {prefix}.dataset/1 is expected"),
        _text("dataset_id"), _text("name"),
        (r("created_at").rlike(STAMP), "created_at: a UTC time is expected"),
        (r("content_sha256").rlike(SHA256), "content_sha256: a SHA-256 is expected"),
        (r("rows").isNull() | (r("rows") >= 0), "rows: negative"),
        (_all("files", lambda f: f["sha256"].rlike(SHA256) & (f["bytes"] >= 0) & ~f["path"].rlike(r"^/|(^|/)\.\.(/|$)")), "files: a SHA-256, a size and a path within the folder are expected"),
        (F.size(F.array_distinct(F.transform(F.coalesce(r("files"), F.array()), lambda f: f["path"]))) == F.size(F.coalesce(r("files"), F.array())), "files: a path twice"),
    ]
    return _checked(_files(spark, root, prefix, "dataset.json", DATASET), rules)


def histories(spark: SparkSession, root: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(points: run_dir, series, name, split, step, value, at; broken: run_dir, line, reason) of every history.jsonl below root.

    A line is a header, a series or a point. A point of a series that isn't declared, a step that doesn't rise or a line that isn't JSON breaks the file; its other lines are given all the same, so the caller decides.
    """
    from pyspark.sql import Window

    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "history.jsonl").text(root, wholetext=True).select("value", "_metadata.file_path")
    folder = _run_dir(prefix)
    lines = raw.select(folder.alias("run_dir"), F.posexplode(F.split("value", "\n")).alias("line", "value")).filter("value <> ''")
    parsed = lines.withColumn("r", F.from_json("value", "schema string, series bigint, name string, split string, step bigint, value double, at string"))
    bad = F.try_parse_json("value").isNull()
    series = parsed.filter(F.col("r.name").isNotNull()).groupBy("run_dir", F.col("r.series").alias("series")).agg(F.min("r.name").alias("name"), F.min("r.split").alias("split"), F.count(F.lit(1)).alias("declared"))
    points = parsed.filter(F.col("r.step").isNotNull()).select("run_dir", "line", F.col("r.series").alias("series"), F.col("r.step").alias("step"), F.col("r.value").alias("value"), F.col("r.at").alias("at"))
    before = F.lag("step").over(Window.partitionBy("run_dir", "series").orderBy("line"))
    joined = points.withColumn("before", before).join(series, ["run_dir", "series"], "left")
    unparsed = parsed.filter(bad).select("run_dir", "line", F.lit("no JSON").alias("reason"))
    said = F.when(F.col("name").isNull(), "a series that isn't declared").when(F.col("step") <= F.col("before"), "a step that doesn't rise")
    twice = series.filter("declared > 1").select("run_dir", F.lit(None).cast("int").alias("line"), F.lit("a series declared twice").alias("reason"))
    broken = unparsed.unionByName(joined.withColumn("reason", said).filter("reason IS NOT NULL").select("run_dir", "line", "reason")).unionByName(twice)
    return joined.select("run_dir", "series", "name", "split", "step", "value", "at"), broken


@dataclass(frozen=True)
class Reader:
    """A reader of a tracker's runs. scan(spark, root) gives path, name, metrics (map of name to value) and reasons; a row with reasons isn't imported."""

    name: str
    scan: Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class FileReader:
    """A reader of one file at a time: parse(path, bytes) gives (name, metrics) of its runs. Whatever it raises is that file's reason, and no other file's."""

    name: str
    pattern: str
    parse: Callable[[str, bytes], list[tuple[str, dict]]]

    def scan(self, spark: SparkSession, root: str) -> DataFrame:
        parse = self.parse

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows: list[tuple] = []
                for path, content in zip(batch["path"], batch["content"], strict=True):
                    try:
                        rows += [(path, name, {k: float(v) for k, v in metrics.items()}, []) for name, metrics in parse(path, bytes(content))]
                    except Exception as e:  # noqa: BLE001  a reader's fault is a row
                        rows.append((path, None, None, [f"read: {type(e).__name__}: {str(e)[:200]}"]))
                yield pd.DataFrame(rows, columns=["path", "name", "metrics", "reasons"])

        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", self.pattern).load(root)
        return files.select("path", "content").mapInPandas(run, FOUND)


FOUND = "path string, name string, metrics map<string, double>, reasons array<string>"
_READERS: dict[str, Reader | FileReader] = {}


def register_reader(reader: Reader | FileReader) -> None:
    """Make a reader part of import_project; one of the same name is replaced."""
    _READERS[reader.name] = reader


def core_reader(prefix: str) -> Reader:
    """The reader of run records of a prefix; register it under that format's name."""

    def scan(spark: SparkSession, root: str) -> DataFrame:
        metrics = F.map_from_entries(F.transform(F.array_distinct(F.transform("record.metrics", lambda m: m["name"])), lambda n: F.struct(n, F.element_at(F.filter("record.metrics", lambda m: m["name"] == n), -1)["value"])))
        return run_records(spark, root, prefix).select("path", F.col("record.run_id").alias("name"), F.when(F.size("reasons") == 0, metrics).alias("metrics"), "reasons")

    return Reader("core", scan)


def _of_points(points: DataFrame, path: str, name: str, order: tuple[str, ...] = ("step",)) -> DataFrame:
    """Runs from rows of (metric, value): of each metric the value that is last by order, then the greatest."""
    last = points.filter("value IS NOT NULL").groupBy(F.col(path).alias("path"), F.col(name).alias("name"), "metric").agg(F.max_by("value", F.struct(*order, "value")).alias("value"))
    return last.groupBy("path", "name").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics")).withColumn("reasons", F.array().cast("array<string>"))


def _scan_sacred(spark: SparkSession, root: str) -> DataFrame:
    return _of_points(trackers.read_sacred(spark, root), "run", "run")


def _scan_dvc(spark: SparkSession, root: str) -> DataFrame:
    return _of_points(trackers.read_dvc(spark, root), "project", "run")


def _scan_mlflow(spark: SparkSession, root: str) -> DataFrame:
    return _of_points(artifacts.read_mlflow(spark, root), "experiment", "run", ("step", "ts"))


def _scan_wandb(spark: SparkSession, root: str) -> DataFrame:
    logs = trackers.read_wandb(spark, root)
    good = _of_points(trackers.wandb_points(logs.filter("problem IS NULL")), "path", "run_id")
    bad = logs.filter("problem IS NOT NULL").select("path", F.col("run_id").alias("name"), F.lit(None).cast("map<string, double>").alias("metrics"), F.array(F.concat(F.lit("read: "), "problem")).alias("reasons"))
    return good.unionByName(bad)


def _parse_json(path: str, content: bytes) -> list[tuple[str, dict]]:
    found, problem = artifacts._parsed(content.decode())
    if problem and not found:
        raise ValueError(problem)
    last: dict = {}
    for m in sorted(found, key=lambda m: (m["step"] is not None, m["step"] or 0)):
        last[m["metric"] if m["split"] is None else f"{m['split']}.{m['metric']}"] = m["value"]
    return [(path.rsplit("/", 1)[-1].split(".")[0], last)] if last else []


def _parse_csv(path: str, content: bytes) -> list[tuple[str, dict]]:
    """The first column names the run; of the other cells those that are finite numbers count."""
    rows = list(csv.reader(io.StringIO(content.decode())))
    out = []
    for row in rows[1:]:
        if row and len(row) > len(rows[0]):
            raise ValueError("a row is longer than the header")
        cells = {k: float(v) for k, v in zip(rows[0][1:], row[1:], strict=False) if NUMBER.fullmatch(v.strip())}
        out += [(row[0], cells)] if cells else []
    return out


NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d{1,2})?")
for _reader in (
    Reader("sacred", _scan_sacred), Reader("dvc", _scan_dvc), Reader("mlflow", _scan_mlflow), Reader("wandb", _scan_wandb),
    FileReader("json", "results*.json*", _parse_json), FileReader("csv", "*.csv", _parse_csv),
):
    register_reader(_reader)


def import_project(spark: SparkSession, root: str, readers: list[str | Reader | FileReader] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(imported: reader, path, name, metrics; quarantined: reader, path, reasons; report: reader, imported, quarantined) by the given readers, or all that are registered.

    Each reader's rows are settled on their own, so one that fails while it is planned or while it runs is a row among the quarantined, and the others go on."""
    found = None
    for given in readers or sorted(_READERS):
        reader = _READERS[given] if isinstance(given, str) else given
        try:
            own = settled(reader.scan(spark, root).select(F.lit(reader.name).alias("reader"), "path", "name", F.col("metrics").cast("map<string, double>").alias("metrics"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons")), "import")
        except Exception as e:  # noqa: BLE001  whatever a user's reader raises is reported
            own = spark.createDataFrame([(reader.name, root, None, None, [f"read: {str(e)[:200]}"])], f"reader string, {FOUND}")
        found = own if found is None else found.unionByName(own)
    good = F.size("reasons") == 0
    report = found.groupBy("reader").agg(F.count_if(good).alias("imported"), F.count_if(~good).alias("quarantined"))
    return found.filter(good).drop("reasons"), found.filter(~good).select("reader", "path", "reasons"), report
