"""Conformance of run directories: the files of a folder joined into one row for each rule that they break.

A folder that holds <prefix>/run.json or <prefix>/state.json is a run's. Nothing that a file holds fails the job; what can't be read is a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.records import canonical, canonical_json, parse_strict
from tracewright.functions.shared import settled
from tracewright.functions.text import CREDENTIAL_SHAPES
from tracewright.sources import records

# The rules in the order of a report, the files they read, and keys whose values are secret.
RULES = ("read", "canonical", "manifest", "history", "state", "terminal", "spec", "source", "credentials", "ext-namespace")
FILES = ("run.json", "state.json", "digests.json", "history.jsonl")
SECRET_KEYS = ("password", "passwd", "secret", "client_secret", "secret_key", "api_key", "apikey", "access_token", "auth_token", "refresh_token", "bearer_token", "session_token", "private_key")
SECRET_PARAMETERS = ("token", "access_token", "api_key", "apikey", "key", "sig", "signature", "password", "secret", "client_secret")
SOURCE = r"^(?:(?:index|conda)(?::.+)?|(?:git|hg|svn|bzr)\+.+|url:.+|file|system)$"
NAMESPACE = r"^[a-z][a-z0-9_-]*(\.[a-z0-9_-]+)*$"
#: Spark reads no longer file into a row.
LONGEST = 2**31 - 16

_SHAPES = [re.compile(s) for s in CREDENTIAL_SHAPES]
_LINK = re.compile(r"\w[\w+.-]*://[^\s\"'<>]+")
_BLANKED = re.compile(r"\**|redacted|<.*>|\$\{?\w+\}?", re.I)


def _leaves(value, at: str, key: str | None = None) -> Iterator[tuple[str, str | None, str]]:
    """(JSON path, key above, text) of every text in a value, keys among them."""
    if isinstance(value, dict):
        for k, v in value.items():
            below = f"{at}.{k}" if re.fullmatch(r"[A-Za-z_][\w-]*", k, re.A) else f"{at}[{json.dumps(k)}]"
            yield below, None, k
            yield from _leaves(v, below, k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, f"{at}[{i}]")
    elif isinstance(value, str):
        yield at, key, value


def _secret(text: str, key: str | None) -> str | None:
    """Why a text shouldn't stand in a record that can't be edited later."""
    if any(s.search(text) for s in _SHAPES):
        return "looks like a credential"
    for link in _LINK.findall(text):
        try:
            parts = urlsplit(link)
            named = {k.lower() for k, _ in parse_qsl(parts.query, keep_blank_values=True)}
            if parts.password is not None or (parts.username and parts.scheme.rsplit("+", 1)[-1].startswith("http")) or named & set(SECRET_PARAMETERS):
                return "a link with a credential"
        except ValueError:
            continue
    plain = re.sub(r"[^a-z0-9]+", "_", (key or "").lower()).strip("_")
    if any(plain == s or plain.endswith("_" + s) for s in SECRET_KEYS) and not _BLANKED.fullmatch(text.strip()):
        return "a value under a key that names a secret"
    return None


_SECRET = T.StructType([T.StructField("at", T.StringType()), T.StructField("why", T.StringType())])
INSPECTED = T.StructType([T.StructField("problem", T.StringType()), T.StructField("same", T.BooleanType()), T.StructField("secrets", T.ArrayType(_SECRET))])


@F.pandas_udf(INSPECTED)
def inspected(content: pd.Series, by_line: pd.Series) -> pd.DataFrame:
    """Whether bytes are strict JSON, whether they are its canonical form, and where they hold credentials. By line, each line is a value of its own."""

    def one(raw: bytes, lines: bool) -> tuple:
        try:
            text = bytes(raw).decode()
            if lines:
                parts = [(f"line {i}: $", x) for i, x in enumerate(text.split("\n"), 1) if x]
            else:
                parts = [("$", text)]
            values = [(at, x, parse_strict(x)) for at, x in parts]
            same = all(canonical_json(v) == x for _, x, v in values)
        except (ValueError, RecursionError) as e:
            return f"no strict JSON: {str(e)[:120]}", False, []
        found = [(at, why) for root, _, v in values for at, key, t in _leaves(v, root) if (why := _secret(t, key))]
        return None, same, [{"at": at, "why": why} for at, why in dict(found).items()]

    return pd.DataFrame([one(c, b) for c, b in zip(content, by_line, strict=True)], columns=["problem", "same", "secrets"])


def _rows(df: DataFrame, rule: str, file: str, at: Column | str, said: Column | str) -> DataFrame:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select("run_dir", F.lit(rule).alias("rule"), F.lit(file).alias("file"), text(at).alias("json_path"), text(said).alias("message"))


def _broken(df: DataFrame, rule: str, file: str) -> DataFrame:
    """A row for each reason that the readers of records give as "field: what is expected"."""
    r = df.select("run_dir", F.explode("reasons").alias("r"))
    return _rows(r, rule, file, F.when(F.col("r").startswith("read:"), "$").otherwise(F.concat(F.lit("$."), F.regexp_extract("r", "^([a-z_]+)", 1))), F.regexp_replace("r", "^[^:]*: ", ""))


def violations(spark: SparkSession, root: str, prefix: str, specs: DataFrame | None = None) -> DataFrame:
    """run_dir, rule, file, json_path, message: what the run directories below root break; one that conforms has no row.

    specs: run_dir, run_id, family, arm, config (JSON text) of the jobs that the runs were submitted as, where these are known.
    Files beyond LONGEST bytes aren't digested; the manifest's row says so. A path in a rule has one row, with the first message."""
    load = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    place = load.select(F.col("path").alias("file_path"), F.col("_metadata.file_path").alias("path"), "length", "content")
    core_at = rf"^(.*)/{prefix}/({'|'.join(re.escape(f) for f in FILES)})$"
    own = place.filter(F.col("file_path").rlike(core_at) & (F.col("length") <= LONGEST))
    name = F.regexp_extract("file_path", core_at, 2)
    core = own.select(F.regexp_extract("file_path", core_at, 1).alias("run_dir"), name.alias("name"), "path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("sha"), inspected("content", name == "history.jsonl").alias("i"))
    # Files are read and parsed once; the rules below work on what is settled.
    core = settled(core.select("run_dir", "name", "path", "text", "sha", "i.problem", "i.same", "i.secrets"), "conformance")
    of = lambda n: core.filter(F.col("name") == n)
    read = lambda n, reader: settled(of(n).join(reader(spark, root, prefix).select("path", "record", "reasons"), "path"), "conformance")
    run_read, state_read = read("run.json", records.run_records), read("state.json", records.state_files)
    good = F.col("problem").isNull() & (F.size("reasons") == 0)
    run, state = run_read.filter(good), state_read.filter(good)
    runs = core.filter(F.col("name").isin("run.json", "state.json")).select("run_dir").distinct()
    manifest, history = of("digests.json").join(runs, "run_dir", "left_semi"), of("history.jsonl").join(runs, "run_dir", "left_semi")
    record = run.select("run_dir", "record", F.col("text").alias("record_text"))
    out = []

    # Each file on its own.
    for each, file, rule in ((run_read, "run.json", "read"), (state_read, "state.json", "state")):
        out += [_rows(each.filter("problem IS NOT NULL"), rule, file, "$", F.col("problem")), _broken(each.filter("problem IS NULL"), rule, file)]
        out.append(_rows(each.filter(good & ~F.col("same")), "canonical" if rule == "read" else rule, file, "$", "the bytes aren't the canonical form"))
    secrets = core.join(runs, "run_dir", "left_semi").select("run_dir", "name", F.explode("secrets").alias("s"))
    out.append(secrets.select("run_dir", F.lit("credentials").alias("rule"), F.col("name").alias("file"), F.col("s.at").alias("json_path"), F.col("s.why").alias("message")))
    needed = run_read.filter("problem IS NULL").select("run_dir", F.posexplode("record.dependencies").alias("i", "d")).filter("d.source IS NOT NULL")
    at = F.format_string("$.dependencies[%d].source", "i")
    out.append(_rows(needed.filter(~F.col("d.source").rlike(SOURCE)), "source", "run.json", at, "no index, repository, url:, file, conda or system"))
    out.append(_rows(needed.filter(F.col("d.source").rlike(r"^url:[^#]*\?")), "source", "run.json", at, "a url: source with a query"))
    spaces = run_read.filter("problem IS NULL").select("run_dir", F.explode(F.from_json("text", "ext map<string, string>")["ext"]).alias("ns", "body"))
    where = F.concat(F.lit("$.ext"), F.when(F.col("ns").rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit("."), "ns")).otherwise(F.concat(F.lit('["'), "ns", F.lit('"]'))))
    said = F.when(~F.col("ns").rlike(NAMESPACE), "no name of a namespace").when(F.split_part("ns", F.lit("."), F.lit(1)) == prefix, "a reserved namespace")
    said = said.when(~F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"), F.lit(False)), "an extension must be an object")
    out.append(_rows(spaces.withColumn("said", said).filter("said IS NOT NULL"), "ext-namespace", "run.json", where, F.col("said")))

    # The history that a record binds.
    lines = history.select("run_dir", F.explode(F.split("text", "\n")).alias("x")).select("run_dir", F.from_json("x", "name string, step bigint").alias("l"))
    counted = lines.groupBy("run_dir").agg(F.count("l.name").alias("series"), F.count("l.step").alias("points"))
    bound = record.join(history.select("run_dir", F.col("sha").alias("history_sha")), "run_dir", "left").join(counted, "run_dir", "left")
    h = lambda c: F.col(f"record.history.{c}")
    claims = F.col("record.history").isNotNull()
    out.append(_rows(bound.filter(~claims & F.col("history_sha").isNotNull()), "history", "history.jsonl", "$", "no record binds it"))
    out.append(_rows(bound.filter(claims & F.col("history_sha").isNull()), "history", "history.jsonl", "$", "the record binds it, but it is missing"))
    kept = bound.filter(claims & F.col("history_sha").isNotNull())
    out.append(_rows(kept.filter(h("sha256") != F.col("history_sha")), "history", "history.jsonl", "$", F.concat(F.lit("its SHA-256 is "), "history_sha")))
    for c in ("series", "points"):
        out.append(_rows(kept.filter(~h(c).eqNullSafe(F.col(c))), "history", "run.json", f"$.history.{c}", F.format_string("the file has %d", c)))
    out.append(_rows(history.join(kept, "run_dir", "left_semi").filter("problem IS NOT NULL"), "history", "history.jsonl", "$", F.col("problem")))
    # The readers name a folder as links are written.
    named = history.join(kept, "run_dir", "left_semi").select("run_dir", F.regexp_replace("path", "/[^/]+/[^/]+$", "").alias("link"))
    wrong = records.histories(spark, root, prefix)[1].withColumnRenamed("run_dir", "link").join(named, "link")
    out.append(_rows(wrong, "history", "history.jsonl", F.concat(F.lit("line "), F.coalesce((F.col("line") + 1).cast("string"), F.lit("?"))), F.col("reason")))

    # The manifest: its form, who binds it, and the files that are there.
    shape = F.from_json("text", "map<string, string>")
    parsed = manifest.filter("problem IS NULL").withColumns({"keys": F.array_sort(F.map_keys(shape)), "tag": shape["schema"], "listed": F.from_json("text", "files map<string, string>")["files"]})
    out.append(_rows(manifest.filter("problem IS NOT NULL"), "manifest", "digests.json", "$", F.col("problem")))
    formed = F.coalesce(F.col("keys") == F.array(F.lit("files"), F.lit("schema")), F.lit(False))
    tagged, given = F.coalesce(F.col("tag") == f"{prefix}.digests/1", F.lit(False)), F.col("listed").isNotNull()
    out.append(_rows(parsed.filter(~formed), "manifest", "digests.json", "$", "schema and files are expected, and nothing else"))
    out.append(_rows(parsed.filter(formed & ~tagged), "manifest", "digests.json", "$.schema", f"{prefix}.digests/1 is expected"))
    out.append(_rows(parsed.filter(formed & ~given), "manifest", "digests.json", "$.files", "an object of digests is expected"))
    out.append(_rows(parsed.filter(~F.col("same")), "manifest", "digests.json", "$", "the bytes aren't the canonical form"))
    entry = F.get(F.filter("record.data", lambda d: d["name"] == f"{prefix}/digests.json"), F.lit(0))
    pos = F.array_position(F.transform("record.data", lambda d: d["name"]), f"{prefix}/digests.json") - 1
    ties = record.select("run_dir", entry.alias("entry"), pos.alias("pos")).join(manifest.select("run_dir", F.col("sha").alias("digest"), "problem"), "run_dir", "left")
    here = F.col("digest").isNotNull() & F.col("problem").isNull()
    out.append(_rows(ties.filter(F.col("entry").isNotNull() & F.col("digest").isNull()), "manifest", "run.json", F.format_string("$.data[%d]", "pos"), "the manifest that it binds is missing"))
    out.append(_rows(ties.filter(F.col("entry").isNull() & here), "manifest", "run.json", "$.data", "it doesn't bind the manifest"))
    out.append(_rows(ties.filter(here & F.col("entry").isNotNull() & ~F.col("entry.role").eqNullSafe("manifest")), "manifest", "run.json", F.format_string("$.data[%d].role", "pos"), "manifest is expected"))
    out.append(_rows(ties.filter(here & (F.col("entry.sha256") != F.col("digest"))), "manifest", "run.json", F.format_string("$.data[%d].sha256", "pos"), F.concat(F.lit("the manifest's is "), "digest")))
    entries = parsed.filter(formed & tagged & given).select("run_dir", F.explode("listed").alias("name", "said"))
    no_digest = F.col("said").isNull() | ~F.col("said").rlike(records.SHA256)
    out.append(_rows(entries.filter(no_digest), "manifest", "digests.json", F.format_string("$.files[\"%s\"]", "name"), "no SHA-256"))
    checked = parsed.filter(formed & tagged & given).join(record, "run_dir", "left_semi").join(entries.filter(no_digest), "run_dir", "left_anti").select("run_dir")
    # A file is below each folder of its path; it meets the run directories among them.
    fits = place.filter(F.col("length") <= LONGEST).select("file_path", F.sha2("content", 256).alias("found"))
    long = place.filter(F.col("length") > LONGEST).select("file_path", F.lit("long").alias("found"))
    parts = F.split("file_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = fits.unionByName(long).select("file_path", "found", F.explode(folders).alias("run_dir")).join(checked, "run_dir", "left_semi")
    actual = below.select("run_dir", F.expr("substring(file_path, length(run_dir) + 2)").alias("name"), "found").filter(~F.col("name").startswith(f"{prefix}/"))
    both = entries.join(checked, "run_dir", "left_semi").join(actual, ["run_dir", "name"], "full")
    said = F.when(F.col("found").isNull(), "listed, but missing").when(F.col("said").isNull(), "not listed").when(F.col("found") == "long", "too long to be digested").when(F.col("found") != F.col("said"), F.concat(F.lit("its SHA-256 is "), "found"))
    out.append(_rows(both.withColumn("why", said).filter("why IS NOT NULL"), "manifest", "digests.json", F.format_string("$.files[\"%s\"]", "name"), F.col("why")))

    # The job's state and its record.
    s = state.select("run_dir", F.col("record").alias("state"))
    ended = F.col("state.state").isin("complete", "failed", "cancelled")
    pair = s.join(record, "run_dir")
    out.append(_rows(pair.filter("state.run_id <> record.run_id"), "state", "state.json", "$.run_id", F.concat(F.lit("the record's is "), "record.run_id")))
    out.append(_rows(s.filter(ended).join(run_read.select("run_dir"), "run_dir", "left_anti"), "terminal", "state.json", "$.state", "the job ended and has no record"))
    out.append(_rows(pair.filter("record.status IS NULL"), "terminal", "run.json", "$.status", "it doesn't say how the job ended"))
    out.append(_rows(pair.filter(ended & (F.col("record.status") != F.col("state.state"))), "terminal", "state.json", "$.state", F.concat(F.lit("its record says "), "record.status")))
    if specs is not None:
        job = record.join(specs.select("run_dir", F.struct("run_id", "family", "arm", "config").alias("spec")), "run_dir")
        for c in ("run_id", "family", "arm"):
            out.append(_rows(job.filter(~F.col(f"record.{c}").eqNullSafe(F.col(f"spec.{c}"))), "spec", "run.json", f"$.{c}", F.concat(F.lit("the job's is "), f"spec.{c}")))
        own_config = canonical(F.get_json_object("record_text", "$.config"))
        out.append(_rows(job.filter(~own_config.eqNullSafe(canonical(F.col("spec.config")))), "spec", "run.json", "$.config", "it isn't the job's"))

    found = reduce(DataFrame.unionByName, out)
    return found.groupBy("run_dir", "rule", "file", "json_path").agg(F.min("message").alias("message"))


def report(spark: SparkSession, root: str, prefix: str, found: DataFrame) -> DataFrame:
    """run_dir, ok, rules (in their order) of every run directory, from the rows of violations."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{run,state}.json").load(root).select("path")
    at = rf"^(.*)/{prefix}/(?:run|state)\.json$"
    runs = paths.filter(F.col("path").rlike(at)).select(F.regexp_extract("path", at, 1).alias("run_dir")).distinct()
    broken = found.groupBy("run_dir").agg(F.collect_set("rule").alias("b"))
    rules = F.filter(F.array(*[F.lit(r) for r in RULES]), lambda r: F.array_contains(F.coalesce("b", F.array().cast("array<string>")), r))
    return runs.join(broken, "run_dir", "left").select("run_dir", (F.size(rules) == 0).alias("ok"), rules.alias("rules"))
