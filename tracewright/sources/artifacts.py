"""Readers of run artifacts: JSON, JSON lines, CSV, MLflow file stores, multirun folders, manifests and BibTeX.

All go through Spark's readers, so any store that Spark opens will do. Each yields rows of (path, metric, step, split,
value) or says so; what doesn't parse is kept as a row of its own with the reason, not dropped silently.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC = T.ArrayType(T.StructType([T.StructField("metric", T.StringType()), T.StructField("step", T.LongType()), T.StructField("split", T.StringType()), T.StructField("value", T.DoubleType())]))

# Names of a step, and a table of more numeric keys than this is a lookup table and no set of metrics.
STEP_KEYS = ("step", "epoch", "iteration")
LOOKUP_KEYS = 60


def finite(value: Column) -> Column:
    """Null for what isn't a finite number: it wasn't measured."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def step_of(stem: Column) -> Column:
    """The step that a file's name gives; 5k is 5000."""
    n, k = F.regexp_extract(stem, r"(?i)(?:step|epoch|iter|ckpt)[-_]?(\d+)(k?)", 1), F.regexp_extract(stem, r"(?i)(?:step|epoch|iter|ckpt)[-_]?(\d+)(k?)", 2)
    return F.when(n != "", n.try_cast("long") * F.when(F.lower(k) == "k", 1000).otherwise(1))


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf")


def payload_metrics(node, step=None, split=None) -> list[dict]:
    """Numbers of a parsed payload: flat, nested under split names, series with a step, or samples (mean, sd and count)."""
    out: list[dict] = []
    if isinstance(node, list):
        rows = [x for x in node if isinstance(x, dict)]
        if rows and all(any(k in x for k in STEP_KEYS) for x in rows):
            for x in rows:
                at = next(x[k] for k in STEP_KEYS if k in x)
                out += payload_metrics({k: v for k, v in x.items() if k not in STEP_KEYS}, int(at) if _number(at) else None, split)
            return out
        for name in sorted({k for x in rows for k, v in x.items() if _number(v)}):
            values = [float(x[name]) for x in rows if _number(x.get(name))]
            mean = sum(values) / len(values)
            sd = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
            out += [{"metric": m, "step": step, "split": split, "value": v} for m, v in ((name, mean), (f"{name}_sd", sd), (f"{name}_n", float(len(values))))]
        return out
    if isinstance(node, dict):
        numbers = {k: float(v) for k, v in node.items() if _number(v)}
        if len(numbers) > LOOKUP_KEYS and len(numbers) == len(node):
            return []
        own = next((int(numbers[k]) for k in STEP_KEYS if k in numbers), step)
        out += [{"metric": k, "step": own, "split": split, "value": v} for k, v in numbers.items() if k not in STEP_KEYS]
        for k, v in node.items():
            if isinstance(v, (dict, list)):
                out += payload_metrics(v, own, k if split is None else f"{split}.{k}")
    return out


def _parsed(body: str) -> tuple[list[dict], str | None]:
    import json

    try:
        return payload_metrics(json.loads(body)), None
    except ValueError:
        pass
    rows, bad = [], 0
    for line in body.splitlines():
        try:
            rows.append(json.loads(line))
        except ValueError:
            bad += bool(line.strip())
    return payload_metrics(rows), f"{bad} lines don't parse" if bad else None


def read_json(spark: SparkSession, folder: str, pattern: str = "*.json*") -> DataFrame:
    """path, metric, step, split, value, problem of JSON and JSON-lines files, whole trees; a cut last line costs itself alone."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for path, body in zip(pdf["path"], pdf["value"], strict=True):
                rows, problem = _parsed(body)
                out += [(path, r["metric"], r["step"], r["split"], r["value"], None) for r in rows]
                out += [(path, None, None, None, None, problem)] if problem else []
            yield pd.DataFrame(out, columns=["path", "metric", "step", "split", "value", "problem"]).astype({"step": "Int64"})

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(run, "path string, metric string, step long, split string, value double, problem string")


def read_csv(spark: SparkSession, folder: str, name_col: str) -> DataFrame:
    """path, run, metric, value: one run per row, every cell that is a finite number."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in rows.columns if c != name_col]))
    out = rows.select(F.input_file_name().alias("path"), F.col(f"`{name_col}`").alias("run"), cells.alias("m"))
    return out.select("path", "run", "m.metric", finite(F.col("m.value")).alias("value")).filter("value IS NOT NULL")


def read_mlflow(spark: SparkSession, store: str) -> DataFrame:
    """experiment, run, metric, step, ts, value of a file store: experiment/run/metrics/name with lines "ts value step"."""
    path = F.input_file_name()
    where = r"/([^/]+)/([^/]+)/metrics/(.+)$"
    lines = spark.read.option("recursiveFileLookup", True).text(store).select(path.alias("path"), F.split("value", " ").alias("v")).filter(F.col("path").rlike(where) & (F.size("v") >= 2))
    value = finite(F.col("v")[1].try_cast("double"))
    return lines.select(F.regexp_extract("path", where, 1).alias("experiment"), F.regexp_extract("path", where, 2).alias("run"), F.regexp_extract("path", where, 3).alias("metric"), F.get("v", 2).try_cast("long").alias("step"), F.col("v")[0].try_cast("long").alias("ts"), value.alias("value")).filter("value IS NOT NULL")


def latest(points: DataFrame) -> DataFrame:
    """A tracker's final value of each metric: the greatest (step, ts, value)."""
    return points.groupBy("experiment", "run", "metric").agg(F.max_by("value", F.struct("step", "ts", "value")).alias("value"))


def overrides(path: Column) -> Column:
    """A multirun folder's name "a=1,b=2,seed=3" as a map."""
    name = F.regexp_extract(path, r"/([^/]*=[^/]*)/", 1)
    return F.when(name != "", F.str_to_map(name, F.lit(","), F.lit("=")))


def arm_of(settings: Column) -> Column:
    """The overrides but for the seed, in order of names."""
    kept = F.array_sort(F.map_entries(F.map_filter(settings, lambda k, _: k != "seed")))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 of every file of a tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,")
_FIELD = re.compile(r"(\w+)\s*=\s*")


def parse_bibtex(text: str) -> list[dict]:
    """Entries with their fields; braces nest. A broken entry is a row with a problem."""
    out = []
    starts = list(_ENTRY.finditer(text))
    for m, after in zip(starts, [*starts[1:], None], strict=True):
        body, fields, at = text[m.end() : after.start() if after else len(text)], {}, 0
        problem = None
        while f := _FIELD.search(body, at):
            i = f.end()
            if i < len(body) and body[i] in '{"':
                depth, j = 0, i
                while j < len(body):
                    c = body[j]
                    depth += (c == "{") - (c == "}")
                    if j > i and depth == (0 if body[i] == '"' else 0) and c == ('"' if body[i] == '"' else "}"):
                        break
                    j += 1
                if j == len(body):
                    problem = f"{f[1]} doesn't end"
                    break
                fields[f[1].lower()] = body[i + 1 : j]
                at = j + 1
            else:
                j = min([k for k in (body.find(",", i), body.find("}", i)) if k >= 0], default=len(body))
                fields[f[1].lower()] = body[i:j].strip()
                at = j
        out.append({"kind": m[1].lower(), "key": m[2], "fields": fields, "problem": problem})
    return out


@F.udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("problem", T.StringType())])), useArrow=True)
def bibtex_entries(text):
    return parse_bibtex(text or "")


def read_bibtex(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, key, fields, problem."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.bib").text(folder, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.explode(bibtex_entries("value")).alias("e")).select("path", "e.*")


# The two forms of a claim in a draft, and its fields.
CLAIM = r"(?s)<!--\s*claim:\s*(.*?)\s*-->"
TEX_CLAIM = r"(?m)(?<!\\)%[ \t]*claim:[ \t]*(.*?)[ \t]*$"
CLAIM_TEXTS = ("as_of", "split", "cite", "model")
CITED = r"\\(?:cite|citep|citet|autocite|parencite)\*?(?:\[[^\]]*\])*\{([^}]*)\}"


def read_claims(spark: SparkSession, folder: str, pattern: str = "*.{md,tex}") -> DataFrame:
    """path, n, line, raw, project, run, metric, claimed, tol, as_of, split, step, cite, model, problem of the claims in Markdown
    comments and LaTeX comments; malformed ones (no run, metric or value, or a tol or step that is no number) keep their text."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    files = files.select(F.input_file_name().alias("path"), "value")
    lines = lambda texts: F.aggregate(texts, F.lit(0), lambda n, t: n + F.size(F.split(t, "\n")) - 1)

    def found(rows: DataFrame, form: str) -> DataFrame:
        whole, between = F.regexp_extract_all("value", F.lit(form), 0), F.split("value", form)
        rows = rows.select("path", whole.alias("whole"), between.alias("between"), F.posexplode(F.regexp_extract_all("value", F.lit(form), 1)).alias("n", "raw"))
        return rows.select("path", "n", (lines(F.slice("between", 1, F.col("n") + 1)) + lines(F.slice("whole", 1, F.col("n"))) + 1).alias("line"), "raw")

    tex = F.lower("path").endswith(".tex")
    claims = found(files.filter(~tex), CLAIM).unionByName(found(files.filter(tex), TEX_CLAIM))
    pick = lambda p: F.nullif(F.regexp_extract("raw", p, 1), F.lit(""))
    field = lambda name: pick(rf"(?:^|\s){name}=(\S+)")
    numbers = {"claimed": field("value").try_cast("double"), "tol": F.when(field("tol").isNull(), 0.0).otherwise(field("tol").try_cast("double")), "step": field("step").try_cast("long")}
    out = claims.select("*", pick(r"^([^/\s]+)/").alias("project"), pick(r"^[^/\s]+/(\S+)").alias("run"), F.lower(field("metric")).alias("metric"), *[c.alias(k) for k, c in numbers.items()], *[field(k).alias(k) for k in CLAIM_TEXTS])
    bad_step = field("step").isNotNull() & F.col("step").isNull()
    return out.withColumn("problem", F.when(F.col("run").isNull() | F.col("metric").isNull() | F.col("claimed").isNull() | F.col("tol").isNull() | bad_step, "malformed"))


def read_citations(spark: SparkSession, folder: str) -> DataFrame:
    """path, key of the works that LaTeX drafts cite."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.tex").text(folder, wholetext=True)
    bare = F.regexp_replace("value", r"(?m)(?<!\\)%.*$", "")
    keys = F.explode(F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(CITED), 1), lambda g: F.split(g, r"\s*,\s*"))))
    return files.select(F.input_file_name().alias("path"), keys.alias("key"))


def parse_feed(rows: DataFrame, body: str = "body") -> DataFrame:
    """guid, url, title, summary of the entries of RSS and Atom bodies, by from_xml. An Atom entry's url is its alternate link, else its first; its
    summary stands before its content."""
    item = "channel STRUCT<item: ARRAY<STRUCT<guid: STRING, link: STRING, title: STRING, description: STRING>>>"
    entry = "entry ARRAY<STRUCT<id: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, title: STRING, summary: STRING, content: STRING>>"
    atom = F.regexp_like(body, F.lit(r"(?s)^\s*(<\?xml.*?\?>)?\s*(<!--.*?-->\s*)*<feed[\s>]"))
    rss = rows.filter(~atom).select(F.explode(F.from_xml(body, item)["channel"]["item"]).alias("i"))
    rss = rss.select(F.col("i.guid").alias("guid"), F.col("i.link").alias("url"), F.col("i.title").alias("title"), F.col("i.description").alias("summary"))
    entries = rows.filter(atom).select(F.explode(F.from_xml(body, entry)["entry"]).alias("i"))
    own = F.filter("i.link", lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    url = F.coalesce(F.get(own, F.lit(0))["_href"], F.get("i.link", F.lit(0))["_href"])
    return rss.unionByName(entries.select(F.col("i.id").alias("guid"), url.alias("url"), F.col("i.title").alias("title"), F.coalesce("i.summary", "i.content").alias("summary")))


def seed_feeds(spark: SparkSession, path: str, feeds: DataFrame) -> DataFrame:
    """url, title of the feeds that a TOML file lists ([[feeds]] with url and title) and feeds (url) lacks; the first of equal urls. An absent file is an error."""
    import tomllib

    text = spark.read.text(path, wholetext=True).first()  # one file that people write
    listed = tomllib.loads(text.value if text else "").get("feeds", [])
    first = {f["url"]: f.get("title") for f in reversed(listed)}
    return spark.createDataFrame(list(first.items()), "url string, title string").join(feeds.select("url"), "url", "left_anti")
