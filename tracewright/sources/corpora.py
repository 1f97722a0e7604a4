"""What source files, result payloads and manifests state about the corpus of a run, without guessing.

A corpus's name joins runs, so only literals count: a variable's name states nothing. What doesn't parse states nothing either, and
its row says why. The declarations that come out are what ``operators.corpora.upsert`` takes.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Calls whose literal arguments name a data set or a tokenizer, keywords of a sequence's length, and the keys under which
# payloads state a field, in order of trust.
DATASET_ARGUMENTS = {"load_dataset": ("source", "config")}
TOKENIZER_CALLS = ("get_encoding", "from_pretrained")
LENGTH_KEYWORDS = ("seq_len", "max_seq_len", "block_size")
PAYLOAD_KEYS = {
    "name": ("dataset", "corpus", "dataset_name", "data", "corpus_name"),
    "source": ("dataset_source", "hf_dataset", "data_source"),
    "config": ("dataset_config", "subset"),
    "tokenizer": ("tokenizer", "tokenizer_name", "encoding"),
    "vocab_size": ("vocab_size", "n_vocab"),
    "seq_len": ("seq_len", "max_seq_len", "block_size", "context_length"),
}
NUMBERS = ("vocab_size", "seq_len")

STATED = "path string, source string, config string, tokenizer string, seq_len long, problem string"


def _statements(call: ast.Call) -> Iterator[tuple[str, str | int]]:
    """(field, literal) of one call; a truth value is no number."""
    called = call.func.attr if isinstance(call.func, ast.Attribute) else getattr(call.func, "id", None)
    meanings = DATASET_ARGUMENTS.get(called) or (("tokenizer",) if called in TOKENIZER_CALLS else ())
    named = [*zip(meanings, call.args, strict=False), *(("seq_len", k.value) for k in call.keywords if k.arg in LENGTH_KEYWORDS)]
    for field, node in named:
        value = node.value if isinstance(node, ast.Constant) else None
        if isinstance(value, int if field == "seq_len" else (str, int)) and not isinstance(value, bool):
            yield field, value if field == "seq_len" else str(value)


def stated_in(code: str) -> dict:
    """The fields that a Python source states: of each the first, outer statements before those nested in them."""
    calls = (node for node in ast.walk(ast.parse(code)) if isinstance(node, ast.Call))
    found: dict = {}
    for field, value in (s for call in calls for s in _statements(call)):
        found.setdefault(field, value)
    return found


def in_source(sources: DataFrame) -> DataFrame:
    """path, source, config, tokenizer, seq_len, problem for sources (path, text): a row for each file that states something or doesn't parse.

    Null text is empty. A file that can't be parsed, or is nested too deeply, has a problem and nothing else; a length beyond 64 bits isn't one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    found = stated_in(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {str(e)[:200]}"))
                    continue
                length = found.get("seq_len")
                kept = length if length is not None and -(2**63) <= length < 2**63 else None
                fields = (found.get("source"), found.get("config"), found.get("tokenizer"), kept)
                rows += [(path, *fields, None)] if any(f is not None for f in fields) else []
            yield pd.DataFrame(rows, columns=["path", "source", "config", "tokenizer", "seq_len", "problem"]).astype({"seq_len": "Int64"})

    return sources.select("path", "text").mapInPandas(run, STATED)


def read_sources(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """in_source of a tree's files; bytes that aren't UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return in_source(files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")))


def in_payload(payload: Column) -> Column:
    """Struct of the fields that a JSON object states; null where it is none, or names no corpus.

    Keys are compared in lower case, and of keys that are then the same the last counts. A text field is that of its first key that is there, if it
    is a text that isn't blank; a number that of the first key with a number, cut to a whole one. Without a name the source is the name, else the config.
    """
    entries = F.map_entries(F.from_json(F.when(F.try_parse_json(payload).isNotNull(), payload), "map<string, variant>"))
    # One array of (key, value) in lower case; the fields below look into it.
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), F.schema_of_variant(e["value"]).alias("kind"), e["value"].alias("value")))

    def of(key: str) -> Column:
        return F.try_element_at(F.filter(lowered, lambda e: e["key"] == key), F.lit(-1))

    def text(key: str) -> Column:
        stripped = F.regexp_replace(F.try_variant_get(of(key)["value"], "$", "string"), r"(?U)^\s+|\s+$", "")
        return F.when((of(key)["kind"] == "STRING") & (stripped != ""), stripped)

    def number(key: str) -> Column:
        return F.when(of(key)["kind"].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(of(key)["value"], "$", "double").cast("long"))

    def first_there(keys: tuple[str, ...]) -> Column:
        return reduce(lambda rest, key: F.when(of(key).isNotNull(), text(key)).otherwise(rest), reversed(keys), F.lit(None).cast("string"))

    fields = {field: F.coalesce(*map(number, keys)) if field in NUMBERS else first_there(keys) for field, keys in PAYLOAD_KEYS.items()}
    name = F.coalesce(fields["name"], fields["source"], fields["config"])
    return F.when(name.isNotNull(), F.struct(name.alias("name"), *[fields[f].alias(f) for f in PAYLOAD_KEYS if f != "name"]))


DECLARED = """path string, kind string, name string, source string, config string, tokenizer string, vocab_size long, seq_len long,
    splits map<string, struct<n_tokens: long, n_records: long, n_bytes: long>>, problem string"""


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def read_manifests(spark: SparkSession, root: str, pattern: str = "corpora.toml") -> DataFrame:
    """path, kind, name, fields, splits and problem of a tree's manifests.

    kind is ``corpus`` (its fields and splits), ``family`` or ``run`` (name is assigned the corpus named in source). A manifest that doesn't parse is a
    row with a problem. Texts stay texts and whole numbers numbers: a field of another kind is null.
    """
    import tomllib

    def parse(path: str, content: bytes) -> list[tuple]:
        doc = tomllib.loads(content.decode())
        rows = []
        for name, body in (doc.get("corpus") or {}).items():
            if isinstance(body, dict):
                texts = [body.get(k) if isinstance(body.get(k), str) else None for k in ("source", "config", "tokenizer")]
                splits = {k: {n: _whole(v.get(n)) for n in ("n_tokens", "n_records", "n_bytes")} for k, v in (body.get("splits") or {}).items() if isinstance(v, dict)}
                rows.append((path, "corpus", name, *texts, *[_whole(body.get(k)) for k in NUMBERS], splits, None))
        for kind in ("family", "run"):
            rows += [(path, kind, name, str(corpus), None, None, None, None, None, None) for name, corpus in ((doc.get("assign") or {}).get(kind) or {}).items()]
        return rows

    columns = ["path", "kind", "name", "source", "config", "tokenizer", "vocab_size", "seq_len", "splits", "problem"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += parse(path, bytes(content))
                except (ValueError, AttributeError, TypeError) as e:
                    rows.append((path, *[None] * 8, f"{type(e).__name__}: {str(e)[:200]}"))
            yield pd.DataFrame(rows, columns=columns).astype({"vocab_size": "Int64", "seq_len": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content").mapInPandas(run, DECLARED)


def assign(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """runs (name, family, corpus: what its artifacts state, or null) with corpus and by: the manifest's run, else its family, else the artifacts.

    An assignment counts only if the corpus that it names is declared; else the artifacts do, and an empty name is none. Of manifests that assign
    one name twice, that of the smallest path counts, then the smallest corpus.
    """
    good = manifests.filter("problem IS NULL")
    declared = good.filter("kind = 'corpus'").select(F.col("name").alias("_to")).distinct().withColumn("_there", F.lit(True))
    best = good.filter("kind <> 'corpus' AND source <> ''").groupBy("kind", F.col("name").alias("key")).agg(F.min(F.struct("path", "source"))["source"].alias("to"))
    of = lambda kind, column: best.filter(F.col("kind") == kind).select(F.col("key").alias(column), F.col("to").alias(f"_{kind}"))
    joined = runs.join(of("run", "name"), "name", "left").join(of("family", "family"), "family", "left").withColumn("_to", F.coalesce("_run", "_family")).join(declared, "_to", "left")
    by = F.when(F.col("_there") & F.col("_run").isNotNull(), "run").when(F.col("_there"), "family").when(F.col("corpus").isNotNull(), "artifacts")
    return joined.withColumn("by", by).withColumn("corpus", F.when(F.col("_there"), F.col("_to")).otherwise(F.col("corpus"))).select(*runs.columns, "by")
