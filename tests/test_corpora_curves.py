"""Corpora stated in code, payloads and manifests; curves written by a stream that stops and goes on."""

import glob
import json

import pytest

from tracewright.operators import corpora as merge
from tracewright.sources import corpora
from tracewright.streaming import curves

CODE = [
    ("plain", "from d import load_dataset\nds = load_dataset('org/shelf', 'v2')\nenc = t.get_encoding('base9')\nfit(ds, block_size=512)", ("org/shelf", "v2", "base9", 512)),
    ("first wins", "load_dataset('one')\nload_dataset('two', 'b')\n", ("one", "b", None, None)),
    ("outer first", "if x:\n    load_dataset('inner')\nload_dataset('outer')", ("outer", None, None, None)),
    ("variables", "load_dataset(name, 'c')\nget_encoding(tok)", (None, "c", None, None)),
    ("truth", "fit(seq_len=True, max_seq_len=64)", (None, None, None, 64)),
    ("text length", "fit(seq_len='64', block_size=2 * 8)", None),
    ("nothing", "print('load_dataset')", None),
    ("method", "hub.load_dataset('m').map(seq_len=7)", ("m", None, None, 7)),
    ("huge", f"fit(seq_len={2**70})", None),
]


def test_corpora_in_source(spark):
    rows = [(n, c) for n, c, _ in CODE] + [("broken", "def f(:\n"), ("zero", "a\0b"), ("null", None), ("empty", "")]
    found = {r["path"]: r for r in corpora.in_source(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {n: tuple(r[1:5]) for n, r in found.items() if r["problem"] is None} == {n: want for n, _, want in CODE if want}
    assert {n for n, r in found.items() if r["problem"]} == {"broken", "zero"} and all(tuple(found[n][1:5]) == (None,) * 4 for n in ("broken", "zero"))


def test_source_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "train.py").write_bytes(b"# \xff\nload_dataset('deep')\n")
    (tmp_path / "notes.txt").write_text("load_dataset('no')")
    assert [r["source"] for r in corpora.read_sources(spark, str(tmp_path)).collect()] == ["deep"]


PAYLOADS = [
    ('{"dataset": " shelf ", "vocab_size": 300.9, "seq_len": true, "block_size": 8}', ("shelf", None, None, None, 300, 8)),
    ('{"corpus": "b", "dataset": 5}', None),  # the first key is there and is no text: it ends the search
    ('{"corpus": "b", "dataset": 5, "hf_dataset": "org/b"}', ("org/b", "org/b", None, None, None, None)),
    ('{"Subset": "small", "ENCODING": "base9"}', ("small", None, "small", "base9", None, None)),
    ('{"tokenizer": "base9"}', None),
    ('{"data": "x", "n_vocab": "many", "context_length": -2.5}', ("x", None, None, None, None, -2)),
    ('{"data": "  "}', None), ("[1]", None), ("{", None), ("", None), (None, None), ("3", None), ('{"data": null, "corpus_name": "y"}', None),
]


def test_corpora_in_payload(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAYLOADS)], "i int, p string")
    got = {r["i"]: r["c"] and tuple(r["c"]) for r in df.select("i", corpora.in_payload(df["p"]).alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PAYLOADS)}


def test_manifests_assign_and_merge(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "corpora.toml").write_text('[corpus.shelf]\nsource = "org/shelf"\nseq_len = 64\nvocab_size = "x"\n[corpus.shelf.splits.train]\nn_tokens = 9\n[corpus.other]\nconfig = "c"\n[assign.family]\nf1 = "shelf"\n[assign.run]\nr2 = "other"\nr5 = "gone"\n')
    (tmp_path / "p" / "corpora.toml").write_text("[corpus\n")
    read = corpora.read_manifests(spark, str(tmp_path))
    rows = read.collect()
    assert sorted(((r["kind"], r["name"], r["source"]) for r in rows if r["problem"] is None), key=str) == [("corpus", "other", None), ("corpus", "shelf", "org/shelf"), ("family", "f1", "shelf"), ("run", "r2", "other"), ("run", "r5", "gone")]
    shelf = next(r for r in rows if r["name"] == "shelf")
    assert (shelf["seq_len"], shelf["vocab_size"], shelf["splits"]["train"]["n_tokens"]) == (64, None, 9) and sum(r["problem"] is not None for r in rows) == 1
    runs = spark.createDataFrame([("r1", "f1", "a"), ("r2", "f1", None), ("r3", "f2", "a"), ("r4", None, None), ("r5", "f1", "a")], "name string, family string, corpus string")
    got = {r["name"]: (r["corpus"], r["by"]) for r in corpora.assign(runs, read).collect()}
    assert got == {"r1": ("shelf", "family"), "r2": ("other", "run"), "r3": ("a", "artifacts"), "r4": (None, None), "r5": ("a", "artifacts")}
    declared = read.filter("kind = 'corpus' AND name = 'shelf'").selectExpr("name", "1L AS place", "source", "config", "tokenizer", "vocab_size", "seq_len", "path AS source_path")
    stored = spark.createDataFrame([("shelf", "mirror/shelf", None)], "name string, source string, config string").selectExpr("*", "CAST(NULL AS string) AS tokenizer", "5L AS vocab_size", "CAST(NULL AS long) AS seq_len", "CAST(NULL AS string) AS source_path")
    merged = merge.upsert(stored, declared).first()
    assert merged["contested"] and merged["seq_len"] == 64 and merged["vocab_size"] == 5


def event(run, seq, name="loss", step=0, value=1.0, split=None, labels=None, kind="point", at=None):
    return {"run_id": run, "seq": seq, "kind": kind, "name": name, "split": split, "labels": labels, "step": step, "value": value, "at": at}


def put(folder, n, events):
    (folder / f"{n}.json").write_text("\n".join(json.dumps(e) for e in events))


def test_curves_go_on_after_a_stop(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def go(rising=False, root=root):
        stream = spark.readStream.schema(curves.EVENTS).option("maxFilesPerTrigger", 1).json(str(source))
        curves.write_curves(stream, root, f"{root}/checkpoint", "made.history/1", rising).awaitTermination(300)

    put(source, 1, [event("a", 2, "acc", 1, 0.5, "test", {"k": "v"}), event("a", 1), event("b", 1, value=2.0)])
    go()
    assert not glob.glob(f"{root}/histories/*")  # nothing is there before an end
    put(source, 2, [event("a", 3, step=0, value=0.25, at="2031-01-01T00:00:00Z"), event("a", 2, "acc", 1, 0.5), event("a", 4, step=-1), event("a", 5, name=None), event("a", 6, value=None), event("a", 7, kind="end"), event("a", 8), event("c", 1, kind="end")])
    go()
    lines = spark.read.text(f"{root}/histories/run_id=a").collect()
    want = [
        {"schema": "made.history/1"}, {"series": 0, "name": "loss", "split": None, "labels": {}}, {"series": 0, "step": 0, "value": 1, "at": None},
        {"series": 1, "name": "acc", "split": "test", "labels": {"k": "v"}}, {"series": 1, "step": 1, "value": 0.5, "at": None},
        {"series": 0, "step": 0, "value": 0.25, "at": "2031-01-01T00:00:00Z"},
    ]
    assert [json.loads(r["value"]) for r in lines] == want and len(glob.glob(f"{root}/histories/run_id=a/part-*")) == 1
    assert lines[2]["value"] == '{"at":null,"series":0,"step":0,"value":1}'
    assert sorted(p.rsplit("=")[-1] for p in glob.glob(f"{root}/histories/run_id=*")) == ["a"]
    assert sorted((r["seq"], r["reason"]) for r in curves.refused(spark, root).collect()) == [
        (2, "delivered twice or too late"), (4, "a negative step"), (5, "a point without a name or a step"), (6, "neither a point nor an end, or without a place"), (8, "after the end")]
    before = {r["run_id"]: tuple(r) for r in curves.references(spark, root).collect()}
    assert before["a"][2:] == (2, 3)
    put(source, 3, [event("b", 2, kind="end")])
    go()
    after = {r["run_id"]: tuple(r) for r in curves.references(spark, root).collect()}
    assert after["a"] == before["a"] and after["b"][2:] == (1, 1)


def test_batch_again_changes_nothing(spark, tmp_path):
    """A batch whose function ran before the stop, but wasn't noted, runs again: the same files come out."""
    rows = [("r", 0, '{"schema":"x"}', False, None, None), ("r", 1, "{}", False, None, 1), ("r", 2, None, True, None, 2)]
    batch = spark.createDataFrame(rows, curves.LINES)
    seen = []
    for _ in range(2):
        curves.write_batch(str(tmp_path))(batch, 7)
        seen.append([r["value"] for r in spark.read.text(f"{tmp_path}/histories/run_id=r").collect()])
    assert seen[0] == seen[1] == ['{"schema":"x"}', "{}"]


@pytest.mark.parametrize("rising", [False, True])
def test_steps_that_do_not_rise(spark, tmp_path, rising):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    put(source, 1, [event("a", i, step=s, value=float(s)) for i, s in enumerate([3, 3, 2, 4])] + [event("a", 9, kind="end")])
    stream = spark.readStream.schema(curves.EVENTS).json(str(source))
    curves.write_curves(stream, root, f"{root}/checkpoint", "made.history/1", rising).awaitTermination(300)
    steps = [json.loads(r["value"]).get("step") for r in spark.read.text(f"{root}/histories/run_id=a").collect()]
    assert [s for s in steps if s is not None] == ([3, 4] if rising else [3, 3, 2, 4])
