"""Verdicts on hypotheses and retrieval of passages, rule by rule."""

import hashlib
import random
from datetime import datetime

from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import ledger, passages, prereg

ARMS = "family string, metric string, name string, value double, ci_low double, ci_high double, members array<string>"
HYP = "hyp_id string, family string, metric string, expect string, margin double, allow_single_run boolean, registered_at timestamp, content string, digest string"


def test_verdicts(spark):
    t = lambda h, s=0, us=0: datetime(2026, 1, 1, h, 0, s, us)
    arms = [("f", "loss", "low", 0.1, 0.05, 0.15, ["l1", "l2", "l3"]), ("f", "loss", "mid", 0.2, 0.12, 0.28, ["m1"]), ("f", "loss", "top", 0.5, 0.4, 0.6, []), ("f", "loss", "one", 0.3, None, None, ["one"]), ("f", "loss", "none", None, None, None, None), ("f", "loss", "l2", 0.9, 0.8, 1.0, [])]
    content, spaced = '{"by":1,"id":"x"}', '{ "id": "x",\n "by": 1.0 }'
    sha = hashlib.sha256(content.encode()).hexdigest()

    def h(name, expect, margin=0.0, allow=False, at=t(5), content=content, metric="loss"):
        return (name, "f", metric, expect, margin, allow, at, content, sha)

    rows = [
        h("apart", "low < top"), h("touch", "top > low", 0.25), h("beyond", "low < top", 0.56), h("between", "low < top", 0.3), h("overlap", "low < mid"), h("wrong", "top < low"),
        h("bare", "one < top"), h("allowed", "one < top", 0.2, True), h("not", "one > top", 0.0, True), h("absent", "low < nobody"), h("empty", "low < none"), h("seed", "l1 < top"), h("own", "l2 > top"),
        h("chain", "low < mid < top"), h("chain2", "low < nobody < mid > top"), h("chain3", "low<top>mid"), h("metric", "low < top", metric="acc"),
        h("cut", "low <"), h("twice", "low < low"), h("null", None), h("late", "low < top", at=t(3, 7)), h("early", "low < top", at=t(3, 6)), h("undated", "low < top", at=None), h("spelled", "low < top", content=spaced), h("changed", "low < top", content='{"by":2,"id":"x"}'), h("lost", "low < top", content=None),
    ]
    evidence = [("f", "low", t(3, 7, 900000)), ("f", "low", t(9)), ("f", "mid", t(8)), ("g", "top", t(1))]
    got = {r.hyp_id: r for r in prereg.judge(spark.createDataFrame(rows, HYP), spark.createDataFrame(arms, ARMS), spark.createDataFrame(evidence, "family string, arm string, at timestamp")).collect()}
    assert {k: r.verdict for k, r in got.items()} == {
        "apart": "confirmed", "touch": "confirmed", "beyond": "refuted", "between": "inconclusive", "overlap": "inconclusive", "wrong": "refuted",
        "bare": "inconclusive", "allowed": "confirmed", "not": "refuted", "absent": "untested", "empty": "untested", "seed": "inconclusive", "own": "confirmed",
        "chain": "inconclusive", "chain2": "refuted", "chain3": "confirmed", "metric": "untested",
        "cut": None, "twice": None, "null": None, "late": "confirmed", "early": "confirmed", "undated": "confirmed", "spelled": "confirmed", "changed": "confirmed", "lost": "confirmed",
    }
    assert got["chain2"].why == "no such arm; no such arm; intervals" and got["seed"].why == "a replicate, not an arm"
    assert got["late"].post_hoc and got["late"].before == "low" and not got["early"].post_hoc and not got["undated"].post_hoc and got["chain"].before == "low"
    assert {k for k, r in got.items() if r.altered} == {"changed", "lost"}


def test_passages(spark):
    rng = random.Random(4)
    vocabulary = ["network", "networks", "training", "trained", "rates", "the", "of", "losses", "loss", "model", "models", "don't", "ünder"]
    phrase = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)))
    texts = [(s, n, phrase()) for s in range(3) for n in range(30)] + [(7, 0, None)]
    claims = [(f"c{i}", i % 4, phrase()) for i in range(12)] + [("none", 0, None), ("stop", 1, "of the")]
    p = spark.createDataFrame(texts, "source long, n int, text string")
    c = spark.createDataFrame(claims, "claim_id string, source long, text string")
    found = passages.retrieve(c, p)
    stems = dict(spark.createDataFrame([(w,) for w in {x for r in texts + claims for x in [r[2] or ""]}], "t string").select("t", X.content_stems(F.col("t"))).collect())
    want = {}
    for claim, source, text in claims:
        own = set(stems[text or ""])
        scored = [(-len(own & set(stems[t or ""])) / len(own), n) for s, n, t in texts if s == source and own & set(stems[t or ""])]
        want |= {(claim, n): (rank, -score) for rank, (score, n) in enumerate(sorted(scored)[:12], 1)}
    assert {(r.claim_id, r.n): (r["rank"], r.coverage) for r in found.collect()} == want
    vectors = spark.createDataFrame([(s, n, [float(n), 1.0]) for s, n, _ in texts if (s, n) != (2, 0)], "source long, n int, embedding array<double>")
    ordered = passages.rerank(found, spark.createDataFrame([(f"c{i}", [1.0, 0.0]) for i in range(11)], "claim_id string, embedding array<double>"), vectors).collect()
    assert {(r.claim_id, r.n) for r in ordered} == set(want)
    bare = {k for k, n in want if k == "c11" or (int(k[1:]) % 4 == 2 and n == 0)}
    for name in {k for k, _ in want}:
        mine = sorted((r["rank"], r.n, r.mode) for r in ordered if r.claim_id == name)
        by_vector = name not in bare and len(mine) > 1
        assert {m for _, _, m in mine} == {"vector" if by_vector else "lexical"}
        key = (lambda n, name=name: (-(want[name, n][1] + n), n)) if by_vector else (lambda n, name=name: (-want[name, n][1], n))
        assert [n for _, n, _ in mine] == sorted([n for k, n in want if k == name], key=key)


def test_pooling_vetoes(spark):
    row = lambda arm, name, seed, split="test", /, **config: ("f", arm, name, seed, split, config or None)
    members = [
        row("good", "good", 1, seed="1", lr="0.1"), row("good", "good-2", 2, seed="2", lr="0.1"), row("good", "good-3", 3), row("seeds", "s1", 1), row("seeds", "s2", 1), row("splits", "p1", 1), row("splits", "p2", 2, None),
        row("settings", "c1", 1, lr="0.1", depth="2"), row("settings", "c2", 2, lr="0.2"), row("held", "h1", 1), row("held", "h2", 2), row("lent", "held", 1), row("loose", "l1", 4), row("loose", "l2", 4),
    ]
    df = spark.createDataFrame(members, "family string, arm string, name string, seed long, split string, config map<string, string>")
    others = spark.createDataFrame([("f", "loose"), ("g", "good")], "family string, name string")
    got = {r.arm: (r.veto, r.differing) for r in ledger.pool_vetoes(df, others).collect()}
    assert got == {"good": (None, ""), "seeds": ("a seed twice", ""), "splits": ("different splits", ""), "settings": ("different settings", "depth,lr"), "held": ("a run has this name", ""), "lent": (None, ""), "loose": ("a run has this name", "")}
    assert ledger.pool_vetoes(df.limit(0)).count() == 0
