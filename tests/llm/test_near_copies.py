"""The pipeline's near-copy stage on planted copies and against all pairs."""

import random

import pytest

import corpus_pipeline
from tracewright.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Texts of 60 to 400 words, with a copy of each that differs in a few words."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(150):
        own = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        changed = list(own)
        for at in rng.sample(range(len(own)), max(1, len(own) * rng.randint(1, 35) // 1000)):
            changed[at] = "other"
        texts += [" ".join(own), " ".join(changed)]
    return texts


def groups(texts, bound=0.8):
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and jaccard(sets[i], sets[j]) >= bound:
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    return group


def run(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copy_stage(spark, table, "").collect()), key=str)


def test_planted_copies(spark):
    texts = planted()
    between = [jaccard(shingles(a), shingles(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert sum(0.8 <= s <= 0.95 for s in between) > 80 and sum(s < 0.8 for s in between) > 5
    kept = {i for i, _ in run(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])}
    assert kept == set(groups(texts))


@pytest.mark.parametrize("bucket", [4, 512])
def test_chains_and_common_passages(spark, bucket):
    """Texts that drift away from each other, and ones that share half of their words."""
    rng = random.Random(3)
    own, texts = [f"a{i}" for i in range(200)], ["", None, "one", "ONE", "a b c"]
    for step in range(60):
        texts.append(" ".join(own))
        own[rng.randrange(200)] = f"b{step}"
    passage = " ".join(f"p{i}" for i in range(150))
    texts += [f"{passage} " + " ".join(f"q{i}x{k}" for k in range(rng.randint(5, 60))) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    least = {}
    got = {r.row: r.component for r in minhash.near_groups(spark, rows, bucket=bucket).collect()}
    for i in sorted(got):
        least.setdefault(got[i], i)
    assert [least[got[i]] for i in range(len(texts))] == groups(texts)


def test_one_row_of_a_group_stays(spark):
    """Repeated ids with different texts, exactly repeated rows, null ids and texts."""
    copy, other, third = (" ".join(f"{c}{i}" for i in range(50)) for c in "xyz")
    rows = [(1, copy), (2, copy), (2, other), (3, third), (3, third), (None, third), (None, "alone"), (None, "alone"), (5, None), (None, None), (4, "")]
    rows = [(i, t, "en", "s", 0) for i, t in rows]
    want = sorted([(1, copy), (2, other), (3, third), (None, "alone"), (4, "")], key=str)
    assert run(spark, rows) == run(spark, rows[::-1]) == want
