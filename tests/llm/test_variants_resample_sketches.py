"""Spelling variants, resampling and sketches against brute force, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.oracle import check
from tracewright.llm import langid, quality, queries, resample, sketches, variants

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def corpus():
    """(doc_id, text): null, empty and blank texts, a long one, repeats, ids that repeat and null ids."""
    rng = random.Random(3)
    stems = ["Letter", "better", "bettr", "lettter", "étude", "etude", "études", "Straße", "naïve×a", "aaaaaa", "aaaaa", "word", "x" * 40, "日本", "a1b2c3"]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "ONE"), (4, "letter " * 6000), (5, "ß÷àé " * 30)]
    rows += [(i, " ".join(rng.choice(stems) for _ in range(rng.randint(0, 60)))) for i in range(6, 60)]
    return [*rows, (60, rows[30][1]), (61, rows[30][1]), (62, rows[30][1].upper())]


REPEATED = [(7, "letter better"), (7, "letter better"), (7, "other words stand here in this one, more than five"), (None, "letter letter letter"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", 1, "w") for i, t in corpus() + REPEATED]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, word long, rank string").repartition(3).cache()


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# spelling variants


def vocabulary_by_hand(rows, drop_every, min_length=5, min_count=3):
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= min_length and n >= min_count}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("drop_every", [None, 3])
def test_variants(spark, docs, drop_every):
    words = variants.vocabulary(spark, docs, drop_every=drop_every)
    want = vocabulary_by_hand(corpus() + REPEATED, drop_every)
    assert {r.word: r.n for r in words.collect()} == want
    got = found(variants.spelling_variants(spark, words))
    assert got == variants_by_hand(want) and sum(form is not None for form, *_ in got.values()) > 3


def test_variants_of_random_words_in_slices(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))): rng.randint(1, 60) for _ in range(700)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = variants_by_hand(words)
    assert found(variants.spelling_variants(spark, df)) == want
    assert variants.Layout(len(words), 1 << 14).slices > 1
    assert found(variants.spelling_variants(spark, df, slice_bits=1 << 14)) == want
    assert max(len({w, want[w][0], want[w][1]}) for w in words) == 3  # chains


def test_each_candidate_once():
    import numpy as np

    letters = np.array([ord(c) for c in "abz"], dtype=np.uint64)
    everything = lambda h, ok: zip(*(x.tolist() for x in np.nonzero(ok)), strict=True)
    for word in ("a", "aab", "abba", "zzzz"):
        got = [c for _, c in variants.candidates([word], letters, everything)]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abz"} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abz"}
        assert len(got) == len(set(got)) and set(got) == want - {word}


def test_pieces_cut_between_runs(monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 7)
    text = "one two threefourfive six" + "x" * 30 + " end"
    parts = list(variants._pieces(text))
    assert "".join(parts) == text and [w for p in parts for w in variants.RUN.findall(p)] == variants.RUN.findall(text) and len(parts) > 2


def test_variants_of_nothing(spark, empty):
    words = variants.vocabulary(spark, empty)
    assert words.count() == 0 and variants.spelling_variants(spark, words).collect() == []
    with pytest.raises(ValueError):
        variants.spelling_variants(spark, words, ratio=1)


# resampling


def features_by_hand(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UP))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def resample_by_hand(rows, target, percent=25, min_words=20, seed=7, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features_by_hand(text)[1]))
    for text in target:
        t.update(map(bucket, features_by_hand(text)[1]))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(n + buckets) / (float(s[b] + 1) * float(m + buckets))))
    out = []
    for i, text in rows:
        words, own = features_by_hand(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0], r[2], r[3]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted((*r, ranks.get(id(r))) for r in out if r[0] is not None), sorted(r[1:] for r in out if r[0] is None)


@pytest.mark.parametrize("chunk_words", [1 << 20, 50])
def test_resample(spark, docs, chunk_words):
    aims = ["better letter of the word", None, "", "étude naïve better letter"]
    target = spark.createDataFrame([(t, 1) for t in aims], "item string, id long")
    got = resample.resample(spark, docs, target, target_text_col="item", chunk_words=chunk_words, percent=40).collect()
    want, nulls = resample_by_hand(corpus() + REPEATED, aims, percent=40)
    rows = [tuple(r) for r in got]
    assert sorted((r for r in rows if r[0] is not None), key=lambda r: r[:5]) == want
    assert sorted(list(r[1:5]) for r in rows if r[0] is None) == [list(x) for x in nulls]
    assert sorted(r[5] for r in rows if r[5]) == list(range(1, 1 + sum(1 for r in rows if r[5]))) and any(r[5] for r in rows)


def test_resample_of_nothing(spark, docs, empty):
    assert resample.resample(spark, empty, docs).collect() == []
    got = resample.resample(spark, docs, empty, percent=100).collect()
    want, _ = resample_by_hand(corpus() + REPEATED, [], percent=100)
    assert sorted((tuple(r) for r in got if r.id is not None), key=lambda r: r[:5]) == want


def test_packed_columns():
    import numpy as np

    a, b = np.array([3, 0, 2**32 - 1]), np.array([], dtype=np.int64)
    (x, y), words = resample._unpack(resample._pack(a, b, words="é\nx".encode()))
    assert x.tolist() == a.tolist() and y.tolist() == [] and words.decode() == "é\nx"
    values, sizes = np.array([1, 4, 9, 0, 2, 7]), np.array([3, 1, 2])
    first = np.array([1, 0, 0, 1, 1, 0], dtype=bool)
    assert resample._sums(resample._deltas(values, first), sizes).tolist() == values.tolist()


# sketches


def sketch_by_hand(text, words=5, fraction=1 / 8):
    own = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(UP)) if w]
    h = {hashlib.md5(" ".join(own[i : i + words]).encode()).hexdigest()[:16] for i in range(max(len(own) - words, 0) + 1)} if own else set()
    below = sorted(x for x in h if int(x, 16) < fraction * 2**64)
    return below or sorted(h)[:1]


def likeness_by_hand(a, b):
    least = min(len(a), len(b))
    return len(set(a) & set(b)) / least if least else float(len(a) == len(b))


def edited_by_hand(rows):
    """For unique ids."""
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for k, (i, t) in enumerate(line):
        t, after = t or "", line[(k + 1) % len(line)][1] or ""
        n = len(t) // 3
        out[i] = (len(t), t[: len(t) - n] + after[:n], after)
    return out


@pytest.mark.parametrize("extra", [[], [(None, "the null one comes last of all")]])
def test_edited(spark, extra):
    rows = corpus() + extra
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, own long").repartition(5)
    want, texts = edited_by_hand(rows), dict(rows)
    for r in sketches.edited(spark, df).collect():
        n, changed, after = want[r.id]
        assert (r.n_chars, r.edited) == (n, changed)
        assert (r.own, r.of_edited, r.of_next) == (sketch_by_hand(texts[r.id]), sketch_by_hand(changed), sketch_by_hand(after))
        want.pop(r.id)
    assert not want


def test_edited_with_repeated_ids(spark, docs, empty, monkeypatch):
    few = spark.createDataFrame(REPEATED, "doc_id long, text string")
    got = sorted((str(r.id), r.n_chars, r.edited) for r in sketches.edited(spark, few).collect())
    # null is followed by 7, whose least head stands for it; 7 is followed by null, whose least head is that of the empty text
    texts = {None: "", 7: "letter better"}
    want = []
    for i, t in REPEATED:
        t, after = t or "", texts[7 if i is None else None]
        want.append((str(i), len(t), t[: len(t) - len(t) // 3] + after[: len(t) // 3]))
    assert got == sorted(want)
    assert sketches.edited(spark, empty).collect() == []
    one = sketches.edited(spark, empty.unionByName(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string"))).collect()
    assert [(r.id, r.edited) for r in one] == [(4, "abcdab")]


def test_hot_ids_are_dealt(spark):
    rows = [(5, f"text {i} of the id that most rows have") for i in range(2500)] + [(6, "six stands before five"), (4, "four stands behind")]
    got = sketches.edited(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    texts = {5: min(t for i, t in rows if i == 5), 4: "four stands behind", 6: "six stands before five"}
    assert len(got) == len(rows)
    for r in got:
        after, n = texts[{6: 5, 5: 4, 4: 6}[r.id]], r.n_chars // 3
        assert r.edited == r.text[: r.n_chars - n] + after[:n]


def test_merge_and_containment(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    long = " ".join(rng.choice(words) for _ in range(3000))
    part = " ".join(long.split()[400:1000])
    rows = [("a", long), ("a", "short one"), ("b", "short one"), ("b", ""), ("c", part), ("c", None)]
    df = spark.createDataFrame(rows, "k string, text string").select("k", sketches.sketch(F.col("text")).alias("s"))
    both = {r.k: r.s for r in sketches.merged(df, ["k"], "s").collect()}
    again = {r.k: r.s for r in df.groupBy("k").agg(sketches.merge(F.collect_list("s")).alias("s")).collect()}
    assert both == again
    assert both["a"] == sorted({*sketch_by_hand(long), *(x for x in sketch_by_hand("short one") if int(x, 16) < 2**61)}) and both["b"] == sketch_by_hand("short one")
    share = spark.createDataFrame([(both["c"], both["a"])], "p array<string>, q array<string>").select(sketches.containment(F.col("p"), F.col("q"))).first()[0]
    assert share > 0.98
    with pytest.raises(ValueError):
        sketches.limit(0)
    assert sketches.limit(1) > "f" * 16


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_importance_resampling", "op13_document_fingerprints"])
def test_against_sql(spark, name):
    assert check(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF) > 100


def test_native(spark):
    df = queries.op13_document_fingerprints(spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExternalRDD"))


# fits of earlier operators


@pytest.mark.parametrize("one_id", [3, 7, 12, None])
def test_language_with_one_id(spark, one_id):
    rows = [(one_id, f"aa words of text {i}", "aa") for i in range(300)] + [(i, f"bb other text {i}", "bb") for i in range(300)] + [(None, None, "cc"), (1, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df)
    assert model.languages == ("aa", "bb") and all(t.count(langid.BETWEEN) == 23 for t in model.texts)
    assert langid.fit(df.coalesce(1)) == model


def test_shared_lines_are_a_parameter(spark):
    rows = [(i, f"good prose number {i * 7919}\nthis line stands in all of the texts") if i % 2 else (i, f"zz {i} qq\nthis line stands in all of the texts") for i in range(80)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    line = b"this line stands in all"
    held = {n: quality.fit(spark, docs, labels, shared_line_bytes=n) for n in (20, None)}
    assert line not in held[20].good + held[20].bad and line in held[None].good and line in held[None].bad
