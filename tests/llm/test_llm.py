"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import bpe, embed_dedup, exact_dedup, langid, lattice_lm, line_dedup, packing, quality, queries, simhash, wavelet
from tracewright.llm.components import connected_components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def corpus():
    """Rows (doc_id, text, lang, _doc, row) with clashing names."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "Épsilon", "zeta's", "42", "x<|endoftext|>y", "日本", "…", "a\u0301b"]
    shared = ["This line is in many documents, it is.", "  ANOTHER Line of more than twenty characters\t", "short line", "Ünïcödé line of twenty chars or more"]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, " \t "), (4, "one"), (5, "one"), (6, "ONE"), (7, "word " * 9000)]
    for i in range(8, 60):
        own = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        own += rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(60, rows[20][1]), (61, rows[20][1].upper()), (62, rows[20][1])]
    return [(i, t, "en" if i % 2 else None, i * 7, "r") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, _doc long, row string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def lines_by_hand(rows, min_docs=3):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(UP)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= 20 and len(holders[key(x)]) >= min_docs and i != max(holders[key(x)]))]
        out[i] = ("\n".join(kept), len(own), len(own) - len(kept))
    return out


@pytest.mark.parametrize("limit", [64 << 20, 40, 0])  # all broadcast; the filters alone or nothing
def test_lines(spark, docs, limit):
    got = line_dedup.dedup_lines(spark, docs, broadcast_bytes=limit)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_dropped"}
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert found == lines_by_hand([r[:2] for r in corpus()])
    assert sum(n for _, _, n in found.values()) > 10


def test_lines_can_be_taken_back(spark, docs):
    rows = [r[:2] for r in corpus()]
    one, two = docs.filter("doc_id < 30"), docs.filter("doc_id >= 30")
    index = line_dedup.LineIndex(spark, shards=4).insert(one).insert(two)
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in index.apply(docs).collect()} == lines_by_hand(rows)
    back = index.delete(two.select("doc_id"))
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in back.apply(one).collect()} == lines_by_hand(rows[:30])
    assert {tuple(r) for r in back.refs.collect()} == {tuple(r) for r in line_dedup.LineIndex(spark).insert(one).refs.collect()}


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 63, 20_000).astype(np.uint64)
    f = line_dedup.CuckooFilter.sized(len(keys))
    f.insert(keys)
    assert f.contains(keys).all()
    other = rng.integers(1, 1 << 63, 20_000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01
    assert (line_dedup.CuckooFilter.from_bytes(f.to_bytes()).contains(keys) == f.contains(keys)).all()


def test_cuckoo_filter_keeps_count_of_equal_fingerprints():
    """More equal ones than two buckets hold go to the stash; each deletion takes one away."""
    key = np.array([(77 << 48) | 5] * 11, dtype=np.uint64)
    f = line_dedup.CuckooFilter(np.zeros((16, line_dedup.SLOTS), dtype=np.uint16))
    f.insert(key)
    assert sum(f.stash.values()) == 3
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    for n in range(11):
        assert f.contains(key[:1]).all()
        f.delete(key[:1])
    assert not f.contains(key[:1]).any() and not f.buckets.any() and not +f.stash


def test_lines_of_documents_that_the_index_lacks(spark, docs):
    """The answer is the same whether filters and counts are broadcast, the filters alone, or nothing."""
    line = "A line of the index, long enough to count."
    held = spark.createDataFrame([(i, line) for i in range(4)], "doc_id long, text string")
    new = spark.createDataFrame([(9, f"{line}\nown"), (3, line), (None, line)], "doc_id long, text string")
    for limit in (64 << 20, 600, 0):
        index = line_dedup.LineIndex(spark, broadcast_bytes=limit, shards=2).insert(held)
        got = {r.doc_id: (r.text, r.n_dropped) for r in index.apply(new).collect()}
        assert got == {9: ("own", 1), 3: (line, 0), None: ("", 1)}


@pytest.mark.parametrize(("bits", "hot"), [(1 << 29, 256), (1 << 29, 1), (0, 256), (0, 1)])  # the filter broadcast or not, large groups broadcast or not
def test_exact(spark, docs, bits, hot, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 1 << 30)
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[(t or "").translate(UP)].append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    got = exact_dedup.exact_groups(spark, docs, broadcast_bits=bits, bits_per_row=5000)
    assert {(r.id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got.collect()} == want
    few = exact_dedup.exact_groups(spark, docs, broadcast_bits=bits, bits_per_row=1)  # nearly all may be repeated
    assert {(r.id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in few.collect()} == want


def test_drop_exact_copies(spark, empty):
    rows = [(1, "a", "x"), (1, "A", "y"), (None, "a", "z"), (2, "b", "w"), (2, "c", "w"), (None, None, "n"), (None, "", "m")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _gone string").withColumn("place", F.lit("p"))
    left = exact_dedup.drop_exact_copies(spark, table)
    assert left.columns == table.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in left.collect())
    assert [(i, t.lower()) for i, t in got] == [(0, ""), (1, "a"), (2, "b"), (2, "c")]
    assert exact_dedup.drop_exact_copies(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("engine", ["trie", "library"])
def test_encoding(name, engine):
    rng = random.Random(2)
    texts = ["", "  a  b\n\n c \n", "don't I'LL", "<|endoftext|>", "a  <|endoftext|>  b <|startoftext|>x", "İstanbul ΑΣ ﬁ ½x²", "日本語 テスト　です", "a\x1cb\x85c\xa0d", "😀 ok", " \u0301x", "ẞ ß", "x" * 300, "ab</w>c </w>", "\x00\x01 \x7f"]
    texts += ["".join(rng.choice("abAB é'\n\t.,1²ß…日\u0301 ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    v = bpe.Vocabulary(path, engine)
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in v.batch(texts)]
    assert got == want
    assert [v.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_encoding_in_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 40)
    text = "The  quick brown\n fox's 42 jumps over the <|endoftext|> lazy dog " * 20
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        for engine in ("trie", "library"):
            got = next(iter(bpe.Vocabulary(path, engine).batch([text])))
            assert np.frombuffer(got, dtype="<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_one_very_long_word():
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (255, 256, 257, 3000)] + ["x" * 20_000, "日" * 700, "a\U0001F600" * 400]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.Vocabulary(path).batch(words)]
        assert got == [Tokenizer.from_file(path).encode(w, add_special_tokens=False).ids for w in words]


def test_encode_table(spark, docs, empty):
    library = Tokenizer.from_file(queries.VOCABULARY)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in corpus()}
    for r in bpe.encode(docs, queries.VOCABULARY, decoded=True).collect():
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == want[r.doc_id if "doc_id" in r else r.id]
        assert r.decoded == library.decode(want[r.id], skip_special_tokens=False)
    assert bpe.encode(empty, queries.VOCABULARY).count() == 0


def check_plan(counts, capacity):
    runs, sequences = packing.plan(counts, capacity)
    used = Counter()
    for n in range(1, capacity + 1):
        own = runs[runs[:, 0] == n]
        for k in range(counts[n]):
            _, rank, seq, each, offset = own[np.searchsorted(own[:, 1], k, side="right") - 1]
            j = k - rank
            used[int(seq + j // each), int(offset + j % each * n)] = n
    by = defaultdict(list)
    for (s, at), n in used.items():
        by[s].append((at, n))
    assert len(used) == sum(counts) and len(by) == sequences
    for own in by.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= capacity
    return sequences


def fewest(lengths, capacity):
    """By trying everything."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_dominance_loses_nothing():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.randint(5, 30)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
        counts = [0] * (capacity + 1)
        for n in lengths:
            counts[n] += 1
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        left = [n for n in range(capacity, 0, -1) for _ in range(rest[n])]
        assert sum(t for t, _ in fixed) + fewest(left, capacity) == fewest(lengths, capacity)
        check_plan(counts, capacity)


def test_packing(spark, docs, empty):
    library = Tokenizer.from_file(queries.VOCABULARY)
    want = {}
    for i, t, *_ in corpus():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[i, p] = (at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
    rows = packing.pack(spark, docs, queries.VOCABULARY, bucket_rows=7).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by) <= -(-sum(n for _, n, _ in want.values()) // 4096) + 1
    assert packing.pack(spark, empty, queries.VOCABULARY).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    for n, bits in ((0, 16), (1, 16), (5000, 16), (3000, 18)):
        x = (rng.zipf(1.4, n) % (1 << bits)).astype("<u4")
        s = wavelet.Shard(wavelet.build(x, [None] if n else [], [n] if n else [], bits))
        assert (s.tokens() == x).all()
        for at in rng.integers(0, n, 20).tolist() if n else []:
            assert s.access(at) == x[at]
            places = np.flatnonzero(x == x[at])
            assert s.rank(int(x[at])) == len(places) and s.rank(int(x[at]), at) == (places < at).sum()
            assert s.select(int(x[at]), int((places < at).sum())) == at
        assert s.rank((1 << bits) - 3) == (x == (1 << bits) - 3).sum()


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_token_output(spark, docs, empty, size, tmp_path):
    library = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    at, want, everything = 0, {}, Counter()
    for i, t, *_ in corpus():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
        everything.update(ids)
    files = wavelet.write_shards(spark, docs, queries.BYTE_VOCABULARY, shard_tokens=size)
    assert {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_documents(spark, files).collect()} == want
    assert wavelet.count_token(files, 0).agg(F.sum("n")).first()[0] == everything[0]
    wavelet.export(files, f"file://{tmp_path}")
    assert sum(wavelet.Shard(p.read_bytes()).n for p in tmp_path.glob("*.wvm")) == at
    assert wavelet.read_documents(spark, wavelet.write_shards(spark, empty, queries.BYTE_VOCABULARY)).count() == 0


def quality_by_hand(spark, rows):
    """Every score from the model's dictionaries and weights, one compressor call for each block."""
    import zstandard

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = queries.quality_model(spark, table, "/root/testdata/sf0.01")
    params = zstandard.ZstdCompressionParameters.from_level(quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(side, text):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(side), compression_params=params)
        return sum(len(c.compress(text[at : at + quality.BLOCK])) for at in range(0, len(text), quality.BLOCK))

    for r in table.orderBy("doc_id").collect()[::7]:
        text = (r.text or "").encode()
        good, bad = size(model.good, text), size(model.bad, text)
        z = model.weights[-1]
        if text:
            x = ((bad - good) / len(text), min(good, bad) / len(text))
            z += sum(w * (a - m) / s for w, a, m, s in zip(model.weights, x, model.mean, model.scale, strict=False))
        assert abs(rows[r.doc_id].score - 1 / (1 + np.exp(-np.clip(z, -50, 50)))) < 1e-2


def test_quality_learns_from_whole_texts(spark):
    """What tells the classes apart stands after the first 5,000 bytes."""
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    rows = []
    for i in range(160):
        rows.append((i, " ".join([word("abcdefgh") for _ in range(900)] + [word("klmno" if i % 2 else "rstuv") for _ in range(300)]), i % 2))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(spark, table.select("doc_id", "text"), table.select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)


def test_quality(spark, docs, empty):
    rows = {r.doc_id: r for r in queries.op4_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    own = [(rows[r.doc_id].predicted, r.quality) for r in labels if rows[r.doc_id].held_out]
    assert sum(a == b for a, b in own) >= 0.95 * len(own)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows.values())
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    quality_by_hand(spark, rows)
    model = quality.fit(spark, docs, no_labels)
    scored = quality.score(docs, model, with_text=True)
    assert set(scored.columns) == {*docs.columns, "score"} and {r.score for r in scored.collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_language(spark, docs, empty):
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    own = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(own) >= 0.97 * len(own)
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[4] == ("en", 1.0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    own = spark.createDataFrame([(1, "½ ² Ⅷ", 1), (2, "123 …", 2), (3, "x²", 3), (4, "x" * 300_000, 4), (4, "x" * 300_000, 4)], "doc_id long, text string, score int")
    assert [r.lang_pred for r in langid.predict(own, model).orderBy("doc_id").collect()] == ["und", "und", "en", "en", "en"]


def test_language_by_hand(spark):
    """Entropies from longest matches that are looked for in the learned text itself; the later part of long texts is learned too."""
    rng = random.Random(10)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "éßñab"}
    rows = [(i, " ".join(word(letters[k]) for _ in range(rng.randint(1, 40))), k) for i, k in enumerate(list(letters) * 6)]
    rows.append((99, "abc " * 3000 + "zzyyxx " * 3, "aa"))
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("aa", "bb", "cc") and "zzyyxx" in model.texts[0]

    def entropy(learned, own):
        n, at = 0, 0
        while at < len(own):
            at += max((k for k in range(1, min(60, len(own) - at) + 1) if own[at : at + k] in learned), default=1)
            n += 1
        return n * np.log2(len(learned) + 1) / len(own)

    asked = [" ".join(word(letters[k]) for _ in range(8)) for k in letters for _ in range(6)]
    got = langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for text, r in zip(asked, got, strict=True):
        own = " " + " ".join(text.split()) + " "
        want = [entropy(t, own) for t in model.texts]
        assert r.lang_pred == model.languages[int(np.argmin(want))]
        assert abs(r.score - 1 / sum(np.exp(-langid.SHARP * (x - min(want))) for x in want)) < 1e-9


def test_suffix_automaton():
    rng = random.Random(6)
    for _ in range(100):
        text, asked = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(0, 20), 15))
        n, at = 0, 0
        while at < len(asked):
            size = max((k for k in range(1, len(asked) - at + 1) if asked[at : at + k] in text), default=1)
            n, at = n + 1, at + size
        assert langid.SuffixAutomaton(text).phrases(asked) == n


def test_lattice():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "<0xC3>"]
    m = lattice_lm.Lattice(pieces, [1, 2, 3, 4, 5, 6, 1])
    p = dict(zip(pieces, np.array([1, 2, 3, 4, 5, 6, 1]) / 22, strict=True))

    def total(t):
        return 1.0 if not t else sum(p[t[:k]] * total(t[k:]) for k in range(1, len(t) + 1) if t[:k] in p)

    words = ["abba", "a", "ab", "aba", "", "bbb"]
    assert np.allclose(np.exp(m.words(words)), [total("▁" + w) for w in words])


def test_lm(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HOT", 3)
    held = queries.held_out(F.col("doc_id"), 10)
    texts = {i: [w.decode() for w in (t or "").translate(UP).encode().split()] + [None] for i, t, *_ in corpus()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in texts.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    pieces, scores = lattice_lm.open_pieces(queries.PIECES)
    is_byte = lambda p: p.startswith("<0x") and len(p) == 6
    ranked = sorted([i for i, p in enumerate(pieces) if p], key=lambda i: (is_byte(pieces[i]), -scores[i], i))
    total = sum(1 / (10 + r) for r in range(len(ranked)))
    weight = {pieces[i]: 1 / (10 + r) / total for r, i in enumerate(ranked)}
    once, twice = (sum(k == m for w, k in c.items() if w is not None) for m in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5

    def lattice(word):
        """Every way to the word, place by place, in plain probabilities."""
        text, ways = "▁" + word, [1.0]
        for i in range(1, len(text) + 1):
            own = [ways[j] * weight[text[j:i]] for j in range(i) if text[j:i] in weight and not is_byte(text[j:i])]
            ways.append(sum(own) if own else ways[-1] * np.prod([weight[f"<0x{x:02X}>"] for x in text[i - 1].encode()]))
        return ways[-1]

    chance = {w: lattice(w) for t in texts.values() for w in t if w is not None}
    for word_pieces in (False, True):
        got = {r.doc_id: r for r in lattice_lm.score_texts(spark, docs, held, queries.PIECES, word_pieces=word_pieces).collect()}
        for i, t in texts.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
            assert abs(r.base_score - sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6
            known = lambda w: max(c[w] - d, 0) / n + d * (v - 1) / n * chance[w] if word_pieces else (1 - c[None] / n) * chance[w]  # noqa: B023, E731
            want = sum(np.log10(c[None] / n if w is None else known(w)) for w in t)
            assert abs(r.score - want) < 1e-6 * max(1, abs(want))
    assert lattice_lm.score_texts(spark, empty, held, queries.PIECES).count() == 0
    t = lattice_lm.Totals(100, 11, 10, 0.5)  # known words, the rest and the end add up to 1
    assert abs(sum((k - 0.5) / 100 for k in [9] * 10) + t.unseen + 0.1 - 1) < 1e-12
    assert abs(lattice_lm.Totals(100, 11, 10, 0.0).unseen + 0.1 - 1) < 1e-12


def test_hot_words(spark, monkeypatch):
    """A long word is among them as long as it fits; one that doesn't leaves room for others."""
    monkeypatch.setattr(lattice_lm, "HOT_BYTES", 130)
    counts = spark.createDataFrame([("x" * 100, 9, -1.0), ("y" * 200, 8, -1.0), ("z" * 30, 7, -1.0), ("w", 6, -1.0)], "word string, c long, lattice double")
    assert sorted(lattice_lm.hot_words(spark, counts)) == [("x" * 100, 9, -1.0), ("z" * 30, 7, -1.0)]


def test_fingerprints_and_groups(spark, docs, empty):
    def by_hand(text):
        own = [w for w in (text or "").translate(UP).encode().split()]
        shingles = [b" ".join(own[k : k + 4]) for k in range(len(own) - 3)] if len(own) > 4 else [b" ".join(own)] * bool(own)
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {i: by_hand(t) for i, t, *_ in corpus()}
    got = {r.id: r for r in simhash.near_groups(spark, docs).collect()}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == want
    group = {i: i for i in want}
    for _ in want:
        for a in want:
            for b in want:
                if (want[a] ^ want[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    assert {i: r.component_id for i, r in got.items()} == group
    assert simhash.near_groups(spark, empty).count() == 0


@pytest.mark.parametrize("bucket", [2048, 6])
def test_no_pair_is_missed(spark, bucket):
    rng = random.Random(8)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            y = x
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << bit
            fps.add(y)
    fps = sorted(fps)
    own = {a: a for a in fps}

    def find(a):
        return a if own[a] == a else find(own[a])

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                own[max(find(a), find(b))] = min(find(a), find(b))
    links = simhash.link_fingerprints(spark, spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), bucket=bucket)
    found = connected_components(spark, links).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.component].add(r.node % (1 << 64))
    want = defaultdict(set)
    for a in fps:
        want[find(a)].add(a)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    assert all((r.a ^ r.b).bit_count() <= 4 or ((r.a % (1 << 64)) ^ (r.b % (1 << 64))).bit_count() <= 4 for r in links.collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (5, 5), (90, 100)]
    got = dict(connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("block", "exact", "hot"), [(2048, False, 256), (5, False, 1), (2048, True, 256), (7, True, 1)])
def test_vectors(spark, block, exact, hot, monkeypatch):
    monkeypatch.setattr(embed_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(embed_dedup, "HOT_GROUPS", 1 << 30)
    rng = np.random.default_rng(9)
    rows = []
    for c in rng.normal(size=(25, 16)):
        rows += [(c + rng.normal(size=16) * 0.08).tolist() for _ in range(8)]
    rows += [rows[0], rows[0], [1.0] * 3, [1.0] * 3, [1.0, 1.0, 1.01], [1e300] * 16, None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16]
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.id: r for r in embed_dedup.near_vectors(spark, table, block=block, exact=exact).collect()}
    good = set(range(206))
    x = {i: np.array(rows[i]) / np.abs(rows[i]).max() for i in good}
    want = {(i, j) for i in good for j in good if i != j and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.9}
    n = Counter(i for i, _ in want)
    assert set(got) == set(range(len(rows)))
    assert sum(r.n_links for r in got.values()) >= (1.0 if exact else 0.9) * len(want)
    assert all(r.n_links <= n[i] and r.kept == (i == r.component_id) for i, r in got.items())
    assert all(got[i].n_links == 0 and got[i].kept for i in got if i not in good)
    assert got[200].component_id == got[201].component_id == got[0].component_id == 0
    assert [(got[i].n_links, got[i].component_id) for i in (202, 203, 204)] == [(2, 202)] * 3  # another length than most
    if exact:
        least = {i: i for i in good}
        for _ in good:
            for i, j in want:
                least[i] = min(least[i], least[j])
        assert all(got[i].component_id == least[i] and got[i].n_links == n[i] for i in good)


def test_candidates():
    """Shared pivots and the first common list, pair by pair."""
    rng = np.random.default_rng(11)
    rows = np.array([rng.permutation(12)[:5] for _ in range(60)], dtype=np.int32)
    for pivot in range(12):
        own = rows[(rows[:, :3] == pivot).any(1)]
        got = embed_dedup.candidates(own, own, pivot, 3, 2)
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                assert got[i, j] == (len(set(a) & set(b)) >= 2 and min(set(a[:3]) & set(b[:3])) == pivot)


def test_recall(spark):
    """Against all pairs, with near copies of a hundredth of the rows and one dense group."""
    own = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()]
    rng = np.random.default_rng(12)
    size = len(own[0][1])
    own += [(10_000 + k, v / np.linalg.norm(v) + rng.normal(size=size) * 0.3 / size**0.5) for k, (i, v) in enumerate(own) if i % 100 == 0]
    own += [(20_000 + k, own[7][1] / np.linalg.norm(own[7][1]) + rng.normal(size=size) * 0.25 / size**0.5) for k in range(300)]
    got = {r.id: r for r in embed_dedup.near_vectors(spark, spark.createDataFrame([(i, v.tolist()) for i, v in own], "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in own])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = (x @ x.T >= 0.9).sum(1) - 1
    assert n.sum() > 10_000
    assert sum(r.n_links for r in got.values()) >= 0.95 * n.sum()
    assert all(got[i].n_links <= k for (i, _), k in zip(own, n.tolist(), strict=True))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.count() <= n and (name != "lines" or docs.count() == n)
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == n
    assert {tuple(r)[:5] for r in last.collect()} == {tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()}


def test_null_ids_and_empty_tables(spark, empty):
    rows = [(None, "A line that three documents hold, or more.\nown"), (None, "a line that three documents hold, or more."), (5, "A line that three documents hold, or more.  "), (5, None), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark, table).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (True, 1, 0), (True, 1, 1), (True, 2, 1)]
    exact = exact_dedup.exact_groups(spark, table).collect()
    assert sorted(r.group_size for r in exact) == [1, 1, 1, 2, 2] and {r.keep_id for r in exact if r.group_size == 2} == {5}
    assert sum(r.kept for r in exact) == 4
    assert simhash.near_groups(spark, table).count() == packing.pack(spark, table, queries.VOCABULARY).count() == 5
    held = queries.held_out(F.col("doc_id"), 5)
    assert lattice_lm.score_texts(spark, table, held, queries.PIECES).count() == 5
    files = wavelet.write_shards(spark, table, queries.BYTE_VOCABULARY)
    assert wavelet.read_documents(spark, files).count() == 5
    assert table.select(held.alias("h")).filter("h IS NULL").count() == 0
    assert line_dedup.dedup_lines(spark, empty).count() == exact_dedup.exact_groups(spark, empty).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_vectors(spark, none).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.001])], "vec_id long, embedding array<double>")
    assert sorted((r.id or 0, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(spark, nulls).collect()) == [(0, 2, 3, False), (0, 2, 3, False), (3, 2, 3, True)]


def test_same_hot_key_everywhere(spark):
    """A line, text and vector that a third of all rows share."""
    rows = [(i, "the same line in very many documents\n" + (f"own words of number {i} stand here alone" if i % 3 else "copy")) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    lines = line_dedup.dedup_lines(spark, table).collect()
    assert {r.doc_id for r in lines if r.n_dropped == 0} == {599}
    assert sum(r.kept for r in exact_dedup.exact_groups(spark, table).collect()) == 401
    groups = simhash.near_groups(spark, table).collect()
    assert {r.component_id for r in groups if r.id % 3 == 0} == {0}
