"""The near-copy stage goes through operator 9."""

import corpus_pipeline
from tracewright.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_links_within_the_radius(spark):
    """Texts of few words whose fingerprints lie within 4 bits but whose runs of five words differ by more than a fifth."""
    words = [f"w{i}" for i in range(40)]
    base = " ".join(words * 12)
    other = " ".join(words * 12 + [f"x{i}" for i in range(14)])
    bits = (simhash.fingerprint(base.encode()) ^ simhash.fingerprint(other.encode())).bit_count()
    assert bits <= 4
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([base, other, "quite another text of some words"])]
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copy_stage(spark, table, "").collect()) == [0, 2]
