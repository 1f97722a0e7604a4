"""Rules on small tables: ranks with nulls and common scores, sentences, identifiers, skew."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import drafts as D
from tracewright.functions import text as X
from tracewright.operators import feed, graph, library, ranking


@pytest.mark.parametrize("size", [1 << 18, 25])
def test_ranks_with_nulls_and_a_common_score(spark, monkeypatch, size):
    monkeypatch.setattr(ranking, "RANGE_ROWS", size)
    rng = random.Random(3)
    rows = [(i, rng.choice([0.5, 0.5, 0.5, None, float("nan"), float(rng.randint(0, 40))])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, s double").repartition(5)
    value = lambda s: None if s is None or s != s else s
    order = sorted(rows, key=lambda r: (value(r[1]) is None, -(value(r[1]) or 0), r[0]))
    assert {r.id: r["rank"] for r in ranking.positions(df, "s", "id").collect()} == {r[0]: k for k, r in enumerate(order)}
    places: dict = {}
    for k, r in enumerate(order):
        places.setdefault(value(r[1]), []).append(k)
    got = {r.id: r.avg_rank for r in ranking.average_ranks(df, "s").collect()}
    assert got == {i: sum(places[value(s)]) / len(places[value(s)]) for i, s in rows}
    assert ranking.positions(df.filter("id < 0"), "s", "id").count() == ranking.average_ranks(df.filter("id < 0"), "s").count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ("One is here. Two follows! (Three) ends.", ["One is here.", "Two follows!", "(Three) ends."]),
    ("See Sec. 2 and Figs. 3 of J. Smith et al. The rest. it goes on", ["See Sec. 2 and Figs. 3 of J. Smith et al. The rest. it goes on"]),
    ("A first\n# Heading\ntext\n- item one\n- item two", ["A first", "# Heading\ntext", "- item one", "- item two"]),
    ("Above.\n\nBelow", ["Above.", "Below"]),
    ("wins 3.5 points. 4 more", ["wins 3.5 points.", "4 more"]),
    ("", []), (" \n ", []),
])
def test_sentences(text, want):
    assert [text[s:e] for s, e in X.sentence_spans(text)] == want


def test_identifiers_and_preamble(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.arxiv_of_doi(F.lit("https://doi.org/10.48550/arXiv.2106.02347v2"))) == "2106.02347"
    assert one(X.arxiv_of_doi(F.lit("10.1/x"))) is None and one(X.normalise_doi(F.lit("10.48550/arXiv.2106.02347"))) is None
    assert one(X.strip_markup(F.lit("arXiv:1.2v1 Announce Type: new Abstract: <p>We  show</p>"))) == "We show"
    refs = spark.createDataFrame([(1, "t", 2000, "10.48550/arxiv.1706.03762", None)], "ref_id long, title string, year int, raw_doi string, raw_arxiv string")
    assert library.normalised(refs).first().identity == "arxiv:1706.03762"


def test_untitled_references_match_nothing(spark):
    asked = spark.createDataFrame([(1, None, None, "", None)], "ask_id long, doi string, arxiv string, title_key string, year int")
    refs = spark.createDataFrame([(7, None, None, "", None)], "ref_id long, doi string, arxiv string, title_key string, year int")
    assert library.lookup(asked, refs).first().ref_id is None


def test_source_skew(spark):
    clicks = [(1, i, 1, "ui") for i in range(5)] + [(2, i, 1, "ui") for i in range(4)] + [(3, i, 1, "ui") for i in range(3, 8)] + [(4, i, 1, "bootstrap") for i in range(5)]
    items = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(8)], "item_id long, feed string")
    got = {r.user_id: r.skewed for r in feed.source_skew(spark.createDataFrame(clicks, "user_id long, item_id long, useful int, source string"), items).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_communities_are_bounded(spark):
    with pytest.raises(ValueError, match="max_edges"):
        graph.communities(spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "a string, b string, weight long"), max_edges=1)


@pytest.mark.parametrize(("source", "want"), [
    (r"We reach $0.91$ and \num{3.25} of \SI{4.50}{ms} at \si{ms}", [0.91, 3.25, 4.5]),
    (r"\begin{align*} x = 1.11 \end{align*} then 2.22 \[ 3.33 \] $$4.44$$ $y = 5.55$", [2.22]),
    (r"\includegraphics[width=0.55\textwidth]{f1.50} wide 0.75\linewidth, 1.25 \cite[p.~2.10]{k1.10} \vspace{2.50em} gap 1.50cm", [1.25]),
    (r"$-1.50 \pm 0.25$ and $1{,}234.50$", [-1.5, 0.25, 1234.5]),
    (r"open $1.25 to the end", []), (r"\begin{equation} 1.23", []),
])
def test_numbers_that_a_reader_sees(spark, source, want):
    assert spark.range(1).select(D.measured_numbers(D.visible_latex(F.lit(source)))).first()[0] == want
