"""Draft, record and literature operators against small cases and brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.functions import drafts as D
from tracewright.functions import records as R
from tracewright.sources import literature as L


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_latex(spark):
    source = "a \\% 5 % no 1.5\nb \\\\% no\n\\begin{equation}\nx = 2.5\n\\end{equation} $0.91 \\pm 0.02$ and $\\alpha = 0.5$ \\num{3.25} \\label{a1.5} \\vspace{0.5em} 1{,}234.5 \\includegraphics[width=0.5\\textwidth]{f.pdf}"
    assert one(spark, D.strip_comments(F.lit(source))).split("\n")[:2] == ["a \\% 5 ", "b \\\\"]
    assert one(spark, D.measured_numbers(D.visible_latex(F.lit(source)))) == [0.91, 0.02, 3.25, 1234.5]
    assert one(spark, D.figures(F.lit(source))) == ["f.pdf"]
    assert one(spark, D.included(F.lit("\\input{a} % \\input{no}\n\\include{ b/c }"))) == ["a", "b/c"]


def test_numbers(spark):
    prose = "v1.2.3 got 0.5, -1.25 and 1,234.5 of 12; 3.2e-4. On 2026-01-02 <!-- 9.5 --> `pkg==1.5x` http://x.y/1.5 ended at 7.5."
    assert one(spark, D.measured_numbers(F.lit(prose))) == [0.5, -1.25, 1234.5, 3.2e-4, 7.5]


def test_numbers_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")

    def brute(text):
        for p in D.NO_MEASUREMENT:
            text = re.sub(p, " ", text or "")
        return len(re.findall(D.NUMBER, text))

    from tracewright.plans.drafts import text_measured_numbers

    got = dict(text_measured_numbers(spark, "/root/testdata/sf0.001").collect())
    assert {d: max(n, 0) for d, n in got.items()} == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_tags(spark):
    tags = spark.createDataFrame([("nlp",), ("transformers",), ("Machine_learning",), ("physics",), ("fine-tunings",), ("other",)], "tag string")
    aliases = spark.createDataFrame([("nlp", "natural-language-processing"), ("x", "transformer"), ("y", "finetuning")], "alias string, target string")
    got = dict(D.canonical_tags(tags, aliases).select("tag", "canonical").collect())
    assert got == {"nlp": "natural-language-processing", "transformers": "transformer", "Machine_learning": "Machine_learning", "physics": "physics", "fine-tunings": "finetuning", "other": "other"}
    asked = spark.createDataFrame([("Language  Models",), ("graph",), ("none",)], "text string")
    nodes = spark.createDataFrame([("language-model",), ("graph",)], "node string")
    assert dict(D.resolve_tags(asked, nodes).collect()) == {"Language  Models": "language-model", "graph": "graph", "none": None}


def test_bibliography(spark):
    assert one(spark, D.escape_tex(F.lit("a & b_1 50%"))) == "a \\& b\\_1 50\\%" and one(spark, D.escape_tex(F.lit("{A} & b"))) == "{A} & b"
    assert one(spark, D.bib_entry(F.lit("book"), F.lit("k"), {"title": F.lit("T"), "note": F.lit(None).cast("string")})) == "@book{k,\n  title = {T},\n}\n"
    names = [tuple(one(spark, D.csl_name(F.lit(n)))) for n in ("Doe, Jane", "Jane Q. Doe", "Plato")]
    assert names == [("Doe", "Jane"), ("Doe", "Jane Q."), ("Plato", None)]
    kinds = [one(spark, D.csl_type(F.lit(k), F.lit(v).cast("string"), F.lit(a).cast("string"))) for k, v, a in (("article", "J", None), ("misc", None, "2101.1"), ("inproceedings", "C", "2101.1"), ("odd", "V", None), ("odd", None, None))]
    assert kinds == ["article-journal", "article", "paper-conference", "article-journal", "document"]
    assert one(spark, D.venue_key(F.lit("The J. Chem. Phys."))) == "j chem phys" and one(spark, D.venue_key(F.lit(None).cast("string"))) == ""


def test_routes(spark):
    asked = [("runs", "Tell me the winner, please"), ("runs", "details of the wideSweep9 one"), ("runs", "our sweep of Tuesday"), ("runs", ""), ("kg", "what may link rivers to lakes"), ("sym", "please solve x + 1 = 3")]
    assert [one(spark, D.route(F.lit(q), n)) for n, q in asked] == ["runs.compare", "runs.detail", "runs.compare", None, "kg.path", "sym.solve"]


@pytest.mark.parametrize(("value", "text"), [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (-1.5e-9, "-1.5e-9"), (123.456, "123.456"), (1.7976931348623157e308, "1.7976931348623157e+308"), (5e-324, "5e-324"), (333333333.33333329, "333333333.3333333")])
def test_number_text(value, text):
    assert R.number_text(value) == text


def test_canonical(spark):
    value = {"b": [1, 2.5, True, None, "é\n"], "a": {"\ue000": 1, "\U0001f600": 2}}
    out = R.canonical_json(value)
    assert out == '{"a":{"\U0001f600":2,"\ue000":1},"b":[1,2.5,true,null,"é\\n"]}' and R.canonical_json(json.loads(out)) == out
    rows = ['{"a":1,"a":2}', "[NaN]", "[12345678901234567890]", "[1e999]", "{", None, ' {"b" : 1.0, "a":[ ]} ']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1).select(R.canonical("t")).collect()]
    assert got == [None] * 6 + ['{"a":[],"b":1}']


def test_licences():
    good = ["MIT", "Apache-2.0 OR MIT", "(GPL-2.0+ WITH Classpath-exception-2.0) AND MIT", "LicenseRef-x", "A AND (B OR (C))"]
    bad = ["", "MIT OR", "OR MIT", "MIT Apache-2.0", "(MIT", "MIT)", "NONE", "MIT WITH", "(MIT) WITH x", "MIT WITH (x)", "a b", "()", "M@T", "MIT WITH AND x", "MIT WITH x WITH y"]
    assert [e for e in good if R.licence_problem(e)] == [] and [e for e in bad if not R.licence_problem(e)] == []


def test_times_and_labels(spark):
    assert R.parse_utc("2026-01-02T03:04:05.5Z").microsecond == 500000
    assert [R.parse_utc(t) for t in ("2026-01-02T03:04:05", "2026-13-02T03:04:05Z", None, "2026-01-02T03:04:05+00:00")] == [None] * 4
    assert one(spark, R.utc_text(F.lit("2026-01-02 03:04:05").cast("timestamp"))) == "2026-01-02T03:04:05Z"
    labels = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert one(spark, R.labelled_split(F.lit("test"), labels)) == "test,a=1,b=2"
    assert one(spark, R.labelled_split(F.lit(None).cast("string"), F.lit(None).cast("map<string,string>"))) is None


def test_literature(spark):
    def rows(parse, body):
        return [r.asDict() for r in parse(spark.createDataFrame([(body,)], "body string")).collect()]

    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A\n Title</title><summary>S</summary><published>2021-01-02T00:00:00Z</published><author><name>Jane Doe</name></author><author><name>Plato</name></author><arxiv:doi>10.1/X</arxiv:doi></entry><entry><id>none</id><title>no</title></entry></feed>'
    (r,) = rows(L.parse_arxiv, atom)
    assert (r["external_id"], r["title"], r["authors"], r["published"], r["doi"]) == ("2101.00001", "A Title", ["Doe, Jane", "Plato"], "2021-01-02", "10.1/x")
    pubmed = '<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Mar</Month></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>Jane</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">7</ArticleId><ArticleId IdType="doi">10.1/Y</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>'
    (r,) = rows(L.parse_pubmed, pubmed)
    assert (r["external_id"], r["abstract"], r["authors"], r["published"], r["venue"], r["doi"]) == ("7", "a b", ["Doe, Jane", "Group"], "2020-03-01", "J", "10.1/y")
    crossref = json.dumps({"message": {"items": [{"DOI": "10.1/Z", "type": "journal-article", "title": ["T"], "container-title": ["J"], "issued": {"date-parts": [[2019, 5]]}, "author": [{"family": "Doe", "given": "Jane"}, {"name": "Group"}]}, {"DOI": "10.1/no", "title": []}, {"DOI": "10.1/e", "type": "component", "title": ["E"]}]}})
    (r,) = rows(L.parse_crossref, crossref)
    assert (r["doi"], r["published"], r["venue"], r["authors"]) == ("10.1/z", "2019-05-01", "J", ["Doe, Jane", "Group"])
    openalex = json.dumps({"results": [{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.48550/arXiv.2101.5", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": "Jane Doe"}}]}]})
    (r,) = rows(L.parse_openalex, openalex)
    assert (r["external_id"], r["arxiv_id"], r["doi"], r["abstract"], r["authors"]) == ("W1", "2101.5", None, "a b a", ["Doe, Jane"])
    assert rows(L.parse_openalex, "junk") == rows(L.parse_crossref, "") == []


def test_dedup_of_papers(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, f"D{rng.randint(0, 25)}"]), rng.choice([None, f"a{rng.randint(0, 25)}"])) for i in range(80)]
    rows += [(100 + i, f"c{i // 2}", f"e{(i + 1) // 2}") for i in range(12)]
    seen, want = set(), []
    for i, d, a in rows:
        keys = {k for k in (d and "d:" + d.lower(), a and "a:" + a) if k}
        if not keys & seen:
            seen |= keys
            want.append(i)
    got = L.dedup_papers(spark.createDataFrame(rows, "n long, doi string, arxiv_id string"), "n")
    assert sorted(r.n for r in got.collect()) == want
