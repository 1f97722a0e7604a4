"""Upsert of references against the same entries taken one by one."""

import random
import re

from tracewright.operators import upsert as U

STORED = "ref_id long, identity string, doi string, arxiv string, title_key string, title string, year int, venue string, lang string"
ENTRY = "seq long, reader string, source_key string, title string, year int, venue string, raw_doi string, raw_arxiv string, lang string"


def identity(doi, arxiv, title, year):
    return f"doi:{doi}" if doi else f"arxiv:{arxiv}" if arxiv else f"title:{title}:{'-' if year is None else year}" if title else None


def one_by_one(stored, entries, origins=(), aliases=()):
    rows = {r[0]: dict(zip(("id", "i", "d", "a", "t", "title", "y", "v", "lang"), r, strict=True)) for r in stored}
    made, named, landed, conflicts = {}, dict(aliases), [], []
    for reader, key, rid in origins:
        made.setdefault((reader, key), rid)

    def look(i=None, d=None, a=None, t=None, y=None, ladder_title=True):
        for name, value in (("i", i), ("d", d), ("a", a)):
            hit = [r for r in rows.values() if value and r[name] == value]
            if hit:
                return min(hit, key=lambda r: r["id"])
        hit = [r for r in rows.values() if t and r["t"] == t and (r["y"] is None or y is None or r["y"] == y)]
        if hit and ladder_title:
            return min(hit, key=lambda r: (r["y"] is None, r["id"]))
        for name in (i, d and f"doi:{d}", a and f"arxiv:{a}"):
            if name in named:
                return rows[named[name]]
        return None

    for seq, reader, key, title, year, venue, doi, arxiv, lang in sorted(entries):
        t = re.sub("[^a-z0-9]+", " ", (title or "").lower()).strip() or None
        own = identity(doi, arxiv, t, year)
        row = rows.get(made.get((reader, key))) or look(own, doi, arxiv, t, year)
        if row is None and (t is None or own is None):
            landed.append((seq, reader, None, "refused"))
            continue
        if row is None:
            rows[seq] = {"id": seq, "i": own, "d": doi, "a": arxiv, "t": t, "title": title, "y": year, "v": venue, "lang": lang}
            landed.append((seq, reader, seq, "added"))
            made.setdefault((reader, key), seq)
            continue
        made.setdefault((reader, key), row["id"])
        if t is None:
            landed.append((seq, reader, row["id"], "unchanged"))
            continue
        before, offered = dict(row), {"d": doi, "a": arxiv, "y": year, "v": venue, "lang": lang}
        new = {k: row[k] if row[k] is not None else v for k, v in offered.items()}
        if row["v"] is None and venue and not venue.lower().startswith("arxiv") and row["y"] and year and row["y"] != year:
            new["y"] = year
            conflicts.append((seq, row["id"], "year", str(year), str(row["y"]), None))
        elif row["y"] is not None and year is not None and row["y"] != year:
            conflicts.append((seq, row["id"], "year", str(row["y"]), str(year), None))
        for k, name in (("d", "doi"), ("a", "arxiv"), ("v", "venue"), ("lang", "lang")):
            if row[k] is not None and offered[k] is not None and row[k] != offered[k]:
                conflicts.append((seq, row["id"], name, row[k], offered[k], None))
        if t != row["t"]:
            conflicts.append((seq, row["id"], "title", row["title"], title, None))
        ident = identity(new["d"], new["a"], row["t"], new["y"])
        gained = {k: new[k] for k in "da" if new[k] != row[k]}
        if ident != row["i"] or gained:
            holder = look(ident, gained.get("d"), gained.get("a"))
            if holder is None or holder["id"] == row["id"]:
                row["i"] = ident
            else:
                conflicts.append((seq, row["id"], "identity", row["i"], ident, holder["id"]))
                for k in gained:
                    new[k] = None
        row.update(new)
        landed.append((seq, reader, row["id"], "merged" if row != before else "unchanged"))
    return rows, landed, conflicts


def same(spark, stored, entries, origins=(), aliases=()):
    args = {"origins": spark.createDataFrame(list(origins), "reader string, source_key string, ref_id long"), "aliases": spark.createDataFrame(list(aliases), "alias string, ref_id long")}
    out, report = U.sync(spark, spark.createDataFrame(stored, STORED), spark.createDataFrame(entries, ENTRY), fields=("title", "lang"), **args)
    rows, landed, conflicts = one_by_one(stored, entries, origins, aliases)
    assert {r.ref_id: (r.identity, r.doi, r.arxiv, r.title_key, r.title, r.year, r.venue, r.lang) for r in out.rows.collect()} == {i: tuple(r[k] for k in ("i", "d", "a", "t", "title", "y", "v", "lang")) for i, r in rows.items()}
    assert sorted(tuple(r) for r in out.landed.collect()) == sorted(landed)
    assert sorted((tuple(r) for r in out.conflicts.collect()), key=str) == sorted(conflicts, key=str)
    counts = {r.reader: r.seen for r in report.collect()}
    assert sum(counts.values()) == len(entries)
    return out


def test_an_entry_finds_the_row_with_its_arxiv_id(spark):
    stored = [(1, "doi:10.1/x", "10.1/x", "2101.00001", "deep nets", "Deep nets", 2021, None, None)]
    out = same(spark, stored, [(10, "bib", "k", "Deep networks", 2021, None, None, "2101.00001", "en")])
    assert out.rows.count() == 1


def test_identity_moves_and_is_refused(spark):
    stored = [(1, "title:one:-", None, None, "one", "One", None, None, None), (2, "doi:10.1/b", "10.1/b", None, "two", "Two", 2001, None, None)]
    entries = [
        (10, "a", "1", "One", 2000, None, None, "1.1", None),  # fills year and arXiv id: the identity moves
        (11, "b", "1", "One", None, None, "10.1/a", None, None),  # and again, to the DOI
        (12, "b", "1", "other title", 1990, None, "10.1/zz", None, None),  # the reader's own row, whatever it says
        (13, "c", "9", "Three", 1999, None, None, "3.3", None),
        (14, "c", "9", "Three", 1999, None, "10.1/b", None, None),  # the DOI is held by 2
        (15, "c", "10", "Three", 2002, "Journal", None, "3.3", "en"),  # the venue's year wins
        (16, "c", "11", "Three", 2003, "arXiv:3.3", None, "3.3", "de"),
        (17, "d", "1", None, None, None, "10.1/b", None, None),  # no title: lands, changes nothing
        (18, "d", "2", None, None, None, "10.1/none", None, None),  # no title and no row
        (19, "d", "3", " ", None, None, None, None, None),
        (20, "d", "4", "gone", 1, None, "10.9/old", None, None),  # by an alias
    ]
    out = same(spark, stored, entries, origins=[("x", "1", 2)], aliases=[("doi:10.9/old", 2)])
    assert [(r.ref_id, r.holder) for r in out.conflicts.filter("field = 'identity'").collect()] == [(13, 2)]


def test_random_entries(spark):
    rng = random.Random(1)
    pick = lambda values, p=0.5: rng.choice(values) if rng.random() < p else None
    entries = []
    for k in range(45):
        title = rng.choice([f"Title {i}" for i in range(12)]) if rng.random() < 0.93 else None
        entries.append((100 + k, rng.choice("pq"), str(rng.randint(0, 70)), title, pick([2000, 2001, 2002], 0.7), pick(["Journal", "arXiv"], 0.3), pick([f"10.1/{i}" for i in range(12)]), pick([f"1.{i}" for i in range(12)]), pick(["en", "de"])))
    stored = [(1, "doi:10.1/0", "10.1/0", None, "title 0", "Title 0", 2000, None, None), (2, "arxiv:1.1", None, "1.1", "title 1", "Title 1", None, "J", "en")]
    same(spark, stored, entries)


def test_one_title_for_all(spark):
    """Entries that change nothing don't wait for each other."""
    entries = [(100 + k, "r", str(k), "Introduction", 2000 + k % 2, None, f"10.1/{k}", None, None) for k in range(200)]
    out = same(spark, [], entries)
    assert out.rows.count() == 2


def test_nothing(spark):
    out = same(spark, [], [])
    assert out.rows.count() == out.landed.count() == out.conflicts.count() == 0
