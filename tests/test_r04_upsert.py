"""Entries that follow from each other are taken in one pass, and names of rows and readers' rows hold groups together."""

import random

from tests.test_upsert import same
from tracewright.operators import upsert as U


def test_tables_written_do_not_follow_the_changes(spark, monkeypatch):
    """Each settled table is a query that the driver plans and keeps; entries that change what later ones read used to add four of them each."""
    written = []
    settled = U.settled
    monkeypatch.setattr(U, "settled", lambda df, label: written.append(label) or settled(df, label))
    rng = random.Random(4)
    entries = [(100 + k, "r", str(k), f"Title {rng.randint(0, 6)}", 2000 + rng.randint(0, 3), None, f"10.1/{rng.randint(0, 9)}" if rng.random() < 0.4 else None, f"1.{rng.randint(0, 9)}" if rng.random() < 0.4 else None, None) for k in range(60)]
    same(spark, [], entries)
    assert len(written) < 16


def test_names_reach_other_groups(spark):
    """Aliases, readers' own rows, an identity that isn't of the row's ids, and names of no row."""
    stored = [(1, "doi:10.1/x", None, None, "one", "One", None, None, None), (2, "old", "10.1/y", None, "two", "Two", 2001, None, None), (3, "title:four:1999", "10.1/z", None, "three", "Three", 2002, None, None)]
    entries = [
        (9, "a", "3", "Four", 1999, None, None, None, None),  # by an identity with another title
        (10, "a", "1", "Five", None, None, "10.1/x", None, None),  # by an identity that isn't its DOI's row
        (11, "a", "2", "Six", 2003, None, "10.1/w", None, "en"),  # by an alias
        (12, "b", "7", "Seven", 2003, None, "10.1/v", None, None),  # the reader's own row
        (14, "b", "7", "Eight", None, "Journal", None, "8.8", None),
        (15, "c", "1", "Eight", None, None, None, "8.8", None),
    ]
    out = same(spark, stored, entries, origins=[("b", "7", 3)], aliases=[("doi:10.1/w", 2)])
    assert {r.seq: r.ref_id for r in out.landed.collect()} == {9: 3, 10: 1, 11: 2, 12: 3, 14: 3, 15: 3}
