"""Entries whose landing depends on ones that wait, and long chains of changes."""

from tests.test_upsert import same
from tracewright.operators import upsert as U


def test_an_entry_that_changes_nothing_by_now_waits_for_one_that_will_change_its_row(spark):
    stored = [(1, "doi:10.1/x", "10.1/x", "1.1", "one", "One", 2000, "J", "en"), (2, "doi:10.1/y", "10.1/y", "2.2", "two", "Two", 2000, "J", "en")]
    entries = [
        (10, "a", "1", "Five", 2001, None, "10.1/d", None, None),  # a new row with the DOI
        (11, "a", "2", "One", 2000, None, "10.1/d", "3.3", None),  # lands there, not on 1 by its title, and gives it an arXiv id
        (12, "a", "3", "Two", 2000, None, None, "3.3", None),  # by that id, not on 2 by its title
    ]
    out = same(spark, stored, entries)
    assert {r.seq: r.ref_id for r in out.landed.collect()} == {10: 10, 11: 10, 12: 10}


def test_passes_follow_changes_not_entries(spark, monkeypatch):
    """Entries on many rows of one title wait for each other only where they change what the other reads."""
    passes = []
    settled = U.settled
    monkeypatch.setattr(U, "settled", lambda df, label: passes.append(label) or settled(df, label))
    entries = [(100 + k, "r", str(k), "Introduction", 2000 + k, "arXiv" if k % 2 else None, f"10.1/{k // 2}", None, None) for k in range(40)]
    same(spark, [], entries)
    assert passes.count("upsert-moved") + passes.count("upsert-round") < 8
