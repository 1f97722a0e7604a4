"""The library's upkeep: entries of readers, one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import library as L
from tracewright.operators import upsert as U
from tracewright.plans.library import REFS
from tracewright.plans.registry import query
from tracewright.sources import projections as P

FIRST = 1_000_000_000
#: A fold over the entries in their order; the library is a list of rows in the order of their ids.
FOLD = f"""RECURSIVE {REFS},
    entries AS (SELECT row_number() OVER (ORDER BY ref_id) AS n, {FIRST} + ref_id AS seq, source AS reader, doi, arxiv, nullif(title_key, '') AS tk, year,
        CASE WHEN ref_id % 4 = 1 THEN source END AS venue, identity FROM refs WHERE ref_id % 10 <> 0),
    fold AS (
        SELECT CAST(0 AS BIGINT) AS n, list({{'id': ref_id, 'i': identity, 'd': doi, 'a': arxiv, 't': nullif(title_key, ''), 'y': year, 'v': CASE WHEN ref_id % 8 = 0 THEN source END}} ORDER BY ref_id) AS library,
            '' AS reader, '' AS outcome FROM refs WHERE ref_id % 10 = 0
        UNION ALL
        SELECT n, CASE outcome WHEN 'added' THEN list_append(library, m) WHEN 'merged' THEN [CASE WHEN x.id = m.id THEN m ELSE x END for x in library] ELSE library END, reader, outcome
        FROM (SELECT *, CASE WHEN r IS NULL THEN CASE WHEN tk IS NULL THEN 'refused' ELSE 'added' END WHEN tk IS NULL OR m = r THEN 'unchanged' ELSE 'merged' END AS outcome
        FROM (SELECT *, CASE WHEN held <> r.id THEN {{'id': m.id, 'i': r.i, 'd': r.d, 'a': r.a, 't': m.t, 'y': m.y, 'v': m.v}} ELSE m END AS m
        FROM (SELECT * EXCLUDE (w), w AS m, CASE WHEN r IS NOT NULL AND (w.i <> r.i OR (r.d IS NULL AND w.d IS NOT NULL) OR (r.a IS NULL AND w.a IS NOT NULL)) THEN
            coalesce([x for x in library if x.i = w.i][1], [x for x in library if r.d IS NULL AND x.d = w.d][1], [x for x in library if r.a IS NULL AND x.a = w.a][1]).id END AS held
        FROM (SELECT *, {{'id': coalesce(r.id, seq), 'i': coalesce('doi:' || coalesce(r.d, doi), 'arxiv:' || coalesce(r.a, arxiv), 'title:' || coalesce(r.t, tk) || ':' || coalesce(CAST(y AS VARCHAR), '-')),
            'd': coalesce(r.d, doi), 'a': coalesce(r.a, arxiv), 't': coalesce(r.t, tk), 'y': y, 'v': coalesce(r.v, venue)}} AS w
        FROM (SELECT *, CASE WHEN r.v IS NULL AND venue IS NOT NULL AND r.y IS NOT NULL AND year IS NOT NULL THEN year ELSE coalesce(r.y, year) END AS y
        FROM (SELECT e.*, library, coalesce([x for x in library if x.i = e.identity][1], [x for x in library if x.d = e.doi][1], [x for x in library if x.a = e.arxiv][1],
                [x for x in library if x.t = e.tk AND x.y IS NOT NULL AND (e.year IS NULL OR x.y = e.year)][1], [x for x in library if x.t = e.tk AND x.y IS NULL][1]) AS r
            FROM fold JOIN entries e ON e.n = fold.n + 1)))))))"""


def _upserted(spark, sf_dir):
    """A tenth of the references are stored, with venues for some; all others come one by one."""
    refs = P.references(spark, sf_dir)
    i = F.col("ref_id")
    stored = L.normalised(refs.filter(i % 10 == 0)).withColumn("title_key", F.nullif("title_key", F.lit(""))).withColumn("venue", F.when(i % 8 == 0, F.col("source")))
    new = refs.filter(i % 10 != 0).select((F.lit(FIRST) + i).alias("seq"), F.col("source").alias("reader"), i.cast("string").alias("source_key"), "title", "year", F.when(i % 4 == 1, F.col("source")).alias("venue"), "raw_doi", "raw_arxiv")
    return U.sync(spark, stored, new)


@query(f"""WITH {FOLD} SELECT x.id AS ref_id, x.i AS identity, x.d AS doi, x.a AS arxiv, x.t AS title_key, x.y AS year, x.v AS venue
    FROM (SELECT unnest(library) AS x FROM fold WHERE n = (SELECT max(n) FROM fold))""")
def library_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir)[0].rows.select(*U.ROW)


@query(f"""WITH {FOLD} SELECT reader, count(*) AS seen, count(*) FILTER (WHERE outcome = 'added') AS added, count(*) FILTER (WHERE outcome = 'merged') AS merged,
    count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, count(*) FILTER (WHERE outcome = 'refused') AS refused FROM fold WHERE n > 0 GROUP BY reader""")
def library_sync(spark, sf_dir):
    return _upserted(spark, sf_dir)[1]
