"""Every registered query opN_ on the smallest tables: by its SQL where it has one, else by what must hold of its rows."""

import pytest

from sightline.llm import queries

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(name, same):
    same(name, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows(name, spark):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name.startswith("op6"):
        items = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
        assert all(r.item_id in items and 0 <= r.distance <= r.budget and 0 <= r["at"] <= r.until for r in rows) and {r.doc_id for r in rows} <= set(ids)
    elif name.startswith("op8"):
        pieces = {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        assert sorted(pieces) == ids
        assert all(sum(n for _, n, _ in p) == p[0][2] and min(p)[0] == 0 for p in pieces.values())
        assert sum(r.length for r in rows) > 2048 * max(r.sequence_id for r in rows)
    else:
        assert sorted(r.doc_id for r in rows) == ids
    if name.startswith("op4"):
        known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        held = [r for r in rows if r.held_out and known[r.doc_id]]
        assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.9 * len(held)
    if name.startswith("op7"):
        starts = sorted((r.doc_id, r.start, r.n_tokens) for r in rows)
        assert all(a[1] + a[2] == b[1] for a, b in zip(starts, starts[1:], strict=False)) and starts[0][1] == 0
