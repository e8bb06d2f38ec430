"""Queries of the subpackage: against SQL, or against brute force on the smallest tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from oracle import connect, difference

from emberline.llm import queries as Q
from emberline.llm.words import words_of


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert not difference(Q.QUERIES[name](spark, sf_dir), con, Q.SQL[name])


def test_fires(spark, sf_dir):
    d = Q._detections(spark, sf_dir).toPandas().sort_values("row_id").reset_index(drop=True)
    p = d[["px", "py", "pz", "pt"]].to_numpy()
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= Q.REACH**2
    lab = np.arange(len(p))
    while True:
        new = np.array([lab[row].min() for row in near])
        if (new == lab).all():
            break
        lab = new
    ids = d["row_id"].to_numpy()
    want = {(ids[lab[i]], ids[i]) for i in range(len(p)) if near[i].sum() > 1}
    assert {tuple(r) for r in Q.p2_found(spark, sf_dir).collect()} == want
    sizes = pd.Series([c for c, _ in want]).value_counts().to_dict()
    assert {r["cluster_row_id"]: r["size"] for r in Q.p2_fires(spark, sf_dir).collect()} == sizes
    assert sum(r["size"] for r in Q.p2_clusters(spark, sf_dir).collect()) == len(p)


def test_leaks(spark, sf_dir, con):
    grams = {}
    for i, t in con.execute("SELECT item_id, text FROM eval_items").fetchall():
        w = words_of(t)[0]
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in con.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        w = words_of(t)[0]
        want |= {(d, i) for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in Q.p7_found(spark, sf_dir).collect()} == want


def test_hard_texts_are_found(spark, sf_dir):
    from emberline.llm.reading import measures, readable

    want = set()
    for r in Q._english(spark, sf_dir).collect():
        w, s, n = measures(readable(r["text"] or ""))
        if w >= 40 and w / s > 18 and n / w > 5.6:
            want.add(r["doc_id"])
    assert {r[0] for r in Q.p9_found(spark, sf_dir).collect()} == want


def test_mix_report(spark, sf_dir):
    r = {x["source"]: x for x in Q.p8_report(spark, sf_dir).collect()}
    assert {k for k, x in r.items() if x["short"]} == {x[0] for x in Q.p8_found(spark, sf_dir).collect()}


def test_bounded_pieces_share_cells_and_keep_nulls(spark, monkeypatch):
    rows = [("tp", i, j, float(1 + k % 90), 2001 + k % 3) for i, j in ((1, 1), (1, 2), (None, 3)) for k in range(200)] + [("tp", 1, 1, 500.0, None)]
    monkeypatch.setattr(Q, "_values", lambda *_: spark.createDataFrame(rows, "field string, lonind int, latind int, value double, year int"))
    seen = []
    merge = Q.merge_counts
    monkeypatch.setattr(Q, "merge_counts", lambda *pieces: seen.extend(pieces) or merge(*pieces))
    exact = {tuple(r)[:4]: (r["value"], r["n"]) for r in Q.p5_percentiles(spark, "").collect()}
    near = {tuple(r)[:4]: (r["value"], r["n"]) for r in Q.p5_bounded(spark, "").collect()}
    assert near.keys() == exact.keys() and len(exact) == 12
    assert all(near[k][1] == n and abs(near[k][0] - v) <= 0.01 * abs(v) + 1e-6 for k, (v, n) in exact.items())
    cells = [{tuple(r) for r in p.select(*Q.CELL).distinct().collect()} for p in seen]
    assert len(cells) == 2 and cells[0] == cells[1]
