"""Mixing to target shares, and reading levels."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import mixing as M
from emberline.llm import reading as R
from emberline.llm.reading import FOLDS, LevelModels, bucket, fold_of, formula_level, is_hard, label_levels, measures, readable, reading_levels, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer files")


def copies(mean, cap, u):
    least, th = M.copy_thresholds(mean, cap)
    return least + np.searchsorted(th, u, side="right")


@pytest.mark.parametrize("mean,cap", [(0.3, 1), (0.99, 1), (1.7, 2), (0.01, 4), (3.5, 4), (1000.0, 5000), (4990.0, 5000), (9_000.0, 10_000), (800.0, 10_000)])
def test_capped_poisson(mean, cap):
    assert abs(M.capped_mean(M.rate_for(mean, cap), cap) - mean) < 1e-9 * max(1, cap)
    least, th = M.copy_thresholds(mean, cap)
    assert th == sorted(th) and least + len(th) <= cap
    n = copies(mean, cap, (np.arange(20_000) + 0.5) / 20_000)
    assert abs(n.mean() - mean) < 0.01 * max(1.0, mean / 100) and n.max() <= cap


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10_000), st.floats(1e-6, 1.2))
def test_copies_at_any_cap(cap, part):
    n = copies(part * cap, cap, (np.arange(4_000) + 0.5) / 4_000)
    assert n.min() >= 0 and n.max() <= cap and (np.diff(n) >= 0).all()
    assert abs(n.mean() - min(part, 1.0) * cap) <= 0.002 * cap + 0.02


def test_thresholds_at_the_ends():
    assert M.copy_thresholds(5.0, 3) == (3, []) and M.rate_for(3.0, 3) is None
    assert M.copy_thresholds(0.0, 3) == M.copy_thresholds(0.5, 0) == (0, [])


def test_token_counts(spark):
    texts = ["Hello world", "", None, "naïve ☃ text", "a" * 200_000, "x <|endoftext|> y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in M.token_counts(df, ["id"], "text").collect()}
    enc = M._tokenizer(Path(M.TOKENIZER).read_bytes())
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)} and got[0] == 2 and got[1] == got[2] == 0


def test_mix(spark):
    docs = [(i, f"word number {i} of the web", " Web " if i % 3 else "web") for i in range(3000)] + [(10_000 + i, "short text", "FORUM ") for i in range(400)] + [(20_000, "alone here", "tiny"), (20_001, None, "web"), (20_002, "lost", None), (20_003, "nobody wants this", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "source AS copies", "source AS u", "source AS thresholds")
    targets = spark.createDataFrame([("web", 0.6, 2), ("Forum", 0.1, 4), ("tiny", 0.2, 3), ("ghost", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = M.Mix(df, "doc_id", "text", "source", targets)
    rep = {r["source_key"]: r for r in mix.report().collect()}
    assert set(rep) == {"web", "forum", "tiny", "ghost"}
    assert rep["tiny"]["short"] and rep["ghost"]["short"] and not rep["web"]["short"] and rep["tiny"]["most_copies"] == 3 and rep["ghost"]["mixed_docs"] == 0
    assert abs(rep["web"]["share_of_size"] - 0.6) < 0.03 and abs(rep["forum"]["share_of_size"] - 0.1) < 0.02
    assert all(r["most_copies"] <= r["max_repeats"] for r in rep.values())
    rows = mix.records().collect()
    assert len(rows) == sum(r["mixed_docs"] for r in rep.values()) and len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert [r["doc_id"] for r in rows] != sorted(r["doc_id"] for r in rows)
    assert rep["tiny"]["least_copies"] == 3 and mix.drawn().count() == len(rows)
    aside = M.Mix(df, "doc_id", "text", "source", targets)
    aside.small = False  # as with very many targets
    assert sorted(map(str, aside.report().collect())) == sorted(map(str, rep.values()))
    again = M.Mix(df.repartition(5), "doc_id", "text", "source", targets)
    assert {(r["doc_id"], r["copies"]) for r in again.copies().collect()} == {(r["doc_id"], r["copies"]) for r in mix.copies().collect()}
    empty = M.Mix(df.limit(0), "doc_id", "text", "source", targets)
    assert empty.records().collect() == [] and all(r["mixed_tokens"] == 0 for r in empty.report().collect())


HARD = "Notwithstanding comprehensive documentation, the organisation's technicians consistently documented considerable improvements across geographically heterogeneous installations, which substantially undermines confidence in subsequent interpretation of manufacturers' advertised specifications. "
EASY = "It works well. I like it. My dad has one too. We use it a lot. "


def test_measures():
    hard, easy = measures(readable(HARD * 2)), measures(readable(EASY * 5))
    assert hard[1] == 2 and formula_level(*hard) == "hard" and easy[1] == 20 and formula_level(*easy) == "easy"
    assert measures("") == (0, 1, 0) and formula_level(0, 1, 0) is None
    marked = measures(readable("<p>" + HARD + "<br/>" + HARD + "</p> See https://example.invalid/a.b.c"))
    assert marked[0] == hard[0] + 1 and formula_level(*marked) == "hard"
    assert measures("Approx. speaking these are two... and 3.5 ends none")[1] == 2
    assert measures('He said "no." Then five left.')[1] == 2 and measures("éa ß1 ½")[2] == 3
    assert measures("w " * 100_000) == (100_000, 1, 100_000)


def test_levels(spark):
    rows = [(i, (HARD if i % 2 else EASY) * (1 + i % 3)) for i in range(200)] + [(900, None), (901, "  "), (902, HARD * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, "easy"), (0, 2, " EASY"), (0, 3, "hard"), (1, 1, "HARD"), (1, 2, "middle"), (2, 1, "??"), (None, 1, "hard"), (3, 1, None)], "doc_id long, rater int, level_name string")
    assert {tuple(r) for r in label_levels(labels.where("doc_id IS NOT NULL"), "doc_id", "level_name").collect()} == {(0, "easy"), (1, "hard")}
    models = LevelModels.fit(df, "doc_id", "text", labels, "level_name")
    out = reading_levels(df, "doc_id", "text", models)
    got = {r["doc_id"]: r["level"] for r in out.collect()}
    assert {r["doc_id"] for r in out.where(is_hard()).collect()} == {i for i in range(200) if i % 2 and i % 3} | {902}
    assert all(got[i] == ("hard" if i % 2 else "easy") for i in range(200)) and got[900] is None and got[901] is None and got[902] == "hard"
    untrained = LevelModels.fit(df.limit(0), "doc_id", "text", labels.limit(0), "level_name")
    assert reading_levels(df.limit(0), "doc_id", "text", untrained).collect() == []
    # a document has no part in the models that score it: its fold's counts are left out
    one = df.where("doc_id = 1")
    alone = LevelModels.fit(one, "doc_id", "text", labels, "level_name")
    fold = one.select(fold_of("doc_id")).first()[0]
    size = alone.logp.shape[1] // FOLDS
    at = bucket("notwithstanding")
    assert len(set(alone.logp[:, fold * size + at])) == 1 and len(set(alone.logp[:, (1 - fold) * size + at])) > 1
    assert tokens(readable("A <b>B</b> c... https://x.y/z d!")) == ["a", "b", "c", ".", "d", "."]


def test_levels_of_many_documents_come_from_all(spark, monkeypatch):
    n, judged = 30_000, 24_000  # beyond 20,000 judged ones a share was drawn, and of more documents in all
    df = spark.range(-1, n).selectExpr("IF(id < 0, NULL, id) AS doc_id", "'It works. I do.' AS text")
    labels = spark.range(judged).selectExpr("id AS doc_id", "'hard' AS level_name")
    fold = {r["doc_id"]: r["fold"] for r in df.select("doc_id", fold_of("doc_id").alias("fold")).collect()}

    def check():
        models = LevelModels.fit(df, "doc_id", "text", labels, "level_name")
        for f in range(FOLDS):
            other = [d is not None and d < judged for d in fold if fold[d] != f]
            assert np.allclose(np.exp(models.prior[:, f]), np.array([len(other) - sum(other) + 1, 1, sum(other) + 1]) / (len(other) + 3))
        return models

    few = check()
    monkeypatch.setattr(R, "BROADCAST_LABELS", 10)  # as with very many labels: texts and levels meet by id
    monkeypatch.setattr(R, "HELD_WORDS", 2)
    assert (check().logp == few.logp).all()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZ09_.!?'-\"() \n\t\x1c;")))
def test_ascii_texts_are_read_like_others(s):
    w, n, k = measures(s)
    assert measures(s + " é") == (w + 1, n, k + 1) and tokens(s + " é") == [*tokens(s), "é"]
