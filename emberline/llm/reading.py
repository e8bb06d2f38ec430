"""Reading level of documents by unigram language models per level."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import join_per_key

LEVELS = ("easy", "middle", "hard")
#: Words are hashed to so many buckets: the models have folds x levels x buckets numbers, whatever the corpus.
BUCKETS = 1 << 17
FOLDS = 2
#: Labels up to which the judged levels are broadcast; more are joined with the texts by id.
BROADCAST_LABELS = 500_000
#: Different words of a fold and level that are counted as words before they are added to their buckets.
HELD_WORDS = 100_000
SMOOTHING, SPREAD, BACKGROUND = 0.5, 0.01, 0.05
#: Words scored at once.
CHUNK_TOKENS = 500_000

_STRIP = re.compile(r"<[^<>]*>|(?:https?://|www\.)\S+|[^\s<>]+@[^\s<>]+\.\w+|&#?\w{1,10};", re.I)
_SOFT = re.compile("[­​-‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+(?:['’\-‐‑][^\W_]+)*")
_END = re.compile(r"[.!?…]+(?=[\"'”’)\]]*(?:\s|$))")
_TOKEN = re.compile(r"[^\W_]+|[.!?…]+")
_JOIN = re.compile(r"['\-](?<=[A-Za-z0-9]['\-])(?=[A-Za-z0-9])")
#: For ASCII texts, which need no regular expression per word: lower case, one sign for all stops, blanks for all but words.
_PARTED = {i: chr(i).lower() if chr(i).isalnum() else "." if chr(i) in ".!?" else " " for i in range(128)}
_NO_ASCII_LETTER = bytes(i for i in range(128) if not chr(i).isalpha())


def readable(text: str) -> str:
    """The text without tags, links, entities and invisible characters."""
    if not text.isascii():
        text = _SOFT.sub("", text)
    marked = "<" in text or "&" in text or "@" in text or "://" in text or "www." in text.lower()
    return _STRIP.sub(" ", text) if marked else text


def _pieces(clean: str) -> list[str]:
    """Lower-case words of a readable text, and its stops."""
    if clean.isascii():
        parted = clean.translate(_PARTED)
        while ".." in parted:
            parted = parted.replace("..", ".")
        return parted.replace(".", " . ").split()
    return _TOKEN.findall(clean.lower())


def letters(text: str) -> int:
    left = text.encode("utf-8", "replace").translate(None, _NO_ASCII_LETTER)
    return len(left) if left.isascii() else sum(c.isalpha() for c in left.decode("utf-8"))


def measures(clean: str) -> tuple[int, int, int]:
    """Words, sentences (one at least) and letters of a readable text.

    A stop, or several, before white space or the end closes a sentence, after
    an abbreviation too; words hold together at an apostrophe or hyphen.
    """
    if clean.isascii():
        words = len(clean.translate(_PARTED).replace(".", " ").split()) - len(_JOIN.findall(clean))
    else:
        words = len(_WORD.findall(clean))
    return words, max(1, len(_END.findall(clean))), letters(clean)


HARD_WORDS, HARD_PER_SENTENCE, HARD_LETTERS = 40, 18.0, 5.6


def is_hard(words: int = HARD_WORDS, per_sentence: float = HARD_PER_SENTENCE, letters: float = HARD_LETTERS) -> Column:
    """The formula over the columns ``n_words, n_sentences, n_letters``."""
    return (F.col("n_words") >= words) & (F.col("n_words") > per_sentence * F.col("n_sentences")) & (F.col("n_letters") > letters * F.col("n_words"))


def formula_level(words: int, sentences: int, letters: int) -> str | None:
    """A level from the measures alone: the seed of a training text that nobody judged."""
    if not words:
        return None
    if words > HARD_PER_SENTENCE * sentences and letters > HARD_LETTERS * words:
        return "hard"
    return "easy" if words < 9.0 * sentences and letters < 5.0 * words else "middle"


def label_levels(labels: DataFrame, doc_id: str, level: str) -> DataFrame:
    """One level per labelled document: the most frequent, the harder on ties; spelling and case are ignored."""
    name = F.lower(F.trim(level))
    rank = F.when(name == "easy", 0).when(name == "middle", 1).when(name == "hard", 2)
    per = labels.select(F.col(doc_id), rank.alias("rank")).where("rank IS NOT NULL").groupBy(doc_id, "rank").count()
    best = per.groupBy(doc_id).agg(F.max(F.struct("count", "rank"))["rank"].alias("rank"))
    return best.select(doc_id, F.element_at(F.array(*map(F.lit, LEVELS)), F.col("rank") + 1).alias("label"))


def tokens(clean: str) -> list[str]:
    """Lower-case words of a readable text, and one mark for each end of a sentence."""
    return [t if t[0].isalnum() else "." for t in _pieces(clean)]


def bucket(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "replace"), usedforsecurity=False).digest()[:4], "big") % BUCKETS


class _Hasher(dict):
    def __missing__(self, word: str) -> int:
        at = bucket(word if word[0].isalnum() else ".")
        if len(self) < 500_000:
            self[word] = at
        return at

    def ids(self, clean: str) -> list[int]:
        return list(map(self.__getitem__, _pieces(clean)))


def fold_of(doc: str) -> Column:
    """The fold by the first hexadecimal digit of a hash of the document's id."""
    digest = F.md5(F.coalesce(F.col(doc).cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 1), 16, 10).cast("int"), F.lit(FOLDS))


def _bucket_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word counts by fold, level and bucket of one partition; bucket -1 counts the documents."""
    parts = FOLDS * len(LEVELS)
    counts, docs, held, at = np.zeros((parts, BUCKETS), np.int64), np.zeros(parts, np.int64), [Counter() for _ in range(parts)], _Hasher()

    def settle(part: int) -> None:
        seen = held[part]
        np.add.at(counts[part], np.fromiter(map(at.__getitem__, seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
        seen.clear()

    for b in batches:
        for fold, label, text in zip(b["fold"], b["label"], b["text"], strict=True):
            clean = readable(text)
            level = label if isinstance(label, str) else formula_level(*measures(clean))
            words = _pieces(clean)
            if level is not None and words:
                part = fold * len(LEVELS) + LEVELS.index(level)
                docs[part] += 1
                held[part].update(words)
                if len(held[part]) > HELD_WORDS:
                    settle(part)
    for part in range(parts):
        settle(part)
    part, full = np.nonzero(counts)
    level, every = np.arange(parts), np.full(parts, -1)
    for k, bucket_, n in ((part, full, counts[part, full]), (level, every, docs)):
        yield pd.DataFrame({"fold": (k // len(LEVELS)).astype("int32"), "level": (k % len(LEVELS)).astype("int32"), "bucket": bucket_.astype("int32"), "n": n})


class LevelModels:
    """Smoothed unigram models: ``logp[level, fold * buckets + bucket]`` and log priors ``prior[level, fold]``.

    The models at ``fold`` score the documents of that fold and were trained
    on the other's: no document has a part in the models that judge it.
    """

    def __init__(self, counts: np.ndarray, docs: np.ndarray):
        logp, prior = [], []
        for fold in range(FOLDS):
            c, d = counts.sum(axis=0) - counts[fold], docs.sum(axis=0) - docs[fold]
            total = c.sum(axis=0) + SMOOTHING
            common = total / total.sum()
            weight = SMOOTHING * BUCKETS * SPREAD
            own = (c + weight * common) / (c.sum(axis=1, keepdims=True) + weight)
            logp.append(np.log((1 - BACKGROUND) * own + BACKGROUND * common))
            prior.append(np.log((d + 1.0) / (d + 1.0).sum()))
        self.logp, self.prior = np.concatenate(logp, axis=1), np.stack(prior, axis=1)

    @classmethod
    def fit(cls, docs: DataFrame, doc_id: str, text: str, labels: DataFrame, level: str) -> LevelModels:
        """Fitted to the judged level of a document where there is one, else to the formula's.

        Every text and every judgement counts.  The texts are read in one
        pass; they are joined with the judged levels by broadcast, and beyond
        ``BROADCAST_LABELS`` labels by id; at most folds x levels x buckets
        numbers reach the driver.  NULL texts take no part.
        """
        judged = label_levels(labels.where(F.col(doc_id).isNotNull()), doc_id, level).withColumnRenamed(doc_id, "doc")
        rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL")
        if labels.count() <= BROADCAST_LABELS:
            rows = rows.join(F.broadcast(judged), "doc", "left")
        else:
            rows = join_per_key(rows, judged.join(rows.groupBy("doc").agg(F.count("*").alias("rows")), "doc"), "doc", "rows", ["label"])
        rows = rows.select(fold_of("doc").alias("fold"), "label", "text")
        found = rows.mapInPandas(_bucket_counts, "fold int, level int, bucket int, n long").groupBy("fold", "level", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        counts, docs_, words = np.zeros((FOLDS, len(LEVELS), BUCKETS)), np.zeros((FOLDS, len(LEVELS))), found[found["bucket"] >= 0]
        counts[words["fold"].to_numpy(int), words["level"].to_numpy(int), words["bucket"].to_numpy(int)] = words["n"].to_numpy(float)
        for r in found[found["bucket"] < 0].itertuples():
            docs_[r.fold, r.level] += r.n
        return cls(counts, docs_)


def score(models: tuple[np.ndarray, np.ndarray], folds: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best level of each text and its log odds per token against the next one, priors included.

    ``ids``: the buckets of all texts in a row, ``lengths`` of them each (above 0).
    """
    logp, prior = models
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ll = prior[:, folds] + np.add.reduceat(logp[:, ids + np.repeat(folds, lengths) * BUCKETS], starts, axis=1)
    best = ll.argmax(axis=0)
    ranked = np.sort(ll, axis=0)
    return best, (ranked[-1] - ranked[-2]) / lengths


def _levels(shared, measured: frozenset[str]):
    wanted = np.array([x in measured for x in LEVELS])

    def work(models, folds: list[int], held: list[str], ids: list[list[int]]) -> pd.DataFrame:
        lengths = np.array([len(i) for i in ids], int)
        some = np.flatnonzero(lengths)
        level, odds = np.full(len(ids), -1), np.full(len(ids), np.nan)
        if len(some):
            flat = np.fromiter((x for i in ids for x in i), np.int64, int(lengths.sum()))
            level[some], odds[some] = score(models, np.array(folds)[some], lengths[some], flat)
        sizes = [measures(t) if k >= 0 and wanted[k] else (None, None, None) for k, t in zip(level, held, strict=True)]
        out = {"level": [LEVELS[k] if k >= 0 else None for k in level], "odds": pd.Series(odds).where(lengths > 0, None), "n_tokens": lengths.astype("int32")}
        return pd.DataFrame(out | {c: pd.array([s[j] for s in sizes], "Int32") for j, c in enumerate(("n_words", "n_sentences", "n_letters"))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, at = shared.value, _Hasher()
        for b in batches:
            parts, folds, held, ids, size = [], [], [], [], 0
            for fold, t in zip(b["fold"], b["text"], strict=True):
                clean = readable(t) if isinstance(t, str) else ""
                found = at.ids(clean)
                folds.append(fold), held.append(clean), ids.append(found)
                size += len(found)
                if size >= CHUNK_TOKENS:
                    parts.append(work(models, folds, held, ids))
                    folds, held, ids, size = [], [], [], 0
            parts.append(work(models, folds, held, ids))
            yield pd.concat([b[["doc"]].reset_index(drop=True), pd.concat(parts, ignore_index=True)], axis=1)

    return run


def reading_levels(df: DataFrame, doc_id: str, text: str, models: LevelModels, measured: Collection[str] = LEVELS) -> DataFrame:
    """``doc_id, level, odds, n_tokens, n_words, n_sentences, n_letters`` of every row.

    ``level``: the one of the highest posterior likelihood by the models that
    were trained without the document's fold.  ``odds``: its log odds per
    token against the next likely one.  The words, sentences and letters are
    counted for the levels in ``measured`` and NULL for others.  NULL texts
    and texts without words or sentence ends have no level.  Whole texts are
    read, however long, in one pass.
    """
    shared = df.sparkSession.sparkContext.broadcast((models.logp, models.prior))
    schema = f"doc {df.schema[doc_id].dataType.simpleString()}, level string, odds double, n_tokens int, n_words int, n_sentences int, n_letters int"
    rows = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).withColumn("fold", fold_of("doc"))
    return rows.mapInPandas(_levels(shared, frozenset(measured)), schema).withColumnRenamed("doc", doc_id)
