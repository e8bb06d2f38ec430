"""Evaluation texts inside a training corpus."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import words_of
from .worker import kept

#: Words of all items up to which one automaton holds them (some 100 bytes each in a worker).
AUTOMATON_WORDS = 4_000_000
#: Bits of the table that tells which items can't be in the corpus, where there are more words; its size is fixed.
TABLE_BITS = 1 << 26
_NONE = 0


class PassageAutomaton:
    """Finds every run of ``least`` consecutive words of an item in a text, and short items that stand whole.

    The patterns of one Aho-Corasick automaton, over words instead of
    characters, are the pieces of half of ``least`` words that an item's text
    splits into: any run of ``least`` words has a whole piece in it.  From
    each hit the run is extended to both sides.  So the automaton has no more
    nodes than the items have words, and a text is scanned once, however many
    items there are.  A text of ``whole`` words at least but fewer than
    ``least`` is one pattern.
    """

    def __init__(self, items: list[tuple[int, list[list[str]]]], least: int, whole: int | None = None):
        import ahocorasick

        self.least, self.code, self.texts = least, {}, []
        size = (least + 1) // 2
        pieces: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, texts in items:
            for words in texts:
                coded = tuple(self.code.setdefault(w, len(self.code) + 1) for w in words)
                if len(words) >= least:
                    starts = range(0, len(words) - size + 1, size)
                elif whole is not None and len(words) >= whole:
                    starts = (0,)
                else:
                    continue
                for i in starts:
                    pieces.setdefault(coded[i : i + size] if len(words) >= least else coded, []).append((len(self.texts), i))
                self.texts.append((item, coded, min(least, len(words))))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.empty = not pieces
        self.shortest = min(map(len, pieces), default=0)
        if pieces:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """``item, start, end, words`` of every longest run, by offsets in ``text``."""
        if self.empty:
            return []
        words, places = words_of(text)
        if len(words) < self.shortest:
            return []
        coded = tuple(map(self.code.get, words, repeat(_NONE)))
        seen: dict[tuple[int, int], int] = {}
        out = set()
        for end, (size, owners) in self.automaton.iter(coded):
            begin = end - size + 1
            for k, at in owners:
                if seen.get((k, begin - at), -1) >= end:
                    continue
                item, own, least = self.texts[k]
                a, i = begin, at
                while a and i and coded[a - 1] == own[i - 1]:
                    a, i = a - 1, i - 1
                b, j = end + 1, at + size
                while b < len(coded) and j < len(own) and coded[b] == own[j]:
                    b, j = b + 1, j + 1
                seen[k, begin - at] = b - 1
                if b - a >= least:
                    out.add((item, a, b))
        return [(item, places[a][0], places[b - 1][1], b - a) for item, a, b in sorted(out)]


def _scan(key: str, shared, least: int, whole: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = kept(f"automaton:{key}", lambda: PassageAutomaton([(i, [words_of(t)[0] for t in texts]) for i, texts in shared.value], least, whole))
        for b in batches:
            rows = [(d, *s) for d, t in zip(b["doc"], b["text"], strict=True) if isinstance(t, str) for s in found.spans(t)]
            yield pd.DataFrame(rows, columns=["doc", "item", "start", "end", "n_words"])

    return run


def _piece_hashes(words: list[str], size: int, cache: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each word on."""
    for w in words:
        if w not in cache:
            if len(cache) > 500_000:
                cache.clear()
            cache[w] = int.from_bytes(hashlib.md5(w.encode("utf-8", "replace"), usedforsecurity=False).digest()[:8], "big")
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter((cache[w] for w in words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return out


def _item_pieces(size: int, least: int, whole: int | None, texts: int):
    """Hashes of the pieces of each item's texts (of a short one: of its first words, at most ``size``, with that number mixed in)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for b in batches:
            rows = []
            for r in b.itertuples():
                for i in range(texts):
                    t = getattr(r, f"t{i}")
                    words = words_of(t)[0] if isinstance(t, str) else []
                    if len(words) >= least:
                        rows += [(r.item, int(h)) for h in _piece_hashes(words, size, cache)[::size].view(np.int64)]
                    elif whole is not None and len(words) >= whole:
                        k = min(whole, len(words))
                        rows.append((r.item, int(_piece_hashes(words[:k], k, cache).view(np.int64)[0])))
            yield pd.DataFrame(rows, columns=["item", "h"]).astype("int64")

    return run


def _possible(shared, sizes: tuple[int, ...]):
    """Hashes of the corpus that the table doesn't rule out, each once a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        table = shared.value
        for b in batches:
            found = set()
            for t in b["text"]:
                words = words_of(t)[0]
                for size in sizes:
                    h = _piece_hashes(words, size, cache)
                    bit = h % np.uint64(TABLE_BITS)
                    found.update(h[(table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0].view(np.int64).tolist())
            yield pd.DataFrame({"h": np.array(sorted(found), np.int64)})

    return run


def _items_to_look_for(docs: DataFrame, items: DataFrame, least: int, whole: int | None, texts: int) -> DataFrame:
    """Items of which some piece is in the corpus, found in one pass over it.

    A table of fixed size is broadcast and tells most of the corpus's pieces
    apart from the items'; the few others are joined by their hash.
    """
    spark, size = docs.sparkSession, (least + 1) // 2
    pieces = items.mapInPandas(_item_pieces(size, least, whole, texts), "item long, h long")
    # the place of a bit is the remainder of the unsigned hash: its lowest bits
    at = pieces.selectExpr(f"CAST(shiftright(h & {TABLE_BITS - 1}L, 3) AS INT) AS byte", "CAST(h & 7L AS INT) AS bit")
    rows = at.groupBy("byte").agg(F.expr("bit_or(shiftleft(1, bit))").alias("bits")).toArrow().to_pandas()
    table = np.zeros(TABLE_BITS // 8, np.uint8)
    table[rows["byte"].to_numpy(int)] = rows["bits"].to_numpy(int)
    shared = spark.sparkContext.broadcast(table)
    sizes = (size,) if whole is None else tuple(sorted({size, whole}))
    seen = docs.mapInPandas(_possible(shared, sizes), "h long").distinct()
    return items.join(pieces.join(seen, "h", "left_semi").select("item").distinct(), "item", "left_semi")


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_texts: Sequence[str], least: int = 12, whole: int | None = None) -> DataFrame:
    """``doc_id, item_id, start, end, n_words``: the runs of at least ``least`` words of an item in a document.

    Offsets are characters of the original text.  Letter case, accents,
    punctuation, spacing, tags, character entities, invisible characters,
    compatibility forms and words broken with a hyphen at a line end make no
    difference.  ``item_texts``: columns (question, answer) whose texts count,
    each for itself.  A text shorter than ``least`` is reported where it
    stands whole, if it has ``whole`` words at least (None: never).  NULL
    texts yield nothing; items that share a passage are all reported;
    repeated documents each are.

    Documents are scanned once and never shuffled; the words of the items are
    counted first.  Where they are more than one automaton holds, a pass
    before rules out the items of which not even half a passage is in the
    corpus; only should the rest still be too many, there are several passes.
    """
    spark = docs.sparkSession
    plain = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    wanted = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(item_texts)))

    def words(df: DataFrame) -> int:
        per = sum((F.coalesce(F.regexp_count(f"t{i}", F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).cast("long") for i in range(len(item_texts))), F.lit(0))
        return df.agg(F.sum(per)).first()[0] or 0

    n = words(wanted)
    if n > AUTOMATON_WORDS:
        wanted = _items_to_look_for(plain.select("text"), wanted, least, whole, len(item_texts))
        n = words(wanted)
    passes = max(1, -(-n // AUTOMATON_WORDS))
    out = None
    for k in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).collect()  # about AUTOMATON_WORDS words
        shared = spark.sparkContext.broadcast([(r["item"], [r[f"t{i}"] for i in range(len(item_texts)) if isinstance(r[f"t{i}"], str)]) for r in rows])
        part = plain.mapInPandas(_scan(uuid.uuid4().hex, shared, least, whole), "doc long, item long, start int, end int, n_words int")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("doc").cast(docs.schema[doc_id].dataType).alias(doc_id), F.col("item").cast(items.schema[item_id].dataType).alias(item_id), "start", "end", "n_words")
