"""Mixing sources to target shares of tokens."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import join_per_key
from ..plans.materialize import materialize
from .worker import kept

#: Targets up to which the plan is broadcast; more are joined with hot sources set aside.
BROADCAST_TARGETS = 5_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _tokenizer(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(key: str, shared, keep: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = kept(f"tokenizer:{key}", lambda: _tokenizer(shared.value))
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            yield b[list(keep)].assign(n_tokens=[len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)])

    return run


def token_counts(df: DataFrame, keep: Sequence[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each row's text; NULL and empty texts have 0.

    The vocabulary file is read on the driver and sent to the workers, so only
    the driver needs it; its size is that of the file.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    plain = df.select(*keep, F.col(text).alias("text")) if text not in keep else df.select(*keep)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    return plain.mapInPandas(_count(hashlib.md5(vocabulary, usedforsecurity=False).hexdigest(), shared, keep), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long")


def source_key(c: str) -> Column:
    """Sources compare without case and outer spaces (of any kind)."""
    return F.lower(F.regexp_replace(F.col(c), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))


def _poisson(rate: float, cap: int) -> np.ndarray:
    """Probabilities of 0 .. cap - 1, by logarithms: no rate is too great."""
    k = np.arange(cap)
    logs = np.concatenate([[0.0], np.cumsum(np.log(k[1:]))]) if cap else np.zeros(0)
    return np.exp(k * math.log(rate) - rate - logs) if rate > 0 else (k == 0).astype(float)


def capped_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson number of the given rate, cut off at ``cap``."""
    return cap - float(((cap - np.arange(cap)) * _poisson(rate, cap)).sum())


def rate_for(mean: float, cap: int) -> float | None:
    """The rate at which the capped mean is ``mean``; None where even ``cap`` copies of everything don't reach it."""
    if mean >= cap:
        return None
    low, high = 0.0, max(1.0, 2.0 * mean)
    while capped_mean(high, cap) < mean:
        low, high = high, 2 * high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    return high


def copy_thresholds(mean: float, cap: int) -> tuple[int, list[float]]:
    """``least, thresholds``: a document with the uniform number u gets ``least`` copies and one more for each threshold <= u.

    The cumulative probabilities, without those that no u below 1 - 2^-53 is
    under or none is above: some 20 deviations of the Poisson number are left.
    """
    if mean <= 0 or cap <= 0:
        return 0, []
    rate = rate_for(mean, cap)
    if rate is None:
        return cap, []
    upto = np.cumsum(_poisson(rate, cap))
    least = int((upto < 2.0**-53).sum())
    return least, [float(x) for x in upto[least:] if x < 1.0 - 2.0**-53]


def uniform(columns: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only: 52 bits of a digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _plan(total: float):
    """Rates of the sources, worked out where their rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for share, cap, size in zip(b["target_share"], b["max_repeats"], b["size"], strict=True):
                mean = share * total / size if size else 0.0
                rows.append((size * cap < share * total, *copy_thresholds(mean, int(cap))))
            out = pd.DataFrame(rows, columns=["short", "least", "thresholds"]).astype({"short": bool, "least": "int32"})
            yield pd.concat([b.reset_index(drop=True), out], axis=1)

    return run


class Mix:
    """A planned mix; ``counts``: the documents' ids, source keys and sizes, written once.

    The mix is as large as all documents together, those of sources without a
    target included.  Each document of a source is used a Poisson number of
    times, whose mean is the source's wanted size over the one it has, cut off
    at the source's cap (the rate is raised so that the mean holds); the number
    is read off from a hash of the document's id and the seed, so it is the
    same wherever and however often it is computed.  A source that can't reach
    its share is used at its cap throughout.

    ``size``: a column of the documents' sizes; by default the tokens of their
    texts by a public tokenizer.  Sources with a NULL name or without a target
    aren't used; a target whose source has no documents is reported with
    nothing; of targets with the same key the first by name counts; repeated
    ids get the same number each.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 7, size: str | None = None):
        self.doc_id, self.text, self.seed, self.docs = doc_id, text, seed, docs.withColumn("source_key", source_key(source))
        if size is None:
            sized = token_counts(self.docs.select(doc_id, "source_key", F.col(text).alias("text")), [doc_id, "source_key"], "text", tokenizer)
        else:
            sized = self.docs.select(doc_id, "source_key", F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n_tokens"))
        self.counts = materialize(sized, "tokens")
        wanted = targets.withColumn("source_key", source_key("source")).where("source_key IS NOT NULL")
        wanted = wanted.groupBy("source_key").agg(F.min_by(F.struct("target_share", "max_repeats"), "source").alias("t"))
        have = self.counts.groupBy("source_key").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("size"))
        self.total = have.agg(F.sum("size")).first()[0] or 0
        zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c.split(".")[-1])
        rows = wanted.join(have, "source_key", "left").select("source_key", zero("t.target_share", "double"), zero("t.max_repeats", "int"), zero("docs", "long"), zero("size", "long"))
        schema = "source_key string, target_share double, max_repeats int, docs long, size long, short boolean, least int, thresholds array<double>"
        self.plan = materialize(rows.mapInPandas(_plan(float(self.total)), schema), "plan")
        self.small = self.plan.count() <= BROADCAST_TARGETS

    def _with_copies(self, rows: DataFrame) -> DataFrame:
        """Rows of sources with a target and their ``copies``."""
        if self.small:
            d = rows.join(F.broadcast(self.plan.select("source_key", "least", "thresholds")), "source_key")
        else:
            d = join_per_key(rows, self.plan, "source_key", "docs", ["least", "thresholds"], inner=True)
        d = d.withColumn("u__", uniform([self.doc_id], self.seed))
        return d.withColumn("copies", F.col("least") + F.size(F.filter("thresholds", lambda t: t <= F.col("u__")))).drop("least", "thresholds", "u__")

    def copies(self) -> DataFrame:
        """Each document of a source with a target, with its number of copies (0 included)."""
        return self._with_copies(self.counts)

    def drawn(self) -> DataFrame:
        """The mix without its texts: a row for each copy of a document."""
        return self.copies().where("copies > 0").select(self.doc_id, "source_key", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))

    def report(self) -> DataFrame:
        """Target and actual share of each source, from the rows of the mix itself.

        ``unused``: documents that the mix doesn't hold; ``least_copies`` and
        ``most_copies``: of those that it holds.  ``short``: the source is
        below its share of the size although each of its documents (with any
        size) is in the mix as often as is allowed.
        """
        per_doc = self.drawn().groupBy("source_key", self.doc_id, "n_tokens").agg(F.count("*").alias("rows"), F.max("copy").alias("copies"))
        full = self.plan.select("source_key", F.col("max_repeats").alias("cap__"))
        per_doc = per_doc.join(F.broadcast(full), "source_key") if self.small else join_per_key(per_doc, self.plan.withColumnRenamed("max_repeats", "cap__"), "source_key", "docs", ["cap__"], inner=True)
        per = per_doc.groupBy("source_key").agg(
            F.sum(F.col("n_tokens") * F.col("rows")).alias("mixed_tokens"), F.sum("rows").alias("mixed_docs"), F.sum(F.when(F.col("copies") >= F.col("cap__"), F.col("n_tokens") * F.col("rows"))).alias("at_cap"),
            F.min("copies").alias("least_copies"), F.max("copies").alias("most_copies"),
        )
        total = per.agg(F.sum("mixed_tokens")).first()[0] or 0
        numbers = ["mixed_tokens", "mixed_docs", "at_cap", "least_copies", "most_copies"]
        out = self.plan.drop("thresholds", "least", "short").join(per, "source_key", "left").fillna(0, numbers)
        below = F.col("mixed_tokens") < F.col("target_share") * float(self.total)
        used_up = F.col("at_cap") >= F.col("size") * F.col("max_repeats")
        out = out.withColumns({"short": below & used_up, "share_of_size": F.col("mixed_tokens") / float(max(1, self.total)), "share_of_mix": F.col("mixed_tokens") / float(max(1, total))})
        return out.withColumnRenamed("size", "tokens").drop("at_cap")

    def records(self) -> DataFrame:
        """The mix: every document with its text, once for each copy, in a global shuffle by a hash.

        The text is carried through the one shuffle that mixes; ``copies`` is
        worked out from the plan per row, so documents aren't joined again.
        """
        d = self._with_copies(self.docs.select(self.doc_id, "source_key", self.text)).where("copies > 0")
        d = d.select(self.doc_id, "source_key", self.text, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        d = d.withColumn("shuffle_key", F.xxhash64(F.lit(self.seed + 1), self.doc_id, "copy"))
        parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return d.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
