"""Toxicity by non-negative positive-unlabelled learning.

A numpy logistic model over hashed words and word beginnings of whole texts is fitted to confirmed toxic
examples P and unlabelled text U. With the share of toxic text, the prior p, the risk is

    p * E_P[loss(g, +)] + max(0, E_U[loss(g, -)] - p * E_P[loss(g, -)])

and where the bracket falls below zero its gradient is followed upwards, so the model can't
drive the negatives' estimated risk under zero by learning P by heart.

Which features tell is decided by how many of all confirmed texts and of all unlabelled ones have
them, and the prior comes from all labelled rows. Only the gradient steps use a sample: at most
MAX_POSITIVE confirmed and MAX_UNLABELLED unlabelled texts, those whose ids have the least hashes.
Every text is scored.
labels, lang, source and doc_id are never inputs of a score. Rows held out (crc32 of the id
as text, mod 4, is 2) give neither labels nor text to the fit.

Defined cases: null and empty texts get the score of a text without words; without any
confirmed example all scores are 0; rows that repeat are scored one by one; of texts that
share a doc_id the one with the fewest features, then with the least hash of them, is the
sample's, and each counts where features are counted, as do rows without doc_id; a doc_id is confirmed if any of its labels is 1; texts of any length are scored whole;
other columns, whatever their names, are only passed on; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filtered_joins, least_hashed, reach_workers, stage, texts
from tidemark.llm.linear import ALL_TEXTS, BUCKETS, COUNTS_SCHEMA, FEATURES_SCHEMA, GROUP, Adam, Rows, distinct_buckets, features, sigmoid, text_counts

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
#: Files of a table that the two bounds above keep small.
SAMPLE_FILES = 8
THRESHOLD = 0.3
#: A feature counts when its share of confirmed texts differs from its share of unlabelled
#: texts by this many standard errors, and it is in so many confirmed texts.
MIN_Z, MIN_TEXTS = 6.0, 5
EPOCHS, STEPS, RATE = 40, 8, 0.05
SHRINK = 1e-4

_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def counted(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(bucket, p, u): in how many of all confirmed and of all texts that aren't held out each
    bucket is. Every task adds its texts up, so no text is shuffled but the confirmed ones."""
    own = texts(docs).where(~held_out())
    confirmed = stage(known.where("toxic = 1").distinct(), "toxic-confirmed")
    with filtered_joins(docs.sparkSession):
        p = own.join(confirmed.where("toxic = 1").select("doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(text_counts, COUNTS_SCHEMA)
        p = p.withColumn("confirmed", F.lit(True))
        u = own.mapInArrow(text_counts, COUNTS_SCHEMA).withColumn("confirmed", F.lit(False))
        each = p.unionByName(u).groupBy("bucket")
        return stage(each.agg(*(F.sum(F.when(F.col("confirmed") == is_p, F.col("texts")).otherwise(0)).alias(name) for name, is_p in (("p", True), ("u", False)))), "toxic-counts")


def telling(counts: DataFrame) -> DataFrame:
    """The buckets by which confirmed texts differ from unlabelled ones; rare ones only fit noise."""
    n, m = counts.where(F.col("bucket") == ALL_TEXTS).agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("u"), F.lit(0))).first()
    if not n or not m:
        return counts.select("bucket").limit(0)
    share = (F.col("p") + F.col("u")) / (n + m)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n + 1 / m))
    apart = F.abs(F.col("p") / n - F.col("u") / m) >= MIN_Z * error
    return counts.where((F.col("bucket") != ALL_TEXTS) & apart & (F.col("p") >= MIN_TEXTS)).select("bucket")


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int) -> tuple[np.ndarray, float]:
    """(weights, intercept) at the least non-negative risk under the logistic loss."""
    rng = np.random.default_rng(5)
    w = np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    adam = Adam(size + 1, RATE)
    for _ in range(EPOCHS):
        in_p, in_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for p_part, u_part in zip(np.array_split(in_p, STEPS), np.array_split(in_u, STEPS), strict=True):
            if not len(p_part) or not len(u_part):
                continue
            p, u = Rows([positive[i] for i in p_part]), Rows([unlabelled[i] for i in u_part])
            gp, gu = p.times(w) + w[size], u.times(w) + w[size]
            sp, su = sigmoid(gp), sigmoid(gu)
            negatives = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if negatives >= 0:
                dp, du = prior * ((sp - 1) - sp) / p.n, su / u.n
            else:
                dp, du = prior * sp / p.n, -su / u.n
            g = np.append(p.back(dp, size) + u.back(du, size), dp.sum() + du.sum())
            g[:size] += SHRINK * w[:size]
            adam.step(w, g)
    return w[:size], float(w[size])


@dataclass(frozen=True)
class Model:
    """The weights of some buckets; all others weigh nothing."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts_: list[str], dense: np.ndarray) -> np.ndarray:
        doc, bucket = distinct_buckets(texts_)
        return sigmoid(np.bincount(doc, dense[bucket], minlength=len(texts_)) + self.intercept)

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.buckets] = self.weights
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model for these documents and labels; the sample's bound is the broadcast's."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    prior, n = known.agg(F.avg("toxic"), F.sum("toxic")).first()
    nothing = Model(np.empty(0, np.int64), np.empty(0), -np.inf)
    if not n:
        return nothing
    p = least_hashed(known.where("toxic = 1"), "doc_id", MAX_POSITIVE).withColumn("confirmed", F.lit(True))
    u = least_hashed(docs.select("doc_id").where(~held_out()), "doc_id", MAX_UNLABELLED).withColumn("confirmed", F.lit(False))
    chosen = stage(p.unionByName(u), "toxic-sample")
    picked = texts(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    found = stage(picked.mapInArrow(features, FEATURES_SCHEMA), "toxic-features")
    found = found.groupBy("doc_id").agg(F.min_by("buckets", F.struct(F.size("buckets"), F.xxhash64("buckets"))).alias("buckets"))
    found = stage(found.join(F.broadcast(chosen), "doc_id").coalesce(SAMPLE_FILES), "toxic-rows")
    n, m = found.agg(F.count_if("confirmed"), F.count_if(~F.col("confirmed"))).first()
    if not n or not m:
        return nothing
    kept = stage(telling(counted(docs, known)).coalesce(SAMPLE_FILES), "toxic-buckets")
    buckets = np.sort(kept.toArrow().column("bucket").to_numpy())  # at most BUCKETS numbers
    each = found.select("doc_id", "confirmed", F.explode("buckets").alias("bucket")).join(kept, "bucket")
    rows = each.groupBy("doc_id", "confirmed").agg(F.sort_array(F.collect_list("bucket")).alias("buckets")).orderBy("confirmed", "doc_id").toArrow()
    lists = rows.column("buckets").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    places = np.searchsorted(buckets, lists.flatten().to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    confirmed = rows.column("confirmed").to_numpy()

    def of(kind: bool, size: int) -> list[np.ndarray]:
        held = [places[ends[i] : ends[i + 1]] for i in np.flatnonzero(confirmed == kind)]
        return held + [np.empty(0, np.int64)] * (size - len(held))

    w, intercept = fit_nnpu(of(True, n), of(False, m), min(max(prior, 1e-4), 0.5), len(buckets))
    return Model(buckets, w, intercept)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    dense = model.dense()
    for whole in batches:
        for start in range(0, whole.num_rows, GROUP):
            part = whole.slice(start, GROUP)
            yield pa.record_batch([part.column("doc_id"), pa.array(model.scores(part.column("text").to_pylist(), dense))], schema=_SCORED)


def _accepted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    dense = model.dense()
    for whole in batches:
        for start in range(0, whole.num_rows, GROUP):
            part = whole.slice(start, GROUP)
            yield part.filter(pa.array(model.scores([t or "" for t in part.column("text").to_pylist()], dense) < THRESHOLD))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What query op8 returns: a row for each row of docs."""
    scored = texts(docs).mapInArrow(partial(_scored, model=fit(docs, labels)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    reach_workers(docs.sparkSession)
    return docs.mapInArrow(partial(_accepted, model=fit(docs, labels)), docs.schema)
