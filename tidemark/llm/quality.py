"""Quality by hierarchical empirical Bayes over sites.

Evidence: a numpy logistic model over style features of the whole text gives each document
the log-odds of being good. Sites: documents lie in paths, paths in hosts. The share of
good text of a host is shrunk toward the global share, that of a path toward its host's, by
prior weights that the data give (method of moments over sites: what site means differ by
more than their sampling error). A document's posterior log-odds are its evidence plus what
its path adds to the global prior; a site of few documents adds next to nothing. The document
itself is taken out of the sums of its path, its host and the whole corpus, so its evidence
counts once.

The fit uses at most MAX_LABELLED labelled rows, those whose ids have the least hashes; site
statistics cover all documents. Sums per site are formed map-side, so a site with a third
of all rows costs no more than another.

Defined cases: null host or path is the site ''; null and empty texts have zero features;
without labels of both kinds the evidence is 0 and all are kept; repeated rows each count;
of labels that share a doc_id the greatest holds, of texts that share one the one of least
features is the sample's; the only document of a corpus has share 0.5; texts of any length are
read whole; other columns, whatever their names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import least_hashed, reach_workers, stage, whole_text
from tidemark.llm.words import hash_words

MAX_LABELLED = 12_000
RIDGE = 1.0
#: Log-odds of the evidence are held within this, so that no document outweighs its site for good.
MOST_ODDS = 12.0
GROUP = 500
N_STYLE = 12

_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _KIND[_b] = 5 if _b >= 0x80 else 0 if chr(_b).islower() else 1 if chr(_b).isupper() else 2 if chr(_b).isdigit() else 3 if chr(_b).isspace() else 4
#: Marks of prose; other ASCII signs are symbols.
_PROSE = np.isin(np.arange(256), np.frombuffer(b".,;:'\"()-?", np.uint8))


def style(text: str) -> list[float]:
    """Features of the whole text: sizes, shares of kinds of characters, repetition."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, minlength=6)
    words, lines = data.split(), data.split(b"\n")
    n, size = len(words), max(1, len(data))
    h = hash_words(words)
    again = float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
    pairs = h[1:] * np.uint64(3) + h[:-1]
    return [
        np.log1p(n), len(data) / max(1, n), kinds[1] / size, kinds[2] / size, kinds[4] / size, counts[~_PROSE & (_KIND == 4)].sum() / size, kinds[5] / size, again,
        1 - len(np.unique(h)) / max(1, n), 1 - len(np.unique(pairs)) / max(1, n - 1) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)),
    ]


def styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([style(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, N_STYLE)
        yield pa.record_batch([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), N_STYLE).cast(pa.list_(pa.float64()))], names=["doc_id", "style"])


def expand(x: np.ndarray) -> np.ndarray:
    """Standardised features with their squares and products, and a constant."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([x, np.clip(x[:, i] * x[:, j], -30, 30), np.ones((len(x), 1))])


class Model:
    """Ridge logistic regression by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self.stand(x)
        self.w = np.zeros(z.shape[1])
        ridge = RIDGE * np.eye(z.shape[1])
        ridge[-1, -1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def stand(self, x: np.ndarray) -> np.ndarray:
        return expand(np.clip((x - self.mean) / self.scale, -10, 10))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.stand(x) @ self.w, -MOST_ODDS, MOST_ODDS)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    sample = stage(least_hashed(known, "doc_id", MAX_LABELLED), "quality-ids")
    known = stage(known.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality")), "quality-sample")
    reach_workers(spark)
    picked = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    found = stage(picked.mapInArrow(styles, "doc_id long, style array<double>"), "quality-styles").groupBy("doc_id").agg(F.min("style").alias("style"))
    rows = found.join(F.broadcast(known), "doc_id").orderBy("doc_id").toPandas()
    if rows["quality"].nunique() < 2:
        return None
    return Model(np.stack(rows["style"].to_numpy()), rows["quality"].to_numpy(np.float64))


def _evidence(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, GROUP):
            part = whole.slice(start, GROUP)
            x = np.array([style(t) for t in part.column("text").to_pylist()]).reshape(-1, N_STYLE)
            odds = model.log_odds(x) if model else np.zeros(len(x))
            yield pa.record_batch([part.column("doc_id"), part.column("host"), part.column("path"), pa.array(odds)], names=["doc_id", "host", "path", "evidence"])


def _logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(held / (1 - held))


def prior_weight(sites: DataFrame, center: Column | float) -> float:
    """How many documents the level above is worth, by the method of moments.

    sites: (n, good), documents and expected good ones. The weighted squared distance of the
    sites' means from their centre, less its sampling part, is the variance between sites.
    """
    c = center if isinstance(center, Column) else F.lit(center)
    mean = F.col("good") / F.col("n")
    row = sites.where("n > 1").agg(F.sum(F.col("n") * (mean - c) ** 2), F.sum(c * (1 - c)), F.sum("n"), F.avg(c * (1 - c))).first()
    if not row[2]:
        return 1e6
    between = max((row[0] - row[1]) / row[2], 0.0)
    return float(min(max(row[3] / between - 1, 1.0), 1e6)) if between > 1e-12 else 1e6


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, evidence, host_share, path_share, score, keep), a row per row of docs.

    host, path: the site of a row, as columns of docs; a path belongs to its host.
    """
    spark = docs.sparkSession
    model = fit(docs, labels)
    reach_workers(spark)
    site = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select("doc_id", whole_text().alias("text"), site(host).alias("host"), site(path).alias("path"))
    scored = stage(rows.mapInArrow(partial(_evidence, model=model), "doc_id long, host string, path string, evidence double"), "quality-evidence")
    good = 1 / (1 + F.exp(-F.col("evidence")))
    paths = stage(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("good")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    base = (total[1] / total[0]) if total[0] else 0.5
    host_weight = prior_weight(hosts, base)
    shares = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), ((F.col("good") + host_weight * base) / (F.col("n") + host_weight)).alias("center"))
    sites = paths.join(shares, "host")
    path_weight = prior_weight(sites, F.col("center"))
    sites = stage(sites.withColumnRenamed("n", "site_n").withColumnRenamed("good", "site_good"), "quality-sites")
    n, all_good = int(total[0] or 0), float(total[1] or 0.0)
    # each level without the document itself
    others = (F.lit(all_good) - good) / (n - 1) if n > 1 else F.lit(0.5)
    others = F.least(F.greatest(others, F.lit(0.0)), F.lit(1.0))
    host_share = (F.greatest(F.col("host_good") - good, F.lit(0.0)) + host_weight * others) / (F.col("host_n") - 1 + host_weight)
    out = scored.join(sites, ["host", "path"]).withColumn("base", others).withColumn("host_share", host_share)
    out = out.withColumn("path_share", (F.greatest(F.col("site_good") - good, F.lit(0.0)) + path_weight * F.col("host_share")) / (F.col("site_n") - 1 + path_weight))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_share")) - _logit(F.col("base")))))
    return out.withColumn("score", score).select("doc_id", "host", "path", "evidence", "host_share", "path_share", "score", (F.col("score") >= 0.5).alias("keep"))
