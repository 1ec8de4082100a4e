"""A quality classifier with hierarchical empirical Bayes: a document's own evidence, its host's and its path's.

The document classifier is a logistic regression over 2**15 hashed words, learnt on the driver from a bounded sample
of labelled rows (``LABELLED`` at most, chosen by a hash of the id; good means quality 1 and not toxic). Its probabilities of
all documents are added up by host (``source``) and by path (host and ``lang``) with map-side combine. A host's mean is shrunk to the
global mean and a path's to its host's, by as many pseudo-documents as the method of moments finds: the more the means of sites
differ for their size, the fewer. A document's log odds are its own, plus what its path's posterior adds to the global prior.

Defined results: a null text has no evidence (the global prior); null hosts and paths are sites of their own; with no labels
every document has probability 0.5; repeated rows count as often as they stand; rows of labels for one id count once
each, with one text of that id; ids of any type; texts of any length; an empty table gives an empty result; other columns, of any name, are
ignored by :func:`scores`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import materialize, sampled, table

FEATURES, LABELLED, MEMO = 1 << 15, 6000, 500_000
#: Tables of sites are broadcast up to so many rows.
BROADCAST_SITES = 100_000


class Features:
    """Hashed words of a text, each once, with a bounded table of hashes."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        memo, out = self.memo, []
        for w in set((text or "").encode().lower().split()):
            i = memo.get(w)
            if i is None:
                if len(memo) >= MEMO:
                    memo.clear()
                i = memo[w] = zlib.crc32(w) % FEATURES
            out.append(i)
        return np.array(out, np.int64)


def fit(rows: list[np.ndarray], y: np.ndarray, rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias; a row's features count 1 over the root of their number. Classes weigh the same."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    size = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    value = (1 / np.sqrt(np.maximum(size, 1)))[owner]
    weigh = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, b, past = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, w[at] * value, len(rows)) + b
        g = (1 / (1 + np.exp(-z)) - y) * weigh / len(rows)
        grad = np.bincount(at, g[owner] * value, FEATURES) + ridge * w
        past += grad * grad
        w -= rate * grad / np.sqrt(past)
        b -= rate * g.sum()
    return w, b


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(p / (1 - p))


def evidence(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """(doc_id, host, path, p) from (doc_id, host, path, text); p is null where the text is or has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for b in batches:
            p = []
            for text in b.column(3):
                at = of(text.as_py())
                p.append(None if not len(at) else 0.5 if model is None else float(1 / (1 + np.exp(-np.clip(model[0][at].sum() / np.sqrt(len(at)) + model[1], -30, 30)))))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p, pa.float64())], names=["doc_id", "host", "path", "p"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {ids}, host string, path string, p double")


def pseudo_count(sites: DataFrame, center: Column) -> float:
    """How many pseudo-documents shrink a site: within-site variance over variance between sites, by moments; 1 to 1000."""
    n, mean = F.col("n"), F.col("s") / F.col("n")
    r = sites.filter("n > 0").agg(F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col("s2") - n * mean * mean).alias("inside"), F.sum(n * (mean - center) ** 2).alias("between")).first()
    if not r["n"] or r["n"] <= r["k"] or r["k"] < 2:
        return 10.0
    inside = max(r["inside"] / (r["n"] - r["k"]), 1e-9)
    between = max((r["between"] - (r["k"] - 1) * inside) / r["n"], inside / 1000)
    return min(1000.0, max(1.0, inside / between))


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, p_text, p_host, p_path, score, keep (score of half or more)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
    chosen = sampled(good, F.col("_id"), LABELLED, good.count()).orderBy(F.xxhash64("_id"), "_id", "good").limit(LABELLED)
    of, found = Features(), []
    if labels.take(1):
        labelled = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "good", "text")
        seen = labelled.mapInArrow(_indices, f"doc_id {labelled.schema['doc_id'].dataType.simpleString()}, good int, at binary")
        found = sorted((r[0], r[1], bytes(r[2])) for r in seen.groupBy("doc_id", "good").agg(F.min("at")).collect())
    model = fit([np.frombuffer(f[2], np.int64) for f in found], np.array([f[1] for f in found], float)) if found else None
    each = materialize(evidence(rows, model))
    paths = materialize(each.groupBy("host", "path").agg(F.count("p").alias("n"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("p") * F.col("p")), F.lit(0.0)).alias("s2")))
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "s2")))
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    prior = total[0] / total[1] if total[1] else 0.5
    k = pseudo_count(hosts, F.lit(prior))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("s") + k * prior) / (F.col("n") + k)).alias("p_host"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    k = pseudo_count(sites, F.col("p_host"))
    sites = materialize(sites.select("_host", F.col("path").alias("_path"), "p_host", ((F.col("s") + k * F.col("p_host")) / (F.col("n") + k)).alias("p_path")))
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    out = each.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    p_text = F.coalesce("p", F.lit(prior))
    odds = logit(p_text) + logit(F.col("p_path")) - logit(F.lit(prior))
    return out.select("doc_id", p_text.alias("p_text"), "p_host", "p_path", (1 / (1 + F.exp(-odds))).alias("score")).withColumn("keep", F.col("score") >= 0.5)


def _indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = Features()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([of(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], names=["doc_id", "good", "at"])


def query(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
