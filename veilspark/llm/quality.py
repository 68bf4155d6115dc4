"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on a few counts of each whole text, fitted on a bounded sample of labelled rows, gives each
document's own probability of being good. Grouped aggregation of these over all documents gives each host's and, in
it, each path's rate of good documents; a host's rate shrinks toward the global rate, a path's toward its host's, by
prior strengths estimated from the spread of the rates. The posterior of a document is its own evidence, freed of
the global base rate, with its path's rate as prior.

In `documents` the host is `source` and the path within it is `lang`.

Defined results: a null host or path is a group of its own; a null or empty text has no evidence of its own and gets
its path's rate; rows repeat as they come; without labels of both classes every document has the share of good labels
(1 without any labels) as its own probability. Extra columns are kept by `keep_good` and ignored by `posteriors`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bounded_sample, join_sized, packed, settle, texts, unpacked

#: Bound of the labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 8_000
_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = b"0123456789"
_BLANK = b" \t\n\r\x0b\x0c"
_PLAIN = _LETTER + _DIGIT + _BLANK + b".,;:?'\"()-"


def features(text: str) -> list[float]:
    """Shares of kinds of bytes, of repeated words and lines, and word lengths, of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    letters = n - len(raw.translate(None, _LETTER))
    marked = sum(map(raw.count, (b"!!", b"***", b"$$$", b"%%%", b"&&&", b"###", b" | ")))
    kinds, w = len(set(words)), max(1, len(words))
    return [
        len(raw.translate(None, _PLAIN)) / n,
        (n - len(raw.translate(None, _UPPER))) / max(1, letters),
        (n - len(raw.translate(None, _DIGIT))) / n,
        marked / w,
        kinds / w**0.9,
        sum(map(len, words)) / w / 10,
        len(set(lines)) / len(lines),
        min(1.0, raw.count(b"|") / w),
        np.log1p(w) / 10,
        float(max(map(len, words), default=0) > 60),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Ridge logistic regression by Newton steps on standardised features."""
    d = x.shape[1] if x.size else 10
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 1.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(share / (1 - share))))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(d + 1), np.diag([ridge] * d + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    y = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    chosen = F.broadcast(bounded_sample(y.groupBy("doc_id").agg(F.min("y").alias("y")), "doc_id", sample_rows))
    # of several texts of one id the smallest, whatever the order of rows
    found = docs.select("doc_id", "text").where("text <> ''").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def run(batches):
        for b in texts(batches):
            rows = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float64())), b.column("y")], ["doc_id", "x", "y"])

    got = found.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, x array<double>, y int").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float) if got.num_rows else np.zeros((0, 0))
    return fit(x, np.array(got.column("y").to_pylist(), float))


def own_evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column __p: the text's own probability of being good, null for a null or empty text."""
    names = docs.columns

    def run(batches):
        for b in texts(batches):
            t = b.column("text").to_pylist()
            p = model(np.array([features(x or "") for x in t], float)) if t else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64(), mask=np.array([not x for x in t], bool))], [*names, "__p"])

    return docs.mapInArrow(run, _ddl(docs) + ", `__p` double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(rates: DataFrame, total: float) -> float:
    """Prior strength: within-group variance over the variance between groups that is left beyond it, by moments."""
    r = rates.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - total, 2)).alias("ss")).first()
    if not r["k"] or r["k"] < 2:
        return 20.0
    within = max(total * (1 - total), 1e-6)
    between = max((r["ss"] - within * r["k"]) / r["n"], 0.0)
    return float(min(max(within / between, 2.0), 1e4)) if between > 0 else 1e4


def site_rates(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """Per (host, path): both rates after shrinking; and the global rate."""
    p = F.col("__p")
    paths = settle(scored.groupBy(F.col(host).alias("__h"), F.col(path).alias("__q")).agg(F.count(p).alias("n"), F.coalesce(F.sum(p), F.lit(0.0)).alias("s")))
    hosts = settle(paths.groupBy("__h").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = float(whole["s"] / whole["n"]) if whole["n"] else 1.0
    kh, kp = _strength(hosts, rate), _strength(paths, rate)
    hosts = hosts.select("__h", ((F.col("s") + kh * rate) / (F.col("n") + kh)).alias("__host_rate"))
    joined = paths.alias("a").join(hosts.alias("b"), F.col("a.__h").eqNullSafe(F.col("b.__h")))
    site = joined.select("a.__h", "a.__q", "__host_rate", ((F.col("s") + kp * F.col("__host_rate")) / (F.col("n") + kp)).alias("__path_rate"))
    return settle(site), rate


def posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", model: Model | None = None) -> DataFrame:
    """docs (all its columns) with __p, __host_rate, __path_rate and __posterior."""
    model = model or train(docs, labels)
    rated = own_evidence(docs.select("doc_id", "text", *dict.fromkeys([host, path])), model).select(host, path, "__p")
    site, rate = site_rates(rated, host, path)
    scored = own_evidence(docs, model).alias("d")
    on = F.col(f"d.{host}").eqNullSafe(F.col("s.__h")) & F.col(f"d.{path}").eqNullSafe(F.col("s.__q"))
    out = join_sized(scored, site.alias("s"), on).drop("__h", "__q")
    prior = _logit(F.col("__path_rate"))
    own = F.when(F.col("__p").isNotNull(), _logit(F.col("__p")) - _logit(F.lit(rate))).otherwise(F.lit(0.0))
    return out.withColumn("__posterior", 1 / (1 + F.exp(-(own + prior))))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, own_score, host_rate, path_rate, posterior and keep of every row."""
    p = posteriors(docs.select("doc_id", "text", "source", "lang"), labels)
    return p.select("doc_id", F.col("__p").alias("own_score"), F.col("__host_rate").alias("host_rate"), F.col("__path_rate").alias("path_rate"), F.col("__posterior").alias("posterior"), (F.col("__posterior") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, columns as they are, whose posterior reaches the threshold."""
    return unpacked(posteriors(packed(docs, "doc_id", "text", "source", "lang"), labels).where(F.col("__posterior") >= threshold))
