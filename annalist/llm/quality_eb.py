"""Quality classifier with hierarchical empirical Bayes.

A logistic regression over measures of a text gives the document's evidence. Sites (hosts) and paths within them have
beta posteriors of the mean evidence: a host shrinks to the global mean, a path to its host, each by a strength that
the spread of the group means themselves gives (method of moments). A document's verdict adds its own log-odds to the
log-odds by which its path stands out from the whole.

One scan measures texts. Posteriors are grouped aggregations: per path first, with a partial sum in each task, hosts
from paths, the whole from hosts; so a site with a third of all rows is summed where its rows are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import added, slices, stored
from annalist.llm.risk_rules import measures

#: The regression is fitted on about so many labelled rows at most.
TRAIN_ROWS = 20_000
KEEP = 0.5
FEATURES = ["log_words", "mean_chars", "symbols", "dup_lines", "repeats", "upper", "bangs", "distinct", "top_word", "digits", "ends", "lines"]
_DIGITS = b"0123456789"


def features(text: str) -> list[float]:
    n, chars, symbols, dup, repeat, lines, upper = measures(text)
    raw = text.encode("utf-8", "replace")
    tokens = raw.split()
    counts = Counter(tokens)
    top = max(counts.values(), default=0)
    w, c = max(n, 1), max(chars, 1)
    return [
        math.log1p(n), min(chars / w, 40.0) / 10, symbols / c, dup / max(lines, 1), repeat / w, upper / c, raw.count(b"!") / w,
        len(counts) / math.sqrt(w) / 10, top / w, (len(raw) - len(raw.translate(None, _DIGITS))) / c, sum(map(raw.count, (b".", b"?"))) / w, math.log1p(lines),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, host, path, text in slices(batches, 4, 500):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array([features(t) for t in text], pa.list_(pa.float64()))], ["doc_id", "host", "path", "x"])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a ridge logistic regression by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(n: int, mean: float, groups: int, spread: float) -> float:
    """Prior observations of a beta prior, by moments: spread is the weighted sum of squares of group means."""
    if groups < 2 or n <= 0:
        return 1e6
    within = max(mean * (1 - mean), 1e-9)
    between = max(spread / n - within * (groups - 1) / n, 1e-9)
    return float(min(max(within / between - 1, 1.0), 1e6))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """From (host, path, p) the posteriors (host, path, host_p, path_p, global_p); a null host or path is its own."""
    paths = stored(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    n, s, groups = hosts.agg(F.coalesce(F.sum("hn"), F.lit(0)), F.coalesce(F.sum("hs"), F.lit(0.0)), F.count("*")).first()
    m = s / n if n else 0.5
    spread = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - m, 2))).first()[0] or 0.0
    a = strength(n, m, groups, spread)
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(paths["host"], "path", "n", "s", "hn", ((a * m + F.col("hs")) / (a + F.col("hn"))).alias("host_p"))
    inner, count = both.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_p"), 2)), F.count("*")).first()
    b = strength(n, m, count - groups + 1, inner or 0.0)
    return both.select("host", "path", "host_p", ((b * F.col("host_p") + F.col("s")) / (b + F.col("n"))).alias("path_p"), F.lit(float(m)).alias("global_p"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", train_rows: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """Per input row: doc_id, doc_p, host_p, path_p, p, kept.

    The host and the path are columns: in ``documents`` the source and the language within it. doc_p is the
    regression's probability of quality 1, p the combined one, kept says p >= keep. A null text is empty; a null host
    or path is a group like another. Label rows without id or label don't count, and of several for one id the lowest
    does. Without labels of both kinds doc_p is 0.5 for all. Repeated rows are each answered and each count.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    measured = stored(source.mapInArrow(_measured, "doc_id long, host string, path string, x array<double>"), "features")
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").cast("int").alias("y"))
    share = min(1.0, train_rows / max(1, labelled.count()))
    train = measured.join(labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)), "doc_id").select("x", "y").toArrow().to_pydict()
    y = np.array(train["y"], float)
    if len(set(train["y"])) > 1:
        mean, scale, w = fit(np.array(train["x"]), y)
        odds = added([F.lit(float(w[-1] - (w[:-1] * mean / scale).sum())), *(F.col("x")[i] * float(w[i] / scale[i]) for i in range(len(FEATURES)))])
    else:
        odds = F.lit(0.0)
    scored = measured.select("doc_id", "host", "path", (1 / (1 + F.exp(-odds))).alias("doc_p"))
    sites = site_posteriors(scored.select("host", "path", F.col("doc_p").alias("p")))
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_p", "path_p", "global_p")
    joined = scored.join(sites, scored["host"].eqNullSafe(sites["h"]) & scored["path"].eqNullSafe(sites["q"]), "left")
    p = 1 / (1 + F.exp(-(_logit(F.col("doc_p")) + _logit(F.col("path_p")) - _logit(F.col("global_p")))))
    return joined.select("doc_id", "doc_p", "host_p", "path_p", p.alias("p"), (p >= keep).alias("kept"))
