"""Quality rules with risk-controlled cutoffs.

Base rules are fixed. Four further rules reject texts whose measure exceeds a cutoff. The cutoffs of a stratum (the
language) are REFERENCE values times one factor, and the factors of GRID are tried from the loosest down: a factor
passes if the exact (Clopper-Pearson) upper bound of the share of labelled good texts that any of the four rejects
is at most RISK, and the first that fails ends the search. Such fixed-sequence testing needs no division of the level
by the number of factors; dividing DELTA by the number of strata (Bonferroni) makes the bounds hold for all of them at
once. So with probability 1 - DELTA no stratum loses more than RISK of its good texts to these rules. A stratum with too
few labels for any bound (88 good texts with four strata) keeps the rules off, as the guarantee asks.

One scan measures the texts; counts for the bounds are a grouped aggregation, the search runs over its rows in tasks,
and the factors come back to the texts by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import slices, stored

RISK, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Usual cutoffs of each measure in published filters for web text. The calibrated factor scales them.
REFERENCE = {"symbols": 0.1, "dup_lines": 0.3, "repeats": 0.2, "upper": 0.3}
#: Factors from the loosest, at which next to nothing is rejected, to the strictest.
GRID = [round(1.15**i, 4) for i in range(16, -21, -1)]
#: So many strata at most are broadcast; with more, texts and factors are shuffled by stratum.
BROADCAST_STRATA = 100_000
_UPPER = bytes(range(65, 91))
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def measures(text: str) -> tuple[int, ...]:
    """The COLUMNS of a text."""
    raw = text.encode("utf-8", "replace")
    tokens = raw.split()
    n = len(tokens)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    repeat = 0
    if n >= 3:
        a = np.array([seen.setdefault(w, len(seen)) for w in tokens], np.int64)
        pair = a[:-1] * len(seen) + a[1:]
        if len(seen) > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        _, inverse, count = np.unique(pair[:-1] * len(seen) + a[2:], return_inverse=True, return_counts=True)
        again, marked = count[inverse] > 1, np.zeros(n, bool)
        for k in range(3):
            marked[k : n - 2 + k] |= again
        repeat = int(marked.sum())
    return n, len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines), len(raw) - len(raw.translate(None, _UPPER))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, stratum, text in slices(batches, 3, 500):
        rows = list(zip(*map(measures, text), strict=True)) or [()] * len(COLUMNS)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(stratum, pa.string()), *(pa.array(x, pa.int64()) for x in rows)], ["doc_id", "stratum", *COLUMNS])


def rules() -> dict[str, Column]:
    """Measures of 0 to 1 in which more is worse."""
    share = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "upper": share("n_upper", "word_chars")}


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact binomial upper bound of a rate of which k of n were seen: P(X <= k) = level there."""
    if n <= 0 or k >= n:
        return 1.0
    parts = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def below(p: float) -> float:
        logs = np.array(parts) + np.arange(k + 1) * math.log(p) + (n - np.arange(k + 1)) * math.log1p(-p)
        top = logs.max()
        return math.exp(top + math.log(np.exp(logs - top).sum()))

    lo, hi = k / n if k else 1e-12, 1 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) > level else (lo, mid)
    return hi


def severity() -> Column:
    """The greatest measure relative to its reference: a text is rejected at a factor that it exceeds."""
    return F.greatest(*(value / REFERENCE[name] for name, value in rules().items()))


def factor(n: int, above: list[int], level: float, risk: float = RISK) -> float | None:
    """The strictest admissible factor; above has the good texts of n that each of GRID rejects."""
    good = None
    for f, k in zip(GRID, above, strict=True):
        # the bound is at least k / n, so a look at that spares most of the exact ones
        if k > n * risk or upper_bound(k, n, level) > risk:
            break
        good = f
    return good


def _searched(risk: float, level: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stratum, n, above = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(stratum, pa.string()), pa.array([factor(m, x, level, risk) for m, x in zip(n, above, strict=True)], pa.float64())], ["stratum", "factor"])

    return run


def factors(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, factor) from good texts (stratum, severity); null where no factor is admissible."""
    above = F.array(*(F.sum((F.col("severity") > f).cast("long")) for f in GRID))
    counts = stored(holdout.groupBy("stratum").agg(F.count("*").alias("n"), above.alias("above")), "counts")
    return stored(counts.mapInArrow(_searched(risk, delta / max(1, counts.count())), "stratum string, factor double"), "factors")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed, factor.

    failed names the calibrated rules that the text fails, factor is that of its stratum (null: the rules are off). A
    null text is empty and fails the base; a null stratum is the stratum ''. A measure that equals its cutoff passes.
    A label row without id or quality doesn't count, and of several for one id the lowest does. Repeated rows are each
    answered; for the bounds an id counts once in each of its strata, with its worst text.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    measured = stored(source.mapInArrow(_measured, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COLUMNS)), "measures")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("q")).where("doc_id is not null and q is not null").groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1").select("doc_id")
    holdout = measured.select("doc_id", "stratum", severity().alias("severity")).join(good, "doc_id").groupBy("doc_id", "stratum").agg(F.max("severity").alias("severity"))
    cuts = factors(holdout, risk, delta).where("factor is not null")
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts

    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fails = F.array_compact(F.array(*(F.when(value / REFERENCE[name] > F.col("factor"), F.lit(name)) for name, value in rules().items())))
    return measured.join(cuts, "stratum", "left").select("doc_id", *COLUMNS[:5], base.alias("base_failed"), (~base & (F.size(fails) == 0)).alias("kept"), F.array_join(fails, ",").alias("failed"), "factor")
