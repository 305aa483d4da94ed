"""Mixing to target weights by iterative proportional fitting (raking).

Texts are counted into cells of (source, language, topic) by one grouped aggregation; all fitting runs on the cells.
A round scales the cells' token weights to the source, the language and the topic marginals in turn, each by a sum
over the cells of a value: a window while the cells are few enough for one task, else a grouped sum, with a partial sum
in each task, that is joined to the cells. Rounds go on until all margins are met or no round
changes a weight any more: where cells that don't exist make the targets impossible, the result says by how much it is
off. Sampling probabilities follow from the fitted weights: a cell's share of the wanted
tokens over its tokens, at most one, with the rest of a full cell's share given to the others. A text stays if a hash
of its id falls under its cell's probability, so a rerun or a lost executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import stored

MARGINS = ("source", "lang", "topic")
#: Default targets: the token share of a margin's value to this power. Below one, rare values gain.
POWER = {"source": 0.7, "lang": 0.7, "topic": 0.9}
SHARE = 0.5
#: Rounds between two looks at the margins; margins are met if off by less than TOLERANCE; the fit stands still if none
#: of CHUNK rounds changes a margin by more than STILL.
TOLERANCE, STILL, CHUNK = 1e-4, 1e-7, 4
#: So many cells at most are summed by window, all cells of one value in a task; more by grouped sums and joins.
WINDOW_CELLS = 1_000_000


def n_words(text: Column) -> Column:
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    return (F.size(parts) - F.when(parts[0] == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def form(text: Column, words: Column) -> Column:
    """The default topic: what kind of text it is."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    return F.when(words < 50, "short").when(2 * bars > words, "table").when(marks > words, "marks").when(F.upper(text) == text, "capitals").when(words >= 1000, "long").otherwise("prose")


def targets(cells: DataFrame, margin: str, wanted: dict | None) -> DataFrame:
    """(value, share) of one margin, summing to one. Values that wanted lacks get nothing."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t"))
    if wanted is not None:
        pairs = [x for k, v in wanted.items() if k is not None for x in (F.lit(str(k)), F.lit(float(v)))]
        given = F.create_map(*pairs)[F.col(margin)] if pairs else F.lit(None).cast("double")
        raw = F.when(F.col("t") > 0, F.coalesce(F.when(F.col(margin).isNull(), F.lit(float(wanted.get(None, 0.0)))), given, F.lit(0.0))).otherwise(0.0)
    else:
        raw = F.pow("t", F.lit(POWER.get(margin, 1.0)))
    sums = stored(sums.select(F.col(margin).alias("value"), raw.alias("raw")), "target")
    total = sums.agg(F.sum("raw")).first()[0] or 1.0
    return sums.select("value", (F.col("raw") / total).alias("share"))


def _scaled(cells: DataFrame, margin: str, few: bool) -> DataFrame:
    """cells with w scaled such that the margin is met."""
    new = F.when(F.col("_own") > 0, F.col("w") * F.col(f"to_{margin}") / F.col("_own")).otherwise(0.0)
    if few:
        return cells.withColumn("_own", F.sum("w").over(Window.partitionBy(margin))).withColumn("w", new).drop("_own")
    own = cells.groupBy(F.col(margin).alias("_v")).agg(F.sum("w").alias("_own"))
    # written at once: both sides read the cells, so unwritten steps would double the plan each time
    return stored(cells.join(own, cells[margin].eqNullSafe(F.col("_v"))).withColumn("w", new).drop("_v", "_own"), "cells")


def raked(cells: DataFrame, wanted: dict[str, dict] | None = None, margins: tuple[str, ...] = MARGINS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells(margins..., tokens) with the fitted weight w, which sums to one, and error, by which margins are off."""
    few = cells.count() <= WINDOW_CELLS
    for m in margins:
        t = targets(cells, m, (wanted or {}).get(m))
        cells = stored(cells.join(t.select(F.col("value").alias("_v"), F.col("share").alias(f"to_{m}")), cells[m].eqNullSafe(F.col("_v")), "left").drop("_v"), "cells")
    cells = cells.withColumn("w", F.col("tokens").cast("double"))
    off = [float("inf")] * len(margins)
    while True:
        for _ in range(CHUNK):
            for m in margins:
                cells = _scaled(cells, m, few)
        cells = stored(cells, "cells")
        before, off = off, [cells.groupBy(m).agg(F.sum("w").alias("s"), F.max(f"to_{m}").alias("to")).agg(F.max(F.abs(F.col("s") - F.col("to")))).first()[0] or 0.0 for m in margins]
        if max(off) < tolerance or max(abs(a - b) for a, b in zip(before, off, strict=True)) <= STILL:
            break
    total = cells.agg(F.sum("w")).first()[0] or 1.0
    return cells.withColumn("w", F.col("w") / total).withColumn("error", F.lit(float(max(off))))


def calibrated(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """cells with p: expected tokens are share of all, split by w as far as the cells have them."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    want, scale = share * total, share * total
    for _ in range(50):
        full = scale * F.col("w") >= F.col("tokens")
        taken, rest = cells.agg(F.sum(F.when(full & (F.col("w") > 0), F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if not rest or rest <= 0:
            break
        new = max(scale, (want - float(taken or 0)) / rest)
        if new <= scale * (1 + 1e-9):
            break
        scale = new
    p = F.when(F.col("w") <= 0, 0.0).when(F.col("tokens") <= 0, 1.0).otherwise(F.least(F.lit(1.0), scale * F.col("w") / F.col("tokens")))
    return cells.withColumn("p", p)


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"), *([] if topic is None else [topic.cast("string").alias("topic")]))
    # counted once: the generated row keeps the optimizer from writing the expression out at both of its uses
    counted = base.withColumn("n_tokens", F.explode(F.array(n_words(F.col("text")))))
    return stored((counted.withColumn("topic", form(F.col("text"), F.col("n_tokens"))) if topic is None else counted).drop("text"), "counted")


def mixture(docs: DataFrame, wanted: dict[str, dict] | None = None, share: float = SHARE, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """Per input row: doc_id, source, lang, topic, n_tokens, weight, p, kept, error.

    wanted gives target shares by margin and value ({"lang": {"en": 0.5, "de": 0.5}}); a margin that it lacks takes
    the default power of the token shares. error, the same in all rows, is the most by which a fitted margin is off; it is
    above TOLERANCE only where the cells there are can't meet the targets. weight is the fitted share of the row's cell over its share as it is. A
    null source, language or topic is a value like another (key None in wanted). A text without words has no weight to
    spend and stays if its cell is kept in full. Rows with the same id share one fate; an empty table gives no rows.
    """
    rows = measured(docs, id_col, text_col, source_col, lang_col, topic)
    cells = stored(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "cells")
    fitted = stored(calibrated(raked(cells, wanted), share), "fitted")
    total = float(fitted.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    fitted = fitted.select(*(F.col(m).alias(f"_{m}") for m in MARGINS), F.when(F.col("tokens") > 0, F.col("w") * total / F.col("tokens")).otherwise(0.0).alias("weight"), "p", "error")
    same = rows["source"].eqNullSafe(F.col("_source")) & rows["lang"].eqNullSafe(F.col("_lang")) & rows["topic"].eqNullSafe(F.col("_topic"))
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11)).cast("double") / F.lit(float(1 << 53))
    return rows.join(fitted, same, "left").select("doc_id", *MARGINS, "n_tokens", "weight", "p", (draw < F.col("p")).alias("kept"), "error")
