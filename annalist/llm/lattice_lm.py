"""Subword lattice likelihood: every segmentation of a word into vocabulary pieces counts.

The pieces and their first weights come from an existing vocabulary file; no piece is ever added, dropped or merged.
A vocabulary with probabilities gives log weights as they are; one whose scores are merge ranks (0, -1, -2, ...)
gives the Zipf weights 1 / (rank + 10). The training text then sharpens these weights by expectation maximisation:
expected piece counts over all lattices of the training words, each word as often as it occurs, with the vocabulary's
weights as a Dirichlet prior. WARM rounds run on the most frequent words, to begin near, and ROUNDS on all.

A text is words and one end. A word is a chain of pieces of which the first, and only the first, carries the word
mark, so piece weights that sum to one give a distribution over words, and the probability of a text is the product of
its words' marginals and the end's: the log-space forward recursion runs once for each distinct word of the corpus and
not once for each occurrence. That is score; vocab_score is the same with the vocabulary's own weights.

For comparison there is word_score: with one more edge in the lattice of a word that the training text has, from its
begin to its end. Absolute discounting weights it: (c - D) / N for the edge, D * V / N for all segmentations into
pieces together, which keeps the sum over all words at one. D is n1 / (n1 + 2 n2), n1 and n2 being the numbers of words
that occur once and twice.

Where the work runs: word counts are a shuffled aggregation with a partial count in each task; the lattice runs over
partitions of the distinct words, vectorised over words of equal length; a bounded table of the most frequent words is
resolved inside the scan of the texts, and only the other words are joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import lower_words, row_ids, slices, stored, texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words, of at most so many bytes each, that go to every task.
FREQUENT, FREQUENT_BYTES = 65_536, 64
#: Rounds of expectation maximisation on the FREQUENT words, and on all.
WARM, ROUNDS = 4, 2
PRIOR = 1000.0
MARK = b" "
_M = np.uint64(0x9E3779B97F4A7C15)
_LOG10 = float(np.log(10.0))


def vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Pieces as bytes, the word mark as one space, and log weights that sum to one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = {i: model.get_score(i) for i in ids}
    ranks = all(float(s).is_integer() for s in scores.values()) and min(scores.values()) < -1000
    out: dict[bytes, float] = {}
    for i in ids:
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        if raw[1:].split() != [raw[1:]] and raw[1:] or raw[:1] in b"\t\n\v\f\r" or (model.is_byte(i) and raw == MARK) or raw.lower() != raw:
            continue  # never part of a lower-cased word behind its mark
        weight = -np.log((i if model.is_byte(i) else -scores[i]) + 10.0) if ranks else scores[i]
        out[raw] = float(np.logaddexp(out[raw], weight)) if raw in out else float(weight)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: float(v - total) for k, v in out.items()}


class Lattice:
    """Pieces by length as sorted 64-bit hashes; works on words of equal length at once."""

    def __init__(self, pieces: list[bytes]):
        self.by = {}
        for size in sorted({len(p) for p in pieces}):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == size])
            rows = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, size)
            h = np.zeros(len(ids), np.uint64)
            for j in range(size):
                h = h * _M + rows[:, j].astype(np.uint64) + np.uint64(1)
            order = np.argsort(h)
            self.by[size] = (h[order], ids[order])

    def edges(self, rows: np.ndarray) -> dict[int, np.ndarray]:
        """For each length, the piece that begins at each position of each row, -1 for none."""
        length, h, out = rows.shape[1], np.zeros(rows.shape, np.uint64), {}
        for size in range(1, min(length, max(self.by)) + 1):
            h = h[:, : length - size + 1] * _M + rows[:, size - 1 :].astype(np.uint64) + np.uint64(1)
            if size in self.by:
                keys, ids = self.by[size]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                found = np.where(keys[at] == h, ids[at], -1)
                if (found >= 0).any():
                    out[size] = found
        return out

    @staticmethod
    def forward(edges: dict[int, np.ndarray], weights: np.ndarray, n: int, length: int) -> np.ndarray:
        """Log marginals of all prefixes; weights has -inf at its end, which -1 picks."""
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(1, length + 1):
                ways = [alpha[j - s] + weights[e[:, j - s]] for s, e in edges.items() if s <= j]
                alpha[j] = _logsumexp(np.stack(ways)) if ways else -np.inf
        return alpha

    @staticmethod
    def backward(edges: dict[int, np.ndarray], weights: np.ndarray, n: int, length: int) -> np.ndarray:
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0
        with np.errstate(invalid="ignore", divide="ignore"):
            for i in range(length - 1, -1, -1):
                ways = [beta[i + s] + weights[e[:, i]] for s, e in edges.items() if i + s <= length]
                beta[i] = _logsumexp(np.stack(ways)) if ways else -np.inf
        return beta


def _logsumexp(x: np.ndarray) -> np.ndarray:
    top = x.max(0)
    return np.where(np.isfinite(top), np.log(np.exp(x - np.where(np.isfinite(top), top, 0)).sum(0)) + top, -np.inf)


def _by_length(words: list[bytes], most: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and byte rows, mark first, of words of equal length, so many cells at a time."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, most * 16 // int(size + 1))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield part, np.frombuffer(b"".join(MARK + words[i] for i in part), np.uint8).reshape(len(part), size + 1)


def _counted():
    """(word, c): occurrences in training texts, words of other texts with 0; a bounded number at once."""

    def flush(counts: Counter, other: set) -> pa.RecordBatch:
        rest = [w for w in other if w not in counts]
        return pa.RecordBatch.from_arrays([pa.array([*counts, *rest], pa.binary()), pa.array([*counts.values(), *[0] * len(rest)], pa.int64())], ["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        other: set = set()
        for held, text in slices(batches, rows=500):
            for h, t in zip(held, text, strict=True):
                (other if h else counts).update(lower_words(t))
            if len(counts) + len(other) > 300_000:
                yield flush(counts, other)
                counts, other = Counter(), set()
        yield flush(counts, other)

    return run


def _expected(pieces: list[bytes], log_weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, weights, total = Lattice(pieces), np.append(log_weights, -np.inf), np.zeros(len(pieces))
        for words, counts in slices(batches, rows=50_000):
            often = np.array(counts, float)
            for which, rows in _by_length(words):
                n, length = rows.shape
                edges = lattice.edges(rows)
                a, b = Lattice.forward(edges, weights, n, length), Lattice.backward(edges, weights, n, length)
                with np.errstate(invalid="ignore"):
                    for size, e in edges.items():
                        use = np.exp(a[: length - size + 1].T + weights[e] + b[size:].T - a[length][:, None]) * often[which][:, None]
                        ok = (e >= 0) & np.isfinite(use)
                        total += np.bincount(e[ok], use[ok], minlength=len(pieces))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "c"])

    return run


def _marginals(pieces: list[bytes], log_weights: list[np.ndarray], n: int, v: int, discount: float, goes_on: float):
    """(word, c, lp, lp0, lpw): log10 of a word's probability by the trained weights, by the vocabulary's alone, and
    with an edge for the word itself. goes_on is the log10 probability that a text doesn't end here."""
    spread = discount * v / n if n else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, weights = Lattice(pieces), [np.append(w, -np.inf) for w in log_weights]
        for words, counts in slices(batches, rows=50_000):
            out = np.zeros((len(weights) + 1, len(words)))
            for at, rows in _by_length(words):
                edges = lattice.edges(rows)
                for k, w in enumerate(weights):
                    out[k, at] = Lattice.forward(edges, w, *rows.shape)[rows.shape[1]] / _LOG10
            edge = np.maximum(np.array(counts, float) - discount, 0) / max(n, 1)
            with np.errstate(divide="ignore"):
                out[-1] = np.logaddexp(out[0] * _LOG10 + np.log(spread), np.log(edge)) / _LOG10
            out[:-1] += goes_on
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64()), *map(pa.array, out)], ["word", "c", "lp", "lp0", "lpw"])

    return run


def _scored(frequent: dict[bytes, tuple], end: tuple):
    """For each text a row with the sums over its frequent words and its end, and a row for each other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, get = row_ids(), frequent.get
        for ids, held, text in slices(batches, 3, 500):
            rows: list[tuple] = []
            for i, h, t in zip(ids, held, text, strict=True):
                u, known, base, lp, lp0, lpw = next(uid), *end
                tokens = lower_words(t)
                for w, tf in Counter(tokens).items():
                    if (x := get(w)) is None:
                        rows.append((u, w, tf, *[None] * 8))
                    else:
                        known += tf * x[0]
                        base += tf * x[1]
                        lp += tf * x[2]
                        lp0 += tf * x[3]
                        lpw += tf * x[4]
                rows.append((u, MARK + u.to_bytes(8, "big"), 1, i, h, len(tokens) + 1, known, base, lp, lp0, lpw))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "word", "tf", "doc_id", "held_out", "n_tokens", "known", "base", "lp_", "lp0_", "lpw_"])

    return run


def lattice_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, folds: int = 7, held_fold: int = 2, warm: int = WARM, rounds: int = ROUNDS) -> DataFrame:
    """Per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocab_score, word_score.

    score is the log10 marginal probability of the text over all segmentations, with trained weights, vocab_score that
    with the vocabulary's own, word_score that with words as edges too, base_score that of an add-one word model. Texts
    whose crc32(id) mod folds is held_fold teach nothing. A null text is empty and has one token, its end. A null id
    belongs to the training texts. Repeated rows are scored, and learnt from, once for each row. With no training text
    the weights stay the vocabulary's and a text ends with probability 0.5.
    """
    source = texts(docs, id_col, text_col).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False)).alias("held_out"), "text")
    counts = stored(source.select("held_out", "text").mapInArrow(_counted(), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    tokens, kinds, once, twice, texts_in = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).crossJoin(source.agg(F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0)))).first()  # one row each
    n, v = tokens + texts_in, kinds + (texts_in > 0)
    floor = float(np.log10(n + v + 1))
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5

    first = vocabulary(path)
    pieces = list(first)
    prior = np.exp(np.array([first[p] for p in pieces]))
    weights = start = np.log(prior)
    seen = counts.where("c > 0").select("word", "c")
    most = stored(seen.where(F.length("word") <= FREQUENT_BYTES).orderBy(F.desc("c"), "word").limit(FREQUENT).repartition(8), "frequent")
    for words in [most] * warm + [seen] * rounds if tokens else []:
        got = words.mapInArrow(_expected(pieces, weights), "piece long, c double").groupBy("piece").agg(F.sum("c").alias("c")).toArrow()  # a row for each piece at most
        use = PRIOR * prior
        use[got["piece"].to_numpy()] += got["c"].to_numpy()
        weights = np.log(use / use.sum())

    ends = texts_in / n if texts_in else 0.5
    goes_on = float(np.log10(max(1 - ends, 1e-9)))
    scored = stored(counts.mapInArrow(_marginals(pieces, [weights, start], n, v, discount, goes_on), "word binary, c long, lp double, lp0 double, lpw double"), "marginals")
    top = scored.where(F.length("word") <= FREQUENT_BYTES).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow().to_pydict()
    frequent = {w: (int(c > 0), float(np.log10(c + 1) - floor), *p) for w, c, *p in zip(*top.values(), strict=True)}
    end = float(np.log10(ends))
    ended = (int(texts_in > 0), float(np.log10(texts_in + 1) - floor), end, end, float(np.log10((texts_in - discount) / n)) if texts_in else end)

    rows = source.mapInArrow(_scored(frequent, ended), "uid long, word binary, tf long, doc_id long, held_out boolean, n_tokens long, known long, base double, lp_ double, lp0_ double, lpw_ double")
    summed = lambda whole, each: F.sum(F.coalesce(whole, F.col("tf") * F.col(each)))
    joined = rows.join(scored, "word", "left").groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("c") > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("tf") * (F.log10(F.col("c") + 1) - floor))).alias("base_score"),
        summed("lp_", "lp").alias("score"), summed("lp0_", "lp0").alias("vocab_score"), summed("lpw_", "lpw").alias("word_score"),
    )
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "vocab_score", "word_score")
