"""Language identification by compression: the language whose dictionary makes a text smallest.

Each learned language has a raw-content zstandard dictionary made of a bounded sample of its labelled texts: its most
frequent words, counted over whole texts, behind whole texts that fit. A text is compressed whole, in pieces short
enough that the dictionary stays in reach, once with each dictionary. One scan of the texts, no shuffle. A task has the
compressors of BLOCK languages at a time, and the driver gathers the samples of BLOCK languages at a time, so any number
of languages can be learned; the dictionaries, DICTIONARY bytes each, go to every task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import slices, stored, texts

#: Bounds of the training data: texts of a language whose words are counted, texts of those that may stand in its
#: dictionary, and bytes of a dictionary.
SAMPLE, STAND, DICTIONARY = 600, 100, 64_000
#: Languages whose compressors a task has, and whose samples the driver gathers, at a time.
BLOCK = 64
#: The most frequent words that may stand in a dictionary, bytes of a piece, and the level.
WORDS, PIECE, LEVEL = 3000, 16_000, 6
#: ASCII other than letters, space and line end tells no language and is left out.
_NO_LETTERS = bytes(c for c in range(128) if not (chr(c).isalpha() or c in b" \n"))
#: A best size less than this share below the second is a narrow margin.
MARGIN = 0.01


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(None, _NO_LETTERS)


def dictionary(counts: dict[str, int], running: list[str]) -> bytes:
    """Whole running texts first, frequent words last, where zstandard reaches them with the shortest offsets."""
    common = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:WORDS]]
    words = (" " + " ".join(reversed(common)) + " ").encode()[-DICTIONARY // 3 :]
    parts, room = [], DICTIONARY - len(words)
    for t in map(plain, running):
        if len(t) < room:
            parts.append(t)
            room -= len(t) + 1
    return b"\n".join([*parts, words])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for langs, text in slices(batches, rows=200):
        for lang, t in zip(langs, text, strict=True):
            counts.update((lang, w) for w in plain(t).decode().split())
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in counts], pa.string()), pa.array([x[1] for x in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "c"])


def learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held_fold: int) -> dict[str, bytes]:
    """Dictionaries by language, the most frequent language first, ties by name."""
    train = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where((~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}  # a row for each language
    out: dict[str, bytes] = {}
    for at in range(0, len(counts), BLOCK):
        langs = list(counts)[at : at + BLOCK]
        share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, SAMPLE / counts[lang])))])
        h = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000))
        sample = stored(train.where(F.col("lang").isin(langs)).where(h < 1_000_000 * share[F.col("lang")]).select("lang", "text", h.alias("h")), "sample")
        frequent = sample.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
        words: dict[str, dict[str, int]] = {lang: {} for lang in langs}
        for lang, w, c in zip(*frequent.where("c > 1").toArrow().to_pydict().values(), strict=True):
            words[lang][w] = c
        # a text longer than a dictionary can't stand in one
        fits = sample.where(F.octet_length("text") < DICTIONARY).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= STAND)
        running: dict[str, dict[str, None]] = {lang: {} for lang in langs}
        for lang, t, _ in sorted(zip(*fits.select("lang", "text", "k").toArrow().to_pydict().values(), strict=True), key=lambda x: x[2]):
            running[lang][t] = None
        out |= {lang: dictionary(words[lang], list(running[lang])) for lang in langs}
    return out


def _compressors(dictionaries: list[bytes]) -> list:
    import zstandard

    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=DICTIONARY, write_content_size=False, write_checksum=False, write_dict_id=False)
    makers = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        makers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
    return makers


def _predicted(dictionaries: dict[str, bytes], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, letters = list(dictionaries), _letters()
        blocks = [list(dictionaries.values())[i : i + BLOCK] for i in range(0, len(langs), BLOCK)]
        kept = _compressors(blocks[0]) if len(blocks) == 1 else None
        for ids, held, text in slices(batches, 3, 500):
            pieces = [[raw[i : i + PIECE] for i in range(0, len(raw), PIECE)] if langs and letters(t) else [] for t, raw in zip(text, map(plain, text), strict=True)]
            sizes = np.array([[sum(len(f(p)) for p in ps) for ps in pieces] for block in blocks for f in (kept or _compressors(block))], float).T
            lang_pred, score, close = [], [], []
            for k, ps in enumerate(pieces):
                if not ps:
                    lang_pred.append("und"), score.append(0.0), close.append(True)
                    continue
                order = np.argsort(sizes[k], kind="stable")  # ties: the more frequent language
                best = sizes[k][order[0]]
                lang_pred.append(langs[order[0]])
                score.append(float(1 / np.exp(-(sizes[k] - best) / (2 + 0.01 * best)).sum()))
                close.append(len(langs) > 1 and bool(sizes[k][order[1]] - best < margin * sizes[k][order[1]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(lang_pred, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def _letters():
    import regex

    find = regex.compile(r"\p{L}").search
    return lambda t: find(t) is not None


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1, margin: float = MARGIN) -> DataFrame:
    """Per input row: doc_id, held_out, lang_pred, score, rejected.

    Learns from texts with a language whose crc32(id) mod folds is not held_fold. und where the text is null or has
    no letter, or where nothing could be learned. rejected marks narrow margins; lang_pred still names the smallest.
    Equal sizes give the language with more training texts. A null id belongs to the training texts; repeated rows
    are each answered.
    """
    dictionaries = learned(docs, id_col, text_col, lang_col, folds, held_fold)
    source = texts(docs, id_col, text_col).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False)).alias("held_out"), "text")
    return source.mapInArrow(_predicted(dictionaries, margin), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
