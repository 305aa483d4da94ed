"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

A CGK walk reads a string by steps: each step emits the current character and moves on by one with a random bit of
(step, character). Strings at a small edit distance give walks at a small Hamming distance, since walks that part
meet again. A table samples some steps of one walk; windows that agree on all of them are candidates. Item windows
begin at every word of an item and text windows at every word of a text, and in both at every code point where words
are not set apart by spaces, so one unedited stretch of a passage is enough, wherever the edits are. A candidate fixes the item-sized window of the text, and the window, with some slack,
is verified by its exact edit distance.

Items under LONG bytes have too few windows for that at 15 % edits. They are cut into short pieces; with k edits allowed,
all but k pieces of an edited item are whole, so a text has so many of them in order, moved by the edits at most. Tables
of all their places find every such group, and the same exact edit distance verifies it: no item is missed.

The texts are read once, without a shuffle. The items are a stated query set, shipped to the tasks in blocks of at
most ITEMS, of which the driver holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import slices, texts

#: Items to a block.
ITEMS = 5000
#: Items under LONG bytes are found by pieces of 5 bytes, or of fewer where not two of 5 are sure to be whole. Those
#: under WHOLE bytes allow no edit, or one that would make another word of them, and must occur as they are.
LONG, WHOLE = 200, 10
#: Bytes of text searched for pieces at a time.
PART = 1 << 18
#: Walks, the steps of each, and the sampled steps of each. With these a window of 32 unedited characters is found by
#: every table. The README has the measured recall by length and edits.
TABLES, STEPS, SAMPLED = 4, 56, 16
EDITS = 0.15
#: With no space in so many bytes before it, any code point of a text begins a window. From U+0800 on (lead bytes from
#: FAR) all do: Chinese, Japanese, Thai and others set no spaces.
NEAR, FAR = 24, 0xE0
_M = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> bytes:
    """A-Z in lower case, white space runs as one space."""
    return b" ".join(text.encode("utf-8", "replace").lower().split())


def walks(seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bits by step and byte, sampled steps) of each table. The first samples stand early, so most windows end there."""
    out = []
    for t in range(TABLES):
        rng = np.random.default_rng(seed + t)
        early = rng.choice(np.arange(1, 13), 5, replace=False)
        late = rng.choice(np.arange(13, STEPS), SAMPLED - 5, replace=False)
        out.append((rng.integers(0, 2, (STEPS, 256)).astype(np.int32), np.sort(np.concatenate([early, late]))))
    return out


def begins(buffer: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Places in order where windows begin: words, code points from U+0800, and others with no word begun near before."""
    if not len(buffer):
        return np.zeros(0, np.int64)
    first = np.concatenate([[True], (buffer[:-1] == 32) | (buffer[:-1] == 10)])
    mark = first | (buffer >= FAR)
    word = np.flatnonzero(first)
    size = np.diff(np.append(word, len(buffer)))
    for at, n in zip(word[size > near].tolist(), size[size > near].tolist(), strict=True):
        mark[at + near : at + n] |= (buffer[at + near : at + n] & 0xC0) != 0x80
    return np.flatnonzero(mark)


def item_begins(n: bytes) -> np.ndarray:
    """The same for an item, a superset of the places it has in any text: what stands before it isn't known."""
    buffer = np.frombuffer(n, np.uint8)
    mark = np.zeros(len(n), bool)
    mark[begins(buffer)] = True
    at = 0
    for word in n.split(b" "):
        if at == 0 or len(word) > NEAR:
            part = buffer[at : at + len(word)]
            mark[at : at + len(word)] |= (part & 0xC0) != 0x80
        at += len(word) + 1
    return np.flatnonzero(mark)


def pieces(text: str, size: int) -> list[tuple[int, bytes]]:
    """(place, first size bytes) of consecutive pieces, each of the fewest code points with size bytes."""
    out, at, part = [], 0, b""
    for c in text:
        part += c.encode()
        if len(part) >= size:
            out.append((at, part[:size]))
            at, part = at + len(part), b""
    return out


class Pieces:
    """Places of the pieces of short items, by their bytes; of items that need so many of them."""

    def __init__(self, size: int, items: list[tuple[int, str, int]]):
        self.size = size
        rows = [(int.from_bytes(p, "little"), k, at) for k, t, _ in items for at, p in pieces(t, size)]
        key, self.owner, self.offset = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))
        self.keys, self.first, self.count = np.unique(key, return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.keys.astype(np.uint64) * _M >> np.uint64(44)] = True
        last = max(k for k, _, _ in items) + 1
        self.need, self.band, self.wide = (np.zeros(last, np.int64) for _ in range(3))
        for k, t, most in items:
            self.need[k], self.band[k] = len(pieces(t, size)) - most, most
            self.wide[k] = max(len(c.encode()) for c in t)

    def groups(self, docs: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position in docs, item, place) of groups of as many pieces as an edited item keeps."""
        ends = np.cumsum([len(d) + 1 for d in docs])
        raw = b"\n".join(docs) + b"\n"
        buffer = np.frombuffer(raw, np.uint8)
        n = len(buffer) - self.size + 1
        if n <= 0:
            return
        # the size bytes from each place on as one number, eight places apart at a time
        whole = raw + b"\n" * 16
        h = np.empty((n + 7) // 8 * 8, np.uint64)
        for j in range(8):
            h[j::8] = np.frombuffer(whole, "<u8", len(h) // 8, j)
        h = h[:n]
        h &= np.uint64((1 << 8 * self.size) - 1)
        slot = h * _M
        slot >>= np.uint64(44)
        at = np.flatnonzero(self.sieve.take(slot.view(np.int64)))
        h = h[at].view(np.int64)
        x = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[x] == h
        at, x = at[hit], x[hit]
        each = self.count[x]
        row = np.repeat(self.first[x], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        at = np.repeat(at, each)
        d = np.searchsorted(ends, at, "right")
        k, place = self.owner[row], at - self.offset[row]
        # documents lie far apart, so no group reaches from one into the next
        order = np.lexsort((place + d * 4096, k))
        d, k, place = d[order], k[order], place[order]
        wide = place + d * 4096
        other = np.arange(len(k)) + self.need[k] - 1
        inside = other < len(k)
        i, other = np.flatnonzero(inside), other[inside]
        begin = ends - np.array([len(t) + 1 for t in docs])
        # an edit moves the rest by the bytes of the widest code point at most
        top = np.maximum.reduceat(buffer, begin)
        band = self.band[k[i]] * np.maximum(1 + (top >= 0xC0) + (top >= 0xE0) + (top >= 0xF0), 1)[d[i]]
        band = np.maximum(band, self.band[k[i]] * self.wide[k[i]])
        near = (k[other] == k[i]) & (wide[other] - wide[i] <= band)
        offset = self.offset[row][order]
        i, band = i[near], band[near]
        # places of all items in one order, those of each item far from the next one's
        line = wide + k * (int(wide.max(initial=0)) + (1 << 24))
        end = np.searchsorted(line, line[i] + band, "right")
        item, start = k[i], place[i] - begin[d[i]]
        for j, e, least, *spot in zip(i.tolist(), end.tolist(), self.need[item].tolist(), d[i].tolist(), item.tolist(), start.tolist(), strict=True):
            # a piece that the text repeats counts once
            if len(set(offset[j:e].tolist())) >= least:
                yield tuple(spot)


def bounded(text: str, item: str) -> bool:
    """Whether item occurs in text with no letter or digit of a spaced script going on at its ends."""
    goes_on = lambda a, b: a.isalnum() and b.isalnum() and ord(a) < 0x800 and ord(b) < 0x800
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        if not (at and goes_on(text[at - 1], item[0])) and not (end < len(text) and goes_on(item[-1], text[end])):
            return True
        at = text.find(item, at + 1)
    return False


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * _M >> np.uint64(44)).astype(np.int64)


def embedded(buffer: np.ndarray, starts: np.ndarray, walk: tuple, sieve: dict[int, np.ndarray] | None = None):
    """(positions in starts, key, end) of the windows; sieve drops windows whose first samples no item has."""
    bits, sampled = walk
    at, h, row, m = starts.astype(np.int32), np.zeros(len(starts), np.uint64), np.arange(len(starts)), 0
    take = set(sampled.tolist())
    for j in range(int(sampled[-1]) + 1):
        c = buffer[at]
        if j in take:
            h = h * _M + c.astype(np.uint64) + np.uint64(1)
            m += 1
            if sieve is not None and m in sieve:
                ok = np.flatnonzero(sieve[m][_slot(h)])
                at, h, row, c = at[ok], h[ok], row[ok], c[ok]
                if not len(at):
                    break
        at = at + bits[j][c]
    return row, h, at


class Items:
    """Walk tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        self.items = [(i, n) for i, t in items if (n := normal(t or ""))]
        self.text = [n.decode() for _, n in self.items]
        self.most = [int(edits * len(t)) for t in self.text]
        self.masks: dict[int, dict[str, int]] = {}
        self.walks = walks()
        self.tables, self.sieves = [], []
        sizes = [len(n) for _, n in self.items]
        self.whole = [k for k, n in enumerate(sizes) if n < WHOLE or not self.most[k]]
        whole = set(self.whole)
        cut: dict[int, list[tuple[int, str, int]]] = {q: [] for q in (5, 4, 3, 2, 1)}
        long = []
        for k, t in enumerate(self.text):
            if k in whole:
                continue
            size = next((q for q in cut if len(pieces(t, q)) - self.most[k] >= (2 if q == 5 else 1)), None)
            if size is not None and sizes[k] < LONG:
                cut[size].append((k, t, self.most[k]))
            else:
                long.append(k)
        self.pieces = [Pieces(q, x) for q, x in cut.items() if x]
        self.cut = {k for x in cut.values() for k, _, _ in x}
        raw = b"\n".join(self.items[k][1] for k in long) + b"\n" * (STEPS + 2)
        buffer = np.frombuffer(raw, np.uint8)
        starts, owner, offset, stop = [], [], [], []
        at = 0
        for k in long:
            n = self.items[k][1]
            for o in item_begins(n).tolist():
                starts.append(at + o), owner.append(k), offset.append(o), stop.append(at + len(n))
            at += len(n) + 1
        for walk in self.walks:
            table, sieve = {}, {m: np.zeros(1 << 20, bool) for m in (4, 7, 10, SAMPLED)}
            if starts:
                row, h, end = embedded(buffer, np.array(starts), walk)
                inside = end <= np.array(stop)
                for r, key in zip(row[inside].tolist(), h[inside].tolist(), strict=True):
                    table.setdefault(key, []).append((owner[r], offset[r]))
                kept = np.array(starts)[row[inside]]
                for m in sieve:
                    _, part, _ = embedded(buffer, kept, (walk[0], walk[1][:m]))
                    sieve[m][_slot(part)] = True
            self.tables.append(table)
            self.sieves.append(sieve)

    def distance(self, k: int, text: str) -> int:
        """Least edit distance of item k to any part of text (bit-parallel)."""
        pattern = self.text[k]
        if k not in self.masks:
            masks: dict[str, int] = {}
            for j, c in enumerate(pattern):
                masks[c] = masks.get(c, 0) | 1 << j
            self.masks[k] = masks
        masks, size = self.masks[k], len(pattern)
        full, top = (1 << size) - 1, 1 << size - 1
        pv, mv, score = full, 0, size
        best = score
        for c in text:
            eq = masks.get(c, 0)
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            xv = eq | mv
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            best = min(best, score)
        return best

    def find(self, docs: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position in docs, item, distance) of verified matches."""
        ends = np.cumsum([len(d) + 1 for d in docs])
        begin = ends - np.array([len(d) + 1 for d in docs])
        buffer = np.frombuffer(b"\n".join(docs) + b"\n" * (STEPS + 2), np.uint8)
        starts = begins(buffer[: ends[-1]])
        spots: dict[tuple[int, int], set[int]] = {}
        for walk, table, sieve in zip(self.walks, self.tables, self.sieves, strict=True):
            if not table:
                continue
            row, h, _ = embedded(buffer, starts, walk, sieve)
            for r, key in zip(row.tolist(), h.tolist(), strict=True):
                p = int(starts[r])
                for k, o in table.get(key, ()):
                    d = int(np.searchsorted(ends, p, "right"))
                    if d < len(docs):
                        spots.setdefault((d, k), set()).add(p - int(begin[d]) - o)
        if self.pieces:
            cuts = np.flatnonzero(np.diff(ends // PART)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(docs)], strict=True):
                for part in self.pieces:
                    for d, k, p in part.groups(docs[lo:hi]):
                        spots.setdefault((lo + d, k), set()).add(p)
        for (d, k), at in spots.items():
            size, last, best = len(self.items[k][1]), None, None
            slack = 6 * self.most[k] if k in self.cut else max(8, int(size * EDITS) * 2)
            for p in sorted(at):
                if last is not None and p - last < slack // 4:  # the window before covers it
                    continue
                last = p
                window = docs[d][max(0, p - slack) : p + size + slack].decode("utf-8", "ignore")
                x = self.distance(k, window)
                best = x if best is None else min(best, x)
                if best == 0:
                    break
            if best is not None and best <= self.most[k]:
                yield d, k, best
        for k in self.whole:
            for d, text in enumerate(docs):
                if self.items[k][1] in text and bounded(text.decode("utf-8", "ignore"), self.text[k]):
                    yield d, k, 0


def _matched(items: list[tuple[int, str]], edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(items, edits)
        for ids, text in slices(batches, rows=1000):
            found = [(ids[d], block.items[k][0], x, len(block.text[k])) for d, k, x in block.find([normal(t) for t in text])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], ["doc_id", "item_id", "distance", "item_chars"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, distance, item_chars): texts with a part within edits * length of an item, by edit distance.

    Case of A-Z and white space don't count. A null or empty text or item matches nothing; items shorter than
    WHOLE bytes, or with no edit to allow, must occur as they are, with no letter or digit next to them. Repeated rows and items give repeated matches; distinct() makes a set of them. An
    empty table on either side gives no row.
    """
    docs = texts(docs, id_col, text_col)
    items = texts(benchmark, item_col, item_text_col).where("text <> ''")
    blocks = -(-items.count() // ITEMS)
    found = []
    for b in range(max(1, blocks)):
        part = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, blocks))) == b).toArrow().to_pydict()
        found.append(docs.mapInArrow(_matched(list(zip(part["doc_id"], part["text"], strict=True)), edits), "doc_id long, item_id long, distance long, item_chars long"))
    return reduce(DataFrame.unionByName, found)
