"""N-gram Jaccard join over a count-vector R-tree.

A document's set holds its distinct 5-word shingles. Each set is hashed into groups; the group counts are the
document's point, and the sum of coordinate minima of two points bounds the overlap of the two sets from above.

How the tree is laid out on Spark:

* Equal sets become one class first, so copies cost one row each.
* Tiles are the top level of the tree. A global order puts shingles of crowded groups last and else follows the
  hash. Two sets with a Jaccard similarity of at least t share one of the first n - ceil(t*n) + 1 shingles of each in
  that order, so routing a point to one tile for each of these shingles loses no pair. Pure coordinate splits cannot
  route: at t = 0.8 two linked documents of 546 shingles may differ by 121 in L1, and with 16 groups two unrelated
  ones differ by 105 on average, so every box would meet every query. The order is only a heuristic against crowded
  tiles; any order that is the same for all documents gives the same links.
* In each tile every point is first tested against the tile's leaders (a star), which links groups of copies without
  making all their pairs. Then leaves of points, packed by set size, are probed with their boxes and the bound for
  pairs that are not connected yet.
* Surviving pairs are verified on the whole sets.

Sets are of 64-bit shingle hashes; a class id is 64 bits of the set's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import components, stored, texts

WORDS = 5
SIMILARITY_PERCENT = 80
GROUP_BITS = 18
LEAF, FEW = 64, 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_B = 0x2545F4914F6CDD1D
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Shingler:
    """Sorted distinct shingle hashes of many texts at once, straight from an Arrow column.

    A word's hash comes from prefix sums of byte values times powers of an odd base, so no word becomes an object.
    """

    def __init__(self, n: int = WORDS):
        self.n, self.power, self.back = n, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.power) < size:
            one = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))
            self.power, self.back = one(_B), one(pow(_B, -1, 1 << 64))

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank, cut = np.ones(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        blank[:-1], cut[offsets] = _BLANK[raw], True
        first = ~blank
        first[1:] &= blank[:-1] | cut[1:]
        last = ~blank[:-1] & (blank[1:] | cut[1:])
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * self.power[: len(raw)], out=sums[1:])
        h = _mixed((sums[end] - sums[start]) * self.back[start] + (end - start).astype(np.uint64))
        bounds, n, odd = np.searchsorted(start, offsets), self.n, _mixed(np.arange(1, self.n + 1, dtype=np.uint64)) | np.uint64(1)
        every = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for i in range(n):
            every += h[i : i + len(every)] * odd[i]
        every = _mixed(every)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(every[a : b - n + 1])
            elif b > a:
                yield _mixed(np.array([(h[a:b] * odd[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield every[:0]


def _each(batches: Iterator[pa.RecordBatch], shingler: Shingler, column: int = 1, size: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    """Parts of batches of about so many bytes of text, and the sets of their rows."""
    for batch in batches:
        text = batch.column(column)
        ends = np.cumsum(np.asarray(pa.compute.binary_length(text).fill_null(0), np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            part = batch.slice(at, to - at)
            yield part, shingler(part.column(column))
            at = to


def groups_of(n: int, fine: bool = True) -> int:
    """Groups of a point, a power of two. A fine point has n / 2 to n, so few differences of near misses cancel; a
    coarse one has enough that unrelated sets, whose expected L1 is 1.13 sqrt(n groups), are farther apart than linked
    ones may be."""
    return 1 << max(4, int(max(1, n) - 1).bit_length() - (1 if fine else 3 if n < 1024 else 4))


def point(shingles: np.ndarray, fine: bool = True) -> np.ndarray:
    """Group counts of a set, in the smallest type that holds them."""
    groups = groups_of(shingles.size, fine)
    x = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return x.astype(np.min_scalar_type(int(x.max())))


def folded(x: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer groups: groups are low bits of the hash, so folding adds them up."""
    return x.reshape(-1, groups).sum(0)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Sum of coordinate minima: no smaller than the overlap of the two sets."""
    g = min(len(x), len(y))
    return int(np.minimum(folded(x.astype(np.int64), g), folded(y.astype(np.int64), g)).sum())


def needed(a, b, percent: int):
    """The overlap that 100 * overlap >= percent * union asks for."""
    return -((-percent * (a + b)) // (100 + percent))


def _as_point(raw: bytes, n: int, fine: bool = False) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // groups_of(n, fine)}").astype(np.int32)


def _group_counts(n_words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(n_words), np.zeros(1 << bits, np.int64)
        for _, sets in _each(batches, shingler):
            if (s := [x for x in sets if x.size]):
                counts += np.bincount((np.concatenate(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["g", "c"])

    return run


def _points(n_words: int, percent: int, level: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(n_words), set()
        for part, sets in _each(batches, shingler):
            n, cls, keys, pts, rough = [], [], [], [], []
            for s in sets:
                n.append(s.size)
                if not s.size:
                    cls.append(None), keys.append(None), pts.append(None), rough.append(None)
                    continue
                cls.append(int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)))
                if cls[-1] in seen:  # a copy in the same task: its class has a row already
                    keys.append(None), pts.append(None), rough.append(None)
                    continue
                if len(seen) < 2_000_000:
                    seen.add(cls[-1])
                first = s.size - -(-percent * s.size // 100) + 1
                order = np.argsort(level[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")  # ties: by hash
                keys.append(s[order[:first]].view(np.int64))
                pts.append(point(s).tobytes())
                rough.append(point(s, False).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(pts, pa.binary()), pa.array(rough, pa.binary())], ["doc_id", "n", "id", "keys", "p", "q"])

    return run


def _sets(n_words: int, wanted: np.ndarray):
    """Sets of the classes that wanted, a bitmap over low bits of class ids, may hold."""
    mask = len(wanted) * 8 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(n_words), set()
        for _, sets in _each(batches, shingler):
            got = []
            for s in sets:
                if not s.size:
                    continue
                h = xxhash.xxh3_64_intdigest(s.tobytes())
                if wanted[(h & mask) >> 3] >> (h & 7) & 1 and h not in seen:
                    if len(seen) < 2_000_000:
                        seen.add(h)
                    got.append((int(np.uint64(h).astype(np.int64)), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], k) for i, k in enumerate((pa.int64(), pa.binary()))], ["id", "s"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for x, y, s, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                need = needed(s.size, t.size, percent)
                if need <= min(s.size, t.size) and np.intersect1d(s, t, assume_unique=True).size >= need:
                    a.append(x), c.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def _bounded(percent: int, fine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [overlap_bound(_as_point(p, n, fine), _as_point(q, m, fine)) >= needed(n, m, percent) for n, m, p, q in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _near(pairs: DataFrame, points: DataFrame, percent: int, column: str) -> DataFrame:
    """The pairs that the bound leaves, on coarse points (q) or fine ones (p)."""
    return _both(pairs, points, "n", column).mapInArrow(_bounded(percent, column == "p"), "a long, b long")


def _both(pairs: DataFrame, side: DataFrame, *columns: str) -> DataFrame:
    """pairs(a, b) with columns of side(id, ...) for a and for b."""
    one = lambda k, i: side.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}{i}") for c in columns))
    return pairs.join(one("a", 1), "a").join(one("b", 2), "b").select("a", "b", *(f"{c}{i}" for c in columns for i in (1, 2)))


def _verify(docs: DataFrame, pairs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are as similar as asked. The sets of their classes are made again from the texts."""
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(docs.mapInArrow(_sets(n_words, bitmap(wanted)), "id long, s binary").dropDuplicates(["id"]), "sets")
    return stored(_both(pairs, sets, "s").mapInArrow(_verified(percent), "a long, b long"), "links")


def _may(n: int, i: int, m, j, percent: int):
    """Whether two sets of n and m shingles may be linked if a shingle at place i of one and j of the other is the first
    that they share: all others they share stand behind it in both."""
    return (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & (np.minimum(n - i, m - j) + 1 >= needed(n, m, percent))


class Leaf:
    """Points of similar set size, on the groups of the smallest of them, and the box around them."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.comps, self.n, self.at = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        self.groups = min(groups_of(r[2], False) for r in rows)
        self.points = np.stack([folded(_as_point(r[4], r[2]), self.groups) for r in rows])
        self.high = self.points.max(0)

    def on(self, groups: int) -> np.ndarray:
        return self.points if groups == self.groups else self.points.reshape(len(self.ids), -1, groups).sum(1)

    def pairs(self, other: Leaf, percent: int) -> Iterator[tuple[int, int]]:
        """Pairs of rows of the two that the bounds leave and that aren't connected yet; other has no larger sets."""
        g = min(self.groups, other.groups)
        least = needed(int(self.n.min()), int(other.n.min()), percent)
        if other.n.max() * 100 < percent * self.n.min() or np.minimum(folded(self.high, g), folded(other.high, g)).sum() < least:
            return
        mine, theirs, high = self.on(g), other.on(g), folded(other.high, g)
        for i in range(len(self.ids)):
            may = np.flatnonzero((other.comps != self.comps[i]) & (other.n <= self.n[i]) & _may(self.n[i], self.at[i], other.n, other.at, percent))
            if len(may) and np.minimum(mine[i], high).sum() >= needed(int(self.n[i]), int(other.n.min()), percent):
                need = needed(self.n[i], other.n[may], percent)
                for j in may[np.minimum(mine[i], theirs[may]).sum(1) >= need].tolist():
                    if self.ids[i] != other.ids[j]:
                        yield max(int(self.ids[i]), int(other.ids[j])), min(int(self.ids[i]), int(other.ids[j]))


SIFTED = "key long, id long, comp long, n int, at int, k long, other long"


def _sifted(percent: int):
    """Rows of SIFTED but other, those of a tile together. Gives the pairs of small tiles that sizes and places
    leave, as (id, other), and the rows of the other tiles as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                k, i, c, n, at, size = row
                if size >= FEW:
                    out.append((*row, None))
                    continue
                if k != key:
                    key, tile = k, []
                for j, d, m, place in tile:
                    if d != c and j != i and _may(n, at, m, place, percent):
                        out.append((None, max(i, j), None, None, None, None, min(i, j)))
                tile.append((i, c, n, at))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], [x.split()[0] for x in SIFTED.split(", ")])

    return run


def _probed(percent: int):
    """Rows (tile, id, component, set size, place, coarse point) come sorted by tile and set size, so leaves fill in
    order of size and are left behind in that order too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaves, fresh = None, [], []
        found: set[tuple[int, int]] = set()

        def close() -> None:
            if fresh:
                leaf = Leaf(fresh)
                leaves[:] = [x for x in leaves if x.n.max() * 100 >= percent * leaf.n.min()]
                for x in [*leaves, leaf]:
                    found.update(leaf.pairs(x, percent))
                leaves.append(leaf)
            fresh.clear()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], ["a", "b"])

        for b in batches:
            for k, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if k != key or len(fresh) == LEAF:
                    close()
                if k != key:
                    key = k
                    leaves.clear()
                fresh.append(row)
            if len(found) > 200_000:
                yield out()
                found.clear()
        close()
        yield out()

    return run


def bitmap(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """A bitmap of fixed size over the low bits of ids; the driver gets one number for each byte at most."""
    size = 1 << bits
    got = ids.groupBy(F.expr(f"shiftright(id & {size - 1}L, 3)").alias("at")).agg(F.expr("bit_or(shiftleft(1, int(id & 7)))").alias("v")).toArrow()
    out = np.zeros(size // 8, np.uint8)
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, n_links.

    component_id is the smallest doc_id that links reach, itself included; n_links counts verified links of its class
    with other classes (a spanning set of them, not all pairs). A null or empty text has no set and no link. A text
    with fewer than n_words words has its whole sequence as its one shingle. Repeated rows and equal texts share a
    class; a null doc_id takes part and is never a component_id unless all ids of the component are null.
    """
    docs = texts(docs, id_col, text_col)
    counts = docs.mapInArrow(_group_counts(n_words, GROUP_BITS), "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).toArrow()
    crowd = np.zeros(1 << GROUP_BITS, np.int64)
    crowd[counts["g"].to_numpy()] = counts["c"].to_numpy()
    usual = max(8.0, float(np.median(crowd)) + 6 * float(np.sqrt(max(1.0, np.median(crowd)))))
    level = np.clip(np.log2(np.maximum(crowd, 1) / usual) * 2 + 1, 0, 100).astype(np.int8)

    rows = stored(docs.mapInArrow(_points(n_words, percent, level, GROUP_BITS), "doc_id long, n long, id long, keys array<long>, p binary, q binary"), "points")
    members = rows.select("doc_id", "n", "id")
    classes = stored(rows.where("keys is not null").select("id", "n", "keys", "p", "q").dropDuplicates(["id"]), "classes")

    # rows of tiles in which the set next in size, up or down, fits
    tile, sized = Window.partitionBy("key"), Window.partitionBy("key").orderBy("n", "id")
    routed = classes.select(F.posexplode("keys").alias("at", "key"), "id", F.col("n").cast("int").alias("n")).withColumn("at", F.col("at") + 1)
    fits = (F.col("before") * 100 >= percent * F.col("n")) | (F.col("n") * 100 >= percent * F.col("after"))
    routed = routed.select("key", "id", "n", "at", F.lag("n").over(sized).alias("before"), F.lead("n").over(sized).alias("after")).where(fits).drop("before", "after")
    # leaders: the set that has the least before the tile's shingle, as the origin of edited copies has, and any one
    first, any_one = F.col("at").cast("long"), F.xxhash64("id", F.lit(1))
    leader = [F.min(F.struct(h.alias("h"), "id", "n", "at")).over(tile).alias(f"l{i}") for i, h in ((1, first), (2, any_one))]
    tiles = stored(routed.select("key", "id", "n", "at", *leader).select("key", "id", "n", "at", *(F.struct(*(f"l{i}.{c}" for c in ("id", "n", "at"))).alias(f"l{i}") for i in (1, 2))), "tiles")

    need = F.ceil(percent * (F.col("n") + F.col("l.n")) / (100 + percent))
    stars = tiles.select("id", "n", "at", F.explode(F.array("l1", "l2")).alias("l")).where("id <> l.id").where((F.least("n", "l.n") * 100 >= percent * F.greatest("n", "l.n")) & (F.least(F.expr("n - at"), F.expr("l.n - l.at")) + 1 >= need))
    stars = stars.select(F.greatest("id", "l.id").alias("a"), F.least("id", "l.id").alias("b")).distinct()
    links = _verify(docs, _near(_near(stars, classes, percent, "q"), classes, percent, "p"), n_words, percent)
    comps = components(links)

    # what is left: rows with another component in their tile
    labelled = tiles.select("key", "id", "n", "at").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    labelled = labelled.select("key", "id", "comp", "n", "at", F.count("*").over(tile).alias("k"), F.min("comp").over(tile).alias("x"), F.max("comp").over(tile).alias("y"))
    sifted = stored(labelled.where("x <> y").select("key", "id", "comp", "n", "at", "k").mapInArrow(_sifted(percent), SIFTED), "sifted")
    probes = sifted.where("key is not null").join(classes.select("id", "q"), "id").select("key", "id", "comp", "n", "at", "q")
    probed = probes.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(_probed(percent), "a long, b long")
    pairs = sifted.where("key is null").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(probed).distinct()
    fresh = _near(_near(pairs.join(links, ["a", "b"], "left_anti"), classes, percent, "q"), classes, percent, "p")
    links = stored(links.unionByName(_verify(docs, fresh, n_words, percent)), "all_links")
    comps = components(links)

    # one row a class, with its copies; classes by component; and back, hot classes and components by broadcast
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").cast("long").alias("n_links"))
    copies = stored(members.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").unionByName(
        members.join(comps.select("id"), "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))).distinct(), "copies")
    joined = copies.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = joined.groupBy("comp").agg(F.min("first").alias("least"), F.count("*").alias("size"))
    label = stored(with_hot(joined, least, "comp", "size", copies.count()).join(degree, "id", "left").select("id", "least", "rows", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "labels")
    return with_hot(members, label, "id", "rows", rows.count()).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def with_hot(left: DataFrame, right: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """A left join on key, which right has once, with the rows of left that it meets in size. Keys with more than one
    in share of all total rows, fewer than share in number, are broadcast, so none of them lands in one task."""
    hot = stored(right.where(F.col(size) * share > total), "hot")
    found = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left_anti")
    return found.unionByName(rest.join(right, key, "left").select(*found.columns))
