"""MinHash near-dedup with SuperMinHash signatures.

1. Each text becomes the set of its distinct word shingles (64-bit hashes) and
   a SuperMinHash signature: an element draws slots from a random permutation
   of its own, the j-th of them with a value in [j, j + 1), and a slot keeps
   its least value. All elements of a batch do step j together and a text is
   done when its largest slot is below j + 1: no later step can change it.
2. Texts with equal sets are one class, numbered by one of its rows; all that
   follows is about classes, so it matters neither how many copies a text has
   nor whether doc_ids repeat.
3. Bands of ``ROWS`` slots deal the classes to buckets. Rows of (band, class)
   are sorted by range, so that a large bucket is spread over tasks; each piece
   of a bucket is held against its first class, and the first ones of the pieces
   against each other's least, on their full sets; links are grouped by
   union-find.
4. A bucket whose members are then in one component is finished. In any other
   one the signatures of members of different components are compared in
   blocks: first for a forest of likely pairs, confirmed as before; then, in
   the buckets still open, for all members with a likely partner that they are
   not yet joined with. Only their texts go to the blocks, where every likely
   pair is held against full sets, likeliest first, and only links come out.

A pair of exactly the least similarity shares no band with a probability of
(1 - 0.8**5)**32 = 3e-6 and is passed over by its signature with 1e-8; no
bucket, group or candidate list has a cap. A center with many members is dealt
over salted tasks, a large bucket over blocks of about ``BLOCK`` members and
``CELL`` shingles, and texts are shuffled only for classes that share a bucket.
A bucket of n members that stay apart costs n * n / 2 comparisons of signatures.

Texts without words have the empty set, n_shingles 0, and are linked with
nothing; a null doc_id is linked with nothing and kept. Rows that share a
doc_id count as one document, that of all their texts. An empty table gives an
empty result. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, materialize, small_batches, table
from .components import Forest, components
from .words import Batch, distinct, mix64, pieces

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
SEED = 0x5EED
#: Share of equal slots (8 bits of each) from which a pair is worth a full comparison.
LIKELY = 0.62
BLOCK = 512
CELL = 1 << 20
PER_SALT = 512
_U = np.uint64


def superminhash(sets: np.ndarray, bounds: np.ndarray, m: int = SLOTS, seed: int = SEED) -> np.ndarray:
    """A row of m values for each set; equal slots have the rate of Jaccard similarity."""
    sizes = np.diff(bounds)
    out = np.full((len(sizes), m), np.iinfo(np.uint64).max, _U)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    items = sets
    picks: list[np.ndarray] = []
    for j in range(m):
        if not len(items):
            break
        draw = mix64(items ^ mix64(np.array([seed + j], _U))[0])
        pick = (j + ((draw & _U(0xFFFFFF)) * _U(m - j) >> _U(24)).astype(np.int64)).astype(np.int16)
        # Who stands at `pick` after the swaps of the steps before: follow them back.
        slot = pick.copy()
        for i in range(j - 1, -1, -1):
            slot[slot == picks[i]] = i
        np.minimum.at(flat, owner * m + slot, (_U(j) << _U(40)) | (draw >> _U(24)))
        live = np.unique(owner)
        open_ = np.zeros(len(sizes), bool)
        open_[live] = out[live].max(axis=1) >= _U(j + 1) << _U(40)
        keep = open_[owner]
        if not keep.any():
            break
        picks.append(pick)
        if not keep.all():
            items, owner = items[keep], owner[keep]
            picks = [p[keep] for p in picks]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, m = signature.shape
    parts = signature.reshape(n, bands, m // bands)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=_U)), (n, bands)).copy()
    for r in range(m // bands):
        key = mix64(key ^ parts[:, :, r]) + _U(r)
    return key.view(np.int64)


def _features(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, t) for b in batches for k, t in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2), strict=True))
        for keys, texts in pieces((k, t.as_py()) for k, t in rows):
            sets, bounds = distinct(*Batch(texts).shingles(shingle))
            signature = superminhash(sets, bounds)
            bands, low = band_keys(signature), mix64(signature).astype(np.uint8)
            sizes = np.diff(bounds)
            digests = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(halves[:, 0], pa.int64()),
                    pa.array(halves[:, 1], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1]), pa.int32()), pa.array(bands.reshape(-1), pa.int64())),
                    pa.array([row.tobytes() for row in low], pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "d1", "d2", "bands", "low"],
            )

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, member, size, center and edge of the runs of two and more, from sorted rows (band, class, size).

    The center is a run's first class. The first and the last run of a task may
    go on in another one: they come out whatever their length, with ``edge`` at
    their first row; where that is out already, a row without a member says so.
    """

    def out(band, member, size, center, edge):
        return pa.RecordBatch.from_arrays([pa.array(band, pa.int64()), pa.array(member, pa.int64()), pa.array(size, pa.int64()), pa.array(center, pa.int64()), pa.array(edge, pa.bool_())], names=["band", "member", "size", "center", "edge"])

    head: tuple | None = None  # first row of the open run
    alone, first = False, True  # whether it is all of it so far and not yet out; whether no run has ended
    for batch in batches:
        band, member, size = (batch.column(i).to_numpy() for i in range(3))
        if not len(band):
            continue
        if head is not None:
            band, member, size = (np.concatenate(([h], x)) for h, x in zip(head, (band, member, size), strict=True))
        begins = np.concatenate(([True], band[1:] != band[:-1]))
        start = np.flatnonzero(begins)
        run = np.cumsum(begins) - 1
        many = np.diff(np.append(start, len(band)))
        emit = (many > 1)[run]
        edge = np.zeros(len(band), bool)
        if head is None:
            emit[0] = edge[0] = True  # the first run of the task is on its edge
        elif not alone:
            emit[0] = False
        yield out(band[emit], member[emit], size[emit], member[start][run][emit], edge[emit])
        at = start[-1]
        if len(start) > 1 or head is None:
            first = len(start) == 1
            alone = many[-1] == 1 and not (first and head is None)
        else:
            alone = False
        head = (band[at], member[at], size[at])
    if head is not None and not first:
        yield out([head[0]], [head[1] if alone else None], [head[2]], [head[1]], [True])


def _set(text: str, shingle: int) -> np.ndarray:
    return np.unique(Batch([text]).shingles(shingle)[0])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= percent * (len(a) + len(b) - both)


def _confirm(shingle: int, percent: int):
    """Rows (center, salt, member, text), the center's own text first in each (center, salt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, center = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for c, salt, member, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (c, salt) != at:
                    at, center = (c, salt), None
                if member is None:
                    center = _set(text, shingle)
                    continue
                own = _set(text, shingle)
                if _linked(center, own, percent):
                    found.append((member, c))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The links u, v among ``pairs`` (center, member), by their full sets."""
    many = pairs.groupBy("center").agg(F.ceil(F.count("*") / PER_SALT).alias("salts"))
    dealt = pairs.join(many, "center").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int"))
    members = dealt.select("center", "salt", "member").join(texts, F.col("member") == texts["class"]).select("center", "salt", "member", "text")
    none = F.lit(None).cast("long").alias("member")
    centers = many.select("center", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"), none).join(texts, F.col("center") == texts["class"]).select("center", "salt", "member", "text")
    rows = members.unionByName(centers).repartition("center", "salt").sortWithinPartitions("center", "salt", F.col("member").asc_nulls_first())
    return rows.mapInArrow(_confirm(shingle, percent), "u long, v long")


def _by_cell(work, names: list[str]):
    """Apply ``work`` to the rows of each (band, i, j), which come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            found = work(held)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(len(names))], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield done()
                    held.clear()
                held.append(row)
        if held:
            yield done()

    return run


def _likely(rows: list[tuple]) -> list[tuple[float, int, int]]:
    """(-share, x, y) of the likely pairs of different components in a cell, likeliest first.

    Rows: band, i, j, block, member, component, low, ...
    """
    i, j = rows[0][1], rows[0][2]
    low = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1)
    group, block = np.array([r[5] for r in rows]), np.array([r[3] for r in rows])
    found = []
    for x in np.flatnonzero(block == i):
        other = group != group[x]
        other &= (block == j) if i != j else (np.arange(len(rows)) > x)
        y = np.flatnonzero(other)
        if len(y):
            share = (low[y] == low[x]).mean(axis=1)
            found += [(-s, x, z) for s, z in zip(share[share >= LIKELY], y[share >= LIKELY], strict=True)]
    return sorted(found)


def _forest(rows: list[tuple]) -> list[tuple[int, int]]:
    """Likely pairs that would join all likely components of a cell: fewer than its rows."""
    forest, out = Forest(), []
    for _, x, y in _likely(rows):
        if forest.union(rows[x][5], rows[y][5]):
            out.append((min(rows[x][4], rows[y][4]), max(rows[x][4], rows[y][4])))
    return out


def _first_shared(x: tuple, y: tuple) -> int:
    """The first band of two rows that both have."""
    return next(b for b, c in zip(x[7], y[7], strict=True) if b == c)


def _partners(rows: list[tuple]) -> list[tuple]:
    """Band, i, j, block, member and component of the rows of a cell with a likely partner, in the first band that both share."""
    some = {k for _, x, y in _likely(rows) if _first_shared(rows[x], rows[y]) == rows[0][0] for k in (x, y)}
    return [rows[k][:6] for k in sorted(some)]


def _cell_links(shingle: int, percent: int):
    """Links that join components of a cell, every likely pair held against full sets.

    A pair is looked at in the first band that both share; once two components
    are joined their other pairs need no look. Rows go on with bands and text.
    """

    def work(rows: list[tuple]) -> list[tuple[int, int]]:
        forest, out, sets = Forest(), [], {}
        for _, x, y in _likely(rows):
            if forest.find(rows[x][5]) == forest.find(rows[y][5]) or _first_shared(rows[x], rows[y]) != rows[x][0]:
                continue
            for k in (x, y):
                if k not in sets:
                    sets[k] = _set(rows[k][8], shingle)
            if _linked(sets[x], sets[y], percent):
                forest.union(rows[x][5], rows[y][5])
                out.append((rows[x][4], rows[y][4]))
        return out

    return work


def _cells(members: DataFrame, grouped: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of each cell (two blocks of a bucket) for buckets of several components."""
    placed = members.join(grouped, members["member"] == grouped["node"], "left").select("band", "member", "size", F.coalesce("component", "member").alias("component"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / CELL)).cast("int")
    several = placed.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("z"), blocks.alias("g"), F.count("*").alias("n")).where("a <> z").select("band", "g", "n")
    block = F.pmod(F.xxhash64("member"), F.col("g")).cast("int")
    opened = join_skewed(placed, materialize(several, "several"), ["band"]).withColumn("block", block).join(more, F.col("member") == F.col("class"))
    cells = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    extra = [c for c in more.columns if c != "class"]
    dealt = opened.withColumn("cell", F.explode(cells)).select("band", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "block", "member", "component", *extra)
    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "member")


def text_key(text: str = "text") -> Column:
    """Tells texts that share a doc_id apart."""
    return F.xxhash64(F.col(text))


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, one_by_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, text_key, n_shingles, d1 and d2 of each row; d1, d2, first, class, component and n of each class.

    A class is a set of shingles; ``first`` is the least doc_id with it,
    ``component`` the class that stands for all that are linked, ``n`` its rows.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text"))
    shape = "doc_id long, text_key long, n_shingles long, d1 long, d2 long, bands array<long>, low binary"
    features = materialize(texts.mapInArrow(_features(shingle), shape).withColumn("row", F.monotonically_increasing_id()), "features")
    sets = features.where("n_shingles > 0 and doc_id is not null")
    known = materialize(sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.min("row").alias("class"), F.count("*").alias("n")), "classes")
    ones = materialize(sets.join(known.select("class"), sets["row"] == known["class"]).select("class", "doc_id", "text_key", "n_shingles", "bands", "low"), "ones")

    banded = ones.select(F.explode("bands").alias("band"), "class", "n_shingles").repartitionByRange("band", "class").sortWithinPartitions("band", "class")
    stars = materialize(banded.mapInArrow(_stars, "band long, member long, size long, center long, edge boolean"), "members")
    edges = stars.where("edge").select("band", "center").distinct()  # two rows a task at most
    tops = edges.groupBy("band").agg(F.min("center").alias("top"))
    over = edges.join(tops, "band").where("center <> top").select(F.col("top").alias("center"), F.col("center").alias("member"))
    pairs = materialize(stars.where("member <> center").select("center", "member").union(over).distinct(), "pairs")
    asked = pairs.select("member").union(pairs.select("center")).distinct()
    members = stars.where("member is not null").select("band", "member", "size")
    wanted = ones.join(asked, ones["class"] == asked["member"], "left_semi").select("class", F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    texts = texts.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("text_key") == F.col("key"))).select("class", "text")
    if not features.groupBy("doc_id", "text_key").count().where("count > 1 and doc_id is not null").isEmpty():
        texts = texts.dropDuplicates(["class"])  # rows that repeat
    texts = materialize(texts, "texts")
    links = _confirmed(pairs, texts, shingle, percent)
    if one_by_id:  # Rows that share a doc_id are one document: their classes are linked.
        shared = materialize(sets.groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("z")).where("a <> z").select("doc_id"), "shared")
        if not shared.isEmpty():
            own = sets.select("doc_id", "d1", "d2").distinct().join(shared, "doc_id", "left_semi").join(known.select("d1", "d2", "class"), ["d1", "d2"])
            own = materialize(own.select("doc_id", "class"), "own")
            links = links.union(own.join(own.groupBy("doc_id").agg(F.min("class").alias("v")), "doc_id").select(F.col("class").alias("u"), "v"))
    grouped = components(materialize(links, "links"))
    again = lambda more: components(more.union(grouped.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    likely = materialize(_cells(members, grouped, ones.select("class", "low")).mapInArrow(_by_cell(_forest, ["center", "member"]), "center long, member long").distinct(), "pairs")
    if not likely.isEmpty():
        grouped = again(_confirmed(likely, texts, shingle, percent))
    marks = ones.select("class", "low", "bands")
    cell = ["band", "i", "j", "block", "member", "component"]
    open_ = materialize(_cells(members, grouped, marks).mapInArrow(_by_cell(_partners, cell), "band long, i long, j long, block long, member long, component long"), "open")
    if not open_.isEmpty():
        whole = open_.join(marks, open_["member"] == marks["class"]).drop("class").join(texts, F.col("member") == texts["class"]).select(*cell, "low", "bands", "text")
        dealt = whole.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "member")
        grouped = again(dealt.mapInArrow(_by_cell(_cell_links(shingle, percent), ["u", "v"]), "u long, v long"))
    out = known.join(grouped, known["class"] == grouped["node"], "left").withColumn("component", F.coalesce("component", "class")).drop("node")
    return features.select("doc_id", "text_key", "n_shingles", "d1", "d2"), materialize(out, "grouped")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    rows, known = classes(docs, shingle, percent)
    least = known.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    named = join_skewed(known.select("component", "d1", "d2", F.col("n").alias("rows")), least, ["component"]).select("d1", "d2", "least", F.col("rows").alias("n"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    placed = join_skewed(rows.where(linked), named, ["d1", "d2"]).select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    alone = rows.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def kept_texts(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id and text_key of the texts that stay: of each group of linked ones the least, and all without words.

    Other than in ``near_duplicates`` texts that share a doc_id are documents of
    their own. Rows without a doc_id all stay and are not in the result.
    """
    rows, known = classes(docs, shingle, percent, one_by_id=False)
    least = known.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    named = join_skewed(known.select("component", "d1", "d2", "first", F.col("n").alias("rows")), least, ["component"])
    # Of the classes that have the least doc_id one stands for the group, of its texts under that id one.
    standing = named.where(F.col("first") == F.col("least")).groupBy("component", "least").agg(F.min(F.struct("d1", "d2")).alias("d")).select("least", "d.d1", "d.d2")
    here = rows.where("doc_id is not null")
    chosen = here.join(standing, (here["doc_id"] == standing["least"]) & (here["d1"] == standing["d1"]) & (here["d2"] == standing["d2"]), "left_semi")
    one = chosen.where("n_shingles > 0").groupBy("doc_id", "d1", "d2").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key")
    return one.union(here.where("n_shingles = 0").select("doc_id", "text_key").distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
