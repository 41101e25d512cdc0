"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words here are runs of letters and digits, lower-cased. The best local alignment
of a document with an item, word by word (match 2, other -1, gap -1), as a share
of the item's full score says how much of the item is there, whatever was put
in, left out or replaced. An item is found if the share is ``threshold`` or more
and the score that of three words in a row (of the whole item, if it is shorter).
An item of one or two words is so found wherever its words stand in a row.

Seeds are an item's 2-grams, gapped ones too: a word and the next or next but
one. Where two matches that follow each other in an alignment are further apart
in text or item, at least two words between them cost 1 each; so an alignment of
score S holds at least S / 2 - 1 seeds. Of these an item can do without half:
its seeds that the most documents have, counted over all of them, are left out.
A stretch of a document that holds the other half within the words that a copy
can span is joined to the item and aligned. The count of needed seeds makes this
lose nothing, so rarity costs time only, never a find; runs of three words would
lose every copy with each third word replaced, whose score is still 0.5.

The benchmark is the stated query set: it comes in blocks of ``BLOCK_WORDS``
words, each of which goes to all tasks, and each block is held against all
documents. Texts are read where they lie, once to count seeds and once to align;
only counts are shuffled, one row a seed. The work grows with the words of the
texts and with the items that share their rare word pairs.

A null or empty text holds nothing; an item without words matches nothing.
Items with equal texts are found each under its own id. Rows and columns of the
documents stay as they are, repeated rows too; a column named ``leaks`` is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bigru import _SEPARATORS
from .common import small_batches, table
from .words import Batch, pieces

#: A copy scores at least what so many words in a row (or the whole of a shorter item) do.
GRAM = 3
#: The second word of a seed is one of so many after the first.
SKIPS = (1, 2)
#: Of the seeds that a copy holds at least, the share that may be too frequent to be used.
LEFT_OUT = 1 / 2
#: Seeds of texts times items with them that are held at once.
HITS = 1 << 20
#: Clean documents score 0 to 0.3; a copy with every third word replaced 0.5,
#: though no three of its words in a row are the item's.
THRESHOLD = 0.4
MATCH, OTHER, GAP = 2, -1, -1
BLOCK_WORDS = 1 << 18
CELLS = 1 << 22

LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Most seeds of a text are no item's: a table of flags by their first bits says so.
_FLAGS, _REST = 1 << 22, np.uint64(64 - 22)


class Items:
    """The words of a block of items, and which of them hold each seed.

    ``least`` is the raw score that a copy reaches at least, ``reach`` the words
    it spans at most, ``need`` the used seeds it holds at least.
    """

    def __init__(self, ids: list[int], texts: list[str | None], threshold: float = THRESHOLD):
        batch = Batch(texts, _SEPARATORS)
        self.ids, self.at = ids, batch.at
        self.vocabulary, self.words = np.unique(batch.words, return_inverse=True)
        long = np.diff(batch.at)
        self.least = np.maximum(np.floor(threshold * MATCH * long).astype(np.int64), MATCH * np.minimum(GRAM, long))
        self.reach = np.maximum(0, (MATCH - OTHER) * long - self.least)
        self.single = bool((long == 1).any())
        found = [x for x in _grams(batch, self.single)]
        code, place = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        item = np.searchsorted(batch.at, place, "right") - 1
        alone = np.concatenate([np.full(len(x[0]), x[2] == 0) for x in found])
        code, item = code[alone == (long[item] == 1)], item[alone == (long[item] == 1)]  # one word is the seed of an item of one word only
        self.code, seed = np.unique(code, return_inverse=True)
        pair, self.many = np.unique(seed * max(1, len(ids)) + item, return_counts=True)
        self.seed, self.item = np.divmod(pair, max(1, len(ids)))
        self.held = np.maximum(1, (self.least + 1) // 2 - 1)
        self._use(np.ones(len(self.code), np.int64), np.zeros(len(ids), np.int64))

    def leave_out(self, counts: np.ndarray) -> None:
        """Forget each item's most frequent seeds, as far as its copies can do without, and all that occur nowhere. Once only."""
        self._use(counts, np.where(np.diff(self.at) > 1, self.held * LEFT_OUT, 0).astype(np.int64))

    def _use(self, counts: np.ndarray, allowed: np.ndarray) -> None:
        live = counts[self.seed] > 0
        seed, item, many = self.seed[live], self.item[live], self.many[live]
        order = np.lexsort((seed, -counts[seed], item))
        upto = np.cumsum(many[order])
        first = np.searchsorted(item[order], np.arange(len(self.ids)))
        upto -= np.concatenate(([0], upto))[first][item[order]]
        keep = np.empty(len(seed), bool)
        keep[order] = upto > allowed[item[order]]
        self.need = self.held - np.bincount(item[~keep], many[~keep], len(self.ids)).astype(np.int64)
        used, self.seed = np.unique(seed[keep], return_inverse=True)
        self.code, self.item, self.many = self.code[used], item[keep], many[keep]
        self.first = np.searchsorted(self.seed, np.arange(len(self.code) + 1))
        self.flags = np.zeros(_FLAGS, bool)
        self.flags[self.code >> _REST] = True

    def of(self, k: int) -> np.ndarray:
        return self.words[self.at[k] : self.at[k + 1]]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The numbers of word hashes in the vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def hits(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """First word and seed of all seeds in a batch of texts, in order."""
        places, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.code):
            for code, place, _ in _grams(batch, self.single):
                some = np.flatnonzero(self.flags[code >> _REST])
                at = np.minimum(np.searchsorted(self.code, code[some]), len(self.code) - 1)
                same = self.code[at] == code[some]
                places.append(place[some[same]])
                seeds.append(at[same])
        place, seed = np.concatenate(places), np.concatenate(seeds)
        order = np.argsort(place, kind="stable")
        return place[order], seed[order]

    def near(self, batch: Batch) -> list[tuple[int, int, int, int]]:
        """Text, item, first word and end (exclusive) of all stretches that may hold a copy."""
        place, seed = self.hits(batch)
        per_seed = np.bincount(seed, minlength=len(self.code))
        per_item = np.bincount(self.item, per_seed[self.seed], len(self.ids)).astype(np.int64)
        group = np.cumsum(per_item) // HITS
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
        out: list[tuple[int, int, int, int]] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            some = (self.item >= lo) & (self.item < hi)
            if per_item[lo:hi].any():
                out += self._near(batch, place, seed, np.searchsorted(self.seed[some], np.arange(len(self.code) + 1)), self.item[some])
        return out

    def _near(self, batch: Batch, place: np.ndarray, seed: np.ndarray, first: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int, int]]:
        many = (first[1:] - first[:-1])[seed]
        ends = np.cumsum(many)
        held = item.astype(np.min_scalar_type(len(self.ids)))[np.repeat(first[seed] - ends + many, many) + np.arange(ends[-1])]
        order = np.argsort(held, kind="stable")
        held, place = held[order].astype(np.int64), np.repeat(place, many)[order]
        new = np.ones(len(held), bool)  # a word that begins two seeds counts once
        new[1:] = (held[1:] != held[:-1]) | (place[1:] != place[:-1])
        held, place = held[new], place[new]
        text = np.searchsorted(batch.at, place, "right") - 1
        last = np.arange(len(held)) + self.need[held] - 1
        hit = np.flatnonzero(last < len(held))
        last = last[hit]
        full = (held[last] == held[hit]) & (text[last] == text[hit]) & (place[last] - place[hit] < self.reach[held[hit]])
        hit, last = hit[full], last[full]
        if not len(hit):
            return []
        held, text, reach = held[hit], text[hit], self.reach[held[hit]]
        begin, end = np.maximum(batch.at[text], place[last] + 1 - reach), np.minimum(batch.at[text + 1], place[hit] + reach)
        new = (held[1:] != held[:-1]) | (text[1:] != text[:-1]) | (begin[1:] > end[:-1])
        a, z = np.concatenate(([0], np.flatnonzero(new) + 1)), np.concatenate((np.flatnonzero(new), [len(hit) - 1]))
        return list(zip(text[a].tolist(), held[a].tolist(), begin[a].tolist(), end[z].tolist(), strict=True))


def _grams(batch: Batch, single: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Codes, first words and skip of the word pairs within each text; single words, as skip 0, if asked for."""
    words, end = batch.words, np.repeat(batch.at[1:], np.diff(batch.at))
    for skip in SKIPS:
        place = np.flatnonzero(np.arange(skip, len(words)) < end[: max(0, len(words) - skip)])
        yield words[place] * _ODD + words[place + skip], place, skip
    if single:
        yield words * _ODD, np.arange(len(words)), 0


def best_scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Best raw local scores of (item, stretch) words, numbers from 0 on; a word of -1 equals none."""
    out = np.zeros(len(pairs), np.int64)
    # Pairs of about one width together, as all of a piece are padded to its widest.
    about = [int(2 * np.log2(len(y) + 1)) for _, y in pairs]
    order = sorted(range(len(pairs)), key=lambda k: (about[k], len(pairs[k][0])))
    a = 0
    while a < len(order):
        b, wide = a, 1
        while b < len(order) and about[order[b]] == about[order[a]] and (b == a or (b + 1 - a) * max(wide, len(pairs[order[b]][1])) <= CELLS >> 7):
            wide = max(wide, len(pairs[order[b]][1]))
            b += 1
        some = order[a:b]
        tall = len(pairs[some[-1]][0])
        kind = np.int16 if wide + (MATCH + 1) * tall < 32000 else np.int32
        items, others = np.full((tall, len(some)), -2, np.int32), np.full((wide, len(some)), -1, np.int32)
        for n, k in enumerate(some):
            items[: len(pairs[k][0]), n] = pairs[k][0]
            others[: len(pairs[k][1]), n] = pairs[k][1]
        slope = (np.arange(wide, dtype=kind) * kind(-GAP))[:, None]
        above, most = np.zeros((wide + 1, len(some)), kind), np.zeros((wide, len(some)), kind)
        for row in items:
            here = (others == row) * kind(MATCH - OTHER)
            here += above[:-1]
            here += kind(OTHER)
            np.maximum(here, above[1:] + kind(GAP), out=here)
            np.maximum(here, 0, out=here)
            here += slope
            np.maximum.accumulate(here, axis=0, out=here)
            here -= slope
            np.maximum(most, here, out=most)
            above[1:] = here
        out[some] = most.max(axis=0)
        a = b
    return out


def _align(items: np.ndarray, long: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local scores of rows of two padded word arrays, and where in ``others`` they end.

    A row of the table is one step for all pairs; runs of gaps within it are a
    running maximum, as each further gap costs the same.
    """
    n, width = others.shape
    slope = np.arange(width, dtype=np.int32) * -GAP
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        equal = (others == items[:, i : i + 1]) & (i < long)[:, None] & (others != 0)
        here = np.maximum(above[:, :-1] + np.where(equal, MATCH, OTHER), above[:, 1:] + GAP)
        here = np.maximum(here, 0)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        at = here.argmax(axis=1)
        top = here[np.arange(n), at]
        better = (top > best) & (i < long)
        best[better], end[better] = top[better], at[better]
        above[:, 1:] = here
    return best, end


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    long = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), max(1, long.max())), np.uint64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, long


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, int, int]]:
    """Share of the item's full score, first word and end (exclusive) in the stretch, for (item, stretch) words."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][1]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * len(pairs[order[b]][1]) < CELLS // 16:
            b += 1
        some = order[a:b]
        items, long = _padded([pairs[k][0] for k in some])
        others, _ = _padded([pairs[k][1] for k in some])
        best, end = _align(items, long, others)
        # The same from the end backwards tells where the alignment begins.
        back_items, _ = _padded([pairs[k][0][::-1] for k in some])
        back, _ = _padded([pairs[k][1][: e + 1][::-1] for k, e in zip(some, end, strict=True)])
        from_end = _align(back_items, long, back)[1]
        for n, k in enumerate(some):
            out[k] = (float(best[n]) / (MATCH * max(1, long[n])), int(end[n] - from_end[n]), int(end[n]) + 1)
        a = b
    return out


def _leaks(texts: list[str | None], items: Items, threshold: float) -> list[list[tuple]]:
    found: list[list[tuple]] = [[] for _ in texts]
    batch = Batch(texts, _SEPARATORS)
    near = items.near(batch) if len(items.code) else []
    if not near:
        return found
    change = np.zeros(len(batch.words) + 1, np.int64)
    np.add.at(change, [x for _, _, x, _ in near], 1)
    np.add.at(change, [y for _, _, _, y in near], -1)
    inside = np.cumsum(change[:-1]) > 0
    ids = np.full(len(batch.words), -1)
    ids[inside] = items.numbers(batch.words[inside])
    some = best_scores([(items.of(k), ids[x:y]) for _, k, x, y in near])
    work = [w for w, score in zip(near, some, strict=True) if score >= items.least[w[1]]]
    best: dict[tuple[int, int], tuple] = {}
    for (d, k, x, _), (score, first, end) in zip(work, align([(items.of(k) + 1, ids[x:y] + 1) for _, k, x, y in work]), strict=True):
        if score >= threshold and score > best.get((d, k), (0,))[0]:
            best[d, k] = (score, x + first, x + end)
    for (d, k), (score, first, end) in best.items():
        data = (texts[d] or "").encode("utf-8", "surrogatepass")
        a, z = int(batch.begin[first] - batch.offset[d]), int(batch.end[end - 1] - batch.offset[d])
        start = len(data[:a].decode("utf-8", "surrogatepass"))
        found[d].append((items.ids[k], score, start, start + len(data[a:z].decode("utf-8", "surrogatepass"))))
    return [sorted(x) for x in found]


def seed_counts(docs: DataFrame, text: str, items: Items) -> np.ndarray:
    """In how many documents each seed of a block occurs; one row a seed reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.code), np.int64)
        for whole in batches:
            for _, texts in pieces((None, t.as_py()) for t in whole.column(0)):
                batch = Batch(texts, _SEPARATORS)
                place, seed = items.hits(batch)
                each = np.unique((np.searchsorted(batch.at, place, "right") - 1) * len(total) + seed)
                some, n = np.unique(each % max(1, len(total)), return_counts=True)
                total[some] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["seed", "n"])

    seen = docs.select(F.col(text)).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.code), np.int64)
    out[seen["seed"].to_numpy()] = seen["n"].to_numpy()
    return out


def _blocks(benchmark: DataFrame, threshold: float) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"]) // 4 + 1
        if size >= BLOCK_WORDS:
            yield Items(ids, texts, threshold)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, threshold)


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``leaks``: item_id, score, start and end (code points) of each item found.

    ``docs`` is read once for each block of the benchmark to count seeds, and
    once more by who reads the result.
    """
    small_batches(docs.sparkSession)
    out = docs.drop("leaks").withColumn("leaks", F.array().cast(T.ArrayType(LEAK)))
    at = out.columns.index(text)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    for items in _blocks(benchmark, threshold):
        items.leave_out(seed_counts(docs, text, items))

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 1024):
                    batch = whole.slice(a, 1024)
                    new: list[list[tuple]] = []
                    for _, texts in pieces((None, t.as_py()) for t in batch.column(at)):
                        new += _leaks(texts, items, threshold)
                    old = batch.column(batch.num_columns - 1).to_pylist()
                    both = [o + [dict(zip(("item_id", "score", "start", "end"), x, strict=True)) for x in n] for o, n in zip(old, new, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(both, kind)], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") > 0)
    return found.select("doc_id", F.inline("leaks"))
