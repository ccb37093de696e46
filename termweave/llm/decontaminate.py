"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. The test items are cut into runs of ``SEED`` words, and every run is a seed: an edited copy is found by any run that the
   edits left whole, however common that run is.
2. One pass joins documents to items on the seeds. Around the seeds a window of the document is looked at. A window with fewer
   words of the item than the threshold needs cannot reach it and is passed over; common phrases mostly end here, and nothing
   is lost.
3. Other windows are aligned with the item: local alignment of words, ``MATCH`` for equal words, ``MISMATCH`` for replaced and
   ``GAP`` for inserted or missing ones. The score over the best possible score (all words equal) is the containment of the
   item; edited copies lose little.
4. A document is contaminated from ``threshold`` on.

Items go to the tasks in shares of at most ``ITEM_WORDS`` words, one pass over the documents per share: what a task holds is
bounded whatever the size of the benchmark. No text is shuffled.

Defined results: words ignore case of A-Z and white space; items without words, null texts and empty texts match nothing; an
item shorter than ``SEED`` words is one run of all its words and must stand alone in a text of just these words; a copy without
a whole run of ``SEED`` words is not looked at; every row of a repeated ``doc_id`` is judged by itself; ties go to the smaller item_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import WORD, pieces, shingle_hashes, word_count, word_hashes
from termweave.runtime import cut

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
ITEM_WORDS = 2_000_000
_ALIGN_CELLS = 1 << 22
_HITS_AT_ONCE = 1 << 20

HITS = "item_id long, score double, word_start long, word_end long"


class _Items:
    """Word hashes of a share of the items, and their runs as seeds in the order of their hashes."""

    def __init__(self, ids: np.ndarray, texts: list[str | None]):
        self.ids = ids
        self.words, self.bounds = word_hashes(pa.array(texts, pa.string()))
        runs, item = shingle_hashes(self.words, self.bounds, SEED)
        at = np.arange(len(runs)) - np.searchsorted(item, np.arange(len(ids)))[item]
        order = np.argsort(runs, kind="stable")
        self.seed_hash, self.seed_item, self.seed_at = runs[order], item[order], at[order]
        self.vocabulary, word = np.unique(self.words, return_inverse=True)
        self.has = np.unique(np.repeat(np.arange(len(ids)), np.diff(self.bounds)) * len(self.vocabulary) + word)  # (item, word)


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment score of each row of ``windows`` with the same row of ``item``, and the window columns it spans.

    Cells of value 0 are padding and match nothing.
    """
    rows, width = windows.shape
    columns = np.arange(width + 1, dtype=np.int32)
    h = np.zeros((rows, width + 1), np.int32)
    origin = np.broadcast_to(columns, h.shape).copy()  # column where the alignment of a cell began
    best, best_from, best_to = (np.zeros(rows, np.int32) for _ in range(3))
    for i in range(item.shape[1]):
        word = item[:, i : i + 1]
        gain = np.where((windows == word) & (word != 0), MATCH, MISMATCH).astype(np.int32)
        diagonal = h[:, :-1] + gain
        up = h[:, 1:] + GAP
        new, start = np.zeros_like(h), np.broadcast_to(columns, h.shape).copy()
        take = np.maximum(diagonal, up)
        live = take > 0
        new[:, 1:] = np.where(live, take, 0)
        start[:, 1:] = np.where(live, np.where(diagonal >= up, origin[:, :-1], origin[:, 1:]), start[:, 1:])
        # Runs of words that only the window has: a running maximum along the row.
        lifted = new - GAP * columns
        source = np.maximum.accumulate(np.where(lifted >= np.maximum.accumulate(lifted, axis=1), columns, 0), axis=1)
        carried = np.take_along_axis(lifted, source, axis=1) + GAP * columns
        moved = carried > new
        new = np.where(moved, carried, new)
        start = np.where(moved, np.take_along_axis(start, source, axis=1), start)
        h, origin = new, start
        top = h.argmax(axis=1)
        value = h[np.arange(rows), top]
        better = value > best
        best, best_to = np.where(better, value, best), np.where(better, top, best_to)
        best_from = np.where(better, origin[np.arange(rows), top], best_from)
    return best, best_from, best_to


def _candidates(items: _Items, words: np.ndarray, bounds: np.ndarray, threshold: float):
    """(row, item, from, to) of document windows around seeds, near ones of the same row and item merged.

    Windows that cannot reach the threshold are left out. Goes by ranges of items with a bounded number of hits each; an item's
    windows do not depend on the range.
    """
    runs, row = shingle_hashes(words, bounds, SEED)
    low = np.searchsorted(items.seed_hash, runs)
    hit = np.flatnonzero(items.seed_hash[np.minimum(low, len(items.seed_hash) - 1)] == runs)
    change = np.bincount(low[hit], minlength=len(items.seed_hash) + 1)
    change -= np.bincount(np.searchsorted(items.seed_hash, runs[hit], "right"), minlength=len(change))
    hits = np.bincount(items.seed_item, np.cumsum(change)[:-1], minlength=len(items.ids)).astype(np.int64)
    part = (np.cumsum(hits) // _HITS_AT_ONCE)[items.seed_item]
    at = np.minimum(np.searchsorted(items.vocabulary, words), len(items.vocabulary) - 1)
    word = np.where(items.vocabulary[at] == words, at, -1)
    found = [np.empty((4, 0), np.int64)]
    for p in np.unique(part[np.flatnonzero(hits[items.seed_item])]):
        windows = _windows(items, np.flatnonzero(part == p), runs[hit], hit, row, bounds)
        found.append(np.stack(windows)[:, _may_reach(items, word, bounds, threshold, *windows)])
    return np.concatenate(found, axis=1)


def _may_reach(items: _Items, word: np.ndarray, bounds: np.ndarray, threshold: float, row, item, begin, end) -> np.ndarray:
    """Whether a window has as many words of its item as an alignment at the threshold needs."""
    able = np.zeros(len(row), bool)
    size = end - begin
    total = np.cumsum(size)
    start = 0
    while start < len(row):
        stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + _HITS_AT_ONCE, "right")), start + 1)
        part = slice(start, stop)
        window = np.repeat(np.arange(stop - start), size[part])
        place = np.arange(len(window)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        w = word[(bounds[row[part]] + begin[part])[window] + place]
        key = item[part][window] * len(items.vocabulary) + w
        same = (w >= 0) & (items.has[np.minimum(np.searchsorted(items.has, key), len(items.has) - 1)] == key)
        able[part] = np.bincount(window[same], minlength=stop - start) >= threshold * np.diff(items.bounds)[item[part]] - 1e-6
        start = stop
    return able


def _windows(items: _Items, seeds: np.ndarray, runs: np.ndarray, hit: np.ndarray, row: np.ndarray, bounds: np.ndarray):
    """(row, item, from, to) around the hits of some of the seeds, without the test of ``_may_reach``."""
    hashes = items.seed_hash[seeds]
    low = np.searchsorted(hashes, runs)
    several = np.searchsorted(hashes, runs, "right") - low
    seed = seeds[np.repeat(low - np.cumsum(several) + several, several) + np.arange(several.sum())]
    hit = np.repeat(hit, several)
    row_of, item = row[hit], items.seed_item[seed]
    length = np.diff(items.bounds)[item]
    begin = hit - np.searchsorted(row, row_of) - items.seed_at[seed] - length // 2  # in words of the row
    end = begin + 2 * length
    order = np.lexsort((begin, item, row_of))
    row_of, item, begin, end = row_of[order], item[order], begin[order], end[order]
    size = np.diff(bounds)[row_of]
    begin, end = np.clip(begin, 0, size), np.clip(end, 0, size)
    # Windows of one item in one row that start within an item's length of the one before are one window of bounded growth:
    # a window is at most three items long, then a new one starts (they overlap by their margins).
    length = np.diff(items.bounds)[item]
    same = np.zeros(len(item), bool)
    same[1:] = (row_of[1:] == row_of[:-1]) & (item[1:] == item[:-1])
    group = np.cumsum(~same) - 1
    base = begin[np.flatnonzero(~same)][group]
    cell = (begin - base) // np.maximum(length, 1)
    change = ~same
    change[1:] |= cell[1:] != cell[:-1]
    starts = np.flatnonzero(change)
    return [row_of[starts], item[starts], begin[starts], np.maximum.reduceat(end, starts)]


def _score(items: _Items, words: np.ndarray, bounds: np.ndarray, threshold: float):
    """(row, item, score, from, to) for all candidates."""
    row, item, begin, end = _candidates(items, words, bounds, threshold)
    lengths = np.diff(items.bounds)[item]
    score, first, last = np.zeros(len(row)), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    order = np.argsort(lengths * (1 << 32) + (end - begin), kind="stable")  # alike sizes share an array
    i = 0
    while i < len(order):
        j = i + 1
        m, width = int(lengths[order[i]]), int(end[order[i]] - begin[order[i]])
        while j < len(order):
            m2, w2 = int(lengths[order[j]]), max(width, int(end[order[j]] - begin[order[j]]))
            if m2 > 1.2 * m + 8 or (j - i + 1) * (w2 + 1) > _ALIGN_CELLS // 16:
                break
            width, j = w2, j + 1
        part = order[i:j]
        m = int(lengths[part].max())
        offsets = np.arange(m)
        item_words = np.where(offsets < lengths[part, None], items.words[np.minimum(items.bounds[item[part], None] + offsets, len(items.words) - 1)], 0)
        columns = np.arange(width)
        at = bounds[row[part], None] + begin[part, None] + columns
        windows = np.where(columns < (end - begin)[part, None], words[np.minimum(at, len(words) - 1)], 0)
        best, f, t = align(item_words, windows)
        score[part] = best / (MATCH * lengths[part])
        first[part], last[part] = begin[part] + f, begin[part] + t
        i = j
    return row, item, score, first, last


def _shares(benchmark: DataFrame) -> Iterator[tuple[_Items, bool]]:
    """The items in shares of bounded size, one at a time, and whether another share follows."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items = items.where("item_id IS NOT NULL").where(F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    total = items.agg(F.sum(word_count("text"))).first()[0] or 0
    n = max(1, -(-2 * total // ITEM_WORDS))
    for share in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == share).orderBy("item_id", "text").collect()
        if rows:
            yield _Items(np.array([r.item_id for r in rows]), [r.text for r in rows]), share + 1 < n


def _for_each_share(docs: DataFrame, benchmark: DataFrame, step) -> DataFrame:
    for items, more in _shares(benchmark):
        docs = docs.mapInArrow(step(items), docs.schema)
        if more:  # a task holds one share
            docs = cut(docs)
    return docs


def _update(threshold: float):
    """Replace the hit of a row by a better one among these items."""

    def step(items: _Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, "text"):
                    row, item, score, first, last = _score(items, *word_hashes(batch.column("text")), threshold)
                    hits = {n: batch.column(n).to_pylist() for n in ("item_id", "score", "word_start", "word_end")}
                    for r, new in zip(row.tolist(), zip((-score).tolist(), items.ids[item].tolist(), first.tolist(), last.tolist())):
                        old = hits["score"][r]
                        if -new[0] >= threshold and (old is None or new < (-old, *(hits[n][r] for n in ("item_id", "word_start", "word_end")))):
                            hits["score"][r] = -new[0]
                            hits["item_id"][r], hits["word_start"][r], hits["word_end"][r] = new[1:]
                    columns = [pa.array(hits[f.name], f.type) if f.name in hits else batch.column(f.name) for f in batch.schema]
                    yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return run

    return step


def _without(threshold: float):
    def step(items: _Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, "text"):
                    row, _, score, _, _ = _score(items, *word_hashes(batch.column("text")), threshold)
                    keep = np.ones(batch.num_rows, bool)
                    keep[row[score >= threshold]] = False
                    yield batch.filter(pa.array(keep))

        return run

    return step


def best_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, score, word_start, word_end)``: the best aligned item of each row; nulls where none fits."""
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, HITS.split(", "))],
    )
    return _for_each_share(rows, benchmark, _update(threshold)).drop("text")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold a test item, each row judged by its own text."""
    return _for_each_share(docs, benchmark, _without(threshold))
