"""Periodic runs of words: stretches of a text that repeat themselves with a smallest period, and the text without the repeats.

Karp, Miller and Rosenberg's naming inside each task, over many texts at once:

1. Level 0 names each word exactly, within its document. Level k + 1 names a stretch of 2^(k+1) words by the pair of names of its halves,
   which are sorted into integers. Only stretches met twice in a document are named; every other one gets a name of its own, and the
   first level without a repeated stretch ends the table.
2. The longest common extension of two places, forward or backward, is read off by descending the levels: equal names at a level move both
   places by its width.
3. A run of period q holds two places q apart that agree, at a multiple of a grid whose step is the least number of such places. Of the grid's
   candidates those stay that agree over a level's width on one side at least; they are extended both ways. A run is
   found under multiples of its period too, as the same stretch: the smallest stays.

No rolling hashes and no suffix sorting: names are equal when words are equal.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import SPACE, as_text, pick, text_slices

RESULT = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def name_levels(words: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words from each place. words: a name for each word of each document, documents one after
    the other; end: where the place's document ends. A stretch that is met once, or would leave its document, has a
    name that no other one has. The last entry of a level stands for places after the end."""
    n = len(words)
    levels, at, key = [], np.arange(n), words.astype(np.int64) * (n + 1) + end
    width = 1
    while True:
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        if not again.any():
            return levels
        name = np.arange(n, 2 * n + 1)
        name[at[again]] = inverse[again]
        levels.append(name)
        at = at[again]
        at = at[at + 2 * width <= end[at]]
        at = at[name[at + width] < n]
        key = name[at] * n + name[at + width]
        width *= 2


def extensions(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places a < b of one document: how many words agree from there on, and how many before."""
    n = len(levels[0]) - 1
    x, y = a.copy(), b.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][x] == levels[k][np.minimum(y, n)]).astype(np.int64) << k
        x += step
        y += step
    forward = x - a
    x, y = a.copy(), b.copy()
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        step = ((x >= width) & (levels[k][x - width] == levels[k][y - width])).astype(np.int64) << k
        x -= step
        y -= step
    return forward, a - x


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = 12, most_pairs: int = 1 << 20) -> np.ndarray:
    """(start, end, period) of all runs, by start, then period. words: the words' names, document after document; sizes: each document's
    number of words, descending. A run has at least `least` words and two periods."""
    none = np.zeros((0, 3), np.int64)
    n = len(words)
    if not n:
        return none
    ends = np.cumsum(sizes)
    end = np.repeat(ends, sizes)
    levels = name_levels(words, end)
    top = int(sizes[0]) // 2
    if not levels or not top:
        return none
    # A run of period q has at least `need` places that agree with the place q further; one side of any of them has half of these.
    period = np.arange(1, top + 1)
    need = np.maximum(period, least - period)
    level = np.floor(np.log2((need + 1) // 2)).astype(np.int64)
    some = level < len(levels)
    period, need, level = period[some], need[some], level[some]
    long_enough = np.searchsorted(-sizes, -np.maximum(least, 2 * period), side="right")
    reach = np.where(long_enough > 0, ends[np.maximum(long_enough, 1) - 1], 0)
    pairs = np.where(reach > period, -(-(reach - period) // need), 0)
    found, done = [], np.append(0, np.cumsum(pairs))
    first = 0
    while first < len(period):
        last = max(first + 1, int(np.searchsorted(done, done[first] + most_pairs, side="right")) - 1)
        which = np.repeat(np.arange(first, last), pairs[first:last])
        i = (np.arange(len(which)) - (done[which] - done[first])) * need[which]
        q = period[which]
        for k in np.unique(level[first:last]).tolist():
            at = np.flatnonzero(level[which] == k)
            a, b, width, name = i[at], i[at] + q[at], 1 << k, levels[k]
            near = (name[a] == name[b]) | ((a >= width) & (name[a - width] == name[b - width]))
            found.append(np.stack([a[near], q[at][near]]))
        first = last
    a, q = np.hstack(found) if found else np.zeros((2, 0), np.int64)
    if not len(a):
        return none
    forward, back = extensions(levels, a, a + q)
    start, stop = a - back, a + q + forward
    ok = stop - start >= np.maximum(least, 2 * q)
    start, stop, q = start[ok], stop[ok], q[ok]
    order = np.lexsort((q, stop, start))
    start, stop, q = start[order], stop[order], q[order]
    new = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])) if len(start) else np.zeros(0, bool)
    runs = np.stack([start[new], stop[new], q[new]], axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _runs_of(texts: list[bytes], least: int) -> tuple[list[list[dict]], list[bytes]]:
    """Each text's runs, and the text without what they repeat."""
    split = [t.split() for t in texts]  # of bytes: at 0x20 and 0x09-0x0D
    sizes = np.array([len(w) for w in split], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = pa.array([w for i in order.tolist() for w in split[i]], pa.binary()).dictionary_encode()
    names = flat.indices.to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, np.int32)
    found = find_runs(names, sizes[order], least)
    begins = np.append(0, np.cumsum(sizes[order]))
    drops = np.zeros(len(names) + 1, np.int32)
    np.add.at(drops, found[:, 0] + found[:, 2], 1)
    np.add.at(drops, found[:, 1], -1)
    keep = np.cumsum(drops) == 0
    doc = np.searchsorted(begins, found[:, 0], side="right") - 1
    runs: list[list[dict]] = [[] for _ in texts]
    for d, (start, stop, q) in zip(doc.tolist(), found.tolist()):
        runs[int(order[d])].append({"start": start - int(begins[d]), "length": stop - start, "period": q})
    rest = [b""] * len(texts)
    for d, i in enumerate(order.tolist()):
        words = split[i] if not runs[i] else compress(split[i], keep[begins[d] : begins[d + 1]].tolist())
        rest[i] = b" ".join(words)
    return runs, rest


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """One row per row of docs: doc_id, runs, collapsed.

    docs needs doc_id and text; other columns are ignored. Words are runs of bytes other than space and 0x09-0x0D and are compared as
    they are. A run is a stretch of consecutive words with smallest period q, of at least `least` words and two periods, that no
    neighbouring word extends keeping the period; runs gives start (a word's number from 0), length and period of each by start, then
    period. collapsed holds the words outside all runs or among the first q of every run that holds them, joined by one space.
    A null or empty text, or one of white space, has no runs and an empty collapsed text. Null ids and repeated rows are returned as they
    are; no rows give no rows. A text of n words takes up to 8 n log2(n) bytes in its task, less if few of its words repeat.
    """

    def run(batches):
        for batch in batches:
            texts = as_text(batch.column("text"))
            for first, last in text_slices(texts, 1 << 21):
                runs, rest = _runs_of([t.as_buffer().to_pybytes() for t in texts[first:last].cast(pa.large_binary())], least)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], pa.array(runs, kind), pa.array(rest, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, RESULT)


def planted_periods(doc_id: Column, text: Column) -> Column:
    """The text in which the words of every tenth document by h = crc32(doc_id in decimal) repeat: with g = floor(h / 10), n words, a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)), each word i >= a becomes word a + (i - a) % p. Other texts, and those without an id, as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    facts = F.struct(words.alias("w"), F.size(words).cast("long").alias("n"), F.floor(h / 10).alias("g"))

    def changed(x: Column) -> Column:
        a = x["g"] % x["n"]
        p = 1 + F.floor((x["n"] - a) / (3 + x["g"] % 8))
        head = F.slice(x["w"], F.lit(1), a.cast("int"))
        cycle = F.slice(x["w"], (a + 1).cast("int"), p.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((x["n"] - a) / p).cast("int"))), F.lit(1), (x["n"] - a).cast("int"))
        return F.array_join(F.concat(head, tail), " ")

    again = F.element_at(F.transform(F.array(facts), lambda x: F.when(x["n"] > 0, changed(x)).otherwise(F.lit(""))), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), again).otherwise(text)
