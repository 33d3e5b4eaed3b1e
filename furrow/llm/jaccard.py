"""N-gram Jaccard join: every link between documents whose shingle sets have Jaccard similarity of
`percent` or more, and the components that the links make.

1. A pass over the texts names each document's set by 128 bits, with a hashed bitmap; equal sets are
   one from here on. The same pass finds shingles that many sets of a batch share.
2. A second pass deals each set into tiles: two sets that link share one of their first
   ``n - ceil(percent * n) + 1`` shingles in any order common to all sets. The order puts the
   shared shingles of step 1 last, so that a passage which thousands of documents hold makes no tile of
   thousands. The order is a matter of speed only: any list of shared shingles gives the same links. Tiles are cut into lists by
   size bands: the sets of a band and those of the next one, as sets further apart in size can't link. Lists with the same
   sets are one from here on; large ones are cut into blocks.
3. In each block every set is held against the block's first one, and these against the list's first; lists of up to three sets have
   as many pairs as that and go to step 4 at once. The bitmaps' bit counts bound the overlap from above; the likeliest pairs of each set
   that pass are confirmed by exact intersection of sorted arrays. This joins large groups of near copies in few comparisons.
4. In lists whose sets still lie in different components, all pairs of sets of different components are held against sizes and
   bitmaps inside tasks, in large lists by blocks. No pair that these rule out leaves its task. A set of small lists travels to each of them with a
   bitmap folded to a quarter; different pairs that it lets pass are held against the whole bitmaps next. Of a large list a task hands on
   each component's likeliest pairs, to be confirmed exactly, and more of them in the next round, until
   none is left. Pairs inside one component are not looked at: their link would change nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import as_text, binary16, checkpointed, from_binary16, pick, scratch, written
from furrow.llm.components import components
from furrow.llm.shingles import mix, set_name, shingle_sets

LEAST_BITS = 256


def bitmap(shingles: np.ndarray) -> bytes:
    """A hashed bitmap signature with four to eight bits a shingle, a power of two."""
    width = max(LEAST_BITS, 1 << int(4 * len(shingles) - 1).bit_length()) if len(shingles) else LEAST_BITS
    bits = np.zeros(width, np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: list[bytes], size: int) -> np.ndarray:
    """(n, words) of bitmaps of one size folded to `size` bytes: the bitmaps that a narrower width would have given."""
    x = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1, size // 8)
    return np.bitwise_or.reduce(x, axis=1)


def _folded(by: int):
    """Rows (sid, n, bits) with the bitmaps folded to 1 / by of their width, LEAST_BITS at least."""

    def run(batches):
        for batch in batches:
            bits = [fold([x], max(LEAST_BITS // 8, len(x) // by)).tobytes() for x in batch.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("n"), pa.array(bits, pa.binary())], names=["sid", "n", "bits"])

    return run


def only_bits(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits each of two bitmaps has alone."""
    return np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64)


def may_link(na, nb, only_a, only_b, percent: int):
    """False only if the sets can't link: each bit that one bitmap alone has stands for at least one shingle that one set
    alone has, so the overlap is at most na - only_a and nb - only_b."""
    overlap = np.minimum(na - only_a, nb - only_b)
    return (overlap > 0) & (100 * overlap >= percent * (na + nb - overlap))


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def bands(percent: int) -> np.ndarray:
    """The least size of each band: sets that can link lie in the same band or in neighbouring ones. At most 128 bands."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] * 100 // percent, out[-1] * 5 // 4) + 1)
    return np.array(out, np.int64)


def _describe(percent: int, width: int, common: int):
    """Pass 1: kind 0 rows (doc_id, n, sid, bits), kind 1 rows (shingle, count) for those in `common` sets of a batch."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            n, names, bits, seen, kept = [], [], [], set(), []
            for _, x in shingle_sets(as_text(batch.column("text")), width):
                name = set_name(x)
                n.append(len(x))
                names.append(name)
                bits.append(bitmap(x))
                if len(x) and name not in seen:
                    seen.add(name)
                    kept.append(x)
            hot, count = np.empty(0, np.uint64), np.empty(0, np.int64)
            if kept:
                hot, count = np.unique(np.concatenate(kept), return_counts=True)
                hot, count = hot[count >= common], count[count >= common]
            d, h = len(n), len(hot)
            nulls = pa.nulls(h)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [d, h]).astype(np.int32)),
                    pa.concat_arrays([ids, nulls.cast(ids.type)]),
                    pa.concat_arrays([pa.array(n, pa.int64()), pa.array(count, pa.int64())]),
                    pa.concat_arrays([binary16(np.array(names, np.uint64).reshape(d, 2)), nulls.cast(pa.binary())]),
                    pa.concat_arrays([pa.array(bits, pa.binary()), nulls.cast(pa.binary())]),
                    pa.concat_arrays([pa.nulls(d, pa.int64()), pa.array(hot.view(np.int64))]),
                ],
                names=["kind", "doc_id", "n", "sid", "bits", "shingle"],
            )

    return run


def _common_shingles(described: DataFrame, least: int, most: int) -> np.ndarray:
    """Sorted hashes of the shingles that most sets share, at most `most` of them (8 bytes each, broadcast)."""
    counts = described.where("kind = 1").groupBy("shingle").agg(F.sum("n").alias("sets")).where(F.col("sets") >= least)
    counts = counts.withColumn("step", F.floor(F.log2("sets")))
    kept, cut = 0, 63
    for step, n in sorted(((r["step"], r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True):
        if kept + n > most:
            break
        kept, cut = kept + n, step
    hot = counts.where(F.col("step") >= cut).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    return np.sort(hot.view(np.uint64))


def _deal(percent: int, width: int, hot):
    """Pass 2: (tile, sid) for each tile of each different set of a batch. The last seven bits of a tile are the set's size band."""

    def run(batches):
        shared, least = hot.value, bands(percent)
        for batch in batches:
            seen, tiles, sids, counts = set(), [], [], []
            for _, x in shingle_sets(as_text(batch.column("text")), width):
                if not len(x) or (name := set_name(x)) in seen:
                    continue
                seen.add(name)
                p = prefix_length(len(x), percent)
                if len(shared):
                    at = np.searchsorted(shared, x)
                    last = shared[np.minimum(at, len(shared) - 1)] == x
                    x = np.concatenate([x[~last], x[last]])
                band = np.searchsorted(least, len(x), side="right") - 1
                tiles.append(x[:p] & ~np.uint64(127) | np.uint64(band))
                sids.append(name)
                counts.append(p)
            if tiles:
                names = np.repeat(np.array(sids, np.uint64).reshape(-1, 2), counts, axis=0)
                tile = np.concatenate(tiles).view(np.int64)
                for i in range(0, len(tile), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(tile[i : i + 100_000]), binary16(names[i : i + 100_000])], names=["tile", "sid"])

    return run


def _meet(most: int = 1 << 20):
    """Rows sorted by (tile, sid) to (list, sid). A tile's sids of one band and of the next make a list; so do those of one band without
    neighbours, if there are several. A list is named by its sids; of those with one name that meet in a task, one is
    handed on. A tile of more than `most` sids is passed on in parts, its lists being named by tile and band."""

    def batch_of(names, sid):
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), binary16(sid)], names=["list", "sid"])

    def in_parts(tile, sid):
        names = [mix(tile.view(np.uint64) - np.uint64(back), 14) for back in (0, 1)]
        return batch_of(np.concatenate(names), np.vstack([sid, sid]))

    def run(batches):
        held, seen, part = None, set(), False

        def lists(tile, sid):
            begins = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            ends = np.append(begins[1:], len(tile))
            group = tile[begins]
            follows = np.append((group[1:] == group[:-1] + 1) & (group[1:] >> 7 == group[:-1] >> 7), False)
            alone = ~follows & ~np.append(False, follows[:-1]) & (ends - begins > 1)
            first = np.concatenate([begins[follows], begins[alone]])
            last = np.concatenate([ends[np.flatnonzero(follows) + 1], ends[alone]])
            sums = np.append(np.uint64(0), np.cumsum(mix(sid[:, 0] + mix(sid[:, 1], 11), 12), dtype=np.uint64))
            names = mix(sums[last] - sums[first] + (last - first).astype(np.uint64), 13)
            _, at = np.unique(names, return_index=True)
            at = at[[x not in seen for x in names[at].tolist()]] if len(at) else at
            if len(seen) > 1 << 19:  # a bound of memory; a list handed on twice does no harm
                seen.clear()
            seen.update(names[at].tolist())
            size = last[at] - first[at]
            rows = np.repeat(first[at] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()) if len(at) else np.empty(0, np.int64)
            return batch_of(np.repeat(names[at], size), sid[rows])

        for batch in batches:
            if not batch.num_rows:
                continue
            tile, sid = batch.column("tile").to_numpy(zero_copy_only=False), from_binary16(batch.column("sid"))
            if held is not None:
                tile, sid = np.append(held[0], tile), np.vstack([held[1], sid])
            new = np.append(True, (tile[1:] != tile[:-1]) | (sid[1:] != sid[:-1]).any(axis=1))
            tile, sid = tile[new], sid[new]
            last = int(np.searchsorted(tile, tile[-1] >> 7 << 7))
            if part:
                # What goes on with the tile that was passed on in parts; its last row, held for comparison, went out before.
                n = int(np.searchsorted(tile, (tile[0] >> 7) + 1 << 7)) if last else len(tile)
                if n > 1:
                    yield in_parts(tile[1:n], sid[1:n])
                if last:
                    tile, sid, last, part = tile[n:], sid[n:], last - n, False
                else:
                    tile, sid = tile[-1:], sid[-1:]
            if last:
                yield lists(tile[:last], sid[:last])
                tile, sid = tile[last:], sid[last:]
            if len(tile) > most:
                yield in_parts(tile, sid)
                tile, sid, part = tile[-1:], sid[-1:], True
            held = (tile.copy(), sid.copy())
        if held is not None and not part:
            yield lists(*held)

    return run


class _Bitmaps:
    """Bitmaps of several widths, to be compared in pairs, folded to the narrower one's width."""

    def __init__(self, bits: list[bytes]):
        widths = np.array([len(x) for x in bits], np.int64)
        self.width, self.place, self.rows = widths, np.zeros(len(bits), np.int64), {}
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = fold([bits[i] for i in at], w)

    def alone(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits each of x[i] and y[i] has alone."""
        only_x, only_y = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        both = np.stack([self.width[x], self.width[y]], axis=1)
        for w, v in np.unique(both, axis=0).tolist():
            size = min(w, v)
            p, q = (self.rows[k].reshape(len(self.rows[k]), -1, size // 8) for k in (w, v))
            p, q = np.bitwise_or.reduce(p, axis=1), np.bitwise_or.reduce(q, axis=1)
            at = np.flatnonzero((both == (w, v)).all(axis=1))
            for i in range(0, len(at), max(1, (16 << 20) // size)):
                k = at[i : i + max(1, (16 << 20) // size)]
                only_x[k], only_y[k] = only_bits(p[self.place[x[k]]], q[self.place[y[k]]])
        return only_x, only_y


def _sizes_fit(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


_OWN = "list long, part long, blocks int, sid binary, n long, bits binary, lead binary, gap long"


def _stars(percent: int):
    """Rows (list, part, blocks, sid, n, bits) sorted by (part, sid), with the part's first sid as lead, and as gap the bits that one of
    the two alone has; null for the lead itself and where sizes or bitmaps rule a link out."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            sid, bits = batch.column("sid").to_pylist(), batch.column("bits").to_pylist()
            if held is not None:
                part, n, sid, bits = np.append(held[0], part), np.append(held[1], n), [held[2], *sid], [held[3], *bits]
            begin = np.append(True, part[1:] != part[:-1])
            lead = np.maximum.accumulate(np.where(begin, np.arange(len(part)), 0))
            y = np.flatnonzero((lead != np.arange(len(part))) & _sizes_fit(n[lead], n, percent))
            only_lead, only_own = _Bitmaps(bits).alone(lead[y], y)
            ok = may_link(n[lead[y]], n[y], only_lead, only_own, percent)
            gap = np.full(len(part), -1, np.int64)
            gap[y[ok]] = (only_lead + only_own)[ok]
            leads = [sid[i] for i in lead.tolist()]
            first = 0 if held is None else 1
            i = int(lead[-1])
            held = (part[i], n[i], sid[i], bits[i])
            gaps = pa.array(gap[first:], mask=gap[first:] < 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("list", "part", "blocks", "sid", "n", "bits")), pa.array(leads[first:], pa.binary()), gaps], names=[c.split()[0] for c in _OWN.split(", ")])

    return run


def _filter_bits(sids: DataFrame, bits: int) -> bytes:
    """A Bloom filter of `bits` bits over 16-byte names; its size doesn't follow the data."""

    def run(batches):
        for batch in batches:
            at = np.concatenate(_places(from_binary16(batch.column("sid")), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    words = sids.select("sid").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64).view(np.uint64)
    return out.tobytes()


def _places(names: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(names[:, 0] ^ names[:, 1], 7 + k) & np.uint64(bits - 1)).astype(np.int64) for k in range(2)]


def _fetch(width: int, wanted, bits: int):
    """(sid, shingles) for the sets that may be wanted."""

    def run(batches):
        want = np.frombuffer(wanted.value, np.uint64)
        for batch in batches:
            seen, sids, sets, size = set(), [], [], 0
            for _, x in shingle_sets(as_text(batch.column("text")), width):
                name = set_name(x)
                if not len(x) or name in seen:
                    continue
                seen.add(name)
                at = [int(h[0]) for h in _places(np.array([name], np.uint64), bits)]
                if all(int(want[h >> 6]) >> (h & 63) & 1 for h in at):
                    sids.append(name)
                    sets.append(x.tobytes())
                    size += len(x) * 8
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([binary16(np.array(sids, np.uint64)), pa.array(sets, pa.binary())], names=["sid", "shingles"])
                    sids, sets, size = [], [], 0
            if sids:
                yield pa.RecordBatch.from_arrays([binary16(np.array(sids, np.uint64)), pa.array(sets, pa.binary())], names=["sid", "shingles"])

    return run


def _confirm(percent: int):
    """Rows (a, b, set_a, set_b) to the (a, b) that link: exact intersection of the sorted arrays."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("set_a")[i].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column("set_b")[i].as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _sets(pairs: DataFrame, texts: DataFrame, known: DataFrame | None, width: int, most_bits: int) -> DataFrame:
    """(sid, shingles) of all sets in pairs (a, b), and a few more: those known, and what is missing by one pass over the texts."""
    missing = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    missing = checkpointed(missing if known is None else missing.join(known.select("sid"), "sid", "left_anti"))
    n = missing.count()
    if known is not None and not n:
        return known
    bits = min(most_bits, max(1 << 16, 1 << int(16 * n).bit_length()))
    wanted = pairs.sparkSession.sparkContext.broadcast(_filter_bits(missing, bits))
    found = texts.select("text").mapInArrow(_fetch(width, wanted, bits), "sid binary, shingles binary")
    found = found.join(missing, "sid", "left_semi").dropDuplicates(["sid"])
    return checkpointed(found if known is None else known.union(found))


def _may_pass(percent: int):
    """Rows (a, b, n_a, n_b, bits_a, bits_b) to the (a, b) that the bitmaps don't rule out."""

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            both = _Bitmaps([*batch.column("bits_a").to_pylist(), *batch.column("bits_b").to_pylist()])
            only_a, only_b = both.alone(np.arange(m), np.arange(m, 2 * m))
            ok = pa.array(may_link(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), only_a, only_b, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return run


def _wanted(table: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The rows of a table, keyed by a side of pairs, that pairs have: only these move for the join that follows."""
    return table.join(pairs.select(side), side, "left_semi")


def _linking(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set names that link."""
    met = pairs.select("a", "b").join(_wanted(sets.toDF("b", "set_b"), pairs, "b"), "b").join(_wanted(sets.toDF("a", "set_a"), pairs, "a"), "a")
    return checkpointed(met.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a binary, b binary"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _labels(links: DataFrame) -> DataFrame:
    """(sid, label): a set's component, named by its least set's 128 bits."""
    return components(links).select(F.col("node").alias("sid"), "label")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose sets lie in different components; a set without links is one of its own."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.withColumnRenamed("sid", side), side, "left").withColumn(f"of_{side}", F.coalesce("label", side)).drop("label")
    return pairs.where("of_a <> of_b").drop("of_a", "of_b")


def _likeliest(comp: np.ndarray, x: np.ndarray, y: np.ndarray, gap: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (x, y) are among the `most` with the least gap of either one's component."""
    keep = np.zeros(len(x), bool)
    for side in (x, y):
        order = np.lexsort((gap, comp[side]))
        c = comp[side][order]
        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.empty(0, int)
        rank = np.arange(len(c)) - np.repeat(starts, np.diff(np.append(starts, len(c))))
        keep[order[rank < most]] = True
    return keep


def _near(percent: int):
    """Rows (list, sid, n, label, bits) sorted by list, for lists of a few sets, to the pairs of a list with different labels that
    sizes and bitmaps don't rule out; `more` is false."""

    def pairs(lists, n, label, sid, bits):
        found = []
        for k in range(1, len(lists)):
            at = np.flatnonzero(lists[k:] == lists[:-k])
            if not len(at):
                break
            ok = (label[at] != label[at + k]) & _sizes_fit(n[at], n[at + k], percent)
            found.append(np.stack([at[ok], at[ok] + k]))
        x, y = np.hstack(found) if found else np.zeros((2, 0), np.int64)
        if not len(x):
            return None
        number: dict[bytes, int] = {}
        who = np.array([number.setdefault(s, len(number)) for s in sid], np.int64)
        _, once = np.unique(np.minimum(who[x], who[y]) * len(number) + np.maximum(who[x], who[y]), return_index=True)
        x, y = x[once], y[once]
        only_x, only_y = _Bitmaps(bits).alone(x, y)
        ok = may_link(n[x], n[y], only_x, only_y, percent)
        a, b = (pa.array([sid[i] for i in side[ok].tolist()], pa.binary()) for side in (x, y))
        return pa.RecordBatch.from_arrays([a, b, pa.array([False] * len(a), pa.bool_())], names=["a", "b", "more"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(batch.column(c).to_numpy() for c in ("list", "n")), *(np.array(batch.column(c).to_pylist(), object) for c in ("label", "sid", "bits"))]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(now[0], now[0][-1]))
            held = [x[last:] for x in now]
            if last and (out := pairs(*[x[:last] for x in now])) is not None:
                yield out
        if held is not None and (out := pairs(*held)) is not None:
            yield out

    return run


def _across(percent: int, most: int):
    """Pairs of different components in one pair of blocks of a list that sizes and bitmaps don't rule out: for each component the
    `most` likeliest ones; `more` tells whether there are others."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[1], key[2]
        group = group.drop_duplicates("sid")
        n = group["n"].to_numpy(np.int64)
        comp = pd.factorize(group["label"])[0]
        block = group["block"].to_numpy()
        size = group["bits"].map(len).min()
        bits = np.vstack([fold([x], size) for x in group["bits"]])
        sids, found = group["sid"].to_numpy(), []
        for i in np.flatnonzero(block == lo):
            rest = (block == hi) & (comp != comp[i])
            if lo == hi:
                rest[: i + 1] = False
            rest &= _sizes_fit(n, n[i], percent)
            j = np.flatnonzero(rest)
            if len(j):
                only_i, only_j = only_bits(bits[i], bits[j])
                ok = may_link(n[i], n[j], only_i, only_j, percent)
                found.append(np.stack([np.full(ok.sum(), i), j[ok], (only_i + only_j)[ok]]))
        x, y, gap = np.hstack(found) if found else np.zeros((3, 0), np.int64)
        keep = _likeliest(comp, x, y, gap, most)
        return pd.DataFrame({"a": pd.Series(list(sids[x[keep]]), dtype=object), "b": pd.Series(list(sids[y[keep]]), dtype=object), "more": bool(not keep.all())})

    return run


def _pairs_between(members: DataFrame, facts: DataFrame, thin: DataFrame, percent: int, most: int, few: int, block: int, small: bool) -> DataFrame:
    """(a, b, more), a before b: pairs of different components from lists (list, sid, label, m) of m sets that hold several; those of
    large lists, and with `small` those of lists of a few. thin: the facts with folded bitmaps."""
    columns = "a binary, b binary, more boolean"
    blocks = F.ceil(F.col("m") / block).cast("int")
    large = members.where(F.col("m") > few)
    cut = large.join(_wanted(facts, checkpointed(large.select("sid").distinct()), "sid"), "sid").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks").cast("long")).cast("int"))
    dealt = (
        cut.select("list", "sid", "label", "n", "bits", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
    )
    out = dealt.groupBy("list", "lo", "hi").applyInPandas(_across(percent, most), columns)
    if small:
        near = members.where(F.col("m") <= few).join(thin, "sid").select("list", "sid", "n", "label", "bits")
        near = near.repartition("list").sortWithinPartitions("list").mapInArrow(_near(percent), columns)
        met = near = checkpointed(_ordered(near).distinct())
        for side in ("b", "a"):
            near = near.join(_wanted(facts.toDF(side, f"n_{side}", f"bits_{side}"), met, side), side)
        near = near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_may_pass(percent), "a binary, b binary")
        out = out.union(near.withColumn("more", F.lit(False)))
    return checkpointed(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "more"))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(list, sid, label, m) of the lists (list, sid) of m sets that hold several components."""
    named = members.join(labels, "sid", "left").select("list", "sid", F.coalesce("label", "sid").alias("label"))
    several = named.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y").select("list", "m")
    return checkpointed(named.join(several, "list"))


def jaccard_classes(
    docs: DataFrame,
    percent: int = 80,
    width: int = 5,
    common: int = 3,
    least_common: int = 8,
    most_common: int = 1 << 21,
    block: int = 2048,
    few: int | None = None,
    most_bits: int = 1 << 27,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    docs needs doc_id (a number, or bytes) and text; other columns are ignored. A-Z count as a-z; words are runs of bytes other than
    space and 0x09-0x0D. A set holds the distinct shingles of `width` words; a text with fewer words
    has its whole sequence as one; a null text or one without words has an empty set, links with nothing and
    is its own component. Two rows link when 100 * intersection >= percent * union. component_id is the
    smallest doc_id reachable by links. Repeated rows are each returned. No rows give no rows.
    Shingles count by 64-bit hash, sets by 128-bit hash. The result is a written table (see common.scratch).

    common, least_common, most_common: which shingles go last in the order (in so many sets of one batch, so many
    in all, and the length of the list, which is broadcast: 8 bytes each). block: sets in a block of a large list; few: sets in a list
    that is held against itself whole (block / 64). most_bits: the greatest size of the broadcast Bloom filter, of 16 bits a set wanted, that
    spares sending unwanted sets.
    """
    with scratch(docs.sparkSession) as result:
        return result(_classes(docs, percent, width, common, least_common, most_common, block, few or block // 64, most_bits))


def _classes(docs, percent, width, common, least_common, most_common, block, few, most_bits) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    kind = kind if kind == "binary" else "bigint"
    texts = pick(docs, doc_id=kind, text="string")
    described = written(
        texts.mapInArrow(_describe(percent, width, common), f"kind int, doc_id {kind}, n long, sid binary, bits binary, shingle long"), "described"
    )
    rows = described.where("kind = 0").select("doc_id", "n", "sid")

    hot = spark.sparkContext.broadcast(_common_shingles(described, least_common, most_common))
    dealt = texts.select("text").mapInArrow(_deal(percent, width, hot), "tile long, sid binary")
    met = dealt.repartition(F.shiftright("tile", 7)).sortWithinPartitions("tile", "sid").mapInArrow(_meet(), "list long, sid binary")
    lists = written(met.repartition("list").distinct(), "lists")
    sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("m")).where("m > 3").select("list", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    part = F.xxhash64("list", F.pmod(F.xxhash64("sid"), F.col("blocks").cast("long")))
    facts = written(described.where("kind = 0 and n > 0").select("sid", "n", "bits").join(lists.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "facts")
    thin = written(facts.mapInArrow(_folded(4), "sid binary, n long, bits binary"), "thin")
    cut = lists.join(sizes, "list").withColumn("part", part).join(facts, "sid").select("list", "part", "blocks", "sid", "n", "bits")
    own = checkpointed(cut.repartition("part").sortWithinPartitions("part", "sid").mapInArrow(_stars(percent), _OWN).drop("bits"))
    tops = checkpointed(own.where("blocks > 1 and lead = sid").select("list", "blocks", "sid"))
    tops = tops.join(_wanted(facts, tops, "sid"), "sid").select("list", F.col("list").alias("part"), "blocks", "sid", "n", "bits")
    tops = tops.repartition("part").sortWithinPartitions("part", "sid").mapInArrow(_stars(percent), _OWN).drop("bits")
    likely = own.union(tops).where("gap is not null").select(F.col("lead").alias("a"), F.col("sid").alias("b"), "gap")
    likely = checkpointed(likely.groupBy("a", "b").agg(F.min("gap").alias("gap")))

    # Two rounds over the pairs with blocks' first sets join nearly all copies: each set's likeliest pair, then four of those still apart.
    sets = _sets(likely, texts, None, width, most_bits)
    best = checkpointed(likely.groupBy("b").agg(F.min(F.struct("gap", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"))
    links = _linking(best, sets, percent)
    tested = _ordered(best)
    labels = _labels(links)
    ranked = _apart(likely, labels).withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy("gap", "a"))).where("i <= 4")
    second = checkpointed(_ordered(ranked).join(tested, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        links = links.union(_linking(second, sets, percent))
        tested = tested.union(second)
        labels = _labels(links)

    # Whatever pairs are left between components; each round looks at more of those of a component that found no link among its likeliest.
    members, first, more = lists, 4, True
    most = first
    while more:
        members = _unsettled(members.select("list", "sid"), labels)
        found = _pairs_between(members, facts, thin, percent, most, few, block, most == first)
        more = bool(found.agg(F.max("more")).first()[0])
        pairs = checkpointed(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            sets = _sets(pairs, texts, sets, width, most_bits)
            links = links.union(_linking(pairs, sets, percent))
            tested = tested.union(pairs)
            labels = _labels(links)
        members, most = members.where(F.col("m") > few), most * 16

    smallest = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"))
    labelled = smallest.join(labels.select("sid", "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    by_label = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    by_set = labelled.join(by_label, "label").select("sid", "component_id")
    out = rows.where("n > 0").join(by_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
