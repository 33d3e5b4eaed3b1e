"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram's vector binds (multiplies) the vectors of its letters, each
permuted (rotated) by its place; a text's vector bundles (adds) those of its n-grams. A language's
prototype bundles its training texts, and a text gets the language whose prototype has the
largest cosine with it.

Only prototypes and partial sums move between tasks: a vector for each language and task.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import as_text, pick

_letters: list = []


def _folded() -> np.ndarray:
    """For each code point its lower-case letter's code point; 0 for what is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


class Space:
    """The vectors of letters and n-grams."""

    def __init__(self, dimensions: int, n: int, seed: int):
        self.d, self.n, self.seed, self.known = dimensions, n, seed, {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.known:
            self.known[code] = (np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.d) * 2 - 1).astype(np.int8)
        return self.known[code]

    def grams(self, letters: np.ndarray) -> np.ndarray:
        """letters: (m, n) code points; (m, d) vectors of +1 and -1."""
        codes, at = np.unique(letters, return_inverse=True)
        base = np.stack([self.letter(int(c)) for c in codes])
        at = at.reshape(letters.shape)
        out = base[at[:, -1]]
        for place in range(1, self.n):
            out = out * np.roll(base, place, axis=1)[at[:, self.n - 1 - place]]
        return out


def _codes(text: str, n: int, most_chars: int):
    """A text's letters as code points, in pieces: runs of other characters are one 0, with one before and after the text. A piece begins
    with the n - 1 last codes of the one before."""
    table, last, held = _folded(), 1, np.zeros(0, np.uint32)
    total = -(-max(1, len(text)) // most_chars)
    for k in range(total):
        codes = table[np.frombuffer(text[k * most_chars : (k + 1) * most_chars].encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = ([0] if k == 0 else []), ([0] if k == total - 1 else [])
        codes = np.concatenate([ends[0], codes, ends[1]]).astype(np.uint32)
        codes = codes[(codes != 0) | (np.append(last, codes[:-1]) != 0)] if len(codes) else codes
        if len(codes):
            last = codes[-1]
            whole = np.concatenate([held, codes])
            yield whole
            held = whole[max(0, len(whole) - n + 1) :]


def text_vectors(space: Space, texts: list[str], groups: list[int] | None = None, most_chars: int = 1 << 20, most_cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """((texts, d) bundles of the texts' n-grams, or of groups of texts numbered from 0; whether each text has a letter). Long texts go
    piece by piece, and counts of n-grams by most_cells at a time, so memory follows neither text length nor alphabet."""
    groups = list(range(len(texts))) if groups is None else groups
    out, some = np.zeros((max(groups, default=-1) + 1, space.d), np.float64), np.zeros(len(texts), bool)
    parts, rows, size = [], [], 0

    def bundle():
        nonlocal parts, rows, size
        if parts:
            _add_grams(out, space, parts, rows, most_cells)
        parts, rows, size = [], [], 0

    for i, text in enumerate(texts):
        for codes in _codes(text, space.n, most_chars):
            some[i] |= codes.any()
            if len(codes) < space.n and len(text) <= most_chars:
                codes = np.concatenate([codes, np.zeros(space.n - len(codes), np.uint32)])
            if codes.any() and len(codes) >= space.n:
                parts.append(codes)
                rows.append(groups[i])
                size += len(codes)
            if size > most_chars:
                bundle()
    bundle()
    return out, some


def _add_grams(out: np.ndarray, space: Space, parts: list[np.ndarray], rows: list[int], most_cells: int) -> None:
    """Add to out[row] the vectors of the n-grams of its parts."""
    n = space.n
    alphabet = np.unique(np.concatenate(parts))
    size = len(alphabet)
    if size**n > 1 << 22 and len(parts) > 1:  # hardly an n-gram in two texts
        for codes, row in zip(parts, rows):
            _add_grams(out, space, [codes], [row], most_cells)
        return
    used, owner = np.unique(rows, return_inverse=True)
    keys = []
    for codes in parts:
        at = np.searchsorted(alphabet, codes).astype(np.int64)
        key = np.zeros(len(at) - n + 1, np.int64)
        for k in range(n):
            key = key * size + at[k : len(at) - n + 1 + k]
        keys.append(key)
    key, owner = np.concatenate(keys), np.repeat(owner, [len(k) for k in keys])
    if size**n <= 1 << 22:
        present = np.zeros(size**n, bool)
        present[key] = True
        different = np.flatnonzero(present)
        column = (np.cumsum(present) - 1)[key]
    else:
        different, column = np.unique(key, return_inverse=True)
    step = max(1, min(4096, most_cells // len(used)))
    if len(different) > step:
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
    for first in range(0, len(different), step):
        m = min(step, len(different) - first)
        lo, hi = np.searchsorted(column, [first, first + m]) if len(different) > step else (0, len(column))
        counts = np.bincount(owner[lo:hi] * m + (column[lo:hi] - first), minlength=len(used) * m).reshape(len(used), m).astype(np.float32)
        letters, rest = np.empty((m, n), np.uint32), different[first : first + m].copy()
        for k in range(n - 1, -1, -1):
            letters[:, k] = alphabet[rest % size]
            rest //= size
        out[used] += counts @ space.grams(letters).astype(np.float32)


def _slices(texts, most_rows: int = 256, most_chars: int = 1 << 20):
    held, size, first = [], 0, 0
    for i in range(len(texts)):
        text = texts[i].as_py()
        if held and (len(held) == most_rows or size + len(text) > most_chars):
            yield first, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def held_out(doc_id: Column) -> Column:
    """Documents that no prototype learns from: the CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn_prototypes(docs: DataFrame, dimensions: int = 1024, n: int = 3, seed: int = 7) -> dict[str, np.ndarray]:
    """{language: prototype} from the texts with a non-null lang, all of docs. Bundles are added up in two steps; the
    driver gets at most 16 vectors a language."""

    def bundle(batches):
        space, sums = Space(dimensions, n, seed), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in _slices(as_text(batch.column("text"))):
                own = langs[first : first + len(texts)]
                names = sorted(set(own))
                vectors, some = text_vectors(space, texts, [names.index(x) for x in own])
                for name in {x for x, ok in zip(own, some) if ok}:
                    sums[name] = sums.get(name, 0) + vectors[names.index(name)]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary())], names=["lang", "vector"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "vector": [np.sum([np.frombuffer(v, "<f8") for v in group["vector"]], axis=0).tobytes()]})

    parts = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(bundle, "lang string, vector binary")
    summed = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("lang", "salt").applyInPandas(add, "lang string, vector binary")
    out: dict[str, np.ndarray] = {}
    for row in summed.collect():
        out[row["lang"]] = out.get(row["lang"], 0) + np.frombuffer(row["vector"], "<f8")
    return out


def identify_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = 1024, n: int = 3, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    docs needs doc_id and text; other columns are ignored. lang_pred is a language of prototypes, the first by name on a
    tie; `und` with score 0 for a null text, one without letters, or if there are no prototypes. score is the cosine, cut to 0 to 1. Whole texts
    are read, in their row's own task, without a shuffle. No rows give no rows. The options must be those of the prototypes.
    """
    names = sorted(k for k, v in prototypes.items() if np.any(v))
    unit = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).astype(np.float32) if names else np.zeros((0, dimensions), np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(unit)  # dimensions * 4 bytes a language

    def run(batches):
        space = Space(dimensions, n, seed)
        for batch in batches:
            found, score = [], []
            for _, texts in _slices(as_text(batch.column("text"))):
                vectors, some = text_vectors(space, texts)
                length = np.linalg.norm(vectors, axis=1)
                ok = some & (length > 0) & bool(names)
                cosines = (vectors / np.where(length > 0, length, 1)[:, None]) @ sent.value.T if names else np.zeros((len(texts), 1))
                best = cosines.argmax(axis=1)
                found += [names[b] if o else "und" for b, o in zip(best, ok)]
                score += [float(min(1.0, max(0.0, c))) if o else 0.0 for c, o in zip(cosines.max(axis=1), ok)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")
