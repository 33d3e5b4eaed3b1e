"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a model has a space marker after another character, no piece and no merge crosses from a word into the marker of the next
one. A text is then cut into chunks, each its markers with the word after them, and a text's ids are its chunks' ids one after the other. Each task keeps a
table of the different chunks it has met: the library segments each of them once and decodes its ids once; a text's ids and
its decoded text are joined back from the table by the chunks' positions. Texts of other models go through the library whole.

Tables are kept by each task: a table of the whole corpus's chunks would have to meet every word of the corpus in a shuffle, to save a few seconds a task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.llm.common import as_text, pick, text_slices

MARKER = "▁"
RESULT = "doc_id long, ids array<int>, decoded string"
_CHUNK = re.compile(" +[^ ]+| +$")
_loaded: dict = {}


def load(model_path: str):
    """(processor, whether chunks stand apart) of a model file; loaded once a Python worker."""
    if model_path not in _loaded:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(processor.serialized_model_proto())
        _loaded[model_path] = processor, stand_apart(model)
    return _loaded[model_path]


def stand_apart(model) -> bool:
    """Whether a model's chunks can be segmented one by one: BPE over texts as they are, with a marker before the first word, characters without a piece
    in bytes, no symbols or unused pieces of the user, and no piece with a marker after another character."""
    rule, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    plain = not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
    bpe = model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
    return plain and bpe and not kinds & {4, 5} and any(p.piece == MARKER for p in model.pieces) and not any(MARKER in p.piece.lstrip(MARKER) for p in model.pieces if p.type == 1)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without its first marker, other markers as spaces."""
    if MARKER in text:
        text = text.replace(MARKER, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _CHUNK.findall(" " + text)]
    return text.split(" ")


class ChunkTable(dict):
    """Number of each chunk; ids and decoded text by number."""

    def __init__(self, processor, most_bytes: int):
        self.processor, self.most_bytes = processor, most_bytes
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new, self.decoded, self.held = [], [], 0
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number

    def learn(self) -> None:
        """Segment and decode the chunks that were new."""
        if not self.new:
            return
        ids = self.processor.encode(self.new, num_threads=1)
        ids = [x if chunk else [self.processor.piece_to_id(MARKER)] for chunk, x in zip(self.new, ids)]  # a last marker alone
        self.decoded += self.processor.decode(ids, num_threads=1)
        size = np.array([len(x) for x in ids], np.int64)
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(size.sum())))
        self.held += sum(map(len, self.new))
        self.new = []

    def join(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All texts' ids, where each one's begin and end, and their decoded texts."""
        if self.held > self.most_bytes:
            self.forget()
        numbers = [list(map(self.__getitem__, chunks_of(t))) for t in texts]
        self.learn()
        decoded = [" ".join(map(self.decoded.__getitem__, x)) for x in numbers]
        at = np.fromiter((i for x in numbers for i in x), np.int64, sum(map(len, numbers)))
        size = self.size[at]
        ends = np.append(0, np.cumsum(size))
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.append(0, np.cumsum([len(x) for x in numbers])).astype(np.int64)], decoded


def encode_pieces(docs: DataFrame, model_path: str, most_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of docs: doc_id, ids (as the library's encode gives them, without begin or end ids), decoded (as its decode gives for these ids).

    docs needs doc_id and text; other columns are ignored. A null or empty text has no ids and an empty decoded text; one of white space has its markers'
    ids. A marker character in a text decodes as a space, as with the library. Null ids and repeated rows are returned as they are; no rows give no rows.
    A text may be of any length; a word of any length is one chunk. most_bytes: characters of chunks after which a task begins its table anew.
    The model's file lies at the same path on all machines.
    """

    def run(batches):
        processor, apart = load(model_path)
        table = ChunkTable(processor, most_bytes)
        for batch in batches:
            texts = as_text(batch.column("text"))
            for first, last in text_slices(texts):
                some = texts[first:last].to_pylist()
                if apart:
                    ids, offsets, decoded = table.join(some)
                else:
                    lists = processor.encode(some, num_threads=1)
                    decoded = processor.decode(lists, num_threads=1)
                    ids, offsets = np.array([i for x in lists for i in x], np.int32), np.append(0, np.cumsum([len(x) for x in lists]))
                column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], column, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, RESULT)
