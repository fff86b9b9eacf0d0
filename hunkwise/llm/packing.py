"""Packing (5): order-preserving dynamic programming over cut points.

Documents are one stream of tokens in the order of their rows. Cut points are document ends, sentence ends and a grid inside
long sentences; a cut costs padding plus a truncation penalty by kind. With positions p and costs f,

    f[j] = penalty[j] + (window - p[j]) + min over p[j] - p[i] <= window of (f[i] + p[i]),

and the sliding minimum is the head of a monotone queue, so a chunk of the stream takes time linear in its cut points.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.llm import common

WINDOW = 1024
#: Cost of a cut at a sentence end, and inside a sentence; at a document end it is 0. Padding costs 1 a token.
SENTENCE, INSIDE = 2, 12
#: Tokens between cut points inside a sentence; tokens after which a chunk of the stream is packed.
GRID, CHUNK = 32, 1 << 20
END_ID = 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceCache(dict):
    """Little-endian ids of a run without inner white space; a run's last punctuation mark is looked up apart."""

    def __init__(self, encoding, most: int = 100_000, longest: int = 64):
        """Keeps `most` runs (about 200 bytes each) of `longest` characters at most."""
        super().__init__()
        self.encoding, self.most, self.longest = encoding, most, longest

    def __missing__(self, run: str) -> bytes:
        body = run[1:] if run[0] == " " else run
        if body.isalpha():
            ids = array("I", self.encoding._encode_single_piece(run)).tobytes()
        elif body and body[-1] in ".,;:!?" and body[:-1].isalpha():
            return self[run[:-1]] + self[run[-1]]
        else:
            ids = array("I", self.encoding.encode_ordinary(run)).tobytes()
        if len(run) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[run] = ids
        return ids


class Ids:
    """The ids that the byte-level tokenizer file gives (add_special_tokens=False), as little-endian unsigned 32-bit bytes.

    path names the tokenizer's .json file; its vocabulary as ranks lies beside it as .tiktoken. A text is cut where the
    tokenizer's own pattern always cuts; texts with characters on whose class the patterns differ, or with the special
    token's string, are encoded whole.
    """

    SPECIAL = "<|endoftext|>"
    RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
    ODD = re.compile("[\x1c-\x1f\x85]|<\\|endoftext\\|>").search

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(re.sub(r"\.json$", ".tiktoken", path), "rb"))}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={self.SPECIAL: len(ranks)})
        self.cache = PieceCache(self.encoding)
        self.sentence_end = np.zeros(len(ranks) + 1, dtype=bool)
        for token, i in ranks.items():
            self.sentence_end[i] = token.rstrip(b" ")[-1:] in (b".", b"!", b"?") or b"\n" in token

    def __call__(self, text: str) -> bytes:
        if self.ODD(text):
            return array("I", self.encoding.encode(text, allowed_special="all")).tobytes()
        return b"".join(map(self.cache.__getitem__, self.RUNS(text)))


def ids_of(path: str) -> Ids:
    """One encoder for a worker process."""
    return common.held(f"ids {path}", lambda: Ids(path))


def cut(positions: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """The cut positions of least cost. positions: ascending from 0, at most `window` apart; the last is always cut."""
    cost, before = [0] * len(positions), [0] * len(positions)
    queue, head = deque([(0, 0)]), 0  # (f[i] + p[i], i), ascending
    for j in range(1, len(positions)):
        at = positions[j]
        while positions[queue[0][1]] < at - window:
            queue.popleft()
        least, i = queue[0]
        cost[j] = least + window - at + penalties[j]
        before[j] = i
        key = cost[j] + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(positions) - 1
    while j:
        out.append(positions[j])
        j = before[j]
    return out[::-1]


def cut_points(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, grid: int = GRID) -> tuple[list[int], list[int]]:
    """Positions (0 first) and penalties of a chunk whose documents end at `ends`."""
    penalty = np.full(len(ids) + 1, -1, dtype=np.int16)
    penalty[grid::grid] = INSIDE
    penalty[1:][sentence_end[ids]] = SENTENCE
    penalty[ends] = 0
    penalty[0] = 0
    at = np.flatnonzero(penalty >= 0)
    return at.tolist(), penalty[at].tolist()


def packed(docs: list[tuple], window: int, sentence_end: np.ndarray, first: int) -> Iterator[tuple]:
    """(id, start, length, doc_tokens, sequence, offset, ids) of the pieces of a chunk; docs: (id, ids as bytes)."""
    sizes = np.array([len(b) // 4 for _, b in docs])
    ends = np.cumsum(sizes)
    stream = b"".join(b for _, b in docs)
    cuts = cut(*cut_points(np.frombuffer(stream, "<u4"), ends, sentence_end, min(GRID, window)), window)
    doc, begins = 0, ends - sizes
    for sequence, (a, b) in enumerate(zip([0, *cuts], cuts)):
        at = a
        while at < b:
            stop = min(b, int(ends[doc]))
            yield docs[doc][0], at - int(begins[doc]), stop - at, int(sizes[doc]), first + sequence, at - a, stream[4 * at : 4 * stop]
            at = stop
            doc += at == ends[doc]


PIECES = common.fields("start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_column: str = "doc_id") -> DataFrame:
    """Pieces of all documents in sequences of at most `window` tokens: id_column, start, length, doc_tokens, sequence_id, offset, ids.

    The stream is that of each input partition, in row order, so that no text is shuffled; a sequence never spans two
    partitions. ids holds the piece's token ids as little-endian unsigned 32-bit numbers. A null or empty text is its end
    id alone. Repeated rows are packed apart, a null id is handed on, other columns are left out; an empty table gives none.
    """
    path = path or default_path()
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), *PIECES])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        encode, arrow, end = ids_of(path), to_arrow_schema(schema), array("I", [END_ID]).tobytes()
        first, held, size = TaskContext.get().partitionId() << 40, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, size
            rows = []
            for row in packed(held, window, encode.sentence_end, first):
                rows.append(row)
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                    rows = []
                last = row[4]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            first, held, size = last + 1, [], 0

        for part in (p for batch in batches for p in common.slices(batch, [1], 4096)):
            for key, text in zip(part.column(0), part.column(1)):
                held.append((key.as_py(), encode(text.as_py() or "") + end))
                size += len(held[-1][1]) // 4
                if size >= CHUNK:
                    yield from flush()
        if held:
            yield from flush()

    return common.bounded(docs.select(id_column, "text")).mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
