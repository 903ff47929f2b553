"""Best-fit packing of token sequences, planned on counts per length.

Texts become token ids followed by an end id; longer ones are cut into pieces. Best-fit-decreasing then runs over the
histogram of piece lengths instead of the pieces: it places whole runs of equal lengths into runs of equally filled
sequences. Each piece has a rank among the pieces of its length and takes the slot planned for that length and rank.

The plan's size depends on the capacity alone (its runs split at most once per length), not on the number of pieces.
Null and empty texts are one end id. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.arrow_text import Powers, Texts, texts_of
from twinframe.session import stage

CAPACITY = 2048
END_ID = 0
#: Distinct chunks whose ids a task remembers before it starts anew.
KNOWN_CHUNKS = 600_000
#: Fixed value: the published pre-tokenization pattern of byte-level BPE vocabularies with 50k entries.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def chunk_starts(texts: Texts) -> np.ndarray:
    """Where a text can be cut so that the parts encode to the same ids as the whole.

    A byte-level BPE first splits at the start of a white-space character that stands alone between two other characters,
    and between a letter and a punctuation mark (not | as special tokens hold it after letters). Neighbours of the space count as such if they are visible ASCII, or characters from ranges without any Unicode white space: those
    with two bytes from U+00C0 on, and those from U+4000 on.
    """
    data = texts.data
    visible = (data > 0x20) & (data < 0x7F)
    pair_lead = (data >= 0xC3) & (data <= 0xDF)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    before = np.zeros(len(data), dtype=bool)
    before[1:] = visible[:-1]
    before[2:] |= pair_lead[:-2] & (data[1:-1] >= 0x80)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = (visible | pair_lead | (data >= 0xE4))[1:]
    begins = texts.offsets[:-1]
    cut = space & before & after
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    mark = visible & ~letter & ~((data >= 0x30) & (data <= 0x39)) & (data != 0x7C)
    cut[1:] |= letter[:-1] & mark[1:]
    starts = begins[begins < texts.offsets[1:]]
    cut[starts] = True
    # a text's first byte may not look back into the text before it, nor its last one ahead
    second = starts + 1
    second = second[second < len(data)]
    cut[second] &= visible[second - 1] | np.isin(second, starts)
    ends = texts.offsets[1:][begins < texts.offsets[1:]] - 1
    cut[ends] &= np.isin(ends, starts)
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of texts. Distinct chunks are encoded once and remembered, as most chunks of a corpus are frequent."""

    def __init__(self, path: str, ranks: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_ranks = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.by_ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.powers = Powers()
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.begins = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        special = [c for c in chunks if self.by_ranks is None or "<|" in c]
        slow = iter(self.tokenizer.encode_batch_fast(special, add_special_tokens=False))
        found = [next(slow).ids if self.by_ranks is None or "<|" in c else self.by_ranks(c) for c in chunks]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        begins = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(counts.sum()))])
        order = np.argsort(hashes := np.concatenate([self.hashes, hashes]))
        self.hashes = hashes[order]
        self.begins = np.concatenate([self.begins, begins])[order]
        self.counts = np.concatenate([self.counts, counts])[order]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (one more entry than texts)."""
        start = chunk_starts(texts)
        end = np.append(start[1:], len(texts.data))
        hashes = texts.span_hash(texts.prefix_hash(self.powers), start, end, self.powers)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > KNOWN_CHUNKS:
            self._forget()
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if new.any():
            raw = texts.data.tobytes()
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist())
            self._learn(distinct[new], [raw[a:b].decode("utf-8", "replace") for a, b in spans])
        at = np.searchsorted(self.hashes, distinct)[which]
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.begins[at] - (ends - counts), counts) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, texts.offsets)]
        return ids, bounds


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``id_col``, ``piece``, ``start``, ``length``, ``ids`` (little-endian 32-bit).

    ``tokenizer`` is a file of the tokenizers library. ``ranks`` may name a rank file of the same vocabulary, which gives
    the same ids some three times faster; texts around special tokens always go through ``tokenizer``.
    Only the first piece of a longer text may be shorter than ``capacity``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks)
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                yield pieces(batch.column(0), texts, encoder)

    def pieces(keys: pa.Array, texts: Texts, encoder: Encoder) -> pa.RecordBatch:
        ids, bounds = encoder.encode(texts)
        n = np.diff(bounds) + 1
        per_text = -(-n // capacity)
        text = np.repeat(np.arange(len(n)), per_text)
        piece = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        first = n - capacity * (per_text - 1)
        start = np.where(piece == 0, 0, first[text] + (piece - 1) * capacity)
        length = np.where(piece == 0, first[text], capacity)
        whole = np.insert(ids, bounds[1:], end_id).astype("<u4")  # text i then begins at bounds[i] + i
        begin = 4 * (bounds[:-1][text] + text + start)
        raw = whole.tobytes()
        parts = [raw[a:b] for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
        return pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(texts.first + text)),
                pa.array(piece.astype(np.int32)),
                pa.array(start),
                pa.array(length),
                pa.array(parts, pa.binary()),
            ],
            names=[id_col, "piece", "start", "length", "ids"],
        )

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit-decreasing over a histogram {length: pieces}.

    Rows of (length, first rank, pieces, first sequence, offset): ``pieces`` pieces of that length, from that rank on, go
    one each to consecutive sequences, at that offset.
    """
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room left: runs of (first sequence, sequences)
    rooms: list[int] = []
    sequences, rows = 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
                if n > left:
                    open_runs.setdefault(room, []).append((first + left, n - left))
                    if len(open_runs[room]) == 1:
                        bisect.insort(rooms, room)
                    n = left
            else:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            rows.append((length, rank, n, first, capacity - room))
            rank, left, room = rank + n, left - n, room - length
            if room:
                open_runs.setdefault(room, []).append((first, n))
                if len(open_runs[room]) == 1:
                    bisect.insort(rooms, room)
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``__rank`` among all of the same length.

    Each task numbers its pieces per length as it reads them; the rows are written once, so these numbers stay. What
    earlier tasks hold of a length is added from a table of counts, one row for each task and length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            values, first, n = np.unique(length[order], return_index=True, return_counts=True)
            before = np.array([seen.get(v, 0) for v in values.tolist()], dtype=np.int64)
            seen.update(zip(values.tolist(), (before + n).tolist()))
            rank = np.empty(len(length), dtype=np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first - before, n)
            columns = [*batch.columns, pa.array(np.full(len(length), part, dtype=np.int64)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__part", "__in_part"])

    at = pieces.columns.index("length")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    numbered = stage(pieces.mapInArrow(run, ", ".join([*fields, "__part long", "__in_part long"])), "pieces")
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("__part", "length").count()
    offsets = counts.select("__part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    joined = numbered.join(offsets, ["__part", "length"])
    return joined.withColumn("__rank", F.col("__before") + F.col("__in_part")).select(*pieces.columns, "__rank")


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length`` column of 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    pieces = pieces.drop("sequence_id", "offset", "__rank")
    rows = stage(ranked(pieces), "ranked")
    counts = {int(r["length"]): r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    names, at = [*pieces.columns, "sequence_id", "offset"], pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            mine = runs[np.searchsorted(keys, (batch.column(at).to_numpy(zero_copy_only=False) << 48) + rank, side="right") - 1]
            columns = [pa.array(mine[:, 3] + rank - mine[:, 1]), pa.array(mine[:, 4].copy())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return rows.mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_texts(docs: DataFrame, tokenizer: str, ranks: str | None = None, **options) -> DataFrame:
    """Packed pieces of all texts, with their ids; options as for ``token_pieces``."""
    return packed(token_pieces(docs, tokenizer, ranks, **options), options.get("capacity", CAPACITY))
