"""Cost-balanced packing of tokenised documents into sequences of bounded length.

Every document becomes token ids plus an end id. Pieces of a full sequence length stand alone. What remains
of each document waits in a buffer of bounded size. A full buffer of T tokens is packed into T // 1024 full
sequences and, for the remainder, one sequence per binary digit of it, so that short sequences need no padding:
pieces go in descending length to the sequence of lowest cost (linear plus quadratic attention) that has
room, and a piece that fits nowhere whole is cut into two or three parts. Pieces that not even three gaps hold wait
until all others lie. While the gaps that are left then make up more than ``PADDED`` of a buffer's tokens, waiting
pieces, the shortest first, are cut into as many parts as the widest gaps ask for; the rest fills the short sequences
at the end. So at most that share of a buffer is padded, whatever its lengths, and with the few tokens of the last short
sequence nothing else is.

The work is a single pass without a shuffle: memory is bounded by the buffer and a task that is run again
gives the same rows.

Defined results: a null text counts as empty (its one id is the end id); texts of any length are packed whole;
repeated rows are packed as often as they occur; of equal lengths the one that comes first in the buffer, and of
equal costs the sequence with the smaller number, is taken; an empty table gives no rows; further columns, of whatever
names, are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillon.llm.common import small_batches

LENGTH = 1024
END_ID = 0
#: Tokens held back before a buffer is packed.
BUFFER = 2_000_000
#: Cost of a piece of n tokens: n + QUADRATIC * n * n.
QUADRATIC = 1 / 512
#: Parts that a piece without room is cut into at most, before it waits for the end.
PARTS = 3
#: Share of a buffer's tokens that may be padded before such a piece is cut into more parts.
PADDED = 1 / 200
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SPECIAL = "<|endoftext|>"
#: White space other than one space or line end between two other characters.
_OTHER_SPACE = re.compile(r"\s{2}|[^\S \n]|^\s|\s\Z")
#: Stretches whose ids a worker keeps.
_CACHE = 500_000


class Encoder:
    """Token ids of byte-level BPE, the same as the ``tokenizers`` library gives for the vocabulary file.

    Words repeat, so the ids of each stretch between two spaces are kept. That is exact where all white
    space is single spaces and line ends, as no token then crosses such a gap; other texts are encoded whole,
    and texts that hold the special token by ``tokenizers`` itself.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path, self.slow, self.known = path, None, {}

    def __call__(self, text: str) -> np.ndarray:
        if _SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if not text or _OTHER_SPACE.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if len(self.known) > _CACHE:
            self.known.clear()
        first, *rest = text.replace("\n", " \n").split(" ")
        parts = list(map(self.known.get, rest))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    stretch = rest[i]
                    ids = self.fast.encode_ordinary(stretch if stretch[0] == "\n" else " " + stretch)
                    parts[i] = self.known[stretch] = array("I", ids).tobytes()
        return np.frombuffer(array("I", self.fast.encode_ordinary(first)).tobytes() + b"".join(parts), np.uint32)


_encoders: dict[tuple[str, str, str], Encoder] = {}


def encoder(path: str, ranks_path: str, pattern: str) -> Encoder:
    """One encoder per worker, so its table and the words it knows serve all tasks."""
    key = (path, ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _sizes(total: int, room: int) -> list[int]:
    """Full sequences, then one for each binary digit of the rest, so that none has to be padded."""
    rest = total % room
    return [room] * (total // room) + ([1 << b for b in range(room.bit_length()) if rest >> b & 1] if room & (room - 1) == 0 else [rest] if rest else [])


def fill(lengths: np.ndarray, room: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Packs pieces: (piece, start in it, length, sequence, offset there) for each part.

    The longest piece goes next, to the sequence of lowest cost among those with room. If none has room, the piece
    is cut: its beginning fills up the sequence with the most room, what is left goes where it fits best. What would
    need more than ``PARTS`` parts waits. The shortest of these are cut up until at most ``PADDED`` is left in gaps; the
    others fill what is left of the short sequences, and then sequences of their own.
    """
    total = int(lengths.sum())
    sizes = _sizes(total, room)
    free, cost, out = list(sizes), [0.0] * len(sizes), []

    def put(piece: int, start: int, n: int, s: int) -> None:
        out.append((piece, start, n, s, sizes[s] - free[s]))
        free[s] -= n
        cost[s] += n + QUADRATIC * n * n

    # Pieces only get shorter: the heap holds the sequences with room for the next one, the others wait by their room.
    waiting: list[list[tuple[float, int]]] = [[] for _ in range(room + 1)]
    for s, size in enumerate(sizes):
        waiting[size].append((0.0, s))
    roomy: list[tuple[float, int]] = []
    rest: list[tuple[int, int]] = []
    least = widest = room + 1
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        while least > n:
            least -= 1
            for entry in waiting[least]:
                heapq.heappush(roomy, entry)
            waiting[least] = []
        if roomy:
            _, s = roomy[0]
            put(piece, 0, n, s)
            if free[s] >= n:
                heapq.heapreplace(roomy, (cost[s], s))
            else:
                heapq.heappop(roomy)
                if free[s]:
                    heapq.heappush(waiting[free[s]], (cost[s], s))
            continue
        widest = min(widest, least - 1)
        gaps: list[tuple[int, tuple[float, int]]] = []
        left = n
        while left > 0 and len(gaps) < PARTS:
            while widest and not waiting[widest]:
                widest -= 1
            if not widest:
                break
            gap = next((f for f in range(left, widest + 1) if waiting[f]), widest)
            gaps.append((gap, heapq.heappop(waiting[gap])))
            left -= gap
        if left > 0:
            rest.append((piece, n))
            for gap, entry in gaps:
                heapq.heappush(waiting[gap], entry)
                widest = max(widest, gap)
            continue
        start = 0
        for gap, (_, s) in gaps:
            put(piece, start, min(gap, n - start), s)
            start += min(gap, n - start)
            if free[s]:
                heapq.heappush(waiting[free[s]], (cost[s], s))
    for _, s in roomy:
        heapq.heappush(waiting[free[s]], (cost[s], s))
    padded, widest = sum(free[: total // room]), room
    while rest and padded > PADDED * total:
        piece, n = rest.pop()
        start = 0
        while start < n:
            while not waiting[widest]:
                widest -= 1
            _, s = heapq.heappop(waiting[widest])
            take = min(n - start, free[s])
            put(piece, start, take, s)
            start += take
            padded -= take * (s < total // room)
            if free[s]:
                heapq.heappush(waiting[free[s]], (cost[s], s))
    ends = [s for s in range(total // room, len(sizes)) if free[s]]
    own = _sizes(sum(n for _, n in rest) - sum(free[s] for s in ends), room)
    ends += range(len(sizes), len(sizes) + len(own))
    sizes, free, cost = sizes + own, free + own, cost + [0.0] * len(own)
    at = iter(ends)
    s = next(at, -1)
    for piece, n in rest:
        start = 0
        while start < n:
            take = min(n - start, free[s])
            put(piece, start, take, s)
            start += take
            if not free[s]:
                s = next(at, -1)
    return out


def pack(docs: DataFrame, path: str, ranks_path: str, pattern: str, length: int = LENGTH, buffer: int = BUFFER) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the CRC-32 of its ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks_path, pattern)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 34
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = 0
        crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())

        def flush() -> None:
            nonlocal sequence, held
            parts = fill(np.array([len(w[2]) for w in waiting]), length)
            for piece, start, n, s, offset in parts:
                doc, first, ids, total = waiting[piece]
                rows.append((doc, first + start, n, crc(ids[start : start + n]), total, sequence + s, offset))
            sequence += 1 + max((p[3] for p in parts), default=-1)
            waiting.clear()
            held = 0

        def ready() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID))
                full = len(ids) // length * length
                for start in range(0, full, length):
                    rows.append((doc, start, length, crc(ids[start : start + length]), len(ids), sequence, 0))
                    sequence += 1
                if full < len(ids):
                    waiting.append((doc, full, ids[full:].astype(np.uint16 if ids.max() < 65536 else np.uint32), len(ids)))
                    held += len(ids) - full
                if held >= buffer:
                    flush()
            if rows:
                yield ready()
        if waiting:
            flush()
        if rows:
            yield ready()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
