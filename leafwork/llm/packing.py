"""Order-preserving packing of documents into sequences by dynamic programming.

Each input partition is one stream of documents in the order in which it is read, so nothing is shuffled. Its tokens are
cut into windows of at most ``LENGTH``. Cuts may be at the ends of documents (free), at the ends of sentences
(``SENTENCE`` padding tokens' worth) or, within long sentences, every ``STEP`` tokens (``INSIDE``). With G(i) the least
sum of padded windows and penalties up to cut i, G(i) = LENGTH + penalty(i) + min G(j) over the cuts j within one window,
and a monotone queue gives the minimum in constant time. The stream is handled in blocks of ``BLOCK`` tokens, whose
open end goes into the next block; what is left at the end of a stream is cut into powers of two, which need no padding.

Defined cases: a null text counts as empty and gives the end id alone; a document that is longer than a window is cut
where the rules above allow; repeated rows are packed once each; a null doc_id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from leafwork.llm.common import map_batches

LENGTH, END_ID = 2048, 1
SENTENCE, INSIDE, STEP, BLOCK = 4, 24, 48, 131_072
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(cuts: np.ndarray, penalties: np.ndarray, length: int, last: bool) -> list[int]:
    """Of ascending positions, with cuts[0] = 0 and gaps of at most ``length``, those that end the best windows.

    Unless ``last``, the windows may end anywhere in the last ``length`` tokens, at the least padding so far.
    """
    at, cost = cuts.tolist(), (penalties + length).tolist()
    best, back = [0] * len(at), [0] * len(at)
    queue, head = [0], 0
    for i in range(1, len(at)):
        low = at[i] - length
        while at[queue[head]] < low:
            head += 1
        back[i] = j = queue[head]
        best[i] = g = best[j] + cost[i]
        while len(queue) > head and best[queue[-1]] >= g:
            queue.pop()
        queue.append(i)
    i = len(at) - 1
    if not last:
        ends = [k for k in range(len(at)) if at[k] > at[-1] - length]
        i = min(ends, key=lambda k: (best[k] - at[k], -k))
    found = []
    while i > 0:
        found.append(at[i])
        i = back[i]
    return found[::-1]


class Packer:
    """Takes documents' ids in order and gives rows of pieces."""

    def __init__(self, first_sequence: int, sentence_end: np.ndarray, length: int = LENGTH):
        self.sequence, self.sentence_end, self.length = first_sequence, sentence_end, length
        self.docs: list[tuple] = []  # doc_id, its tokens, tokens cut before, what is left of its ids
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), 0, ids))
        self.size += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        if not self.size:
            return []
        ids = np.concatenate([d[3] for d in self.docs])
        doc_ends = np.cumsum([len(d[3]) for d in self.docs])
        sentences = np.flatnonzero(self.sentence_end[ids]) + 1
        marks = np.unique(np.concatenate(([0], sentences, doc_ends)))
        gaps = np.diff(marks)
        extra = np.concatenate([np.arange(a + STEP, b, STEP) for a, b in zip(marks[:-1][gaps > STEP], marks[1:][gaps > STEP])] or [marks[:0]])
        cuts = np.union1d(marks, extra)
        penalties = np.full(len(cuts), SENTENCE)
        penalties[np.searchsorted(cuts, extra)] = INSIDE
        penalties[np.searchsorted(cuts, doc_ends)] = 0
        ends = best_cuts(cuts, penalties, self.length, last)
        if last:
            at, rest = ends[-2] if len(ends) > 1 else 0, 0
            rest = len(ids) - at
            ends = ends[:-1]
            for power in (1 << k for k in range(rest.bit_length() - 1, -1, -1)):
                if rest & power:
                    at += power
                    ends.append(at)
        return self.pieces(ids, doc_ends, ends)

    def pieces(self, ids: np.ndarray, doc_ends: np.ndarray, ends: list[int]) -> list[tuple]:
        rows, wide, begin, d, left = [], ids.astype("<u4"), 0, 0, []
        at = 0
        for end in ends:
            while at < end:
                while doc_ends[d] <= at:
                    d += 1
                doc_id, total, before, own = self.docs[d]
                to = min(end, int(doc_ends[d]))
                start = before + at - (int(doc_ends[d]) - len(own))
                rows.append((doc_id, start, to - at, crc32(wide[at:to].tobytes()), total, self.sequence, at - begin))
                at = to
            begin = end
            self.sequence += 1
        for k in range(d, len(self.docs)):
            doc_id, total, before, own = self.docs[k]
            gone = min(len(own), max(0, at - (int(doc_ends[k]) - len(own))))
            if gone < len(own):
                left.append((doc_id, total, before + gone, own[gone:]))
        self.docs, self.size = left, len(ids) - at
        return rows


def pack(docs: DataFrame, length: int = LENGTH, file: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from leafwork.llm.tokens import byte_words

        encode = byte_words(file)
        ends = np.zeros(65_536, bool)
        ends[[i for b, i in encode.ranks.items() if b[-1:] in b".!?\n"]] = True
        packer = Packer(TaskContext.get().partitionId() << 33, ends, length)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        table = lambda rows: dict(zip(names, zip(*rows)))
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                packer.add(doc_id, np.append(encode(text or ""), np.uint16(END_ID)))
                if packer.size >= BLOCK and (rows := packer.flush(False)):
                    yield table(rows)
        if rows := packer.flush(True):
            yield table(rows)

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, SCHEMA)
