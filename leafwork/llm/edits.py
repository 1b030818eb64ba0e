"""Token counts that follow edits.

A document is kept as units (pre-tokens, a word with the blank before it) in leaves of a segment tree whose nodes hold the
sums of characters and tokens. ``count_trees`` makes the trees once; they are rows that can be stored. ``edit_trees`` takes
them up, together with edits, and gives the trees that follow. An edit finds its place by descending the tree, starts a unit
before the place (its end can depend on the next character; white space, on where its run ends), re-encodes until a unit
boundary of the new text meets one of the old text behind the edit, and updates the sums on the way up. What lies outside
keeps its counts and isn't even cut into units again: a unit's tokens depend on the unit alone.

Defined cases: a null text counts as empty; null edits count as none; places are code points of the text as it stands when
the edit comes and are clipped to it; a null replacement deletes; repeated rows are handled on their own; an empty table
gives an empty result; a column ``edits`` of the documents gives way to that of ``attach_edits``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import map_batches, shared_dir
from leafwork.llm.tokens import SPACE, ByteWords

#: Units: whatever the pattern of the vocabulary makes of a text, its pre-tokens never cross these.
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
LEAF = 64


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as bytes of one width, which comes first."""
    width = next(w for w in (1, 2, 4) if not len(numbers) or numbers.max() < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


class CountedText:
    """A text with its units and token counts. ``stored``: the lengths of its units and their counts, where they are known."""

    def __init__(self, text: str, words: ByteWords, stored: tuple[np.ndarray, np.ndarray] | None = None):
        self.words, self.source, self.reencoded = words, text, 0
        self.lengths, self.counts = stored or self.first_count(text)
        starts = np.arange(0, len(self.lengths), LEAF)
        chars, tokens = (np.add.reduceat(x, starts) if len(starts) else np.zeros(1, np.int64) for x in (self.lengths, self.counts))
        self.begins = (np.cumsum(chars) - chars).tolist()
        self.changed: dict[int, tuple[list[str], list[int]]] = {}
        self.width = 1 << (len(chars) - 1).bit_length()
        rest = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars.tolist() + rest, [0] * self.width + tokens.tolist() + rest
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def first_count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        memory = self.words.memory
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.words.tangled.search(text) or text[:1] == " ":
            units = UNIT.findall(text)
            return np.array(list(map(len, units)), np.int64), np.array(list(map(self.count, units)), np.int64)
        first, *rest = text.split(" ")  # units that begin with a blank, quickly
        lengths = np.array([len(first) - 1, *map(len, rest)], np.int64) + 1
        return lengths, np.array([self.count(first), *[len(x) >> 1 for x in map(memory.__getitem__, rest)]], np.int64)

    def leaf(self, i: int) -> tuple[list[str], list[int]]:
        """Units and counts of a leaf; a leaf that no edit touched is cut from the text only now."""
        if i in self.changed:
            return self.changed[i]
        at, units = self.begins[i], []
        for n in self.lengths[i * LEAF : (i + 1) * LEAF].tolist():
            units.append(self.source[at : at + n])
            at += n
        return units, self.counts[i * LEAF : (i + 1) * LEAF].tolist()

    def count(self, unit: str) -> int:
        if unit[:1] == " " and len(unit) > 1:
            return len(self.words.memory[unit[1:]]) >> 1
        return len(self.words.encoding.encode_ordinary(unit))

    @property
    def total(self) -> int:
        return self.tokens[1]

    def locate(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one with text for the end) and its first character."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at - begin >= self.chars[node] and self.chars[node + 1]:
                begin, node = begin + self.chars[node], node + 1
        return node - self.width, begin

    def put(self, leaf: int, units: list[str], counts: list[int]) -> None:
        self.changed[leaf] = (units, counts)
        node = self.width + leaf
        chars, tokens = sum(map(len, units)) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, start: int, stop: int, new: str) -> None:
        start = min(max(start, 0), self.chars[1])
        stop = min(max(stop, start), self.chars[1])
        leaf, begin = self.locate(start)
        first, (own, counts) = leaf, self.leaf(leaf)
        while leaf and (len(own) < 4 or start - begin <= sum(map(len, own[:3]))):  # some units before the place are needed
            leaf -= 1
            begin -= self.chars[self.width + leaf]
            before = self.leaf(leaf)
            own, counts = before[0] + own, before[1] + counts
        last = self.locate(stop)[0]
        known = first + 1
        own, counts = list(own), list(counts)
        while known <= last:
            more = self.leaf(known)
            own, counts, known = own + more[0], counts + more[1], known + 1
        i, at = 0, begin
        while i < len(own) and at + len(own[i]) <= start:
            at, i = at + len(own[i]), i + 1
        back = True
        while i and back:  # the unit before, and on over white space, which is cut in two before a word
            i -= 1
            at -= len(own[i])
            back = not own[i].strip()
        while True:
            old = "".join(own[i:])
            text = old[: start - at] + new + old[stop - at :]
            ends, j = {}, at
            for k in range(i, len(own)):
                j += len(own[k])
                if j >= stop:
                    ends[j - stop + start + len(new) - at] = k + 1
            ends.setdefault(start + len(new) - at if stop == at else -1, i)
            complete = known >= len(self.begins)
            units, size, to = [], 0, None
            for m in UNIT.finditer(text):
                if not complete and m.end() >= len(text) - 1:
                    break  # its end could depend on the next leaf
                units.append(m[0])
                size = m.end()
                if size >= start + len(new) - at and size in ends:
                    to = ends[size]
                    break
            if to is None and complete:
                to = len(own)
            if to is not None:
                break
            more = self.leaf(known)
            own, counts, known = own + more[0], counts + more[1], known + 1
        self.reencoded += sum(map(len, units))
        used = [self.count(u) for u in units]
        self.put(leaf, own[:i] + units + own[to:], counts[:i] + used + counts[to:])
        for k in range(leaf + 1, known):
            self.put(k, [], [])

    def text(self) -> str:
        ends = [*self.begins[1:], len(self.source)]
        return "".join("".join(self.changed[i][0]) if i in self.changed else self.source[a:b] for i, (a, b) in enumerate(zip(self.begins, ends)))

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and counts of all units as they are now."""
        if not self.changed:
            return self.lengths, self.counts
        parts, at = [], 0
        for i in sorted(self.changed):
            units, counts = self.changed[i]
            parts.append((self.lengths[at * LEAF : i * LEAF], self.counts[at * LEAF : i * LEAF]))
            parts.append((np.array(list(map(len, units)), np.int64), np.array(counts, np.int64)))
            at = i + 1
        parts.append((self.lengths[at * LEAF :], self.counts[at * LEAF :]))
        return tuple(np.concatenate(x) for x in zip(*parts))


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with column edits from (doc_id, seq, start, stop, replacement), in order of seq."""
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("edits"))
    return docs.drop("edits").join(own, "doc_id", "left")


TREE = "text string, lengths binary, counts binary"


def count_trees(docs: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, text) to doc_id, n_tokens, and the tree: text, lengths, counts."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from leafwork.llm.tokens import byte_words

        words = byte_words(file)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            found = [CountedText(t, words) for t in texts]
            yield {
                "doc_id": batch["doc_id"], "n_tokens": [x.total for x in found], "text": texts,
                "lengths": [_packed(x.lengths) for x in found], "counts": [_packed(x.counts) for x in found],
            }

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return map_batches(rows, run, f"doc_id long, n_tokens long, {TREE}")


def edit_trees(trees: DataFrame, file: str | None = None, keep_trees: bool = True) -> DataFrame:
    """``count_trees``'s rows with column edits to doc_id, tokens_before, tokens_after, chars_after, chars_encoded_again, and
    (unless ``keep_trees`` is off) the trees that follow."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from leafwork.llm.tokens import byte_words

        words = byte_words(file)
        for batch in batches:
            out = {n: [] for n in ("tokens_before", "tokens_after", "chars_after", "chars_encoded_again", "text", "lengths", "counts")}
            for text, lengths, counts, edits in zip(*(batch[c] for c in ("text", "lengths", "counts", "edits"))):
                counted = CountedText(text, words, (_unpacked(lengths), _unpacked(counts)))
                out["tokens_before"].append(counted.total)
                for e in edits or ():
                    counted.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                out["tokens_after"].append(counted.total)
                out["chars_after"].append(counted.chars[1])
                out["chars_encoded_again"].append(counted.reencoded)
                if keep_trees:
                    out["text"].append(counted.text())
                    for name, numbers in zip(("lengths", "counts"), counted.stored()):
                        out[name].append(_packed(numbers))
            yield out | {"doc_id": batch["doc_id"]}

    schema = "doc_id long, tokens_before long, tokens_after long, chars_after long, chars_encoded_again long" + f", {TREE}" * keep_trees
    return map_batches(trees.select("doc_id", "text", "lengths", "counts", "edits"), run, schema)


def store_trees(docs: DataFrame, folder: str | None = None, file: str | None = None) -> DataFrame:
    """``count_trees`` written as Parquet, by default into the shared folder, and read again."""
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/token-trees-{uuid.uuid4().hex}"
    count_trees(docs, file).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
