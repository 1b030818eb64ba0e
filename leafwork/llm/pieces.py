"""SentencePiece BPE encoding and decoding as a max-plus scan over chunks.

A segmentation is the BPE result exactly if every two neighbouring pieces are what BPE makes of the two alone: what BPE
does inside a stretch doesn't depend on what lies outside as long as no merge crosses its ends. So the result is the best
path in the max-plus semiring whose weights are 0 for neighbours that agree with BPE and minus infinity for others, and
there is one such path. A boundary state of a cut is the piece that reaches or crosses it. A chunk of a giant document
gives the transfer matrix from the states at its left cut to those at its right cut; matrices are combined associatively
(a chunk with a word break has rank one) in a tree of at most ``FAN`` at a time, up to the document's own matrix and down
again to the states at all cuts, and each chunk is then backtraced alone.

Documents up to ``CHUNK`` characters are one chunk and are not shuffled. Longer ones are dealt out chunk by chunk.

Defined cases: a null text counts as empty and has no pieces; characters outside the vocabulary become bytes; repeated rows
are encoded each; a null doc_id is kept; an empty table gives an empty result; decoding gives the text back, whatever it holds,
but for U+2581, which stands for a blank; bytes of other ids that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import cut, map_batches

CHUNK, WORDS, PAIRS, FAN = 32_768, 400_000, 400_000, 256
BLANK = "▁"
Span = tuple[int, int]  # a piece by its place: first character, end


class Pieces:
    """A SentencePiece BPE model: its pieces, ids and the paths that agree with it."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = range(model.vocab_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in size if model.is_byte(i)}
        self.names = [model.id_to_piece(i) for i in size]
        self.ids = {n: i for i, n in enumerate(self.names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.scores = {n: model.get_score(i) for n, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.joints = {n[k : k + 2] for n in self.ids for k in range(len(n) - 1)}  # neighbours that some piece holds
        plain = "\n" not in self.ids and not any(j[1] in ".," and j[0].isalpha() for j in self.joints)
        self.tangled = re.compile("  |^ |[\0▁]" if plain else "")  # else breaks aren't found by splitting
        self.marks = re.compile(r"^[.,]|[\W\d_][.,]")  # a full stop or comma after a letter begins a new word
        self.heads = {n[:k]: -1 for n in self.ids for k in range(1, len(n) + 1)}  # beginnings of pieces; pieces get their id below
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.own = {n: i for n, i in self.ids.items() if self.greedy(n) == [n]}  # pieces that BPE makes of their own text
        self.heads |= self.own

    def greedy(self, text: str) -> list[str]:
        """BPE of a short text by its definition: the best-scored pair merges first, the leftmost of equals."""
        parts, get = list(text), self.scores.get
        none = float("-inf")
        found = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while found and (best := max(found)) > none:
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(found):
                found[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def agree(self, left: int, right: int) -> bool:
        """Whether the weight of two neighbouring pieces is 0 (and not minus infinity)."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self.names[left], self.names[right]
        found = self.pairs[left << 20 | right] = a + b not in self.own and self.greedy(a + b) == [a, b]
        return found

    def forward(self, text: str, start: int, end: int, before: str | None) -> dict[int, int]:
        """From position ``start``, after the piece ``before``: each position up to ``end`` that a path reaches, with the start of its last piece.

        Paths may cross ``end``: positions up to the longest piece beyond it are given, reached by pieces that begin before it.
        """
        last: dict[int, int] = {start: -1 if before is None else self.own.get(before, -1)}  # -1: nothing, or what nothing merges with
        begin: dict[int, int] = {}
        heads, pairs, agree = self.heads.get, self.pairs.get, self.agree
        limit = min(len(text), end + self.longest - 1)
        for j in range(start, min(end, limit)):
            if j not in last:
                continue
            left = last[j]
            for i in range(j + 1, limit + 1):
                right = heads(text[j:i])
                if i == j + 1 and (right is None or right < 0):  # a character outside the vocabulary
                    begin[i], last[i] = j, -1
                if right is None:
                    break
                if right >= 0 and i not in begin:
                    ok = left < 0 or pairs(left << 20 | right)
                    if ok or (ok is None and agree(left, right)):
                        begin[i], last[i] = j, right
        return begin

    def back(self, reach: dict[int, int], start: int, end: int) -> list[Span]:
        path = []
        while end > start:
            path.append((reach[end], end))
            end = reach[end]
        return path[::-1]

    def breaks(self, text: str, lo: int, hi: int) -> list[int]:
        """Positions in [lo, hi] that no piece crosses: no piece holds the two characters there as neighbours."""
        return [i for i in range(max(lo, 1), min(hi, len(text) - 1) + 1) if text[i - 1 : i + 1] not in self.joints]

    def to_ids(self, text: str, path: list[Span]) -> list[int]:
        out = []
        for a, b in path:
            number = self.ids.get(text[a:b])
            out += [number] if number is not None else [self.bytes[x] for x in text[a:b].encode("utf-8", "surrogatepass")]
        return out

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            found = self.words[word] = array("H", self.longest_first(word) or self.to_ids(word, self.back(self.forward(word, 0, len(word), None), 0, len(word)))).tobytes()
        return found

    def longest_first(self, word: str) -> list[int] | None:
        """The ids of a word by its one path, searched from the longest piece that agrees with the one before; a stretch has one
        path at most, so a position is visited once. None: the word holds characters outside the vocabulary."""
        heads, pairs, agree, n = self.heads.get, self.pairs.get, self.agree, len(word)
        out, open_, seen, left, j = [], [], set(), -1, 0
        while True:
            found = []
            for i in range(j + 1, n + 1):
                right = heads(word[j:i])
                if right is None:
                    break
                if right >= 0 and i not in seen:
                    found.append((i, right))
            while True:
                while found:
                    i, right = found.pop()
                    if left < 0 or (ok := pairs(left << 20 | right)) or (ok is None and agree(left, right)):
                        break
                else:
                    if not out:
                        return None
                    found = open_.pop()
                    out.pop()
                    left = out[-1] if out else -1
                    continue
                break
            out.append(right)
            if i == n:
                return out
            open_.append(found)
            seen.add(i)
            j, left = i, right

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as bytes of unsigned 16-bit numbers; words between breaks are chunks of their own."""
        if not text:
            return b""
        if self.tangled.search(text):
            shown, out, at = BLANK + text.replace(" ", BLANK), [], 0
            for i in [*self.breaks(shown, 1, len(shown)), len(shown)]:
                out.append(self.word(shown[at:i]))
                at = i
            return b"".join(out)
        parts = (BLANK + text.replace(" ", "\0" + BLANK)).replace("\n", "\0\n\0")
        if not self.marks.search(text):
            parts = parts.replace(".", "\0.").replace(",", "\0,")
        return b"".join(map(self.word, parts.split("\0")))

    # Chunks of giant texts. A state is (text of the piece, how far it reaches beyond the cut).

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """All pieces of the vocabulary that reach or cross position ``at`` of ``text``: candidates for the boundary state."""
        if at == 0:
            return [(0, 0)]
        spans = ((a, b) for a in range(max(0, at - self.longest), at) for b in range(at, min(len(text), a + self.longest) + 1))
        return [(a, b) for a, b in spans if b - a == 1 or text[a:b] in self.own]

    def transfer(self, text: str, lo: int, hi: int) -> dict:
        """The matrix of the chunk [lo, hi) of ``text`` (the chunk with what is around it): entry state -> exit states.

        States are (start, end) relative to their cut. With a break inside, rows that reach the first break share its exits.
        """
        end = len(text) == hi
        first = next(iter(self.breaks(text, lo + self.longest, min(hi - self.longest, lo + 4 * self.longest))), None)
        exits = lambda reach, lo_: [(j - hi, i - hi) for i, j in reach.items() if i >= hi and j < hi and (not end or i == hi)]
        common = []
        if first:  # a path passes every break, so that only what follows the last one matters at the right cut
            last = next(i for i in range(hi - self.longest, first - 1, -1) if i == first or text[i - 1 : i + 1] not in self.joints)
            common = exits(self.forward(text, last, hi, None), last)
        rows = {}
        for a, b in self.states(text, lo):
            key = (a - lo, b - lo)
            before = text[a:b] or None
            if first:
                reached = self.forward(text, b, first, before)
                rows[key] = common if first in reached or first == b else []
            else:
                rows[key] = ([(a - hi, b - hi)] if b >= hi and (not end or b == hi) else []) + exits(self.forward(text, b, hi, before), b)
        return rows

    def trace(self, text: str, lo: int, hi: int, entry: Span, leave: Span) -> bytes:
        """The ids of the pieces that begin in a chunk, between its two boundary states; words between breaks are looked up."""
        (a, b), end = (entry[0] + lo, entry[1] + lo), leave[1] + hi
        if b >= hi and (a, b) == (leave[0] + hi, end):
            return b""
        stops = [i for i in self.breaks(text, b, hi) if b <= i <= min(hi, end)]
        before = text[a:b] or None
        if not stops:
            return array("H", self.to_ids(text, self.back(self.forward(text, b, hi, before), b, end))).tobytes()
        out = [array("H", self.to_ids(text, self.back(self.forward(text, b, stops[0], before), b, stops[0]))).tobytes()]
        out += [self.word(text[i:j]) for i, j in zip(stops, stops[1:])]
        at = stops[-1]
        out.append(array("H", self.to_ids(text, self.back(self.forward(text, at, max(hi, at), None), at, end))).tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray, head: bool = True) -> str:
        """The text of ids: bytes are joined, the blank that leads the first word goes from the head of a text."""
        if not hasattr(self, "raw"):
            self.raw = [n.replace(BLANK, " ").encode() for n in self.names]
            for value, number in self.bytes.items():
                self.raw[number] = bytes([value])
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if head and text[:1] == " " else text


@lru_cache(1)
def pieces(model_file: str | None = None) -> Pieces:
    import public_tokenizers

    return Pieces(model_file or public_tokenizers.path("piece_bpe_32k.model"))


def combine(left: dict, right: dict) -> dict:
    """The product of two transfer matrices in the max-plus semiring with weights 0 and minus infinity; it is associative."""
    out = {}
    for entry, middles in left.items():
        found = {}
        for m in middles:
            for leave in right.get(m, ()):
                found.setdefault(leave, True)
        out[entry] = list(found)
    return out


def boundary_states(matrices: list[dict], entry: Span, leave: Span) -> list[Span]:
    """The state at each cut, from ``entry`` before the first matrix to ``leave`` behind the last, that lies on the one path."""
    n = len(matrices)
    ahead = [matrices[-1]]  # products of all matrices from a place to the end
    for m in matrices[-2:0:-1]:
        ahead.append(combine(m, ahead[-1]))
    states = [entry]
    for i in range(n - 1):
        rest = ahead[n - 2 - i]
        states.append(next(m for m in matrices[i][states[-1]] if leave in rest.get(m, ())))
    return [*states, leave]


def _states(matrices: DataFrame, fan: int) -> DataFrame:
    """(row, chunk, matrix) to (row, chunk, n_chunks, states): the states before and behind each chunk. No group has more than ``fan`` rows."""
    whole = F.floor(F.col("chunk") / fan).cast("int").alias("part")

    def product(group: pd.DataFrame) -> pd.DataFrame:
        found = reduce(combine, map(_read, group.sort_values("chunk")["matrix"]))
        return pd.DataFrame({"row": group["row"].iloc[:1], "chunk": group["chunk"].iloc[0] // fan, "matrix": repr(found)})

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        found = [_read(m) for m in group["matrix"]]
        if "states" in group:
            a, b, c, d = group["states"].iloc[0]
            entry, leave = (a, b), (c, d)
        else:  # a document as a whole has one entry and one exit
            ((entry, (leave, *_)),) = reduce(combine, found).items()
        at = boundary_states(found, entry, leave)
        return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "states": [[*a, *b] for a, b in zip(at, at[1:])]})

    out = "row long, chunk int, states array<int>"
    if not matrices.where(F.col("chunk") >= fan).take(1):
        return matrices.groupBy("row").applyInPandas(settle, out)
    above = cut(matrices.groupBy("row", whole).applyInPandas(product, "row long, chunk int, matrix string"))
    outer = _states(above, fan).select(F.col("row").alias("of"), F.col("chunk").alias("part"), "states")
    inner = matrices.withColumn("at", whole).join(outer, (F.col("row") == F.col("of")) & (F.col("at") == F.col("part"))).select("row", "part", "chunk", "matrix", "states")
    return inner.groupBy("row", "part").applyInPandas(settle, out)


def encode(docs: DataFrame, model_file: str | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, chunk, n_chunks, ids (bytes of unsigned 16-bit numbers): a row for each chunk, one for most documents."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    longest = pieces(model_file).longest

    def whole(batches: Iterator[dict]) -> Iterator[dict]:
        model = pieces(model_file)
        for batch in batches:
            ids = [model.encode(t) for t in batch["text"]]
            yield {"doc_id": batch["doc_id"], "chunk": [0] * len(ids), "n_chunks": [1] * len(ids), "ids": ids}

    schema = "doc_id long, chunk int, n_chunks int, ids binary"
    short = map_batches(rows.where(F.char_length("text") <= chunk), whole, schema)

    # giant documents: chunks with the longest piece's reach around them, stored so that their row numbers stay
    shown = F.concat(F.lit(BLANK), F.replace(F.col("text"), F.lit(" "), F.lit(BLANK)))
    giant = (
        rows.where(F.char_length("text") > chunk)
        .select("doc_id", F.monotonically_increasing_id().alias("row"), shown.alias("t"))
        .withColumn("n_chunks", (F.floor((F.char_length("t") - 1) / chunk) + 1).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .withColumn("lo", F.least(F.col("chunk") * chunk, F.lit(longest)))
        .withColumn("t", F.substring("t", F.col("chunk") * chunk - F.col("lo") + 1, F.col("lo") + F.lit(chunk + longest)))
        .withColumn("hi", F.least(F.col("lo") + chunk, F.char_length("t")))
        .select("doc_id", "row", "chunk", "n_chunks", "lo", "hi", "t")
    )
    giant = cut(giant.repartition(F.col("row"), F.col("chunk")))

    def matrices(batches: Iterator[dict]) -> Iterator[dict]:
        model = pieces(model_file)
        for batch in batches:
            found = [model.transfer(t, lo, hi) for t, lo, hi in zip(batch["t"], batch["lo"], batch["hi"])]
            yield {"row": batch["row"], "chunk": batch["chunk"], "matrix": [repr(m) for m in found]}

    states = _states(cut(map_batches(giant, matrices, "row long, chunk int, matrix string")), fan)

    def traced(batches: Iterator[dict]) -> Iterator[dict]:
        model = pieces(model_file)
        for batch in batches:
            ids = []
            for t, lo, hi, (a, b, c, d) in zip(batch["t"], batch["lo"], batch["hi"], batch["states"]):
                ids.append(model.trace(t, lo, hi, (a, b), (c, d)))
            yield {"doc_id": batch["doc_id"], "chunk": batch["chunk"], "n_chunks": batch["n_chunks"], "ids": ids}

    long = map_batches(giant.join(states, ["row", "chunk"]).select("doc_id", "chunk", "n_chunks", "t", "lo", "hi", "states"), traced, schema)
    return short.unionByName(long)


def _read(text: str) -> dict:
    from ast import literal_eval

    return literal_eval(text)


def decode(encoded: DataFrame, model_file: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``encode``'s rows to doc_id, chunk, n_chunks, text (and ids): the chunks of a document in order make its text."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        model = pieces(model_file)
        for batch in batches:
            found = [model.decode(np.frombuffer(raw, "<u2"), not chunk) for chunk, raw in zip(batch["chunk"], batch["ids"])]
            yield {"doc_id": batch["doc_id"], "chunk": batch["chunk"], "n_chunks": batch["n_chunks"], "text": found, "ids": batch["ids"]}

    return map_batches(encoded, run, "doc_id long, chunk int, n_chunks int, text string" + ", ids binary" * keep_ids)
