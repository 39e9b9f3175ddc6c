"""Operator 10: token counts by byte-pair merging with a heap and a linked list.

The vocabulary of a SentencePiece BPE model gives each merge its rank. A word starts as one symbol per character; a
heap holds the adjacent pairs that are pieces, the lowest rank (then the leftmost) is popped and merged in the linked
list, and the new pairs are pushed. The count is the number of initial symbols less the merges, where a character
that is no piece counts as its UTF-8 bytes. No token is ever looked up or emitted.

A text is cut where no piece reaches across: before a run of blanks that follows something else, and at line feeds if
no piece holds one. Counts of words are remembered, at most REMEMBER of them in a Python worker.

Models with a normaliser are refused. Defined results: a null text counts as empty; an empty text has no tokens.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinclock.llm.common import bound_batches, text_udf

MARK = "▁"
LIMIT = 4096
REMEMBER = 800_000
_SHIFT = 40
_LOW = (1 << _SHIFT) - 1


class Merges:
    """Ranks of pieces, and what they say about where a text may be cut."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.inner_mark = any(MARK in p.lstrip(MARK) for p in ranks)
        self.feed_alone = not any("\n" in p for p in ranks)

    @classmethod
    def load(cls, path: str) -> Merges:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        if any(model.is_unused(k) for k in ids) or model.encode("Ａ  ½", out_type=str) != model.encode(f"Ａ{MARK}{MARK}½", out_type=str) or not model.encode(" "):
            raise ValueError("only models without unused pieces and without a normaliser")
        scores = sorted({model.get_score(k) for k in ids}, reverse=True)
        place = {s: n for n, s in enumerate(scores)}
        return cls({model.id_to_piece(k): place[model.get_score(k)] for k in ids})


def count_word(word: str, ranks: dict[str, int]) -> int:
    """Tokens of ``word``: its symbols less the merges."""
    n = tokens = len(word)
    for c in word:
        if c not in ranks:
            tokens += len(c.encode("utf-8", "surrogatepass")) - 1
    get = ranks.get
    heap = []
    for k in range(n - 1):
        rank = get(word[k: k + 2])
        if rank is not None:
            heap.append(rank << _SHIFT | k)
    if not heap:
        return tokens
    heapify(heap)
    # a symbol is known by its first character: end[k] is where it ends (0 once merged away), before[k] the symbol before it
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heappop(heap)
        k = top & _LOW
        middle = end[k]
        if not middle or middle >= n:
            continue
        stop = end[middle]
        if get(word[k:stop]) != top >> _SHIFT:
            continue
        end[k], end[middle] = stop, 0
        tokens -= 1
        if stop < n:
            before[stop] = k
            rank = get(word[k: end[stop]])
            if rank is not None:
                heappush(heap, rank << _SHIFT | k)
        if k:
            left = before[k]
            rank = get(word[left:stop])
            if rank is not None:
                heappush(heap, rank << _SHIFT | left)
    return tokens


class _Counts(dict):
    """Counts of words, each with ``lead`` before it: those met since the last turn, and ``old``, those of the turn before,
    so that common words are not forgotten with the rare ones."""

    def __init__(self, ranks: dict[str, int], lead: str, turn: int):
        self.ranks, self.lead, self.turn, self.old = ranks, lead, turn, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = count_word(self.lead + word, self.ranks)
        if len(word) <= 64:
            if len(self) >= self.turn:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n


class Counter:
    def __init__(self, merges: Merges):
        self.merges = merges
        # each holds two turns at most
        self.bare, self.marked = _Counts(merges.ranks, "", REMEMBER // 8), _Counts(merges.ranks, MARK, REMEMBER * 3 // 8)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _line(self, line: str, first: bool) -> int:
        """Tokens of a line; a blank goes before the first."""
        if MARK in line or "  " in line or line[:1] == " " or line[-1:] == " ":
            line = MARK * first + line.replace(" ", MARK)
            return sum(map(self.bare.__getitem__, self.words.findall(line)))
        words = line.split(" ")
        return (self.marked if first else self.bare)[words[0]] + sum(map(self.marked.__getitem__, words[1:]))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.merges.inner_mark:
            return count_word(MARK + text.replace(" ", MARK), self.merges.ranks)
        if not self.merges.feed_alone:
            return self._line(text, True)
        lines = text.split("\n")
        # an empty line has no symbol, but the first one has the leading blank
        total = self._line(lines[0], True) if lines[0] else count_word(MARK, self.merges.ranks)
        return total + len(lines) - 1 + sum(self._line(line, False) for line in lines[1:] if line)


_own: list[Counter] = []


def counter_of(merges: Merges) -> Counter:
    """The counter of this Python worker, which keeps what it remembers from task to task. (Called by its module's name:
    a function that is sent to the workers carries copies of what it refers to.)"""
    if not _own or _own[0].merges is not merges:
        _own[:] = [Counter(merges)]
    return _own[0]


def counter(docs: DataFrame, path: str):
    """A column function from text to token count. The ranks of the model at ``path`` are broadcast (a few MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(Merges.load(path))

    def prepare():
        own = counter_of(shared.value)
        return lambda texts: pa.array([own.count(t.decode("utf-8", "replace")) if t else 0 for t in texts], pa.int64())
    return text_udf(prepare, "bigint")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    bound_batches(docs.sparkSession)
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), counter(docs, path)(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
