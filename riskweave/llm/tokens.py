"""Operator 1: token counts by a linear longest-match automaton.

Word pieces are taken greedily, the longest first.  A trie of the vocabulary gets
failure links: where a word leaves the trie, the link leads to the node that is
reached once the longest pieces of what was read are taken off, and the link carries
how many those are.  Links and counts are made once, so a word costs one step for
each character and no piece is ever built.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+|[^\w\s]")
REMEMBERED = 250_000   # words in each of a worker's two generations
LONGEST = 48


class WordPieces:
    """Counts of greedy pieces for words; ``first`` may begin a word, ``inner`` go on."""

    def __init__(self, first: set[str], inner: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]   # nodes 0 and 1 are the two roots
        ends: set[int] = set()
        for root, vocabulary in ((0, first), (1, inner)):
            for piece in vocabulary:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                    node = self.next[node][c]
                if piece:
                    ends.add(node)
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = [0, 1]
        for node in queue:
            for c, child in self.next[node].items():
                queue.append(child)
                if child in ends:
                    self.link[child], self.popped[child] = 1, 1
                    continue
                at, popped = self.link[node], self.popped[node]
                while at >= 0 and c not in self.next[at]:
                    at, popped = self.link[at], popped + self.popped[at]
                if at >= 0:
                    self.link[child], self.popped[child] = self.next[at][c], popped
        self.short: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Number of pieces, 0 if the vocabulary can't make the word."""
        nodes, link, popped = self.next, self.link, self.popped
        at = total = 0
        for c in word:
            while c not in nodes[at]:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return 0
            at = nodes[at][c]
        while at != 1:
            total += popped[at]
            at = link[at]
            if at < 0:
                return 0
        return total

    def remembered(self, word: str) -> int:
        found = self.older.get(word)
        if found is None:
            found = self.count(word)
        if len(word) <= LONGEST:
            if len(self.short) >= REMEMBERED:
                self.short, self.older = {}, self.short
            self.short[word] = found
        return found

    def text(self, text: str) -> tuple[int, int, int]:
        """Words, tokens and unknown words; an unknown word is one token."""
        words = WORD.findall(text)
        counts = list(map(self.short.get, words))
        if None in counts:
            counts = [self.remembered(w) if n is None else n for w, n in zip(words, counts)]
        unknown = counts.count(0)
        return len(words), sum(counts) + unknown, unknown


def vocabulary(path: str) -> tuple[set[str], set[str]]:
    """(first, inner) pieces of a public vocabulary of word pieces: pieces that begin
    with a word mark may begin a word, the others continue it or are signs."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, inner = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece[0] == "▁":
            first.add(piece[1:])
        else:
            inner.add(piece)
    first |= {p for p in inner if len(p) == 1}  # a character alone may begin a word
    return first - {""}, inner


@lru_cache(maxsize=2)
def load(path: str) -> WordPieces:
    """One automaton for each worker process."""
    return WordPieces(*vocabulary(path))


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                 vocabulary: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_tokens, n_unknown.

    Words are runs of letters, digits and underscores, and single other signs; an
    unknown word is one token.  A null text counts as empty and has none of them; a
    text of any length is counted whole.  Rows that repeat are kept, other columns are not
    read.  An empty table gives no rows."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        pieces = load(vocabulary or default_vocabulary())
        for b in batches:
            found = [pieces.text(v.as_py() or "") for v in b.column(1)]
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
