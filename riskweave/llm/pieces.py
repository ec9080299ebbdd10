"""Operator 10: byte-pair pieces by a prefix table, and back.

A merge vocabulary gives every prefix of a text one last token.  The table of last
tokens is filled from left to right: an automaton names the pieces that end at a
position, and a piece is the last token of that prefix if it may stand next to the
last token of the prefix before it.  Two tokens may be neighbours if no merge
across their border would have come before the merges that built them.  Reading
the table from its end gives the ids backwards, without a merge queue.

No piece of the vocabulary crosses from a letter to another sign or from another
character to a word mark (U+2581), and none holds a line feed (checked when it is
read).  So texts fall into segments, about a word each, that are encoded on their
own; short segments are remembered within a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LETTER = r"[^\W\d_\xb2\xb3\xb9]"             # no decimal or raised digits
OTHER = rf"(?:[^\w{MARK}\n]|[\d_\xb2\xb3\xb9])"  # neither letter, word mark nor line feed
#: Marks and letters; marks, other signs and the letters after them; marks; a line feed.
SEGMENT = re.compile(rf"{MARK}*{LETTER}+|{MARK}*{OTHER}+{LETTER}*|{MARK}+|\n")
#: What no piece may hold, or it could lie across two segments.
CROSSING = re.compile(rf"{LETTER}{OTHER}|[^{MARK}]{MARK}|\n")
UNKNOWN = " ⁇ "        # what the unknown id decodes to
REMEMBERED = 100_000   # segments in each of a worker's two generations
LONGEST = 48           # longer segments are encoded anew each time
NEIGHBOURS = 200_000   # pairs of tokens that a worker remembers
STRETCH = 1 << 20      # characters of a text that are cut into segments at once
YIELDED = 500_000      # ids in one batch of rows, if its last text has no more


class Pieces:
    """The pieces of a vocabulary file with byte fallback, and their merge order."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in every]
        self.end = model.eos_id()
        self.byte = {int(self.text[i][3:5], 16): i for i in every if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i)
                                          or model.is_unknown(i) or model.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        # Merges run from high to low score.  Runs of word marks share the lowest
        # score and are merged last, see marks().
        low = min(model.get_score(i) for i in plain)
        self.order = {i: -model.get_score(i) for i in plain}
        self.runs = {self.text[i] for i in plain if set(self.text[i]) == {MARK} and len(self.text[i]) > 1}
        if bad := [t for t in self.id if t not in self.runs and CROSSING.search(t)]:
            raise ValueError(f"pieces lie across segments: {bad[:5]}")
        if any(model.get_score(self.id[r]) != low for r in self.runs):
            raise ValueError("runs of word marks must have the lowest score")
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.decimal = [str(i) for i in every]
        self.length = [len(t) for t in self.text]
        #: For each token, which tokens may stand before it, as far as known.
        self.after: list[dict[int, bool]] = [{} for _ in every]
        self.pairs = 0
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            if t not in self.runs and self._halves(i) != (-1, -1):
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.shown = {i: self.text[i] for i in plain} | {model.unk_id(): UNKNOWN}
        self.single = {t for t in self.id if len(t) == 1}
        self.short: dict[str, tuple[int, str, str | None]] = {}
        self.older: dict[str, tuple[int, str, str | None]] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for one character, (-1, -1)
        for a piece that the merges of its own text never reach."""
        if token not in self.parts:
            now = [self.id.get(c, -1) for c in self.text[token]]
            last = None
            while len(now) > 1:
                best = min(((self.order[m], k, m) for k in range(len(now) - 1)
                            if now[k] >= 0 and now[k + 1] >= 0
                            and (m := self.id.get(self.text[now[k]] + self.text[now[k + 1]])) is not None
                            and self.text[m] not in self.runs), default=None)
                if best is None:
                    last = (-1, -1)
                    break
                _, k, merged = best
                last = (now[k], now[k + 1])
                now[k:k + 2] = [merged]
            self.parts[token] = last
        return self.parts[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stood at one side of ``token`` while it was built, each with the
        order of the merge that ended it, outermost last."""
        chain_, ends = [], float("inf")
        while True:
            chain_.append((token, ends))
            halves = self._halves(token)
            if halves is None:
                return chain_[::-1]
            ends, token = self.order[token], halves[side]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between ``left`` and ``right``."""
        if left in self.after[right]:
            return self.after[right][left]
        ok = (-1, -1) not in (self._halves(left), self._halves(right))
        a, b = (self._edge(left, 1), self._edge(right, 0)) if ok else ([], [])
        i = j = 0
        while ok:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            merged = self.id.get(self.text[x] + self.text[y])
            # On equal order the merge further left comes first: that of the left
            # token before the one across the border, that one before the right's.
            if merged is not None and self.text[merged] not in self.runs \
                    and self.order[merged] < x_ends and self.order[merged] <= y_ends:
                ok = False
            elif x_ends == y_ends == float("inf"):
                break
            elif x_ends <= y_ends:
                i += 1
            else:
                j += 1
        if self.pairs >= NEIGHBOURS:
            self.pairs = 0
            for known in self.after:
                known.clear()
        self.pairs += 1
        self.after[right][left] = ok
        return ok

    def _known(self, text: str) -> list[int]:
        """Ids of a text whose characters all are pieces."""
        last, filled, after = [-1], 0, self.after  # last: of each prefix
        for at, (length, token) in self.automaton.iter(text):  # longest first at each end
            if at < filled:
                continue
            if length <= at:
                left = last[at + 1 - length]
                ok = after[token].get(left)
                if not (self.may_follow(left, token) if ok is None else ok):
                    continue
            last.append(token)
            filled = at + 1
        ids, lengths = [], self.length
        while filled:
            token = last[filled]
            ids.append(token)
            filled -= lengths[token]
        ids.reverse()
        return ids

    def marks(self, n: int) -> list[int]:
        """Ids of a run of ``n`` word marks.  All merges of marks have one score, so
        they go from left to right; a heap holds the merges that may come next."""
        if n < 2:
            return [self.id[MARK]] * n
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, 1, 1) for k in range(n - 1)] if MARK * 2 in self.runs else []
        while heap:
            k, mine, its = heapq.heappop(heap)
            r = after[k]
            if size[k] != mine or r >= n or size[r] != its:
                continue
            size[k], size[r], after[k] = mine + its, 0, after[r]
            if after[r] < n:
                before[after[r]] = k
                if MARK * (size[k] + size[after[k]]) in self.runs:
                    heapq.heappush(heap, (k, size[k], size[after[k]]))
            p = before[k]
            if p >= 0 and MARK * (size[p] + size[k]) in self.runs:
                heapq.heappush(heap, (p, size[p], size[k]))
        return [self.id[MARK * s] for s in size if s]

    def _segment(self, text: str) -> list[int]:
        if text == "\n":
            return [self.byte[10]]
        head, word = "", text
        if text[:2] == MARK * 2:
            n = len(text) - len(text.lstrip(MARK)) - 1
            head, word = text[:n], text[n:]
        if self.single.issuperset(word):
            ids = self._known(word)
            if not head:
                return ids
        else:
            ids, start = [], 0
            for k, c in enumerate(word):
                if c not in self.single:
                    ids += self._known(word[start:k])
                    ids += [self.byte[b] for b in c.encode()]
                    start = k + 1
            ids += self._known(word[start:])
        if head:
            run = len(head)
            if ids[0] == self.id[MARK]:
                run, ids = run + 1, ids[1:]
            ids = self.marks(run) + ids
        return ids

    def segment(self, text: str) -> tuple[int, str, str | None]:
        """Number of ids, the ids in decimal, and the decoded text of one segment, which
        is None if it is the segment with its marks as blanks."""
        found = self.older.get(text)
        if found is None:
            ids = self._segment(text)
            raw = self.raw(ids)
            found = (len(ids), " ".join([self.decimal[i] for i in ids]), None if raw == text.replace(MARK, " ") else raw)
        if len(text) <= LONGEST:
            if len(self.short) >= REMEMBERED:  # what is used again moves to the young ones
                self.short, self.older = {}, self.short
            self.short[text] = found
        return found

    def digest_parts(self, text: str) -> Iterator[tuple[int, str, str]]:
        """Number of ids, the ids in decimal and the decoded text of each stretch."""
        for segments in self.stretches(text):
            got = list(map(self.short.get, segments))
            if None in got:
                got = [self.segment(s) if found is None else found for s, found in zip(segments, got)]
            if any(g[2] is not None for g in got):
                back = "".join([s.replace(MARK, " ") if g[2] is None else g[2] for s, g in zip(segments, got)])
            else:
                back = "".join(segments).replace(MARK, " ")
            yield sum([g[0] for g in got]), " ".join([g[1] for g in got]), back

    def stretches(self, text: str) -> Iterator[list[str]]:
        """Segments of a text, at most about STRETCH characters at a time.  Only the last
        segment of a stretch can go on behind it; it begins the next one."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        at, size = 0, STRETCH
        while at < len(marked):
            found = SEGMENT.findall(marked, at, at + size)
            if at + size < len(marked):
                if len(found) == 1:
                    size *= 2
                    continue
                found.pop()
            yield found
            at, size = at + sum(map(len, found)), STRETCH

    def segments(self, text: str) -> list[str]:
        return [*chain.from_iterable(self.stretches(text))]

    def forget(self) -> None:
        """Keep only the younger half of what is remembered, give back what Arrow holds."""
        self.older = {}
        pa.default_memory_pool().release_unused()

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with the end id."""
        return [*chain.from_iterable(self._segment(s) for s in self.segments(text)), self.end]

    def raw(self, ids) -> str:
        """The text of ids, its leading blank still there; bytes that are no UTF-8
        become U+FFFD, one for each."""
        if self.value.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids if i in self.shown]).replace(MARK, " ")
        out: list[str] = []
        pending = bytearray()
        for i in chain(ids, (-1,)):
            if i in self.value:
                pending.append(self.value[i])
                continue
            if pending:
                out.append(_utf8(bytes(pending)))
                pending.clear()
            if i in self.shown:
                out.append(self.shown[i])
        return "".join(out).replace(MARK, " ")

    def decode(self, ids) -> str:
        """The text of ids; one leading blank, which encoding adds, goes."""
        raw = self.raw(ids)
        first = next((i for i in ids if i in self.shown or i in self.value), self.end)
        return raw[1:] if first in self.order and raw[:1] == " " else raw


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out = []
        while data:
            for n in (4, 3, 2, 1):
                try:
                    c = data[:n].decode()
                except UnicodeDecodeError:
                    continue
                if len(c) == 1:
                    out.append(c)
                    data = data[n:]
                    break
            else:
                out.append("�")
                data = data[1:]
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """One table for each worker process."""
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                 model: str | None = None, ids: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256
    and, unless ``ids`` is false, ids (array of int, end id last).

    A null text counts as empty and has the end id alone.  Rows that repeat are kept;
    other columns are not read, so their names cannot clash.  A segment without word
    marks is encoded in one piece however long it is; long texts are encoded whole.  An
    empty table gives no rows.  ``model`` is read by each
    worker from its own installation when it is not given."""
    kind = docs.schema[doc_id].dataType.simpleString()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]

    def rows_of(keys, rows):
        counts, digests, decoded, lists = zip(*rows)
        columns = [keys, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        if ids:
            offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists))))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        pieces = load(model or default_model())
        end = str(pieces.end)
        for batch in batches:
            rows, held, first = [], 0, 0
            for k, value in enumerate(batch.column(1)):
                count, hashed, back, found, blank = 1, hashlib.sha256(), hashlib.sha256(), [], True
                for n, joined, text_back in pieces.digest_parts(value.as_py() or ""):
                    if blank:  # the blank that encoding adds
                        text_back, blank = text_back[1:] if text_back[:1] == " " else text_back, False
                    count += n
                    hashed.update((joined + " ").encode())
                    back.update(text_back.encode())
                    if ids:
                        found.append(np.fromstring(joined, np.int32, sep=" "))
                hashed.update(end.encode())
                rows.append((count, hashed.hexdigest(), back.hexdigest(), np.concatenate([*found, [pieces.end]]).astype(np.int32) if ids else None))
                held += count
                if ids and held >= YIELDED:
                    yield rows_of(batch.column(0).slice(first, k + 1 - first), rows)
                    rows, held, first = [], 0, k + 1
            if rows:
                yield rows_of(batch.column(0).slice(first), rows)
        pieces.forget()

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(
        run, schema + (", ids array<int>" if ids else ""))


def decode_ids(rows: DataFrame, *, ids: str = "ids", out: str = "text", model: str | None = None) -> DataFrame:
    """``rows`` with the text of each list of ids in ``out`` (null ids: null; an
    existing column of that name is replaced)."""
    @F.pandas_udf("string")
    def back(column):
        pieces = load(model or default_model())
        return column.map(lambda x: None if x is None else pieces.decode([int(i) for i in x]))

    return rows.withColumn(out, back(F.col(ids)))
