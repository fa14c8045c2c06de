"""Byte-level BPE by prefix dynamic programming, and its inverse.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours stay apart, that is, if
merging the bytes of the two by rank gives the two again. So every prefix of a piece has one possible last
token: the token that ends there and stays apart from the last token of the prefix before it. ``Prefixes``
stores that token for every byte, and a piece is read off from its end. Appending bytes goes on from the
stored prefix, cutting is dropping entries, and both give the encoding of the new bytes exactly.

``Document`` holds the pieces of a text. The pattern never looks behind the start of a match, so an edit
keeps all matches that end well before it, takes up the stored prefix of the piece it falls in, and stops as
soon as a new match starts where an old one did.

``encoded`` works on Arrow batches, a bounded number of texts at a time. Pieces that were met before are
looked up in a bounded table of each Python worker, which changes the time and never the result. Rows are
independent: nothing is shuffled.

Defined cases: a null text is empty and has no ids; a piece that is a token is that token, whatever its
merges would give; the text of a special token is ordinary text; lone surrogates, which Spark cannot hold,
do not occur; repeated rows are rows like others; null ids are passed on; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Pieces and pairs of tokens a Python worker remembers; beyond that it starts afresh.
REMEMBERED = 1 << 18
# Bytes of texts that are worked on at a time.
CHUNK = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Before(dict):
    """Tokens that may stand before a token, and those that may not, worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary, token: int):
        super().__init__()
        self.vocabulary, self.token = vocabulary, token

    def __missing__(self, left: int) -> bool:
        self.vocabulary.remember()
        found = self[left] = self.vocabulary.apart(left, self.token)
        return found


class Vocabulary:
    """Tokens by rank, the two tokens each was merged from, and which neighbours stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.single = frozenset(rank for token, rank in ranks.items() if len(token) == 1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.before: list[Before] = []
        self.remembered = 0
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) > 1:
                self._add(token, rank)
        self.longest = max(map(len, ranks), default=1)
        # Finds all tokens that end at a byte, the longest first; bytes stand as the characters of their number.
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self._whole(rank):
                self.before.append(Before(self, rank))
                self.ending.add_word(token.decode("latin-1"), (rank, len(token), self.before[-1]))
        self.ending.make_automaton()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        return cls(read_ranks(path))

    def _add(self, token: bytes, rank: int) -> None:
        """Finds the halves of a token: two earlier tokens that stay apart as long as it is unknown."""
        get = self.ranks.get
        for at in range(1, len(token)):
            left, right = get(token[:at], rank), get(token[at:], rank)
            if left < rank and right < rank and self._whole(left) and self._whole(right) and self.apart(left, right):
                self.halves[rank] = left, right
                self.joined[left, right] = rank
                return

    def _whole(self, token: int) -> bool:
        """Whether the merges of a token's bytes lead to it."""
        return token in self.halves or token in self.single

    def apart(self, left: int, right: int) -> bool:
        """Undoes the merges next to the border, the last first, and looks for an earlier one across it.

        Of merges of one rank the left one comes first: it beats a merge across the border on its left,
        and one across beats a merge on the border's right.
        """
        joined, halves, before = self.joined, self.halves, 1 << 62
        while True:
            if joined.get((left, right), before) < before:
                return False
            left_made = left if left in halves else -1
            right_made = right if right in halves else -1
            if left_made > right_made:
                before, left = left, halves[left][1]
            elif right_made >= 0:
                before, right = right + 1, halves[right][0]
            else:
                return True

    def remember(self) -> None:
        """Counts the pairs that are remembered; beyond the bound it starts afresh."""
        self.remembered += 1
        if self.remembered > REMEMBERED:
            self.remembered = 1
            for known in self.before:
                known.clear()


class Prefixes:
    """The last token of every byte prefix of a growing piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last = array("q")
        self.extend(data)

    def extend(self, data: bytes) -> None:
        words, last, start = self.vocabulary, self.last, len(self.data)
        self.data += data
        context = max(0, start - words.longest)  # the bytes before are part of no token that ends in the new ones
        done, append = start, last.append
        for end, (token, length, before) in words.ending.iter(self.data[context:].decode("latin-1")):
            end += context + 1
            if end > done and (length == end or before[last[end - length - 1]]):
                append(token)
                done = end

    def cut(self, length: int) -> None:
        del self.data[length:], self.last[length:]

    def ids(self) -> list[int]:
        """The tokens of the whole piece; a piece that is a token is that one."""
        whole = self.vocabulary.ranks.get(bytes(self.data))
        if whole is not None:
            return [whole]
        out, end, sizes = [], len(self.last), self.vocabulary.bytes
        while end:
            out.append(self.last[end - 1])
            end -= len(sizes[out[-1]])
        return out[::-1]


class Document:
    """A text cut into pieces that follows appends and edits."""

    # A match may read this many characters from its start on, and two beyond its end.
    LOOK = 3

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.starts, self.pieces = "", [], []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, begin: int, end: int, new: str) -> None:
        """Puts ``new`` in place of the characters from ``begin`` to ``end``."""
        old, starts = self.text, self.starts
        self.text = old[:begin] + new + old[end:]
        ends = [*starts[1:], len(old)]
        keep = len(starts)
        while keep and (ends[keep - 1] + 1 >= begin or starts[keep - 1] + self.LOOK > begin):
            keep -= 1
        kept_starts, kept = starts[:keep], self.pieces[:keep]
        shift = len(self.text) - len(old)
        at = {start + shift: number for number, start in enumerate(starts) if number >= keep and start >= end}
        reusable = self.pieces[keep] if keep < len(self.pieces) else None
        for match in self.pattern.finditer(self.text, starts[keep] if keep < len(starts) else 0 if not starts else ends[-1]):
            number = at.get(match.start())
            if number is not None:
                kept_starts += [start + shift for start in starts[number:]]
                kept += self.pieces[number:]
                break
            data = match.group().encode("utf-8")
            kept_starts.append(match.start())
            kept.append(self._piece(data, reusable))
            reusable = None
        self.starts, self.pieces = kept_starts, kept

    def _piece(self, data: bytes, old: Prefixes | None) -> Prefixes:
        """A piece, from what ``old`` has in common with it."""
        piece = Prefixes(self.vocabulary)
        if old is not None:
            same = next((i for i, (a, b) in enumerate(zip(old.data, data)) if a != b), min(len(old.data), len(data)))
            piece.data, piece.last = old.data[:same], old.last[:same]
        piece.extend(data[len(piece.data):])
        return piece

    def ids(self) -> list[int]:
        return [token for piece in self.pieces for token in piece.ids()]


class Encoder(dict):
    """Ids of pieces as little-endian 32-bit numbers, worked out when they are first asked for."""

    def __init__(self, ranks: str, pattern: str):
        import regex

        super().__init__()
        self.vocabulary = Vocabulary.read(ranks)
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = b"".join([token.to_bytes(4, "little") for token in Prefixes(self.vocabulary, piece.encode("utf-8")).ids()])
        if len(piece) < 64:
            self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer: tuple[str, str]) -> Encoder:
    """The encoder of this Python worker."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(*tokenizer)
    return _ENCODERS[tokenizer]


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``CHUNK`` bytes in a column, a row at least."""
    sizes = batch.column(column).nbytes
    rows = max(1, min(batch.num_rows, batch.num_rows * CHUNK // max(1, sizes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def encoded(docs: DataFrame, tokenizer: tuple[str, str]) -> DataFrame:
    """doc_id and ``ids``, the ids of the whole text as little-endian unsigned 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer).ids
        for batch in batches:
            for part in chunks(batch, 1):
                out = pa.array([ids(text) if text else b"" for text in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, tokenizer: tuple[str, str]) -> DataFrame:
    """``rows`` of doc_id and ids with ``decoded``, the bytes the ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: token for token, rank in read_ranks(tokenizer[0]).items()}.__getitem__
        for batch in batches:
            for part in chunks(batch, 1):
                out = pa.array([b"".join(map(token, memoryview(ids).cast("I"))) for ids in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
