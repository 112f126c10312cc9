"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has exactly one token that can end its encoding:
of the vocabulary's tokens that are suffixes of the prefix, the one that fits
the last token of what stands before it. Two tokens fit if their bytes together
encode to just these two. Storing that token for each prefix gives the encoding
of any prefix by walking back, makes an append exact without looking at what
came before, and after an edit leaves all in front of it as it is.

The vocabulary splits a text into pieces first; within a piece the table above
is kept, and whole pieces are remembered, as they repeat throughout a corpus.
"""

from __future__ import annotations

import base64
import re

import ahocorasick
import regex

#: The pre-tokenizer of the public vocabulary (fixed value); the alternatives
#: other than the last two exclude each other but for the one with the apostrophe.
PATTERN = r" ?\p{L}+|'(?:[sdmt]|ll|ve|re)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over ASCII only, for the faster standard engine.
_ASCII = r" ?[A-Za-z]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"

_REMEMBERED = 400_000
_SHORT = 24
_NEVER = 1 << 60


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its id per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class PrefixEncoder:
    """Encodes texts with one vocabulary; ids of special tokens never come out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._fits: dict[tuple[int, int], bool] = {}
        self._grown: dict[int, tuple[list[bytes], list[int], list[bytes], list[int]]] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(PATTERN).findall
        self._split_ascii = re.compile(_ASCII).findall
        self._suffixes: ahocorasick.Automaton | None = None

    # ------------------------------------------------------------ tokens that fit

    def _spines(self, token: int) -> tuple[list[bytes], list[int], list[bytes], list[int]]:
        """How the ends of a token come about while it is merged on its own: the
        parts that stand first and last in turn, and for each the highest rank
        merged before the next one replaces it."""
        known = self._grown.get(token)
        if known is not None:
            return known
        data, ranks = self.tokens[token], self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        first, first_until, last, last_until = [parts[0]], [], [parts[-1]], []
        high_first = high_last = -1
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            high_first, high_last = max(high_first, rank), max(high_last, rank)
            if at == 0:
                first.append(parts[0])
                first_until.append(high_first)
                high_first = -1
            if at == len(parts) - 1:
                last.append(parts[-1])
                last_until.append(high_last)
                high_last = -1
        self._grown[token] = grown = (first, [*first_until, _NEVER], last, [*last_until, _NEVER])
        return grown

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens together encode to just these two: no
        merge across the border ever comes before those that build the tokens."""
        known = self._fits.get((left, right))
        if known is None:
            _, _, ends, ends_until = self._spines(left)
            begins, begins_until, _, _ = self._spines(right)
            i = j = 0
            while True:
                until_left, until_right = ends_until[i], begins_until[j]
                across = self.ranks.get(ends[i] + begins[j])
                if across is not None and across < until_left and across <= until_right:
                    known = False
                    break
                if until_left == until_right == _NEVER:
                    known = True
                    break
                if until_left <= until_right:
                    i += 1
                else:
                    j += 1
            if len(self._fits) >= _REMEMBERED:
                self._fits.clear()
            self._fits[(left, right)] = known
        return known

    # ------------------------------------------------------------ prefixes

    def extend_last(self, data: bytes, last: list[int]) -> list[int]:
        """Continues the table: last[i] is the last token of data[: i + 1]. What is
        already in last is kept, so that an append costs only its own bytes."""
        begin = len(last)
        if len(data) - begin > _SHORT:
            return self._extend_long(data, last)
        token_of, known, longest, append = self.ranks.get, self._fits.get, self.longest, last.append
        for end in range(begin + 1, len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = token_of(data[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start - 1]
                    good = known((before, token))
                    if not (self.fits(before, token) if good is None else good):
                        continue
                append(token)
                break
        return last

    def _extend_long(self, data: bytes, last: list[int]) -> list[int]:
        """The same in time proportional to the matches of tokens, for long pieces."""
        if self._suffixes is None:
            a = ahocorasick.Automaton()
            for token, rank in self.ranks.items():
                a.add_word(token.decode("latin-1"), (len(token), rank))
            a.make_automaton()
            self._suffixes = a
        begin = len(last)
        at, found = begin, []
        offset = max(0, begin - self.longest)
        for end, match in self._suffixes.iter(data[offset:].decode("latin-1")):
            end += offset
            if end < begin:
                continue
            if end != at:
                self._choose(last, at, found)
                at, found = end, []
            found.append(match)
        self._choose(last, at, found)
        return last

    def _choose(self, last: list[int], end: int, found: list[tuple[int, int]]) -> None:
        for length, token in sorted(found, reverse=True):
            start = end + 1 - length
            if start == 0 or (start > 0 and self.fits(last[start - 1], token)):
                last.append(token)
                return

    def back(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.tokens[token])
        out.reverse()
        return out

    # ------------------------------------------------------------ texts

    def pieces(self, text: str) -> list[str]:
        return self._split_ascii(text) if text.isascii() else self._split(text)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(self.back(self.extend_last(data, [])))
        if len(piece) <= 64:
            if len(self._pieces) >= _REMEMBERED:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty text and for null."""
        out: list[int] = []
        if text:
            known, extend, new = self._pieces.get, out.extend, self._piece
            for piece in self.pieces(text):
                extend(known(piece) or new(piece))
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, new = self._pieces.get, self._piece
        return sum([len(known(piece) or new(piece)) for piece in self.pieces(text)])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


class EditableEncoding:
    """A text with its encoding, kept right through appends and edits.

    A piece depends on nothing in front of its start and on one character behind
    its end, so that an edit is re-encoded from the piece before it to the first
    old piece boundary behind it at which the new split meets the old one.
    """

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder = encoder
        self.text = text
        self._pieces = encoder.pieces(text)
        self._last = [encoder.extend_last(p.encode("utf-8", "surrogatepass"), []) for p in self._pieces]
        self.reencoded = len(text)

    def ids(self) -> list[int]:
        return [i for last in self._last for i in self.encoder.back(last)]

    def append(self, more: str) -> None:
        """Adds to the end. The last piece keeps the table of its bytes where it only grows."""
        if not self._pieces:
            self.__init__(self.encoder, more)
            return
        old_piece, old_last = self._pieces.pop(), self._last.pop()
        tail = old_piece + more
        self.text += more
        self.reencoded = len(tail)
        # text.isascii() only chooses the engine, not the split
        for k, piece in enumerate(self.encoder.pieces(tail)):
            data = piece.encode("utf-8", "surrogatepass")
            kept = old_last[: len(data)] if k == 0 and (piece.startswith(old_piece) or old_piece.startswith(piece)) else []
            self._pieces.append(piece)
            self._last.append(self.encoder.extend_last(data, list(kept)))

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replaces text[begin:end] by new."""
        starts, at = [], 0
        for piece in self._pieces:
            starts.append(at)
            at += len(piece)
        first = max(0, sum(s <= begin for s in starts) - 3)
        origin = starts[first] if starts else 0
        shift = len(new) - (end - begin)
        self.text = self.text[:begin] + new + self.text[end:]
        behind = {s + shift: k for k, s in enumerate(starts) if s > end}
        pieces, pos = [], origin
        meets = None
        finder = regex.compile(PATTERN)
        for match in finder.finditer(self.text, origin):
            if match.start() in behind:
                meets = behind[match.start()]
                break
            pieces.append(match.group())
            pos = match.end()
        self.reencoded = pos - origin
        tables = [self.encoder.extend_last(p.encode("utf-8", "surrogatepass"), []) for p in pieces]
        rest = len(self._pieces) if meets is None else meets
        self._pieces[first:rest] = pieces
        self._last[first:rest] = tables
