"""Token ids of whole texts by the tokenizers library, with a memo of the pieces that texts are made of.

Both vocabularies cut a text before a space that is followed by another
character than white space (whatever precedes it), so the ids of a text are the
ids of its pieces one after another.  Each worker keeps the ids of the pieces it
has met, up to a bound in bytes, and asks the library for all others.  Where white
space is dropped, a batch of texts is cut as one: each distinct piece into the
words, digits and marks that the pre-tokenizer makes of it, of which each distinct
one is looked up once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO = 128 << 20  # bytes of pieces and ids that a worker remembers
KEEP = 40  # characters of the longest piece that is worth it: longer ones, such as texts without spaces, hardly come again

ENTRY = 100  # bytes of a dictionary's entry

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"  # none of these joins with a neighbour when normalized
_LETTERS = re.compile(f"[{_LATIN}]+").fullmatch
_LOWERED = "".join(c for c in map(chr, range(0x250)) if _LETTERS(c) and _LETTERS(c.lower()))  # those that stay letters in lower case (a dotted I doesn't)
_PLAIN = re.compile(f"[ -~{_LOWERED}]*").fullmatch
_CUT = re.compile(f" |'(?:s|t|re|ve|m|ll|d)|[{_LATIN}]+|[0-9]|[^ {_LATIN}0-9]+").findall  # word_level's pre-tokenizer on plain text; spaces stay

#: A batch of texts, null or not, to where each one's ids begin and the last one's end, and the ids of all.
Batches = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

_known: dict[tuple[str, str], Callable[[str], bytes]] = {}
_known_batches: dict[tuple[str, str], Batches] = {}


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _alphabet()


class _Memo(dict):
    """The little-endian 32-bit ids of a piece after ``lead``.

    A piece of Latin letters alone is one token of the pre-tokenizer, so the model
    itself gets it, and a mark after such a piece begins another.  The whole tokenizer gets
    every other piece.  Of kind "word" the pieces are what :func:`word_batches` cuts: letters
    are in lower case, and what follows a line break is for the whole tokenizer.
    """

    def __init__(self, tokenizer, lead: str, kind: str):
        super().__init__()
        self.tokenizer, self.lead, self.kind, self.room = tokenizer, lead, kind, MEMO
        self.model = tokenizer.model
        self.marks = {m: self._whole(m) for m in ".,"}

    def _whole(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _letters(self, piece: str) -> bytes | None:
        if not _LETTERS(piece):
            return None
        mapped = self.lead + piece
        if self.lead or not piece.isascii():
            mapped = mapped.encode().decode("latin-1").translate(_ALPHABET)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])

    def _shared(self, piece: str) -> tuple[bytes | None, bool]:
        """The ids of a piece that is another with a mark behind, by way of that one; and whether it was known."""
        mark = piece[-1] if piece[-1:] in self.marks else ""
        base = piece[: len(piece) - len(mark)]
        if not mark or not _LETTERS(base):
            return None, False
        if (ids := self.get(base)) is not None:
            return ids + self.marks[mark], True
        if (ids := self._letters(base)) is not None:
            self._keep(base, ids)
            return ids + self.marks[mark], False
        return None, False

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= KEEP and self.room > 0:
            self[piece] = ids
            self.room -= getsizeof(piece) + getsizeof(ids) + ENTRY

    def __missing__(self, piece: str) -> bytes:
        if self.kind == "word":
            ids = self._whole(piece[1:]) if piece[0] == "\n" else self._letters(piece)
        else:
            ids, known = self._shared(piece)
            if ids is not None:
                if known:  # what comes but once in any form is kept once
                    self._keep(piece, ids)
                return ids
            ids = self._letters(piece)
        if ids is None:
            ids = self._whole(self.lead + piece)
        self._keep(piece, ids)
        return ids


def _regular(lines: list[str]) -> bool:
    """Whether each line break stands between two characters that aren't white space, and so is a piece of its own."""
    return all(x and not x[0].isspace() and not x[-1].isspace() for x in lines)


def _byte_pieces(text: str) -> list[str]:
    """The text cut at the spaces that begin a piece; a piece that begins with white space belongs to the one before."""
    out: list[str] = []
    for x in text.split(" "):
        if out and (not x or x[0].isspace()):
            out[-1] += " " + x
        else:
            out.append(x)
    return out


def byte_level(tokenizer) -> Callable[[str], bytes]:
    first, later = _Memo(tokenizer, "", "byte"), _Memo(tokenizer, " ", "byte")
    get = later.__getitem__

    def run(text: str) -> bytes:
        if not text:
            return b""
        lines = text.split("\n")
        if not _regular(lines):
            lines = [text]
        out: list[bytes] = []
        for i, line in enumerate(lines):
            if i:
                out.append(first["\n"])
            pieces = line.split(" ")
            if "" in pieces or len(lines) == 1:
                pieces = _byte_pieces(line)
            out.append(first[pieces[0]])
            out += map(get, pieces[1:])
        return b"".join(out)

    return run


class _Slots(dict):
    """A number from 0 on for each distinct key."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def word_batches(tokenizer) -> Batches:
    """For a vocabulary that drops white space.

    Plain pieces are cut in lower case, all as one string; a piece that isn't plain or that may hold an added token is
    left whole, after a line break, which no piece holds.
    """
    memo = _Memo(tokenizer, "", "word")
    added = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]

    def parts(joined: str) -> list[str]:
        lowered = joined.lower()
        inside = [x for x in added if x in lowered]
        if _PLAIN(joined) and not inside:
            return _CUT(lowered)
        pieces, odd = joined.split(" "), []
        for i, p in enumerate(pieces):
            if not _PLAIN(p) or (inside and any(x in p.lower() for x in inside)):
                odd.append("\n" + p)
                pieces[i] = "\n"
        left = iter(odd)
        return [next(left) if x == "\n" else x for x in _CUT(" ".join(pieces).lower())]

    def cut(pieces: pa.Array) -> pa.ListArray:
        """The ids of each piece."""
        one = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
        slots = _Slots({" ": 0})
        at = np.fromiter(map(slots.__getitem__, parts(pc.binary_join(one, " ")[0].as_py())), np.int32)
        rows = [b"", *map(memo.__getitem__, islice(slots, 1, None))]
        ends = np.cumsum([0, *map(len, rows)]) // 4
        ids = pa.ListArray.from_arrays(ends.astype("<i4"), np.frombuffer(b"".join(rows), "<i4")).take(pa.array(at[at > 0]))
        spaces = np.flatnonzero(at == 0)
        edges = np.concatenate([[0], spaces - np.arange(len(spaces)), [len(at) - len(spaces)]])
        return pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[edges]), ids.values)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()).fill_null(""), "\n", " "), " ")
        edges, found = words.offsets.to_numpy(), words.values.dictionary_encode()
        del words
        ids = cut(found.dictionary).take(found.indices)
        return ids.offsets.to_numpy()[edges], ids.values.to_numpy()

    return run


def word_level(tokenizer) -> Callable[[str], bytes]:
    """:func:`word_batches` for one text."""
    batches = word_batches(tokenizer)
    return lambda text: batches(pa.array([text]))[1].tobytes()


def text_batches(get: Callable[[str], bytes]) -> Batches:
    """Of texts one by one."""

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = [get(t or "") for t in texts.to_pylist()]
        return np.cumsum([0, *map(len, rows)]) // 4, np.frombuffer(b"".join(rows), "<i4")

    return run


def encoder(kind: str, path: str) -> Callable[[str], bytes]:
    """The worker's encoder, made once: text to the bytes of its ids as little-endian unsigned 32-bit integers.

    ``kind``: "byte" for byte-level BPE with spaces kept, "word" for BPE with word ends.
    """
    if (kind, path) not in _known:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _known[kind, path] = {"byte": byte_level, "word": word_level}[kind](tokenizer)
    return _known[kind, path]


def batch_encoder(kind: str, path: str) -> Batches:
    """The worker's encoder of batches, made once; ``kind`` as for :func:`encoder`."""
    if (kind, path) not in _known_batches:
        from tokenizers import Tokenizer

        _known_batches[kind, path] = word_batches(Tokenizer.from_file(path)) if kind == "word" else text_batches(encoder(kind, path))
    return _known_batches[kind, path]
