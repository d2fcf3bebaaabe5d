"""Exact, cached tokenization with the tokenizers library.

A text is cut where the tokenizer itself always cuts, and the ids of each distinct piece are kept as little-endian
32-bit bytes, so a text's ids are a join of cached pieces. The cache is bounded and lives as long as the worker.
A text that holds a string of the vocabulary's added tokens (`<|endoftext|>`) goes to the library whole, which finds them.
A new piece of Latin letters alone, with or without a leading blank, is one word to the tokenizer's pre-tokenizer, so
it goes to the library's merge model directly; the ASCII punctuation at its end, however long, is the pre-tokenizer's next
word, so that the ids of the two are joined. Any other piece goes through the whole tokenizer.
The vocabulary file's path is a parameter; in the queries it comes from the installed `public_tokenizers`.
"""

from __future__ import annotations

import os
import re
from array import array
from operator import attrgetter

#: Pieces in each of two generations.
CACHE = 300_000
#: Pieces longer than this are encoded but not kept.
KEEP = 48

_ID = attrgetter("id")
_loaded: dict[tuple[str, bool], "Pieces"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: What stands for a Latin letter, or for the blank, in the words of a byte-level vocabulary.
_AS_BYTES = {c: c.encode().decode("latin-1").translate(_LETTERS) for c in map(chr, range(0x250)) if c.isalpha() or c == " "}
#: ASCII punctuation without the apostrophe, which may begin a word of its own ('s).
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


class Pieces(dict):
    """piece -> its ids as bytes; a missing one is encoded on sight."""

    def __init__(self, path: str, fold: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.fold = fold
        self.most = CACHE if fold else 2 * CACHE  # pieces with and without their blank are two
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _latin(self, piece: str) -> str | None:
        """The piece as the merge model takes it, if it is a single word of Latin letters."""
        word = piece.lower() if self.fold else piece
        blank = not self.fold and word[0] == " "
        if not (word[1:] if blank else word).isalpha():
            return None
        if word.isascii():
            return "Ġ" + word[1:] if blank else word
        try:
            return "".join(map(_AS_BYTES.__getitem__, word))
        except KeyError:  # letters that aren't Latin
            return None

    def __missing__(self, piece: str) -> bytes:
        if (got := self.old.get(piece)) is None:
            run = piece.rstrip(_MARKS)
            word = self._latin(run) if run else None
            if word is None:
                got = self.encode(piece)
            elif len(run) == len(piece):
                got = array("I", map(_ID, self.merge(word))).tobytes()
            else:
                got = self[run] + self[piece[len(run) :]]
        if len(piece) <= KEEP:
            if len(self) >= self.most:  # the last generation answers until it too is replaced
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got

    def joined(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


def load(path: str, fold: bool) -> Pieces:
    if (path, fold) not in _loaded:
        _loaded[path, fold] = Pieces(path, fold)
    return _loaded[path, fold]


_SPACES = re.compile(r"\s\s")
_ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: White space to Python's split(), but not to the tokenizer.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_CUTS = re.compile(r"(?<=\S)(?= )|(?=\n)|(?<=\n)")


def word_ids(text: str, path: str) -> bytes:
    """Ids under a lower-casing vocabulary that drops white space and never crosses it (`word_bpe_49k.json`)."""
    pieces = load(path, True)
    if any(t in text for t in pieces.added):
        return pieces.encode(text)
    if any(c in text for c in _ODD):
        return pieces.joined([p for p in _ASCII_SPACE.split(text) if p])
    return pieces.joined(text.split())


def byte_ids(text: str, path: str) -> bytes:
    """Ids under a byte-level BPE vocabulary whose words take one leading blank (`byte_bpe_50k.json`).

    While no two white-space characters are neighbours, a cut before each blank and around each line end falls
    between the tokenizer's own words. Any other text is encoded whole.
    """
    pieces = load(path, False)
    if _SPACES.search(text) or any(t in text for t in pieces.added):
        return pieces.encode(text)
    if "\x00" in text:
        return pieces.joined([p for p in _CUTS.split(text) if p])
    return pieces.joined(text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00"))  # an empty piece has no ids
