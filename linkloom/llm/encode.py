"""Texts to token ids with the tokenizers library, inside tasks.

Byte-level BPE never merges across the pieces that its pattern cuts. A text is cut at
such places only (white space before a word), each distinct piece is encoded once by
the library, and the ids of a text are the ids of its pieces. ``tests/llm`` compares
this with encoding whole texts.

In texts of ASCII and Latin letters alone the pattern's classes are plain ranges, so its
cuts themselves are the pieces, and each goes to the library's merge model in the model's
alphabet of bytes. Pieces of all other texts go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: The white space of the tokenizer's pattern.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]")
#: The tokenizer's pattern for texts of these signs alone, and the signs.
_LETTER, _GAP = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", "\\t-\\r "
_PLAIN = re.compile(f"[\x00-\x7f{_LETTER}]*")
_CUT = f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_LETTER}0-9{_GAP}]+|[{_GAP}]+(?![^{_GAP}])|[{_GAP}]+"
_CUTS = re.compile(_CUT)
#: Pieces whose ids a worker remembers: up to twice as many, the longest unused go first.
REMEMBERED = 200_000
LONGEST = 64
#: The id written after each document.
END_ID = 0
#: Pieces encoded by one call, a line each.
LINES = 4096


def byte_alphabet() -> dict[int, str]:
    """The signs of bytes that do not stand for themselves: those that do not show, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes by pieces; with ``added``, texts are split at the added tokens first.

    Without it, an added token in a text is written out like any other word.
    """

    def __init__(self, path: str, *, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # pieces hold no added token once texts are split
        self.tokenizer.encode_special_tokens = True
        self.added, self.split = {}, None
        if added:
            self._split_at_added()
        (self.newline,) = self._ids("\n")
        kinds = (type(self.tokenizer.pre_tokenizer).__name__, type(self.tokenizer.model).__name__)
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are made as little-endian unsigned 32-bit integers")
        #: Whether cuts may go to the model alone.
        self.plain = self.tokenizer.normalizer is None and kinds == ("ByteLevel", "BPE") and (
            not self.tokenizer.pre_tokenizer.add_prefix_space and self.tokenizer.pre_tokenizer.use_regex
        )
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        #: Pieces of the texts at hand: cuts of plain ones, and those of the others.
        self.cuts: set[str] = set()
        self.others: set[str] = set()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _split_at_added(self) -> None:
        tokens = self.tokenizer.get_added_tokens_decoder()
        for token in tokens.values():
            # these flags take neighbouring signs into the match or undo it
            if token.lstrip or token.rstrip or token.single_word or (token.normalized and self.tokenizer.normalizer):
                raise ValueError(f"texts are not split at an added token like {token!r}")
        self.added = {token.content: np.array([i], dtype="<u4").tobytes() for i, token in tokens.items()}
        if self.added:
            longest_first = sorted(self.added, key=len, reverse=True)
            self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")

    def _pieces(self, text: str) -> list[str]:
        if not self.plain or not _PLAIN.fullmatch(text):
            pieces = _PIECES.findall(text)
            self.others.update(pieces)
            return pieces
        cuts = _CUTS.findall(text)
        self.cuts.update(cuts)
        return cuts

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text; an added token is a piece of its own."""
        if self.split is None:
            return self._pieces(text)
        parts = self.split.split(text)
        if len(parts) == 1:
            return self._pieces(text)
        pieces: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                pieces.append(part)
                self.others.add(part)
            else:
                pieces += self._pieces(part)
        return pieces

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new(self, pieces: set[str]) -> list[str]:
        """The pieces without ids; those used a while ago are taken up again."""
        known, older = self.known, self.older
        new = []
        for piece in pieces.difference(known):
            if piece in older:
                known[piece] = older[piece]
            else:
                new.append(piece)
        return new

    def _merge(self, cuts: list[str]) -> None:
        """The ids of new cuts of the pattern, by the merge model."""
        known, alphabet, tokenize = self.known, self.alphabet, self.model.tokenize
        for cut in cuts:
            if cut.isascii() and cut.isprintable():
                signs = cut.replace(" ", alphabet[0x20])
            else:
                signs = cut.encode().decode("latin-1").translate(alphabet)
            known[cut] = array("I", [token.id for token in tokenize(signs)]).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode other new pieces, one to a line; white space alone."""
        lines = []
        for piece in pieces:
            if piece in self.added:
                self.known[piece] = self.added[piece]
            elif piece.isspace():
                self.known[piece] = np.array(self._ids(piece), dtype="<u4").tobytes()
            else:
                lines.append(piece)
        for at in range(0, len(lines), LINES):
            part = lines[at : at + LINES]
            ids = np.array(self._ids("\n".join(part)), dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids)).tolist()
            if len(ends) != len(part):
                raise RuntimeError("the tokenizer does not encode line by line")
            start = 0
            for piece, end in zip(part, ends, strict=True):
                self.known[piece] = ids[start:end].tobytes()
                start = end + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        self.cuts, self.others = set(), set()
        cut = [self._cut(text) if text else [] for text in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known = self.known
        new = self._new(self.cuts)
        self._merge(new)
        others = self._new(self.others)
        self._learn(others)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for piece in (*new, *others):
            if len(piece) > LONGEST:
                del known[piece]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker, with the ids of the plain call."""
    return Encoder(path, added=True)
