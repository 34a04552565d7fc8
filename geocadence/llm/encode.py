"""Exact, cached encoding of whole texts with a public byte-level BPE tokenizer.

A byte-level BPE encodes each pre-token by itself. A text is cut here at places that are always
borders between pre-tokens (after a run of letters, digits or marks, or a lone line end); each distinct
piece is encoded once by the ``tokenizers`` library, and the ids of a text are the ids of its pieces in
order.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np

_L, _P = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
#: The last branch takes what no other does, up to a single blank between two characters.
_PIECE = re.compile(
    rf" ?[{_L}]+(?![^\W\d_])"
    rf"| ?[{_P}]+(?=[{_L}0-9\s]|\Z)"
    rf"|\n(?=[!-~{_L}])"
    rf"| ?[0-9]+(?=[{_P}{_L}\s]|\Z)"
    r"|(?s:.)+?(?=(?<=\S) (?=\S)|\Z)"
)
_SINGLE = re.compile(rf" ?[{_L}]+| ?[{_P}]+|\n| ?[0-9]+")
#: A blank beside another blank, or at either end: such texts are cut by ``_PIECE`` alone.
_ODD = re.compile(r" (?:\s|\Z|(?<=\s )|(?<=\A ))")
#: A line end that is not between two plain characters.
_LOOSE = re.compile(rf"\n(?:(?![!-~{_L}])|(?<![!-~{_L}]\n))")
_ENCODERS: dict[str, "PieceEncoder"] = {}


def encoder(path: str, limit: int = 800_000) -> "PieceEncoder":
    """The encoder of this Python worker; its cache, of ``limit`` entries, lives on through later tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    _ENCODERS[path].limit = limit
    return _ENCODERS[path]


def vocabulary(path: str) -> int:
    """How many ids a tokenizer has, with its added tokens: the largest plus one."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=-1) + 1


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _AfterBlank(dict):
    """Ids of pieces that follow a blank, by the piece without it."""

    def __init__(self, owner: "PieceEncoder"):
        super().__init__()
        self.owner = owner

    def __missing__(self, run: str) -> bytes:
        return self.owner.ids(" " + run, self, run)


class PieceEncoder(dict):
    """Encodes lists of texts to little-endian unsigned 32-bit ids, those of the library's plain call with
    ``add_special_tokens=False``.

    As a dict it maps a piece to its ids, ``after`` a piece that follows a blank, and both encode what is
    missing. ``limit`` bounds the entries (about 300 bytes each); only runs within a line of up to ``longest``
    characters are kept. Texts with the string of a special token, and a tokenizer of another kind, are
    encoded whole without a cache.
    """

    def __init__(self, path: str, limit: int = 800_000, longest: int = 64):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.symbols, self.after = self.tokenizer.model, _byte_symbols(), _AfterBlank(self)
        self.limit, self.longest = limit, longest
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        self.by_piece = conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text in one call of the library."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __missing__(self, run: str) -> bytes:
        return self.ids(run, self, run)

    def ids(self, run: str, keep: dict, key: str) -> bytes:
        """Ids of a run of pieces; kept in ``keep`` if it may come again."""
        if _SINGLE.fullmatch(run):
            ids = array("I", [t.id for t in self.model.tokenize(run if run.isascii() and run.isalnum() else run.encode().decode("latin-1").translate(self.symbols))]).tobytes()
        elif len(pieces := _PIECE.findall(run)) > 1:
            ids = b"".join([self.after[x[1:]] if x[0] == " " and len(x) > 1 else self[x] for x in pieces])
            if "\n" in run:  # a line end between two words: seldom the same again
                return ids
        else:
            ids = self.whole([run])[0]
        if len(run) <= self.longest:
            keep[key] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; equal to ``whole``."""
        if not self.by_piece:
            return self.whole(texts)
        if len(self) + len(self.after) > self.limit:  # the oldest entries are the common ones
            for own in (self, self.after):
                for run in list(islice(reversed(own), len(own) // 2)):
                    del own[run]
        out, after = [], self.after.__getitem__
        for text in texts:
            if self.special and self.special.search(text):
                out.append(self.whole([text])[0])
            elif _ODD.search(text):
                out.append(b"".join([after(x[1:]) if x[0] == " " and len(x) > 1 else self[x] for x in _PIECE.findall(text)]))
            elif text:
                lines = [text] if "\n" not in text or _LOOSE.search(text) else text.split("\n")
                out.append(self["\n"].join([self[first] + b"".join(map(after, rest)) for first, *rest in [line.split(" ") for line in lines]]))
            else:
                out.append(b"")
        return out
