"""Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library.

A byte-level BPE never merges across the pieces that its pre-tokeniser cuts, so the ids of a text are the
ids of its pieces in a row. Pieces repeat, and looking them up is several times faster than merging them
again: an unseen piece goes to the library's merge model, known ones come from a bounded two-generation
store that a worker keeps between tasks. Texts with characters outside Basic Latin, the letters of Latin-1
and Latin Extended-A/B, where the two regex dialects could cut differently, texts that hold an added token
such as "<|endoftext|>", and vocabularies of another kind go through the whole tokenizer. Nulls and empty
texts have no ids.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Fixed pattern: the pre-tokeniser of byte-level BPE, for texts that `_PLAIN` accepts.
_PIECE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ɏ0-9]+|\s+(?!\S)|\s+"
)
_OTHER = re.compile(r"[^\n\t\r -~À-ɏ]")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> list[str]:
    """The visible letter that a byte-level vocabulary writes for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


class _Pieces(dict):
    """Ids of pieces; an unknown piece is taken from the generation before, or merged by the library's model."""

    def __init__(self, model, old: _Pieces | None = None) -> None:
        self.model, self.merge, self.old = model, model.tokenize, old or {}
        self.letters = dict(enumerate(_byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isascii() and piece.isprintable():
                shown = piece.replace(" ", self.letters[32])
            else:
                shown = piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.merge(shown)]).tobytes()
        self[piece] = ids
        return ids

    def turned(self, room: int) -> _Pieces:
        """Itself, or the next generation once it holds more than room pieces."""
        if len(self) <= room:
            return self
        self.old = {}
        return _Pieces(self.model, self)


class Encoder:
    """Encodes texts to bytes of ids; keeps at most two generations of about `room` pieces."""

    def __init__(self, path: str, room: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        cutter = spec.get("pre_tokenizer") or {}
        plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        self.by_piece = bool(plain and spec["model"]["type"] == "BPE" and not spec.get("normalizer") and sys.byteorder == "little")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.room, self.known = room, _Pieces(self.tokenizer.model)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.by_piece and not _OTHER.search(text) and not any(token in text for token in self.added):
                out.append(b"".join(map(self.known.__getitem__, _PIECE.findall(text))))
            else:
                out.append(self._library(text))
            self.known = self.known.turned(self.room)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, room: int = 500_000) -> Encoder:
    """One encoder a worker process, vocabulary and size of its store (about 220 bytes a piece and generation)."""
    return Encoder(path, room)
