"""Word-level use of a public BPE tokenizer: a text is encoded blank-delimited word by word.

The tokenizer splits at white space and drops it, so a word between ASCII blanks has the same
ids alone as in its text.  Plain words are cut by the tokenizer's own pattern spelled for ASCII
and Latin letters and looked up piece by piece; any other word (marks, other scripts, controls,
special tokens) goes through the library's ``encode``.
"""

from __future__ import annotations

import os
import re
import sys
import types

import public_tokenizers
from tokenizers import Tokenizer

from imprint._ship import ship_with_tasks

ship_with_tasks(__name__)

TOKENIZER = "word_bpe_49k.json"

#: The tokenizer's split pattern over lower-cased ASCII and Latin-1 letters.
_LETTERS = "a-zß-öø-ÿ"
_CUT = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+"
#: Words for which that spelling is the tokenizer's own: visible ASCII and Latin-1 letters.
_PLAIN = "[!-~À-ÖØ-öø-ÿ]+"

MAX_WORDS = 400_000  # entries a worker's table holds; further words are encoded as they come
MAX_WORD_BYTES = 64  # longer words are not kept in the table


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The vocabulary file's path on this machine, for a public name or a path of one's own
    (resolved where the task runs)."""
    return name if os.path.isabs(name) else str(public_tokenizers.path(name))


class WordEncoder:
    """ids of one blank-delimited word in UTF-8."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = re.compile(_PLAIN).fullmatch
        self.cut = re.compile(_CUT).findall
        byte_text = _byte_letters()
        self.spell = lambda piece: "".join(map(byte_text.__getitem__, piece.encode()))
        self.pieces: dict[str, list[int]] = {}

    def __call__(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if self.plain(text) and "<|" not in text:
            ids: list[int] = []
            for piece in self.cut(text.lower()):
                ids += self.pieces.get(piece) or self._piece(piece)
            return ids
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        ids = [t.id for t in self.tokenizer.model.tokenize(self.spell(piece))]
        if len(self.pieces) < MAX_WORDS and len(piece) <= MAX_WORD_BYTES:
            self.pieces[piece] = ids
        return ids


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte value."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = [""] * 256
    for b in shown:
        letters[b] = chr(b)
    for i, b in enumerate(hidden):
        letters[b] = chr(256 + i)
    return letters


def worker_table(kind: str, path: str) -> types.SimpleNamespace:
    """The encoder, word table and id-to-piece table that tasks of one Python worker share."""
    shared = sys.modules.setdefault("_imprint_worker_tables", types.ModuleType("_imprint_worker_tables"))
    found = shared.__dict__.get((kind, path))
    if found is None:
        encoder = WordEncoder(path)
        size = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        pieces = [encoder.tokenizer.id_to_token(i) for i in range(size)]
        found = types.SimpleNamespace(encoder=encoder, words={}, pieces=pieces)
        shared.__dict__[(kind, path)] = found
    return found
