"""Byte-level BPE ids of whole texts, fast enough for a corpus.

A tokenizer of this kind first splits a text into pieces and then merges inside each piece alone, so a piece's ids can be kept
and reused. Texts of common characters are split here by an equivalent pattern of the standard library; any text with a
character outside that set goes through the tokenizer whole.
"""

from __future__ import annotations

import json
import re
from struct import pack

import numpy as np

#: Letters for which the split below is known to agree: ASCII, Latin-1 and Latin Extended-A.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ \\t\\n\\r\\x0b\\x0c{LETTERS}0-9]+|[ \\t\\n\\r\\x0b\\x0c]+(?![^ \\t\\n\\r\\x0b\\x0c])|[ \\t\\n\\r\\x0b\\x0c]+"
)
#: Anything else sends the text through the tokenizer whole.
OTHER = re.compile(f"[^\\t\\n\\r\\x0b\\x0c\\x20-\\x7e{LETTERS}¡«»¿–—‘’“”…€]")


class Ids(dict):
    """Little-endian unsigned 32-bit ids of pieces, as bytes; filled by the tokenizer as pieces are met."""

    def __init__(self, merge, most: int):
        super().__init__()
        self.merge, self.most = merge, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece)
        ids = pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.most:
            self.clear()
        self[piece] = ids
        return ids


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merger(path: str, tokenizer):
    """Ids of one piece. Where ids rise in the order of the merges, the vocabulary serves as ranks of a faster merger."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of, vocab = _byte_of(), model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    made = [vocab.get(a + b, -1) for a, b in pairs]
    if model.get("type", "BPE") != "BPE" or made != sorted(set(made)) or any(c not in byte_of for t in vocab if t not in special for c in t):
        return lambda piece: tokenizer.encode(piece, add_special_tokens=False).ids
    import tiktoken

    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    fast = tiktoken.Encoding("pieces", pat_str="[\\s\\S]+", mergeable_ranks=ranks, special_tokens={})
    return fast.encode_ordinary


class Encoder:
    """``encode(texts)``: ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids = Ids(_merger(path, self.tokenizer), most)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, whole = [], []
        for i, text in enumerate(texts):
            if not text:
                out.append(b"")
            elif OTHER.search(text) or any(s in text for s in self.special):
                out.append(None)
                whole.append(i)
            else:
                out.append(b"".join(map(self.ids.__getitem__, PIECES.findall(text))))
        if whole:
            for i, found in zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
                out[i] = np.array(found.ids, "<u4").tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Default place of a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
