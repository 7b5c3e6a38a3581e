"""Whole-text tokenisation with a piece-level cache.

The tokenizer file's own pipeline lower-cases, drops white space and cuts words into pieces of letters, single
digits and other signs, each of which its BPE model encodes alone. Cutting is done here on byte arrays; only
pieces not seen before reach the tokenizers library's model. A word with anything but ASCII or the letters
from À to ÿ, with an apostrophe, a control character or what may be a special token is one piece, which the
library's whole pipeline encodes.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: The pre-tokenizer pattern that the cutting follows.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, DIGIT, SIGN, SPACE = range(4)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, lower, odd = np.full(256, SIGN, np.uint8), np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
    kind[48:58] = DIGIT
    kind[[32, *range(9, 14)]] = SPACE
    lower[65:91] += 32
    odd[[*range(9), *range(14, 32), 39, 127, *range(128, 256)]] = True
    return kind, lower, odd


KIND, LOWER, ODD = _tables()
#: Pieces that the model may encode alone; all others are words left whole.
PLAIN = re.compile(rb"(?:[!-&(-~]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")


def byte_chars() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: itself if printable Latin-1, else from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def after(flags: np.ndarray) -> np.ndarray:
    """True where the element before is."""
    out = np.zeros_like(flags)
    out[1:] = flags[:-1]
    return out


#: Bytes that the cached pieces of one Python worker take, about, and what a piece takes beside its own bytes and ids.
CACHE_BYTES, PIECE_BYTES = 48 << 20, 220


class PieceTokenizer:
    """`cache_bytes` bounds the cache; beyond it the cache starts anew before the next texts, which changes no result."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norms = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        if norms != ["NFC", "Replace", "Lowercase"] or (steps[0].get("pattern") or {}).get("Regex") != PIECES:
            raise ValueError("the cutting into pieces doesn't fit this tokenizer")
        self.model, self.chars, self.cache_bytes = self.tokenizer.model, byte_chars(), cache_bytes
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])
        self.held = 0

    def learn(self, pieces: list[bytes]) -> None:
        tokenize, chars, known, flat, ends = self.model.tokenize, self.chars, self.known, self.flat, self.ends
        before = len(flat)
        for piece in pieces:
            if piece.isalnum():  # ASCII letters and digits stand for themselves
                flat.extend([t.id for t in tokenize(piece.decode())])
            elif not PLAIN.fullmatch(piece) or b"<|" in piece:
                flat.extend(self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids)
            else:
                flat.extend([t.id for t in tokenize(piece.decode() if piece.isascii() else "".join(map(chars.__getitem__, piece)))])
            known[piece] = len(ends) - 1
            ends.append(len(flat))
        self.held += PIECE_BYTES * len(pieces) + sum(map(len, pieces)) + 4 * (len(flat) - before)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a binary array's texts in order, and where each text's ids end. Nulls count as empty."""
        if self.held > self.cache_bytes:
            self.reset()
        texts = [x or b"" for x in text.to_pylist()]
        buf = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        text_ends = np.cumsum([len(x) + 1 for x in texts])
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        kind = KIND[buf]
        space = kind == SPACE
        odd, low = ODD[buf], LOWER[buf]
        lead = buf == 0xC3
        second = after(lead) & (buf >= 0x80) & (buf < 0xC0) & (buf != 0x97) & (buf != 0xB7)
        odd ^= second
        odd[:-1] ^= second[1:]
        low += (second & (buf < 0x9F)).view(np.uint8) << 5
        odd[:-1] |= (buf[:-1] == 60) & (buf[1:] == 124)
        first = ~space & after(space)
        first[0] = ~space[0]
        start = ~space & ((kind == DIGIT) | np.append(True, kind[1:] != kind[:-1]))
        start |= first
        if odd.any():
            word = np.cumsum(first, dtype=np.int32) - 1
            words = np.zeros(word[-1] + 1 if len(word) else 0, dtype=bool)
            words[word[odd]] = True
            whole = words[word] & ~space
            start &= ~whole | first
            low = np.where(whole, buf, low)
        at = np.flatnonzero(start)
        solid = ~space
        place = np.cumsum(solid, dtype=np.int32)
        offsets = np.empty(len(at) + 1, np.int32)
        offsets[:-1] = place[at] - 1
        offsets[-1] = place[-1]
        data = low[solid]
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes = np.asarray(pieces.indices)
        known, distinct = self.known, pieces.dictionary.to_pylist()
        self.learn([piece for piece in distinct if piece not in known])
        local = [known[piece] for piece in distinct]
        all_ends = np.frombuffer(self.ends, dtype=np.int64)
        pick = np.asarray(local, dtype=np.int32)[codes] if distinct else np.zeros(0, np.int64)
        starts = all_ends[pick]
        sizes = all_ends[pick + 1] - starts
        out_ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.frombuffer(self.flat, dtype=np.uint32)
        ids = ids[np.repeat((starts - out_ends[:-1]).astype(np.int32), sizes) + np.arange(out_ends[-1], dtype=np.int32)] if out_ends[-1] else np.zeros(0, np.uint32)
        return ids, out_ends[np.searchsorted(at, text_ends - 1, side="left")]


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> PieceTokenizer:
    """One for each Python worker, so that the vocabulary is read once and what is cached, within its bound, serves the
    worker's next task too."""
    return PieceTokenizer(path)
