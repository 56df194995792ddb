"""Whole-text encoding with the ``tokenizers`` library, through a word cache.

The library spends most of its time on splitting a text and on bookkeeping, so
a text is first cut at places where its pre-tokenizer always cuts, and each
distinct chunk is looked up once per call:

* mode ``word`` (vocabularies that drop white space and lower-case): chunks are
  separated by ASCII white space;
* mode ``byte`` (byte-level vocabularies whose words carry one leading space):
  a chunk starts at a single space between two characters that are no white
  space.

Inside a chunk a letter followed by ASCII punctuation is a further cut, and so
is a single line feed between characters that are no white space. The ids
of a text are the ids of its chunks in order, equal to encoding it whole
(tested against the library). A text in which a space stands next to other
white space takes the slower exact cut of ``_SAFE``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
# Everything that some regex flavour may call white space, and controls.
_WIDE = "\\s\\x00-\\x20\\x7f-\\xa0͏ ᠎ -‏ -  -⁤　﻿"
_SAFE = re.compile(f"(?<=[^{_WIDE}])(?= [^{_WIDE}])")
_INNER = re.compile(f"(?<=[{_LETTER}])(?=[!-/:-@\\[-`{{-~])")
_LINE = re.compile(f"(?<=[^{_WIDE}])\n(?=[^{_WIDE}])")
_ODD = re.compile(f"[{_WIDE}]")
_ENDS = {chr(c) for c in range(33)}
_GLUE, _CUT = "\ue000", "\ue001"    # private-use marks between chunks and pieces

_WORD = re.compile(f" ?[{_LETTER}]+").fullmatch
# Byte-level vocabularies write a byte as its Latin-1 character if that can be seen, the others from U+0100 on in order.
_UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(_UNSEEN)}
_BYTE_SPACE = chr(_BYTE_CHARS[32])

CACHE_PIECES = 250_000
PORTION = 8 << 20    # bytes of text encoded at a time


class CachedEncoder:
    """``encode(texts)`` gives, per text, its ids and the end id as bytes.

    Ids are little-endian unsigned of ``dtype`` (two bytes when the vocabulary
    fits). The cache is bounded by ``CACHE_PIECES`` entries and
    one call's words. A text that holds the string of an added token is left to
    the library, which gives it that token's id.
    """

    def __init__(self, path: str, mode: str, end_id: int = 2):
        from tokenizers import Tokenizer

        if mode not in ("word", "byte"):
            raise ValueError(f"unknown mode {mode!r}")
        self.path, self.tok = path, Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True   # pieces hold no added token
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.added = "|".join(sorted(re.escape(a.lower()) for a in added if a))
        self.dtype = np.dtype("<u2" if max(self.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.word = mode == "word"
        self.sep, self.mark = (" | ", "|") if self.word else ("\n", "\n")
        self.sep_id = self.tok.encode(self.mark, add_special_tokens=False).ids[0]
        self.pieces: dict[str, bytes] = {}

    # -- distinct pieces ---------------------------------------------------
    def _encode_pieces(self, new: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, a few hundred per call of the library: the
        separator between them is a token of its own that no piece holds."""
        out: dict[str, bytes] = {"": b""}
        tokenize, rest, words, flat, ends = self.tok.model.tokenize, [], [], [], [0]
        for p in new:
            # Latin letters are one word, and the same after normalising: the model alone gives their ids
            if _WORD(p) and not (self.word and (p[0] == " " or p != p.lower())):
                if p.isascii():
                    told = tokenize(_BYTE_SPACE + p[1:] if p[0] == " " else p)
                else:
                    told = tokenize(p.encode().decode("latin-1").translate(_BYTE_CHARS))
                words.append(p)
                flat += [t.id for t in told]
                ends.append(len(flat))
            elif p:
                rest.append(p)
        width = self.dtype.itemsize
        raw = np.array(flat, self.dtype).tobytes()
        out.update(zip(words, [raw[width * x:width * y] for x, y in zip(ends, ends[1:])]))
        new = rest
        joined = "".join(new)
        if self.mark in joined or _ODD.search(joined.replace(" ", "")) or " " in new:
            odd = [p for p in new if p == " " or self.mark in p or _ODD.search(p, 1) or (p[0] != " " and _ODD.match(p))]
            for p in odd:
                out[p] = np.array(self.tok.encode(p, add_special_tokens=False).ids, self.dtype).tobytes()
            new = [p for p in new if p not in out]
        for i in range(0, len(new), 256):
            some = new[i:i + 256]
            ids = np.array(self.tok.encode_batch_fast([self.sep.join(some)], add_special_tokens=False)[0].ids, self.dtype)
            cut = (np.flatnonzero(ids == self.sep_id) * width).tolist()
            if len(cut) != len(some) - 1:
                raise ValueError("the separator is no single token of this vocabulary")
            raw = ids.tobytes()
            out.update(zip(some, [raw[x:y] for x, y in zip([0, *(c + width for c in cut)], [*cut, len(raw)])]))
        return out

    def _learn(self, want: set[str]) -> dict[str, bytes]:
        """The cache, with the ids of at least the pieces ``want``."""
        pieces = self.pieces
        new = want.difference(pieces)
        if new:
            if len(pieces) > CACHE_PIECES:
                pieces = self.pieces = {p: pieces[p] for p in want if p in pieces}
            pieces.update(self._encode_pieces(list(new)))
        return pieces

    def _joined(self, parts: list[list[str]]) -> list[bytes]:
        """Ids of chunks given by their pieces."""
        get = self._learn(set().union(*parts)).__getitem__
        return [get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps)) for ps in parts]

    # -- chunks ------------------------------------------------------------
    def _cut(self, chunks: list[str]) -> list[list[str]]:
        """Pieces of each chunk, all chunks by one substitution."""
        joined = _GLUE.join(chunks)
        if joined.count(_GLUE) == len(chunks) - 1 and _CUT not in joined:
            cut = _INNER.sub(_CUT, joined)
            if "\n" in cut:
                cut = _LINE.sub(f"{_CUT}\n{_CUT}", cut)
            return [c.split(_CUT) for c in cut.split(_GLUE)]
        return [_INNER.split(c) for c in chunks]

    def _led(self, chunks: list[str], lead: str) -> list[bytes]:
        """Ids of chunks that follow ``lead``; a chunk of letters is one piece."""
        alone = [lead + c for c in chunks]
        mixed = [i for i, c in enumerate(chunks) if not c.isalpha()]
        cut = self._cut([alone[i] for i in mixed]) if mixed else []
        for i in mixed:
            alone[i] = ""
        get = self._learn(set(alone).union(*cut)).__getitem__
        out = list(map(get, alone))
        for i, ps in zip(mixed, cut):
            out[i] = get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))
        return out

    def _chunk_ids(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of distinct chunks; in byte mode a chunk comes without its leading
        space, and is None if white space stands at an end of it."""
        if self.word:
            return self._led(chunks, "")
        good = [i for i, c in enumerate(chunks) if c.isascii() and c.isalnum() or c and not (
            (c[-1] in _ENDS or c[-1] > "~") and _ODD.match(c[-1]) or (c[0] in _ENDS or c[0] > "~") and _ODD.match(c[0]))]
        out: list[bytes | None] = [None] * len(chunks)
        for i, ids in zip(good, self._led([chunks[i] for i in good], " ")):
            out[i] = ids
        return out

    # -- texts -------------------------------------------------------------
    def encode(self, texts: pa.Array) -> pa.Array:
        """One binary value per text. Only the distinct chunks are Python
        objects; splitting and joining are Arrow's."""
        if self.word:
            parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        else:
            parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = parts.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        ids = self._chunk_ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())     # to_pylist takes ten times as long
        whole = np.empty(0, np.int64)                      # texts to encode by the exact cut
        if not self.word:
            begins = offsets[:-1]
            lone = np.fromiter((i is None for i in ids), bool, len(ids))
            bad = lone[at]
            first = parts.flatten().take(pa.array(begins)).to_pylist()
            odd = np.fromiter((not c or _ODD.match(c[-1]) is not None for c in first), bool, len(first))
            bad[begins] = odd
            whole = np.unique(np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1)
            at = at.astype(np.int64)
            at[begins] = len(ids) + np.arange(len(first))
            ids += self._joined(self._cut(first))
            ids = [i or b"" for i in ids]
        at = np.insert(at, offsets[1:], len(ids))           # the end id after each text
        ids.append(self.end)
        joined = pa.array(ids, pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)
        cut = ends[offsets + np.arange(len(offsets))]
        out = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(cut)), joined.buffers()[2]])
        special = np.empty(0, np.int64)
        if self.added:
            held = pc.match_substring_regex(texts, self.added, ignore_case=True)
            special = np.flatnonzero(pc.fill_null(held, False).to_numpy(zero_copy_only=False))
        if len(whole) or len(special):
            values = out.to_pylist()
            for i in whole.tolist():
                values[i] = b"".join(self._exact(texts[i].as_py())) + self.end
            plain = type(self.tok).from_file(self.path) if len(special) else None       # rare: not kept
            for i in special.tolist():
                values[i] = np.array(plain.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype).tobytes() + self.end
            out = pa.array(values, pa.large_binary())
        return out

    def _exact(self, text: str) -> list[bytes]:
        return self._joined([_INNER.split(c) for c in _SAFE.split(text)]) if text else []


def portions(texts: pa.Array, size: int = PORTION) -> Iterator[slice]:
    """Slices of about ``size`` bytes of text (a longer text stands alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        base = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield slice(begin, end)
        begin = end


def widen(ids: bytes, dtype: np.dtype) -> bytes:
    """The same ids as little-endian unsigned 32-bit."""
    return ids if dtype.itemsize == 4 else np.frombuffer(ids, dtype).astype("<u4").tobytes()


_ENCODERS: dict[tuple, CachedEncoder] = {}


def encoder(path: str, mode: str, end_id: int) -> CachedEncoder:
    """One encoder per worker process and vocabulary."""
    key = (path, mode, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = CachedEncoder(path, mode, end_id)
    return _ENCODERS[key]
