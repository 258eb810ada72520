"""Byte-level BPE ids of whole texts through the ``tokenizers`` library, with a bounded cache of words."""

from __future__ import annotations

import functools
import gc
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
WORDS_KEPT = 150_000

#: Characters of which every regular-expression library has the same idea of letter, digit and space.
_PLAIN = re.compile(r"[\t\n\r -~¡-ԯ]*")

#: Stretches of a text that start where the pre-tokenizer always starts a token: before a space or a line break that
#: follows no white space. A NUL, put where another start is known, ends a stretch too.
CHUNKS = re.compile("[ \n]*[^ \n\x00]+|[ \n]+")
#: White space other than space and line break before one of the two: no chunk ends there.
UNSAFE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff][ \n]")
#: The same of bytes: what white space of other kinds may end with in UTF-8.
_MAY_BE_SPACE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31, *range(0x80, 0xC0)])
#: First bytes of two of which, but for the signs of multiplication and division (C3 97, C3 B7), only letters are made.
_LETTER_LEADS = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to those of ``Tokenizer.encode``.

    The pre-tokenizer always starts a new token at a space that a non-space character follows, and between a lone
    line break and what stands on its sides, so a text falls into independent words there. A word's ids come from
    the cache or from the library's BPE model; a text with two white-space characters in a row, and a word outside
    the plain alphabets, go through ``Tokenizer.encode`` itself, and so does a text that holds the string of an added
    token, which the library turns into that token's id wherever it stands.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        #: Byte-level BPE writes each byte as a printable character: itself, or the next one from 256 on.
        self.table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.as_bytes = [i.to_bytes(4, "little") for i in range(self.vocab_size)]
        self.odd = False
        outer = self

        class Spaced(dict):
            def __missing__(self, word):
                line = word[:1] == "\n"  # a new line's first word: the break is a token of its own
                own = word[1:] if line else word
                if not own or own[0].isspace():
                    outer.odd = True
                    return b""
                lead = "" if line else " "
                stem = own.rstrip(",.") if own.isascii() else own
                if stem.isalpha() and (stem.isascii() or _PLAIN.fullmatch(stem)):  # letters, then stops: two tokens
                    ids = outer.pieces[lead + stem] + (outer.pieces[own[len(stem) :]] if len(stem) < len(own) else b"")
                else:
                    ids = outer._fresh(lead + own)
                if line:
                    ids = outer.pieces["\n"] + ids
                if outer.again(word) and len(self) < WORDS_KEPT:
                    self[word] = ids
                return ids

        class Pieces(dict):
            def __missing__(self, piece):
                shown = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(outer.table)
                ids = b"".join([outer.as_bytes[t.id] for t in outer.model.tokenize(shown)])
                if outer.again(piece) and len(self) < WORDS_KEPT:
                    self[piece] = ids
                return ids

        self.words, self.pieces = Spaced(), Pieces()
        self.once: set[str] = set()
        gc.set_threshold(200_000)  # nothing here is cyclic, and the caches are long to walk

    def again(self, word: str) -> bool:
        """Whether a word has been met before: a word met once takes no room in the cache."""
        if word in self.once:
            return True
        if len(self.once) >= WORDS_KEPT:
            self.once.clear()
        self.once.add(word)
        return False

    def _whole(self, text: str) -> bytes:
        return b"".join([self.as_bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _fresh(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text):
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self._whole(text)
        words = text.replace("\n", " \n").split(" ")
        self.odd = False
        ids = (self._fresh(words[0]) if words[0] else b"") + b"".join(map(self.words.__getitem__, words[1:]))
        if self.odd or not words[0] and len(words) > 1 and not words[1]:
            return self._whole(text)
        return ids

    def encode_document(self, text: str | None) -> bytes:
        """The ids and the end id."""
        return self.encode(text) + END_ID.to_bytes(4, "little")


def _bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, none of them null, and where each begins and the last ends."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at - at[0]


def _spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data == 10)


def _chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks start: at a text, at a space or line break that follows neither, at a stop between a letter and one of the two."""
    space = _spaces(data)
    start = space.copy()
    start[1:] &= ~space[:-1]
    stop = np.flatnonzero(((data[1:-1] == 46) | (data[1:-1] == 44)) & space[2:]) + 1
    last, lead = data[stop - 1], data[stop - 2]
    sign = (lead == 0xC3) & ((last == 0x97) | (last == 0xB7))
    start[stop[((last | 32) - 97 < 26) | (last >= 128) & _LETTER_LEADS[lead] & ~sign]] = True
    start[at[:-1][at[:-1] < len(data)]] = True
    return np.flatnonzero(start)


class BatchEncoder:
    """Ids of many texts at once, equal to those of ``Tokenizer.encode``, as little-endian unsigned 32-bit numbers.

    Texts stay in their Arrow buffer: chunks are found among its bytes, and each different one is looked up once. Chunks
    not met before are laid together and encoded by the library as a few long strings, which are cut apart again by the
    bytes of their tokens; the ids of a bounded number of chunks are kept. Those of the generation before are kept too
    and move over when they are met again. A text that holds the string of an added token or white space of other
    kinds at a chunk's end is encoded whole.
    """

    #: CHUNKS_KEPT and CHARS_KEPT hold for a generation, of which there are two. Chunks looked up together.
    JOINED_CHARS, CHUNKS_KEPT, CHARS_KEPT, TOGETHER = 1_000, 600_000, 12_000_000, 1_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of each id: byte-level BPE writes a byte as one character.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.chars = 0

    def _ids(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        joined, held, size = [], [], 0
        together, alone = [], []
        for c in new:
            if c[0] not in " \n" or c[-1].isspace():
                alone.append(c)
                continue
            together.append(c)
            held.append(c)
            size += len(c)
            if size >= self.JOINED_CHARS:
                joined.append("".join(held))
                held, size = [], 0
        joined += ["".join(held)] if held else []
        if together:
            ids = np.concatenate(self._ids(joined))
            ends = np.cumsum(self.sizes[ids])
            cuts = np.cumsum(np.fromiter((len(c.encode()) for c in together), np.int64, len(together)))
            at = np.searchsorted(ends, cuts, "right")
            if not np.array_equal(ends[at - 1], cuts) or at[-1] != len(ids):
                raise ValueError("the vocabulary does not spell its texts byte for byte")
            data, at = ids.tobytes(), (4 * at).tolist()
            self.kept.update(zip(together, [data[s:e] for s, e in zip([0, *at], at, strict=False)], strict=True))
        if alone:
            self.kept.update(zip(alone, (ids.tobytes() for ids in self._ids(alone)), strict=True))
        self.chars += sum(map(len, new))

    def _known(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks."""
        if len(self.kept) > self.CHUNKS_KEPT or self.chars > self.CHARS_KEPT:
            self.before, self.kept, self.chars = self.kept, {}, 0
        out = list(map(self.kept.get, chunks))
        missed = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missed:
            c = chunks[i]
            ids = self.before.get(c)
            if ids is None:
                new.append(c)
            else:
                self.kept[c] = ids
                self.chars += len(c)
        if new:
            self._learn(new)
        for i in missed:
            out[i] = self.kept[chunks[i]]
        return out

    def _gathered(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after another, and how many each has."""
        different = chunks.dictionary_encode()
        known = self._known(different.dictionary.to_numpy(zero_copy_only=False).tolist())  # faster than to_pylist
        n = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first, which = np.cumsum(n) - n, different.indices.to_numpy()
        n, first = n[which], first[which]
        ends = np.cumsum(n)
        place = np.repeat(first - (ends - n), n)
        place += np.arange(len(place))
        return np.frombuffer(b"".join(known), "<u4")[place], n

    def _whole(self, texts: pa.LargeStringArray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts the library must see whole."""
        out = np.zeros(len(texts), bool)
        raw = data.tobytes()
        for a in self.added:
            if a.encode() in raw:
                out |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        end = np.flatnonzero(_MAY_BE_SPACE[data[:-1]] & _spaces(data[1:]))
        lead = data[end - 1]
        end = end[(data[end] < 128) | (lead < 0xC3) | (lead > 0xDF)]  # a character of two bytes is white space after C2 only
        for i in np.unique(np.searchsorted(at, end, "right") - 1).tolist():
            out[i] |= UNSAFE.search(texts[i].as_py()) is not None
        return out

    def encode_column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where those of each end. ``end`` is put after each; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data, at = _bytes_of(texts)
        whole = self._whole(texts, data, at)
        odd = []
        if whole.any():
            odd = self._ids(texts.filter(pa.array(whole)).to_pylist())
            texts = pc.if_else(pa.array(whole), "", texts)
            data, at = _bytes_of(texts)
        starts = _chunk_starts(data, at)
        bounds = np.append(starts, len(data))
        chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        parts = [self._gathered(chunks.slice(k, self.TOGETHER)) for k in range(0, len(starts), self.TOGETHER)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(p[0] for p in parts)])
        sums = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(p[1] for p in parts)]))
        ends = sums[np.searchsorted(starts, at[1:])]
        if odd:
            n = np.array([len(x) for x in odd], np.int64)
            ids = np.insert(ids, np.repeat(ends[whole], n), np.concatenate(odd))
            more = np.zeros(len(ends), np.int64)
            more[whole] = n
            ends = ends + np.cumsum(more)
        if end is not None:
            ids, ends = np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)
        return ids, ends

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        return [own.tobytes() for own in np.split(ids, ends[:-1])] if len(texts) else []


@functools.lru_cache(maxsize=2)
def batch_encoder(path: str) -> BatchEncoder:
    """One per worker process, so that what it keeps outlives a task."""
    return BatchEncoder(path)


def byte_portions(rows: pa.RecordBatch, text: int, size: int = 4_000_000):
    """Slices of a record batch with about ``size`` bytes of the text column each, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < rows.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, size + (ends[start - 1] if start else 0), "right")))
        yield rows.slice(start, stop - start)
        start = stop


def in_portions(rows, text: int, chars: int = 1_000_000):
    """The columns of a record batch as lists, about ``chars`` of the text column at a time."""
    columns = [c.to_pylist() for c in rows.columns]
    start = held = 0
    for i, t in enumerate(columns[text]):
        held += len(t or "")
        if held >= chars or i + 1 == rows.num_rows:
            yield [c[start : i + 1] for c in columns]
            start, held = i + 1, 0


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, so that its cache outlives a task."""
    return Encoder(path)
