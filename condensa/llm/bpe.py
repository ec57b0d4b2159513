"""Byte-level BPE of whole texts with the tokenizers library, made cheap for corpus use.

A text is cut at single blanks between two non-blank characters. The vocabulary's own
pre-tokenizer always starts a new piece there, so the ids of the parts, one after the
other, are the ids of the text. Parts repeat (words follow a power law): each block of
texts is cut by Arrow and its different parts are looked up once, and each worker keeps
the words it met lately and asks the library only for the others.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_OF_TEXT = 50256

_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Two of the characters that ``\s`` of Python's patterns means, in RE2.
_TWO_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
_WORD = r"^ ?\pL+$"
_WORD_AND_MARKS = r"^ ?\pL+[!-/:-@\[-`{-~]+$"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte, as byte-level BPE vocabularies spell them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def _parts(text: str) -> list[str]:
    """The parts of a text with runs of blanks, or with the sign that marks cuts elsewhere."""
    first, *others = _SINGLE_BLANK.split(text)
    return [first, *[" " + p for p in others]]


def _offsets(parts: pa.Array) -> np.ndarray:
    return np.frombuffer(parts.buffers()[1], "<i8")[parts.offset : parts.offset + len(parts) + 1]


class Encoder:
    """encode(texts) -> ids of each text as little-endian uint32 bytes; a null text counts as empty.

    ``room``: how many words and other short parts are remembered, those met last first.
    """

    def __init__(self, path: str, room: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings that spell a special token are ordinary text, as the vocabulary's notes advise
        self.tokenizer.encode_special_tokens = True
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.room, self.met, self.ids_of_met = room, pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def encode(self, texts: pa.Array, block_bytes: int = 2 << 20) -> Iterator[memoryview]:
        """In blocks of texts with about ``block_bytes`` bytes; a longer text is a block of its own."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        block = np.cumsum(pc.binary_length(texts).to_numpy()) // block_bytes
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield from self._block(texts.slice(a, b - a))

    def _block(self, texts: pa.Array) -> Iterator[memoryview]:
        rare = pc.or_(pc.match_substring_regex(texts, _TWO_BLANKS), pc.match_substring(texts, "\0"))
        # a lone line feed is a piece of its own
        cut = pc.replace_substring(pc.if_else(rare, "", texts), " ", "\0 ")
        cut = pc.split_pattern(pc.replace_substring(cut, "\n", "\0\n\0"), "\0")
        apart = [_parts(text) for text in texts.filter(rare).to_pylist()]
        lists = pa.concat_arrays([cut, pa.array(apart, cut.type)])
        ids = self._ids(lists.flatten())
        ends = _offsets(ids)[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        spans = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        others = iter(spans[len(texts) :])
        for own, is_rare in zip(spans, rare.to_pylist(), strict=False):
            yield next(others) if is_rare else own

    def _ids(self, parts: pa.Array) -> pa.Array:
        """The ids of each part, one behind the other; a word is looked up without the marks behind it."""
        coded = pc.dictionary_encode(parts)
        whole = coded.dictionary
        marks = pc.match_substring_regex(whole, _WORD_AND_MARKS).to_numpy(zero_copy_only=False)
        size = np.where(marks, pc.binary_length(pc.utf8_rtrim(whole, punctuation)), pc.binary_length(whole))
        edges = np.empty(2 * len(whole) + 1, "<i8")
        edges[::2] = _offsets(whole)
        edges[1::2] = edges[:-1:2] + size
        halves = pc.dictionary_encode(pa.Array.from_buffers(pa.large_string(), 2 * len(whole), [None, pa.py_buffer(edges), whole.buffers()[2]]))
        ids = self._looked_up(halves.dictionary).take(halves.indices)
        ids = pa.Array.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer(_offsets(ids)[::2].copy()), ids.buffers()[2]])
        return ids.take(coded.indices)

    def _looked_up(self, parts: pa.Array) -> pa.Array:
        at = pc.fill_null(pc.index_in(parts, value_set=self.met), -1).to_numpy()
        fresh = at < 0
        ids = pa.concat_arrays([self.ids_of_met, self._encoded(parts.filter(pa.array(fresh)))])
        ids = ids.take(pa.array(np.where(fresh, len(self.met) - 1 + np.cumsum(fresh), at)))
        old = np.ones(len(self.met), bool)
        old[at[~fresh]] = False
        old, short = pa.array(old), pc.less_equal(pc.binary_length(parts), 64)
        self.met = pa.concat_arrays([parts.filter(short), self.met.filter(old)]).slice(0, self.room)
        self.ids_of_met = pa.concat_arrays([ids.filter(short), self.ids_of_met.filter(old)]).slice(0, self.room)
        return ids

    def _encoded(self, parts: pa.Array) -> pa.Array:
        """What the library makes of each part; words need not be cut by it."""
        is_word = pc.match_substring_regex(parts, _WORD)
        words, others = parts.filter(is_word), iter(parts.filter(pc.invert(is_word)).to_pylist())
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), "\0")[0].as_py()
        words = iter(words.encode().decode("latin-1").translate(self.letters).split(self.letters[0]))
        tokenize, encode = self.tokenizer.model.tokenize, self.tokenizer.encode
        ids = [
            array("I", [t.id for t in tokenize(next(words))] if w else encode(next(others), add_special_tokens=False).ids).tobytes()
            for w in is_word.to_pylist()
        ]
        return pa.array(ids, pa.large_binary())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)
