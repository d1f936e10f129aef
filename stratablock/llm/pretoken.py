"""Byte-level BPE by the tokenizers library, with a bounded cache of words.

The pre-tokenizer of a byte-level BPE never joins what precedes a space to the
space when a visible character follows it, and it looks no further back.  So a
text may be cut there, each unit encoded on its own, and the ids joined.  Units
recur, and only those not in the cache go to the library.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Python's \s holds all that the library's \s does, and these may be white space to some versions.
_BLANK = r"\s\x1c-\x1f\u180e\u200b\ufeff"
_ODD = re.compile(rf" (?:[{_BLANK}]|\Z)")
_CUT = re.compile(rf" (?=[^{_BLANK}])")
_STARTS = re.compile(rf" [^{_BLANK}]")

#: Units in the cache at most; longer units than this many characters aren't kept.
CACHE_UNITS, CACHE_CHARS = 700_000, 48
#: Texts are handled in groups of about so many bytes.
GROUP_BYTES = 1 << 20
# Letters of which every Unicode version knows that they are letters, marks that form one pre-token, and a line's end.
_MARKS = frozenset(".,!?;:#*$%&|")
_WORDS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,!?;:#*$%&|]*)(?:(\n)([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,!?;:#*$%&|]*))?\Z")


def cut_units(text: str) -> list[str]:
    """text is the first item, then a space before each further item."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def starts_unit(text: str) -> bool:
    """Whether a cut before this text is safe, whatever precedes it."""
    return _STARTS.match(text) is not None


def byte_marks() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if visible, else the next one from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Bounded(dict):
    """A cache that takes what comes until it is full: frequent units come early.  It starts anew after many misses."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most:
            if len(key) <= CACHE_CHARS:
                self[key] = value
        else:
            self.missed += 1
            if self.missed > 8 * self.most:
                self.clear()
                self.missed = 0
        return value


class UnitEncoder:
    """ids of texts as little-endian unsigned 16-bit integers (32-bit for large vocabularies).

    special_as_text: whether the strings of special tokens are ordinary in a text, or give their ids, as is the library's default.
    """

    def __init__(self, path: str, cache_units: int = CACHE_UNITS, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        # a text that holds one of these isn't cut: the library looks for them before it splits
        self.special = () if special_as_text else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self._packed = [i.to_bytes(self.width, "little") for i in range(size)]
        self._model = self.tokenizer.model.tokenize
        self._marks = byte_marks()
        self._spaced = _Bounded(self._make_spaced, cache_units)
        self._bare = _Bounded(self._make_bare, cache_units // 4)

    def _make_bare(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _make_spaced(self, key: str) -> bytes:
        """ids of the key with a space before it.  Words, marks and line ends in a plain unit are pre-tokens of their own."""
        if key.isascii():  # the common cases of what follows, without the pattern
            if key.isalpha():
                packed = self._packed
                return b"".join([packed[t.id] for t in self._model("\u0120" + key)])
            if key[-1:] in _MARKS and key[:-1].isalpha():
                return self._spaced[key[:-1]] + self._bare[key[-1]]
        m = _WORDS.match(key)
        if m is None:
            return self._make_bare(" " + key)
        word, marks, line, then, more = m.groups()
        if len(word) == len(key):
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self._marks)
            packed = self._packed
            return b"".join([packed[t.id] for t in self._model(self._marks[32] + shown)])
        bare = self._bare
        return self._spaced[word] + (bare[marks] if marks else b"") + (bare[line] + bare[then] + (bare[more] if more else b"") if line else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out = self._spaced.__getitem__, []
        for t in texts:
            if any(s in t for s in self.special):
                out.append(self._make_bare(t))
                continue
            units = cut_units(t)
            out.append(self._make_bare(units[0]) + b"".join(map(get, units[1:])))
        return out

    def count_units(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit of a text."""
        sizes = np.fromiter(map(len, map(self._spaced.__getitem__, units)), np.int64, len(units))
        sizes[0] = len(self._make_bare(units[0]))
        return sizes // self.width


_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, special_as_text: bool = True) -> UnitEncoder:
    """One per Python worker, vocabulary and way to take special tokens."""
    if (path, special_as_text) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.freeze()  # millions of short strings follow and no cycles: don't scan what stays
        gc.set_threshold(200_000, 50, 50)
        _encoders[path, special_as_text] = UnitEncoder(path, special_as_text=special_as_text)
    return _encoders[path, special_as_text]


def groups(batches: Iterable[pa.RecordBatch], text: int, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of the text column (one text may be larger)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        begin = size = 0
        for i, n in enumerate(lengths):
            if size + n > limit and i > begin:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)
