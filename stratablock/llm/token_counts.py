"""Token counts that follow edits.

A document is a segment tree over runs of pre-token units: leaves hold a run's
text and token count, inner nodes the sums of characters and tokens below them.
An edit finds its leaves by descending the character sums, re-encodes those (and
the leaf before, while the cut between them may no longer hold) and updates the
sums on their paths to the root.  Nothing else is encoded again.

A null text counts as empty and has no tokens.  Very long texts only have more
leaves.  Rows that repeat an id are counted one by one; an empty table gives an
empty result; columns besides the named ones are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of
from .pretoken import UnitEncoder, cut_units, encoder, groups, starts_unit

#: Units in a leaf.
LEAF_UNITS = 32
Edit = tuple[int, int, str]


class TokenTree:
    """The token count of one text under edits."""

    def __init__(self, units: list[str], enc: UnitEncoder):
        runs = [units[i : i + LEAF_UNITS] for i in range(0, len(units), LEAF_UNITS)]
        self.enc = enc
        self.reencoded = 0
        counts = np.add.reduceat(enc.count_units(units), np.arange(0, len(units), LEAF_UNITS)).tolist()
        self._build([" " * (i > 0) + " ".join(r) for i, r in enumerate(runs)], counts)

    def _count(self, texts: list[str]) -> list[int]:
        return [len(b) // self.enc.width for b in self.enc.encode(texts)]

    def _build(self, leaves: list[str], counts: list[int] | None = None) -> None:
        self.leaves = leaves or [""]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = np.zeros(2 * self.size, np.int64)
        self.tokens = np.zeros(2 * self.size, np.int64)
        n = len(self.leaves)
        self.chars[self.size : self.size + n] = [len(x) for x in self.leaves]
        self.tokens[self.size : self.size + n] = self._count(self.leaves) if counts is None else counts
        for sums in (self.chars, self.tokens):
            level = self.size
            while level > 1:
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(1)
                level //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end of the text), and the place in it."""
        node = 1
        at = min(at, self.n_chars)
        if at == self.n_chars and at:
            leaf, inside = self._find(at - 1)
            return leaf, inside + 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node]:
                at -= int(self.chars[node])
                node += 1
        return node - self.size, at

    def _set(self, leaf: int, text: str, count: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        self.chars[node], self.tokens[node] = len(text), count
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end (not included) by new."""
        if not 0 <= start <= end <= self.n_chars:
            raise IndexError(f"{start}..{end} isn't within {self.n_chars} characters")
        left, at = self._find(start)
        right, to = self._find(end)
        text = self.leaves[left][:at] + new + self.leaves[right][to:]
        while left and not starts_unit(text):
            left -= 1
            text = self.leaves[left] + text
        units = cut_units(text)
        runs = [units[i : i + LEAF_UNITS] for i in range(0, len(units), LEAF_UNITS)]
        pieces = [" " * (i > 0) + " ".join(r) for i, r in enumerate(runs)] or [""]
        counts = self._count(pieces)
        self.reencoded += len(text)
        span = right - left + 1
        if len(pieces) > 2 * span + 2:  # much was put in: more leaves, whose counts are known
            known = self.tokens[self.size : self.size + len(self.leaves)].tolist()
            self._build(self.leaves[:left] + pieces + self.leaves[right + 1 :], known[:left] + counts + known[right + 1 :])
            return
        if len(pieces) > span:
            pieces, counts = ["".join(pieces)], [sum(counts)]
        for i in range(span):
            self._set(left + i, *((pieces[i], counts[i]) if i < len(pieces) else ("", 0)))


#: Fixed values of the clean-up edits: long numbers and addresses are masked, the last line of several goes.
ADDRESS, NUMBER = "<address>", "<number>"
# What stands before an @, from its start on, and what stands after it; no place is looked at more than a few times.
_AROUND_AT = re.compile(r"(?<![^\s@])[^\s@]++@(?=([^\s@]*+))")
_DIGITS = re.compile("[0-9]{5,}+")


def addresses(text: str, end: int) -> Iterator[tuple[int, int]]:
    """Places of name@host, the host having a dot within it, from left to right; the text counts up to ``end``."""
    done = 0
    for m in _AROUND_AT.finditer(text, 0, end):
        if m.start() >= done and text.find(".", m.start(1) + 1, m.end(1) - 1) >= 0:
            done = m.end(1)
            yield m.start(), done


def cleanup_edits(text: str) -> list[Edit]:
    """Edits from the end of the text to its start, so that each leaves the places of the next ones as they are."""
    last = text.rfind("\n")
    found = [(last, len(text), "")] if last > 0 else []
    end = last if last > 0 else len(text)
    taken = list(addresses(text, end))
    found += [(a, b, ADDRESS) for a, b in taken]
    starts = [a for a, _ in taken]
    for m in _DIGITS.finditer(text, 0, end):
        k = bisect_right(starts, m.start()) - 1  # an address holds all of a number or nothing
        if k < 0 or taken[k][1] <= m.start():
            found.append((m.start(), m.end(), NUMBER))
    return sorted(found, reverse=True)


def apply_edits(text: str, edits: list[Edit]) -> str:
    for a, b, new in edits:
        text = text[:a] + new + text[b:]
    return text


COUNTS = "doc_id long, n_chars long, n_tokens long, n_edits int, n_chars_edited long, n_tokens_edited long, n_chars_reencoded long"


def token_counts(docs: DataFrame, vocabulary: str, edits_of: Callable[[str], list[Edit]] = cleanup_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: token counts before and after the edits, and how many characters the edits had encoded again."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for part in groups(batches, 1):
            out = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tree = TokenTree(cut_units(text), enc)
                before, edits = tree.n_tokens, edits_of(text)
                for e in edits:
                    tree.edit(*e)
                out.append((doc_id, len(text), before, len(edits), tree.n_chars, tree.n_tokens, tree.reencoded))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in COUNTS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).mapInArrow(count, COUNTS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_token_counts": op2_token_counts}
