"""Token ids of whole texts by a byte-level BPE tokenizer file, with the work per distinct word done once.

A byte-level BPE tokenizer cuts a text before it merges, and always between a
character and a single blank that follows it.  So texts are cut there by Arrow,
the cuts of a slice are numbered by Arrow, and only words that the worker does
not know yet reach the tokenizer.  The known words are Arrow and numpy arrays of
a bounded number of entries; when they are full, those not met in the present
slice are forgotten.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 400_000
SLICE_BYTES = 4 << 20
_CUT = "\0"
# The white space of the tokenizer's pattern, as ranges of a character class.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = f"[{_SPACES}][{_SPACES}]|{_CUT}"
# Letters up to U+00FF, and marks that always start a new unit after a letter.
_LETTERS = " ?[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = r"[.,!?;:|\"()%&$*#]+"
_STEM = re.compile(_LETTERS)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the
    characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of whole texts through one tokenizer file (byte-level, no normalizer, no added prefix).

    Without ``plain``, strings of added tokens inside a text get the id of the
    token, as the library does by default; with it they are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False, limit: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(map(re.escape, added))
        self.limit = limit
        self.known = pa.array([], pa.large_string())
        self.length, self.begin = np.empty(0, np.int32), np.empty(0, np.int32)
        self.flat = np.empty(0, "<u4")

    def _code(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; one run of letters is a unit of the pattern, which goes straight to the merges."""
        out: list = [None] * len(words)
        other = []
        for i, word in enumerate(words):
            if _STEM.fullmatch(word):
                out[i] = [t.id for t in self.model.tokenize(
                    word.encode().decode("latin-1").translate(self.alphabet))]
            else:
                other.append(i)
        for start in range(0, len(other), 4096):
            some = other[start:start + 4096]
            for i, coded in zip(some, self.tokenizer.encode_batch_fast(
                    [words[i] for i in some], add_special_tokens=False)):
                out[i] = coded.ids
        return out

    def _rows(self, words: pa.Array) -> np.ndarray:
        """The row of each distinct word among the known ones; unknown words are added."""
        row = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        new = np.flatnonzero(row < 0)
        unknown = words.take(pa.array(new))
        ids = self._code(unknown.to_pylist())
        if len(self.known) + len(new) > self.limit:
            kept = np.unique(row[row >= 0])
            self.known = self.known.take(pa.array(kept))
            self.flat = self.flat[spans(self.begin[kept], self.length[kept])]
            self.length = self.length[kept]
            self.begin = np.cumsum(self.length, dtype=np.int32) - self.length
            row = np.where(row < 0, row, np.searchsorted(kept, row)).astype(np.int32)
        row[new] = len(self.known) + np.arange(len(new), dtype=np.int32)
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n, dtype=np.int32) - n])
        self.length = np.concatenate([self.length, n])
        self.flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), "<u4", int(n.sum()))])
        self.known = pa.concat_arrays([self.known, unknown])
        return row

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """Cut texts at single blanks and line breaks; a cut left out only makes a longer piece."""
        odd = pc.match_substring_regex(texts, _ODD)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", f"{_CUT}\n{_CUT}")
        if pc.any(odd).as_py():
            some = texts.filter(odd)
            cut = pc.replace_substring_regex(some, f"([^{_SPACES}]) ([^{_SPACES}])", f"\\1{_CUT} \\2")
            cut = pc.replace_substring_regex(cut, f"([^{_SPACES}])\n([^{_SPACES}])", f"\\1{_CUT}\n{_CUT}\\2")
            marked = pc.replace_with_mask(marked, odd, cut)
        return pc.split_pattern(marked, _CUT)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = self._cut(texts)
        per_text = np.diff(pieces.offsets.to_numpy())
        coded = pieces.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, f"^(?P<stem>{_LETTERS})(?P<tail>{_MARKS})$")
        split = parts.is_valid()
        stems = pc.if_else(split, parts.field(0), coded.dictionary)
        tails = pc.if_else(split, parts.field(1), "")
        both = pa.concat_arrays([stems, tails]).cast(pa.large_string()).dictionary_encode()
        pair = self._rows(both.dictionary)[both.indices.to_numpy()].reshape(2, -1).T
        words = pair[coded.indices.to_numpy()].ravel()
        n = self.length[words]
        upto = np.append(0, np.cumsum(n, dtype=np.int64))
        return self.flat[spans(self.begin[words], n)], np.diff(upto[np.append(0, 2 * np.cumsum(per_text))])

    def encode(self, texts: pa.Array | list, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null: empty), ``end_id`` after each if given, and the count per text."""
        given = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(given):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        whole = pc.match_substring(given, _CUT)
        if self.added:
            whole = pc.or_(whole, pc.match_substring_regex(given, self.added))
        rare = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        ids, counts = self._slice(pc.if_else(whole, "", given) if len(rare) else given)
        if not len(rare) and end_id is None:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1]) if len(rare) else None
        for i in rare.tolist():
            parts[i] = np.array(self.tokenizer.encode(given[i].as_py(), add_special_tokens=False).ids, "<u4")
            counts[i] = len(parts[i])
        if parts is not None:
            ids = np.concatenate(parts)
        if end_id is None:
            return ids, counts
        ends = np.cumsum(counts + 1) - 1
        out = np.empty(len(ids) + len(counts), "<u4")
        body = np.ones(len(out), bool)
        body[ends] = False
        out[body], out[ends] = ids, end_id
        return out, counts + 1


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., for ``length[0]`` numbers, then those of the next entry, and so on."""
    ends = np.cumsum(length, dtype=np.int32)
    return np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of texts with at most ``most`` bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, start = np.cumsum(size), 0
    while start < len(size):
        before = upto[start] - size[start]
        rows = max(1, int(np.searchsorted(upto, before + most, side="right")) - start)
        yield start, rows
        start += rows


def word_ids(path: str, plain: bool = False) -> WordIds:
    """The worker's encoder for a tokenizer file; Spark keeps workers between tasks.

    It hangs on the interpreter and not on this module, because functions that
    travel by value bring their own copy of the module's globals with each task.
    """
    kept = sys.__dict__.setdefault("_incident_analytics_encoders", {})
    if (path, plain) not in kept:
        kept[path, plain] = WordIds(path, plain)
    return kept[path, plain]
