"""Exact and fast encoding of whole text columns with a file of the tokenizers library.

A text is cut where no token of the tokenizer can cross, each distinct cut is encoded
once, and the ids of all cuts are gathered with array operations. Cuts are found again by
a hash and compared in full.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Rolling, text_bytes

#: A space beside other white space, or at an end, isn't a safe cut for byte-level BPE.
_ODD = r"\A | \z|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}] | [\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|\x00"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: No token of either kind joins a letter and one of these after it.
_MARKS = r"(\p{L})([.,;:!?])"
#: Distinct cuts that a worker remembers before it starts anew.
REMEMBERED = 1_000_000


def tokenizer_json(name: str, path: str | None = None) -> str:
    """The text of a tokenizer file, by path or by its public name."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Encodes string columns; ``spaces_kept`` tells byte-level BPE from word BPE.

    Word BPE drops white space before it encodes, so any white space is a cut. In
    byte-level BPE a space belongs to the token after it: a single space between two
    other characters that aren't white space starts a cut.
    """

    def __init__(self, definition: str, spaces_kept: bool, end_id: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces_kept, self.end_id = Tokenizer.from_str(definition), spaces_kept, end_id
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.hashes = Rolling(6)
        self._forget()

    def _forget(self) -> None:
        # Sorted hashes of the cuts that were encoded, which cut each is of, and where its ids are.
        self.keys, self.which, self.starts, self.counts = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        self.words, self.ids, self.filled = pa.array([], pa.string()), np.zeros(1 << 16, np.int32), 0

    def _cuts(self, column: pa.Array) -> pa.ListArray:
        if not self.spaces_kept:
            return pc.ascii_split_whitespace(pc.replace_substring_regex(column, _MARKS, r"\1 \2"))
        odd = pc.match_substring_regex(column, _ODD)
        marked = pc.replace_substring(column.filter(pc.invert(odd)), " ", "\x00 ")
        plain = pc.split_pattern(pc.replace_substring_regex(marked, _MARKS, "\\1\x00\\2"), "\x00")
        if not pc.any(odd).as_py():
            return plain
        rest = [[x if i == 0 else " " + x for i, x in enumerate(_SAFE.split(t))] for t in column.filter(odd).to_pylist()]
        flags = odd.to_numpy(zero_copy_only=False)
        place = np.empty(len(flags), np.int64)
        place[~flags] = np.arange(len(plain))
        place[flags] = len(plain) + np.arange(len(rest))
        return pa.concat_arrays([plain, pa.array(rest, plain.type)]).take(pa.array(place))

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these distinct cuts start in self.ids, and how many there are."""
        if len(self.keys) + len(words) > REMEMBERED:
            self._forget()
        raw, bounds = text_bytes(words)
        keys = self.hashes.ranges(self.hashes.prefixes(raw), bounds[:-1], bounds[1:])
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        met = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        rows = np.flatnonzero(met)
        known = np.zeros(len(keys), bool)
        if len(rows):
            known[rows] = pc.equal(words.take(pa.array(rows)), self.words.take(pa.array(self.which[at[rows]]))).to_numpy(zero_copy_only=False)
        starts, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        starts[known], counts[known] = self.starts[at[known]], self.counts[at[known]]
        new = np.flatnonzero(~known)
        texts = words.take(pa.array(new)).to_pylist()
        for i in range(0, len(new), 20_000):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]
            own = new[i : i + 20_000]
            counts[own] = np.fromiter(map(len, lists), np.int64, len(lists))
            starts[own] = self.filled + np.cumsum(counts[own]) - counts[own]
            total = int(counts[own].sum())
            if self.filled + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.int32)])
            self.ids[self.filled : self.filled + total] = np.fromiter((x for ids in lists for x in ids), np.int32, total)
            self.filled += total
        # One cut of each hash is remembered; another with that hash is encoded anew each time.
        added, one = np.unique(keys[~met], return_index=True)
        if len(added):
            one = np.flatnonzero(~met)[one]
            to = np.searchsorted(self.keys, added)
            more = {"keys": added, "which": len(self.words) + np.arange(len(one)), "starts": starts[one], "counts": counts[one]}
            for name, x in more.items():
                setattr(self, name, np.insert(getattr(self, name), to, x))
            self.words = pa.concat_arrays([self.words, words.take(pa.array(one))])
        return starts, counts

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each row with the end id at its end, and the n + 1 bounds of rows."""
        column = column.cast(pa.string()) if column.type != pa.string() else column
        lists = self._cuts(column.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        starts, lengths = self._places(coded.dictionary)
        which = coded.indices.to_numpy()
        counts = lengths[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(starts[which] - (ends - counts), counts) + np.arange(total)]
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bounds = np.concatenate([[0], ends])[cuts]
        return np.insert(flat, bounds[1:], np.int32(self.end_id)), bounds + np.arange(len(bounds))


_encoders: dict[tuple, Encoder] = {}


def encoder(definition: str, spaces_kept: bool, end_id: int) -> Encoder:
    """One encoder for all tasks of a worker, so that what it remembers serves them all."""
    key = (hash(definition), spaces_kept, end_id)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition, spaces_kept, end_id)
    return _encoders[key]
