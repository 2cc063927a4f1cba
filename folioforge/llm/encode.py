"""Token ids of public tokenizers, with each distinct word encoded once for a while.

Both tokenizers cut a text before every space that follows and precedes other characters and around line ends; where spaces
count, a letter run before a full stop, comma or exclamation mark is cut off too. A text's ids are therefore those of such
units in a row, and a unit met before needs no second encoding. Texts with any other white space, and texts that hold the content
of an added token (such as <|endoftext|>, which has an id of its own), are encoded as a whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count, islice

import numpy as np

_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_ODD = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WITH_SPACES = re.compile(rf" ?{_LETTERS}+(?=[ \n.,!]|\Z)| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
_BLANK_LINE = re.compile(r"^ *$", re.MULTILINE)
_WHOLE = "\0whole\0"


class UnitEncoder:
    """Encodes batches of texts with a tokenizers file; ids are those of the library's encode(text, add_special_tokens=False).

    ``keeps_spaces``: whether spaces and line ends give ids (byte-level vocabularies) or are dropped (word-end vocabularies).
    ``limit``: units remembered at most; beyond it only those used again since are kept.
    """

    def __init__(self, path: str, keeps_spaces: bool, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_spaces = keeps_spaces
        # Between units that are encoded together: it always gives this one id, and units that hold it are encoded alone.
        self.mark, self.between = ("\n", "\n") if keeps_spaces else ("\x01", " \x01 ")
        (self.mark_id,) = self._ids(self.mark)
        self.limit = limit
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        # Numbers in order; a factory that refers to the dictionary itself would keep a forgotten one until a full garbage collection.
        self.known: defaultdict[str, int] = defaultdict(count().__next__)
        self.starts, self.lengths, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.flat, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _trim(self) -> None:
        keys = np.array(list(self.known), dtype=object)
        keep = np.flatnonzero(self.used > 1)
        ids, lengths = self._gather(keep), self.lengths[keep]
        self._forget()
        if len(keep) <= self.limit // 2:
            for k in keys[keep]:
                self.known[k]  # noqa: B018  gives the key the next number
            self._append(ids, lengths)

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        if self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.filled], np.zeros(self.filled + 2 * len(ids), np.uint32)])
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.filled + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.zeros(len(lengths), np.int64)])
        self.filled += len(ids)

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.lengths[numbers]
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(self.starts[numbers] - before, lengths) + np.arange(lengths.sum())]

    def _learn(self, fresh: list[str]) -> None:
        ids, lengths = [], []
        for k in range(0, len(fresh), 100):
            part = fresh[k : k + 100]
            text = self.between.join(part)
            if text.count(self.mark) == len(part) - 1 and _WHOLE not in text and not (self.keeps_spaces and _BLANK_LINE.search(text)):
                own = np.array(self._ids(text), np.uint32)
                cut = np.flatnonzero(own == self.mark_id)
                if len(cut) == len(part) - 1:
                    ids.append(np.delete(own, cut))
                    lengths.append(np.diff(np.concatenate([[-1], cut, [len(own)]])) - 1)
                    continue
            each = [np.array(self._ids(u.removeprefix(_WHOLE)), np.uint32) for u in part]
            ids += each
            lengths.append(np.array([len(x) for x in each], np.int64))
        self._append(np.concatenate(ids), np.concatenate(lengths))

    def _has_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _units(self, text: str) -> list[str]:
        if _ODD.search(text) or _WHOLE in text or self._has_added(text):
            return [_WHOLE + text]
        if self.keeps_spaces:
            return _WITH_SPACES.findall(text)
        try:  # this vocabulary is lower case; within Latin-1 each letter has one lower-case letter
            text.encode("latin-1")
            lower = text.lower()
        except UnicodeEncodeError:
            lower = text
        # Only the text itself can hold an added token, not what lower case makes of it.
        return [_WHOLE + text] if self._has_added(lower) else lower.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        if len(self.known) > self.limit:
            self._trim()
        old, numbers = len(self.known), []
        for text in texts:
            units = self._units(text)
            numbers.append(np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)))
        if len(self.known) > old:
            self._learn(list(islice(self.known, old, None)))
        every = np.concatenate([*numbers, np.zeros(0, np.int64)])
        self.used += np.bincount(every, minlength=len(self.used))
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
        counts = np.bincount(owner, weights=self.lengths[every], minlength=len(texts)).astype(np.int64)
        return self._gather(every), counts


_encoders: dict[tuple[str, bool, int], UnitEncoder] = {}


def encoder(path: str, keeps_spaces: bool, remembered: int | None = None) -> UnitEncoder:
    """One encoder for each vocabulary file, and number of units that it may remember, in this process."""
    # Encoding a word of the second kind costs more, so more of them are remembered.
    key = (path, keeps_spaces, remembered or (250_000 if keeps_spaces else 900_000))
    if key not in _encoders:
        _encoders[key] = UnitEncoder(*key)
    return _encoders[key]
