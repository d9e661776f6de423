"""Vectorised use of the public word-BPE tokenizer (see ``/opt/tokenizers/README.md``)."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from meshline.llm.shared import coded_words

END_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 and up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in kept)}


#: Letters of Latin-1: the library's normaliser does nothing but lower-case them. One mark may follow.
PLAIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$"


class WordTokenizer:
    """Ids of whole texts, with a memo of words that is bounded in bytes.

    The vocabulary never merges across white space, so a text's ids are those of its white-space-separated
    words in turn. Words of Latin-1 letters (with one full stop or comma after them) go to the library's BPE model
    directly, after the lower-casing and byte mapping that its normaliser would do, once for all their spellings;
    all other words go through the library's whole chain.
    """

    def __init__(self, path: str | None = None, most_bytes: int = 48_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or default_vocabulary())
        self.pieces, self.letters = self.whole.model.tokenize, _byte_letters()
        self.most = most_bytes
        self._forget()

    def _forget(self) -> None:
        """Start the memo anew: entry 0 is no id, entries 1 and 2 are the ids of a full stop and a comma."""
        self.memo: dict[str, int] = {}
        self.ids, self.ends, self.taken = array("I"), array("q", [0]), 0
        for mark in (".", ","):
            self._add(self._any(mark))

    def _add(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return len(self.ends) - 1

    def _any(self, word: str) -> list[int]:
        return self.whole.encode(word, add_special_tokens=False).ids

    def _plain(self, core: str) -> list[int]:
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.pieces(core)]

    def _entries(self, words: pa.Array, new) -> np.ndarray:
        """The memo's entry of each word; ``new`` gives the ids of those that it doesn't have."""
        memo, out = self.memo, []
        for w in words.to_pylist():
            at = memo.get(w)
            if at is None:
                ids = new(w)
                at = memo[w] = self._add(ids)
                self.taken += 120 + len(w) + 4 * len(ids)
            out.append(at)
        return np.array(out, np.int64)

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and each text's bounds; ``end_id`` follows each text (None: nothing)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        words, codes, bounds = coded_words(texts)
        if self.taken > self.most:
            self._forget()
        # a word is what the memo has for its letters, and for the mark after them
        low = pc.utf8_lower(words)
        mark = np.where(pc.ends_with(low, "."), 1, np.where(pc.ends_with(low, ","), 2, 0))
        core = pc.if_else(pa.array(mark > 0), pc.utf8_slice_codeunits(low, 0, -1), low)
        plain = np.asarray(pc.match_substring_regex(words, PLAIN))
        entry = np.zeros((len(words), 2), np.int64)
        coded = core.filter(pa.array(plain)).dictionary_encode()
        entry[plain, 0] = self._entries(coded.dictionary, self._plain)[np.asarray(coded.indices)] if plain.any() else 0
        entry[plain, 1] = mark[plain]
        entry[~plain, 0] = self._entries(words.filter(pa.array(~plain)), self._any)
        ends = np.frombuffer(self.ends, np.int64)
        first = np.concatenate([[0], ends[:-1]])
        flat, cuts = gathered(np.frombuffer(self.ids, np.uint32), first, ends, entry.ravel())
        first, ends = cuts[:-1:2], cuts[2::2]
        if end_id is not None:  # one more word ends each text
            flat, first, ends = np.append(flat, np.uint32(end_id)), np.append(first, len(flat)), np.append(ends, len(flat) + 1)
            codes = np.insert(codes, bounds[1:], len(words))
            bounds = bounds + np.arange(len(bounds))
        ids, cuts = gathered(flat, first, ends, codes)
        return ids, cuts[bounds]


def gathered(flat: np.ndarray, first: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``first`` to ``ends`` of ``flat`` named by ``which``, one after another, and their bounds."""
    n = (ends - first)[which]
    cuts = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(first[which] - cuts[:-1], n) + np.arange(cuts[-1])], cuts


@lru_cache(maxsize=2)
def word_tokenizer(path: str | None = None) -> WordTokenizer:
    """One for all tasks of a Python worker: the vocabulary is read once, and the memo goes on growing to its bound."""
    return WordTokenizer(path)


def text_or_empty(batch) -> pa.Array:
    return pc.fill_null(batch.column("text"), "")
