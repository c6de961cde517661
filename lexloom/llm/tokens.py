"""Token ids of whole texts, through the public tokenizers library.

The word tokenizer drops white space and never lets a token cross it, so a text's ids are
the ids of its white-space separated words in order. Each Arrow batch therefore tokenizes
its distinct words once and gathers the ids of all texts with numpy.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexloom.llm.common import spread, text_bytes

END_ID = 1
#: Distinct words kept with their ids between batches; the memo starts anew beyond this.
MEMO_WORDS = 400_000
#: A chunk of distinct words that is tokenized as one text.
CHUNK_WORDS = 2000
#: Words of these letters only are one pre-token each, whatever stands around them.
PLAIN_WORD = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True
#: ASCII signs other than the apostrophe, which can begin a token with the letters after it.
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """``encode`` gives (flat uint32 ids, int64 offsets by text); each text ends with END_ID."""

    _shared: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One for each path in a Python worker, which serves many tasks."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: pa.Array) -> None:
        plain = pc.match_substring_regex(words, PLAIN_WORD)
        ids, sizes, order = [], [], []
        easy = words.filter(plain).to_pylist()
        for i in range(0, len(easy), CHUNK_WORDS):
            part = np.array(self.tokenizer.encode_batch_fast([" ".join(easy[i : i + CHUNK_WORDS])], add_special_tokens=False)[0].ids, np.uint32)
            ids.append(part)
            sizes.append(np.diff(np.concatenate(([-1], np.flatnonzero(self.ends_word[part])))))
        order.append(words.filter(plain))
        rest = words.filter(pc.invert(plain))
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(rest.to_pylist(), add_special_tokens=False)]
        ids.append(np.fromiter((i for x in coded for i in x), np.uint32))
        sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
        order.append(rest)
        size = np.concatenate(sizes)
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
        self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, *ids))
        self.known = pa.concat_arrays([self.known, *order])

    def _words(self, words: pa.Array) -> np.ndarray:
        """Where the memo has each of these distinct words."""
        if len(self.known) > MEMO_WORDS:
            self._forget()
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            self._learn(words.filter(pc.is_null(at)))
            at = pc.index_in(words, value_set=self.known)
        return np.asarray(at, np.int64)

    def _split(self, texts: pa.Array) -> pa.Array:
        """Lower-case texts with a space between a letter and the sign after it, as lists of words."""
        body, offsets = text_bytes(texts)
        body = _LOWER[body]
        before = _ASCII_LETTER[body[:-1]]
        if len(body) > 2:
            latin = (body[:-2] == 0xC3) & (body[1:-1] != 0x97) & (body[1:-1] != 0xB7)
            before[1:] |= latin
        cut = np.flatnonzero(before & _SIGN[body[1:]]) + 1
        moved = offsets + np.searchsorted(cut, offsets, "left")
        wide = np.insert(body, cut, 32)
        spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(moved)), pa.py_buffer(wide)])
        return pc.ascii_split_whitespace(spaced)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        # Control strings are matched by case before anything else, so texts with one go in whole.
        special = np.asarray(pc.match_substring(texts, "<|"), bool)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        lists = self._split(plain)
        ends = np.asarray(lists.offsets, np.int64)
        ends = ends - ends[0]
        coded = pc.dictionary_encode(lists.flatten())
        word = self._words(coded.dictionary)[np.asarray(coded.indices, np.int64)]
        n = self.size[word]
        out = self.flat[np.repeat(self.first[word], n) + spread(n)]
        until = np.concatenate(([0], np.cumsum(n)))[ends]
        if special.any():
            parts = [out[until[i] : until[i + 1]] for i in range(len(texts))]
            for i in np.flatnonzero(special):
                parts[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            out, until = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        out = np.insert(out, until[1:], END_ID)
        return out.astype(np.uint32, copy=False), until + np.arange(len(until))
