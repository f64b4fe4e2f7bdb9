"""Token ids of whole texts, with each word encoded once per worker.

The vocabulary drops white space and never joins across it, so a text's ids are those of its words in turn. A worker
keeps the ids of words it has met, up to a number of words; beyond it the less used half goes. Only unknown words go
through the tokenizers library.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that one worker keeps.
KEEP_WORDS = 500_000
#: Latin letters, then ASCII punctuation: the letters are one pre-token and the rest another.
_PLAIN = "^[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+([!-/:-@\\[-`{-~]*)$"
_TAIL = "[!-/:-@\\[-`{-~]$"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable:
    """Numbers for the words that a worker has met, and which of them are worth keeping."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.uses = np.zeros(1 << 14, np.int32)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For each word its place among the distinct ones; their numbers, -1 if new; the distinct words."""
        coded = pc.dictionary_encode(words)
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        distinct = coded.dictionary.to_pylist()
        get = self.index.get
        numbers = np.array([get(w, -1) for w in distinct], np.int64)
        old = numbers[numbers >= 0]
        self.uses[old] += 1
        return coded.indices.to_numpy(), numbers, distinct

    def add(self, words: list[str]) -> np.ndarray:
        begin = len(self.index)
        numbers = np.arange(begin, begin + len(words))
        self.index.update(zip(words, numbers.tolist()))
        while len(self.uses) < len(self.index):
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        return numbers

    def crowded(self) -> np.ndarray | None:
        """Once over ``KEEP_WORDS``: the numbers of the half used most, which are renumbered from 0 in that order."""
        n = len(self.index)
        if n <= KEEP_WORDS:
            return None
        stay = np.argsort(-self.uses[:n], kind="stable")[:KEEP_WORDS // 2]
        words = list(self.index)
        self.index = {words[i]: k for k, i in enumerate(stay.tolist())}
        self.uses[:len(stay)] = self.uses[stay] // 2
        self.uses[len(stay):] = 0
        return stay


class WordEncoder:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them.

    For vocabularies that split at white space, mark word ends, and whose letters and other characters never share a
    token. Unknown words are encoded many at a time; word ends tell them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ends = [i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends_word[ends] = True
        self.table = WordTable()
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        values = pa.array(words, pa.string())
        plain = pc.match_substring_regex(values, _PLAIN).to_numpy(zero_copy_only=False)
        tails = pc.match_substring_regex(values, _TAIL).to_numpy(zero_copy_only=False)
        words = [words[i] for i in np.flatnonzero(plain)] + [words[i] for i in np.flatnonzero(~plain)]
        groups = 1 + tails[plain]
        joined = [" ".join(words[i:min(i + 1000, len(groups))]) for i in range(0, len(groups), 1000)]
        ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != groups.sum():
            raise ValueError("the vocabulary does not end each word once")
        ends = ends[np.cumsum(groups) - 1] if len(groups) else ends
        others = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(words[len(groups):], add_special_tokens=False)]
        lengths = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in others], np.int64)])
        flat = np.concatenate([flat, *others])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])
        return self.table.add(words), words

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)], ends

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids end."""
        texts = pa.array(texts, pa.large_string())
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        stay = self.table.crowded()
        if stay is not None:
            self.flat, ends = self._gather(stay)
            self.lengths = self.lengths[stay]
            self.starts = ends - self.lengths
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        at, numbers, distinct = self.table.find(words.flatten())
        new = np.flatnonzero(numbers < 0)
        if len(new):
            learnt, order = self._learn([distinct[i] for i in new])
            place = dict(zip(order, learnt.tolist()))
            numbers[new] = [place[distinct[i]] for i in new]
        ids, ends = self._gather(numbers[at])
        return ids, ends[words.offsets.to_numpy()[1:] - 1]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
