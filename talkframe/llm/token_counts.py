"""Token counts at every prefix, by dynamic programming over last tokens.

Byte-pair encoding has one last token for every prefix, and the count of a prefix is one more than that of what stands
before its last token. A token can follow another exactly if the two, encoded together, stay two. So one pass over a text gives the
counts of all its prefixes, and truncation and budget questions need no further encoding.

No token of the vocabulary holds a space behind another character, so the recurrence starts anew at each run of spaces. A
worker keeps the prefix counts of the words it has met, up to a number of words.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.storage import column, pieces
from talkframe.llm.tokenizing import WordTable, tokenizer_path

#: Pairs of tokens that one worker keeps.
KEEP_PAIRS = 1_000_000
LIMIT = 4096
_SPACE = "▁"
_UNITS = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class PrefixCounter:
    """Counts as ``SentencePieceProcessor(model_file=path).encode`` gives them, for each prefix of a text.

    For models of byte-pair type with byte fallback, a leading space and no other change of the text.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        normal = [i for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.tokens = {self.model.id_to_piece(i).replace(_SPACE, " "): i for i in normal}
        if any(" " in t.lstrip(" ") for t in self.tokens):
            raise ValueError("the vocabulary has a token with an inner space")
        self.longest = max(map(len, self.tokens))
        if any("\n" in t for t in self.tokens):
            raise ValueError("the vocabulary has a token with a line break")
        self.inside = {t[i:i + 2] for t in self.tokens for i in range(len(t) - 1)}
        self.follow: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.tails: dict[str, list[int]] = {}
        self.words, self.counts = WordTable(), np.zeros(0, np.int64)

    def _may_follow(self, left: str, right: str) -> bool:
        # The line break is no token: it keeps the model's leading space away from the pair.
        ids = self.model.encode("\n" + left + right)[2:]
        return ids == [self.tokens[left], self.tokens[right]]

    def _chain(self, text: str) -> list[int]:
        """Counts of the prefixes of 1, 2, … characters of a string that no token reaches across."""
        tokens, follow, longest = self.tokens, self.follow, self.longest
        last: list[str] = [""]
        counts = [0]
        for end in range(1, len(text) + 1):
            # The last token often grows by the new character; that size is tried first, then all.
            guess = len(last[-1]) + 1
            for size in (guess, *range(1, min(end, longest) + 1)):
                token = text[end - size:end]
                if size <= end and token in tokens:
                    before = last[end - size]
                    if not before:
                        fits = True
                    else:
                        known = follow.get(before)
                        if known is None:
                            known = follow[before] = {}
                        fits = known.get(token)
                        if fits is None:
                            fits = known[token] = self._may_follow(before, token)
                            self.pairs += 1
                    if fits:
                        last.append(token)
                        counts.append(counts[end - size] + 1)
                        break
            else:
                # A character outside the vocabulary: one token a byte, and nothing joins across it.
                last.append("")
                counts.append(counts[-1] + len(text[end - 1].encode("utf-8", "surrogatepass")))
        return counts[1:]

    def unit(self, text: str) -> list[int]:
        """Counts of the prefixes of 1, 2, … characters of a run of spaces and what follows up to the next space."""
        core = text.rstrip(string.punctuation)
        if not core or len(core) == len(text) or text[len(core) - 1:len(core) + 1] in self.inside:
            return self._chain(text)
        counts = self._chain(core)
        return counts + [counts[-1] + n for n in self._tail(text[len(core):])]

    def _tail(self, text: str) -> list[int]:
        if len(self.tails) > 10_000:
            self.tails.clear()
        if text not in self.tails:
            self.tails[text] = self._chain(text)
        return self.tails[text]

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, … code points of ``text``."""
        text = text.replace(_SPACE, " ")  # the model's own space is one to it
        out, total = [0], 0
        for i, unit in enumerate(_UNITS.findall(" " + text) if text else []):
            counts = self.unit(unit)
            out += [total + n for n in counts[i == 0:]]
            total += counts[-1]
        return np.array(out, np.int64)

    def measure(self, texts: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and code points of its longest prefix with at most ``limit`` tokens."""
        totals, fitting = np.zeros(len(texts), np.int64), np.array([len(t) for t in texts], np.int64)
        if not texts:
            return totals, fitting
        texts = [t.replace(_SPACE, " ") for t in texts]
        if self.pairs > KEEP_PAIRS:
            self.follow, self.pairs = {}, 0
        stay = self.words.crowded()
        if stay is not None:
            self.counts = self.counts[stay]
        # Lines, then words. Where spaces stand together or at a line's end the text is taken unit by unit.
        values = pa.array(texts, pa.large_string())
        lines = pc.split_pattern(values, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        line_ends, word_ends = lines.offsets.to_numpy(), words.offsets.to_numpy()
        flat = words.flatten()
        at, numbers, distinct = self.words.find(flat)
        chars = pc.utf8_length(flat).to_numpy().astype(np.int64)
        first = word_ends[:-1]  # the first word of each line
        bare = np.ones(len(first), bool)
        bare[line_ends[:-1]] = False  # the first line has the model's leading space
        new = np.flatnonzero(numbers < 0)
        if len(new):
            found = [distinct[i] for i in new]
            numbers[new] = self.words.add(found)
            self.counts = np.concatenate([self.counts, np.array([self.unit(" " + w)[-1] for w in found], np.int64)])
        tokens = self.counts[numbers][at]
        bare_first = first[bare]
        codes, where = np.unique(at[bare_first], return_inverse=True)
        tokens[bare_first] = np.array([self.unit(distinct[c])[-1] if distinct[c] else 0 for c in codes], np.int64)[where] if len(codes) else 0
        tokens[bare_first] += 1  # the line break before
        ends = np.cumsum(tokens)
        lone = np.diff(word_ends) == 1
        blank = chars == 0
        blank[first[lone & bare]] = False
        odd = np.add.reduceat(blank, word_ends[line_ends[:-1]]) > 0
        begin, stop = word_ends[line_ends[:-1]], word_ends[line_ends[1:]]
        before = np.where(begin > 0, ends[begin - 1], 0)
        totals[:] = ends[stop - 1] - before
        reach = np.cumsum(chars + 1)
        for i in np.flatnonzero(odd | (totals > limit)).tolist():
            if odd[i]:
                totals[i], fitting[i] = self._by_unit(texts[i], limit)
                continue
            # Counts rise from word to word but may fall inside one: the longest prefix that fits ends in the word that passes the limit.
            k = int(begin[i] + np.searchsorted(ends[begin[i]:stop[i]] - before[i], limit, side="right"))
            held = int(ends[k - 1] - before[i]) if k > begin[i] else 0
            place = int(reach[k - 1] - (reach[begin[i] - 1] if begin[i] else 0)) if k > begin[i] else 0
            word = distinct[at[k]]
            line = int(np.searchsorted(word_ends, k, side="right")) - 1
            head = "\n" if k == first[line] and bare[line] else " "
            counts = [1] + [1 + n for n in self.unit(word)] if head == "\n" and word else [1] if head == "\n" else self.unit(" " + word)
            inside = max((j for j, n in enumerate(counts, 1) if held + n <= limit), default=0)
            fitting[i] = max(0, place - 1 + inside)
        return totals, fitting

    def _by_unit(self, text: str, limit: int) -> tuple[int, int]:
        units = _UNITS.findall(" " + text) if text else []
        total = place = fits = 0
        for unit in units:
            counts = self.unit(unit)
            for j, n in enumerate(counts, 1):
                if total + n <= limit:
                    fits = place + j
            total += counts[-1]
            place += len(unit)
        return total, max(0, fits - 1)


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(documents: DataFrame, model: str) -> DataFrame:
    """``(doc_id, prefix_tokens)``: the exact count at every prefix, in code points from 0.

    Element ``i`` answers how many tokens the first ``i`` code points have. A null text is empty: one 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for batch, texts in pieces(batches):
            counts = [counter.prefixes(t) for t in texts]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "prefix_tokens"])

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id bigint, prefix_tokens array<bigint>")


def count_tokens(documents: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, fitting_chars)`` of every row.

    ``fitting_chars`` is the length of the longest prefix that has at most ``limit`` tokens. A null text is empty. Rows without
    ``doc_id`` and repeated rows stay; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for batch, texts in pieces(batches):
            tokens, fitting = counter.measure(texts, limit)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(tokens), pa.array(fitting)],
                ["doc_id", "n_bytes", "n_tokens", "fitting_chars"],
            )

    counted = documents.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, fitting_chars bigint")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fitting_chars")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and how much of it fits 4096."""
    return count_tokens(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
