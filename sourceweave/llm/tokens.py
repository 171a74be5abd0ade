"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch of words are held as one flat array of symbols with the sequence each belongs to. In every
step each sequence takes the lowest rank among its neighbouring pairs, and all places of that pair merge at once, in
all sequences; a sequence is done when none of its pairs has a rank. What is left is counted.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import slices, small_batches

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Characters of the chunks that a worker keeps, and of the longest of them: longer ones hardly come twice.
CACHE_CHARS, KEPT_CHARS = 4 << 20, 64
GROUP_CHARS = 4 << 20

#: White space of the vocabulary's patterns, which str.split() takes for granted, and what only str.split() adds.
_ONLY_SPLIT = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TokenCounter:
    """Counts the tokens of texts for a byte-level BPE vocabulary with word ends, in the library's json form."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary, merges = told["model"]["vocab"], told["model"]["merges"]
        self.special = [t["content"] for t in told["added_tokens"]]
        self.by_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        steps = told["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.suffix = told["model"]["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[symbols[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocabulary[symbols[b] + self.suffix] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = len(pairs)
        self.cache: dict[str, int] = {}
        self.held = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none), at

    def count_sequences(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of the pre-tokens, given as bytes, none of them empty."""
        lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        out = lengths.copy()
        if not len(sequences):
            return out
        flat = np.frombuffer(b"".join(sequences), dtype=np.uint8)
        symbol, owner = self.inner[flat], np.repeat(np.arange(len(sequences)), lengths)
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self.last[flat[ends]]
        while len(symbol) > 1:
            rank, at = self._rank(symbol[:-1], symbol[1:])
            rank[owner[:-1] != owner[1:]] = self.none
            rank = np.append(rank, self.none)
            at = np.append(at, 0)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            live = least < self.none
            if not live.any():
                break
            sizes = np.diff(np.append(starts, len(owner)))
            stay = np.repeat(live, sizes)
            merge = (rank == np.repeat(least, sizes)) & stay
            # in a run of places that overlap (a pair of equal symbols), every second one from the left
            place = np.flatnonzero(merge)
            run = np.append(True, np.diff(place) > 1)
            first = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - first) % 2 == 0]
            symbol[place] = self.made[at[place]]
            keep = stay.copy()
            keep[place + 1] = False
            np.subtract.at(out, owner[place], 1)
            symbol, owner = symbol[keep], owner[keep]
        return out

    def _normal(self, chunk: str) -> str:
        """Composed, and lower-cased character by character (no rule for a final sigma)."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return chunk.lower()

    def _learn(self, chunks: list[str]) -> dict[str, int]:
        """Counts of chunks; the short ones are kept, as many as CACHE_CHARS hold."""
        split = [self.pattern.findall(self._normal(c)) for c in chunks]
        words = sorted(set().union(*split)) if split else []
        counts = dict(zip(words, self.count_sequences([w.encode("utf-8", "replace") for w in words]).tolist()))
        found = dict(zip(chunks, (sum(map(counts.__getitem__, s)) for s in split)))
        if self.held > CACHE_CHARS:
            self.cache.clear()
            self.held = 0
        short = {c: n for c, n in found.items() if len(c) <= KEPT_CHARS}
        self.cache.update(short)
        self.held += sum(map(len, short))
        return found

    def _chunks(self, text: str) -> list[str]:
        return [c for c in _SPACE.split(text) if c] if _ONLY_SPLIT.search(text) else text.split()

    def count(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text; texts, long ones in stretches, are worked on in groups of bounded size."""
        out, group, owner, size = [], [], [], 0

        def settle() -> None:
            for at, n in zip(owner, self._group(group)):
                out[at] += n
            group.clear()
            owner.clear()

        for text in texts:
            out.append(0)
            for part in slices(text):
                group.append(part)
                owner.append(len(out) - 1)
                size += len(part)
                if size >= GROUP_CHARS:
                    settle()
                    size = 0
        settle()
        return out

    def _group(self, texts: list[str]) -> list[int]:
        split, specials = [], []
        for text in texts:
            parts = self.by_special.split(text) if any(s in text for s in self.special) else [text]
            specials.append(len(parts) - 1)
            split.append([c for p in parts for c in self._chunks(p)])
        missing = set().union(*split) if split else set()
        known = {c: self.cache[c] for c in missing if c in self.cache}
        known |= self._learn([c for c in missing if c not in known])
        return [n + sum(map(known.__getitem__, c)) for n, c in zip(specials, split)]


_COUNTERS: dict[str, TokenCounter] = {}


def token_counter(tokenizer: str) -> TokenCounter:
    """The counter of this process for a vocabulary: a worker keeps its cache from task to task."""
    if tokenizer not in _COUNTERS:
        import public_tokenizers

        _COUNTERS[tokenizer] = TokenCounter(tokenizer if os.sep in tokenizer else public_tokenizers.path(tokenizer))
    return _COUNTERS[tokenizer]


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``: whole texts, no special tokens added.

    Special strings inside a text are one token each, as the library's default has it. Null texts count as empty:
    no bytes, no tokens. Null identifiers stay null; rows that repeat are counted each by itself; a very long text is
    counted whole, a stretch at a time, which ends at white space (one without any is held whole); an empty table gives an empty result; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch in batches:
            n = counter.count(t.as_py() or "" for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
