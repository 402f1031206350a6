"""Encoding with public tokenizers, the same ids as the libraries give, with a bounded memory of words.

A tokenizer whose pre-tokenizer never joins characters across white space gives a text the ids of its words
one after another. For the one whose rules are known here (WORD_RULES), words met before are looked up by a 64-bit
hash. All other tokenizers encode each text as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from chronofeat.llm._common import _LOWER, hashes_at, utf8, words_in
# The normaliser and pre-tokenizer of that file, as its JSON states them.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
#: Words, and parts of words, that a worker remembers the ids of; beyond that, those met least recently are forgotten.
WORDS, PARTS = 800_000, 300_000
#: Characters that normalisation changes by case only; words with others are encoded by the library.
_PLAIN = re.compile("[!-~¡-į]+")
_PLAIN_WORDS = re.compile("[\n!-~¡-į]+")


def path_of(name: str) -> str:
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(8)
def version(name: str) -> str:
    """Digest of the tokenizer file."""
    with open(path_of(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Memory:
    """Ids of strings. A string has a number, and its ids lie in one array with all others'."""

    def __init__(self, kind: np.dtype, most: int) -> None:
        self.most, self.time, self.kind = most, 0, kind
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.length, self.met = np.empty(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def unknown(self, wanted: set[str]) -> list[str]:
        return list(wanted.difference(self.number))

    def add(self, strings: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        n = len(self.start)
        self.number.update(zip(strings, range(n, n + len(strings))))
        self._append(ids, length)

    def _append(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(length) - length]
        self.length = np.r_[self.length, length]
        self.met = np.r_[self.met, np.full(len(length), self.time)]
        self.ids = np.concatenate((self.ids, ids))

    def numbers(self, strings: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.number.__getitem__, strings), np.int64, len(strings))
        self.met[out] = self.time
        return out

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings, one after another, and how many each has."""
        length = self.length[numbers]
        at = np.repeat(self.start[numbers] - np.cumsum(length) + length, length)
        at += np.arange(len(at))
        return self.ids[at], length

    def tidy(self) -> None:
        """Forgets the half met least recently where there are too many."""
        self.time += 1
        if len(self.start) <= self.most:
            return
        kept = np.flatnonzero(self.met > np.partition(self.met, len(self.met) // 2)[len(self.met) // 2])
        new = np.full(len(self.met), -1)
        new[kept] = np.arange(len(kept))
        self._rename(new)
        self.ids, length = self.take(kept)
        self.start, self.length, self.met = np.cumsum(length) - length, length, self.met[kept]

    def _rename(self, new: np.ndarray) -> None:
        names = new.tolist()
        self.number = {s: names[i] for s, i in self.number.items() if names[i] >= 0}


class HashMemory(Memory):
    """Ids of strings that are known by their 64-bit hashes."""

    def _clear(self) -> None:
        super()._clear()
        self.key, self.of_key = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes, and their numbers

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of ascending hashes; -1: unknown."""
        if not len(self.key):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.key, hashes), len(self.key) - 1)
        out = np.where(self.key[at] == hashes, self.of_key[at], -1)
        self.met[out[out >= 0]] = self.time
        return out

    def add_hashes(self, hashes: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Adds ascending hashes that are unknown."""
        at, n = np.searchsorted(self.key, hashes), len(self.start)
        self.key, self.of_key = np.insert(self.key, at, hashes), np.insert(self.of_key, at, np.arange(n, n + len(hashes)))
        self._append(ids, length)

    def _rename(self, new: np.ndarray) -> None:
        numbers = new[self.of_key]
        self.key, self.of_key = self.key[numbers >= 0], numbers[numbers >= 0]


class Encoder:
    """Ids (of `kind`, width bytes each) of whole texts, without special tokens added."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words: HashMemory | None = None
        file = path_of(name)
        if file.endswith(".json"):
            from tokenizers import Tokenizer

            with open(file, encoding="utf-8") as f:
                spec = json.load(f)
            self.tok = Tokenizer.from_file(file)
            self.tok.no_truncation()
            self.tok.no_padding()
            size = self.tok.get_vocab_size()
            self.library = lambda texts: [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            if _joins_nothing(spec):
                end = spec["model"]["end_of_word_suffix"]
                self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1 + len(spec["added_tokens"]), bool)
                self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(end)]] = True
                self.special = [x["content"] for x in spec["added_tokens"]]
                kind = np.dtype("<u2" if size <= 65_536 else "<u4")
                self.words, self.parts = HashMemory(kind, WORDS), Memory(kind, PARTS)
                self.split = regex.compile(WORD_RULES["pattern"] + "|\n").findall
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=file)
            size = sp.get_piece_size()
            self.library = lambda texts: sp.encode(texts, num_threads=1)
        self.width = 2 if size <= 65_536 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")

    def _flat(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), self.kind, int(length.sum())), length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), one text after another, and how many each has."""
        if self.words is None:
            return self._flat(self.library([t or "" for t in texts.to_pylist()]))
        numbers, n = self._words(texts)
        ids, length = self.words.take(numbers)
        return ids, np.diff(np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(n)]])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        if self.words is None:
            return self._flat(self.library([t or "" for t in texts.to_pylist()]))[1]
        numbers, n = self._words(texts)
        return np.diff(np.r_[0, np.cumsum(self.words.length[numbers])][np.r_[0, np.cumsum(n)]])

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts, which are known then, and how many words each text has."""
        self.words.tidy()
        self.parts.tidy()
        raw, ends = utf8(texts)
        if b"<" not in raw.tobytes():  # else a special string might come about
            raw = _LOWER[raw]
        starts, lengths, n = words_in(raw, ends)
        hashes, first, of = np.unique(hashes_at(raw, starts, lengths), return_index=True, return_inverse=True)
        new = np.flatnonzero(self.words.known(hashes) < 0)
        if len(new):
            view = memoryview(np.ascontiguousarray(raw))
            at, stop = starts[first[new]], (starts + lengths)[first[new]]
            self._learn([str(view[a:b], "utf-8") for a, b in zip(at.tolist(), stop.tolist())], hashes[new])
        return self.words.known(hashes)[of], n

    def _learn(self, new: list[str], hashes: np.ndarray) -> None:
        """Encodes words: those without unusual signs by their parts, the others one by one."""
        joined = "\n".join(new)
        if not _PLAIN_WORDS.fullmatch(joined) or any(s in joined for s in self.special):
            plain = np.array([bool(_PLAIN.fullmatch(w)) and not any(s in w for s in self.special) for w in new])
            odd = np.flatnonzero(~plain)
            self.words.add_hashes(hashes[odd], *self._flat(self.library([new[i] for i in odd])))
            new, hashes = [new[i] for i in np.flatnonzero(plain)], hashes[plain]
            joined = "\n".join(new)
        if not new:
            return
        every = self.split(joined.lower())
        unknown = self.parts.unknown(set(every))
        if "\n" in unknown:  # between words
            unknown.remove("\n")
            self.parts.add(["\n"], np.zeros(0, self.kind), np.zeros(1, np.int64))
        for at in range(0, len(unknown), 20_000):
            some = unknown[at : at + 20_000]
            ids = np.array(self.library([" ".join(some)])[0], self.kind)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):  # a part's last token, and no other, ends a word
                self.parts.add(some, ids, np.diff(np.r_[0, cut]))
            else:
                self.parts.add(some, *self._flat(self.library(some)))
        numbers = self.parts.numbers(every)
        ids, length = self.parts.take(numbers)
        between = np.flatnonzero(numbers == self.parts.number["\n"]) if len(new) > 1 else np.zeros(0, np.int64)
        ends = np.r_[np.cumsum(length)[between], len(ids)]
        self.words.add_hashes(hashes, ids, np.diff(np.r_[0, ends]))


def _joins_nothing(spec: dict) -> bool:
    """Whether a tokenizer file has the rules known here: white space is a border for all that follows, and adds nothing."""
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return spec.get("normalizer") == WORD_RULES["normalizer"] and split[0].get("pattern") == {"Regex": WORD_RULES["pattern"]} and bool(spec["model"].get("end_of_word_suffix"))


@lru_cache(8)
def blanks_are_one(name: str) -> bool:
    """Whether a run of blanks, tabs and line ends is to a tokenizer what one blank is."""
    if not path_of(name).endswith(".json"):
        return False
    with open(path_of(name), encoding="utf-8") as f:
        return _joins_nothing(json.load(f))


@lru_cache(2)
def encoder(name: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(name)
