"""Packing of token sequences by lexical retrieval.

Documents are encoded, given an end token and dealt out by range of (similarity key, doc_id), so that texts
which share much lie in the same shard and no key is too large for one. Each shard has a BM25 inverted index
of token ids. A window's first document is its seed: the index scores all unused documents of the shard by all
of the seed's terms, and those that share one fill the window, best first; other shards are not searched. A document that does not fit is cut, and its rest is the next window's
seed. Windows follow each other without gaps; what is left at the end of a partition goes to windows of
powers of two, so no position is padded.

Results for unusual input: null or empty text: the end token alone; very long texts: as many windows as they
need; repeated rows: packed like others; null doc_id: packed; equal scores: the document first in the shard; an empty
table gives an empty result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.llm._common import chunks, documents, give_back, mix, store
from chronofeat.llm.tokenization import encoder

WINDOW, END = 4096, 2
#: Tokens in a shard, about; and in a partition.
SHARD, PARTITION = 1_500_000, 6_000_000
K1, B = 1.2, 0.75

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def similarity_keys(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The smallest hash of each text's runs of three ids; ids of texts of n ids (one at least) one after another."""
    x = ids.astype(np.uint64)
    h = x.copy()
    for j in (1, 2):
        h[: len(h) - j] = h[: len(h) - j] * np.uint64(0x9E3779B97F4A7C15) + x[j:]
    h = mix(h)
    ends = np.cumsum(n)
    for j in (1, 2):  # runs that reach beyond the text, unless it has no other
        at = ends - j
        h[at[n > j]] = np.uint64(2**64 - 1)
    return np.minimum.reduceat(h, ends - n).view(np.int64)


def encode_documents(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, key, n_tokens and ids (with the end token) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in chunks(batches):
            ids, n = enc.encode(batch.column(1))
            ids, n = np.insert(ids, np.cumsum(n), enc.kind.type(end)), n + 1
            at = (np.r_[0, np.cumsum(n)] * enc.width).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(similarity_keys(ids, n)), pa.array(n), raw], ["doc_id", "key", "n_tokens", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, key long, n_tokens long, ids binary")


class Index:
    """BM25 of the documents of a shard; terms are token ids.

    Postings lie by document: a seed's terms are marked, and each document adds up its gains of marked terms. Documents
    that are used leave once they are a third of those in the index.
    """

    def __init__(self, docs: list[np.ndarray]) -> None:
        n = len(docs)
        size = np.array([len(d) for d in docs])
        terms = max(int(d.max()) for d in docs) + 1
        kind = np.int32 if n * terms < 2**31 else np.int64
        key = np.repeat(np.arange(n, dtype=kind) * kind(terms), size)
        key += np.concatenate(docs).astype(kind)
        key, tf = np.unique(key, return_counts=True)
        owner, self.term = key // terms, key % terms
        df = np.bincount(self.term, minlength=terms)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.gain = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / size.mean())) * idf[self.term]).astype(np.float32)
        cuts = np.searchsorted(owner, np.arange(n + 1))
        self.of_doc = [self.term[a:b] for a, b in zip(cuts, cuts[1:])]  # a seed's terms, also after it left
        self.docs, self.starts = np.arange(n), cuts[:-1]
        self.marked = np.zeros(terms, np.float32)

    def _leave(self, unused: np.ndarray) -> None:
        keep = unused[self.docs]
        if 3 * np.count_nonzero(keep) >= 2 * len(self.docs):
            return
        length = np.diff(np.r_[self.starts, len(self.term)])
        postings = np.repeat(keep, length)
        self.term, self.gain = self.term[postings], self.gain[postings]
        self.docs, length = self.docs[keep], length[keep]
        self.starts = np.cumsum(length) - length

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share terms with a document, best first."""
        self._leave(unused)
        if not len(self.docs):
            return self.docs
        self.marked[self.of_doc[seed]] = 1
        score = np.add.reduceat(self.gain * self.marked[self.term], self.starts) * unused[self.docs]
        self.marked[self.of_doc[seed]] = 0
        at = np.flatnonzero(score > 0)
        return self.docs[at[np.lexsort((at, -score[at]))]]


def retrieval_order(docs: list[np.ndarray], fill: int, window: int = WINDOW) -> tuple[list[int], int]:
    """The order in which a shard's documents are laid out, from a window that holds `fill` tokens already; and its new fill."""
    index, unused, order, queue, seed, at = Index(docs), np.ones(len(docs), bool), [], iter(()), None, 0
    while True:
        if seed is not None:
            queue = iter(index.neighbours(seed, unused).tolist())
            seed = None
        nxt = next((d for d in queue if unused[d]), None)
        if nxt is None:
            while at < len(docs) and not unused[at]:
                at += 1
            if at == len(docs):
                return order, fill
            nxt, queue = at, iter(())
            seed = nxt
        unused[nxt] = False
        order.append(int(nxt))
        if fill + len(docs[nxt]) > window:
            seed = nxt  # its rest opens the next window
        fill = (fill + len(docs[nxt])) % window
        if not fill:
            queue, seed = iter(()), None


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row for each piece of a document: where it starts, its ids' checksum, and its place in a sequence."""
    spark = docs.sparkSession
    tokens = store(encode_documents(docs, tokenizer, end), "tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    dealt = tokens.repartitionByRange(max(2 * spark.sparkContext.defaultParallelism, total // PARTITION), "key", "doc_id").sortWithinPartitions("key", "doc_id", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # workers live on: what the first step remembered is of no use here or later
        give_back()
        base, position, held = TaskContext.get().partitionId() << 36, 0, []  # held: pieces of the open window

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], SCHEMA.replace(" long", "").split(", "))

        def place(ids: list[int | None], texts: list[np.ndarray]) -> list[tuple]:
            nonlocal position, held
            order, _ = retrieval_order(texts, position % window, window)
            give_back()
            done = []
            for d in order:
                x, start = texts[d], 0
                while start < len(x):
                    take = min(len(x) - start, window - position % window)
                    held.append((ids[d], start, x[start : start + take], len(x)))
                    start, position = start + take, position + take
                    if position % window == 0:
                        done += finish(position // window - 1)
            return done

        def finish(number: int) -> list[tuple]:
            nonlocal held
            out, offset = [], 0
            for doc, start, x, n in held:
                out.append((doc, start, len(x), zlib.crc32(x.astype("<u4").tobytes()), n, base + number, offset))
                offset += len(x)
            held = []
            return out

        ids, texts, size = [], [], 0
        for b in chunks(batches, text="ids"):
            for doc, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(doc)
                texts.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"))
                size += len(texts[-1])
                if size >= SHARD:
                    if rows := place(ids, texts):
                        yield batch(rows)
                    ids, texts, size = [], [], 0
        rows = place(ids, texts) if texts else []
        # the rest: windows of powers of two, longest first
        left, number = sum(len(h[2]) for h in held), position // window
        pieces, held = held, []
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc, start, x, n = pieces.pop(0)
                take = min(room, len(x))
                held.append((doc, start, x[:take], n))
                if take < len(x):
                    pieces.insert(0, (doc, start + take, x[take:], n))
                room -= take
            rows += finish(number)
            number += 1
        if rows:
            yield batch(rows)

    return dealt.select("doc_id", "n_tokens", "ids").mapInArrow(run, SCHEMA)
