"""Language-model scoring by a Katz backoff bigram model.

P(w | h) = r*(c(h w)) / C(h)                       if h w was seen in training
         = alpha(h) P(w)                           if h was seen, but not before w
         = P(w)                                    if h was never seen
P(w)     = r*(c(w)) / N, or for any word not in training the mass that is left.

r* is the Good-Turing count of Katz for counts up to K; larger counts lose LARGE, so that some mass is left in
every context. alpha(h) is the mass that h leaves, over the unigram mass of the words not seen after h: the
probabilities of all V words and the unknown one sum to 1 in every context.

Tables, all partitioned by hash: unigram counts, written to the shared folder; and pair counts, of which each
partition holds whole pairs together with the documents they occur in, so pairs are counted and scored where
they lie. Pairs are dealt by their second word, so that its count is there, too; a word with over a
thousandth of all tokens is dealt by both words, and its count is known to all tasks (a thousand words at
most). Contexts and documents are then put together from each partition's sums.

The order is fixed at two: an order of three was not built, as its distinct triples alone would take the disk that
the query may use (see the README).

Results for unusual input: null or empty text: the end token alone; very long texts: whole; repeated rows: each is
returned (and learnt from); rows of one doc_id with different texts: each is scored; null doc_id: scored, never learnt from, held_out null;
no training row: score and base_score 0; an empty table gives an empty result; other columns of the input, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.llm._common import chunks, give_back, grouped_sum, mix, small_batches, store, word_hashes

K, LARGE = 5, 0.1
#: Tokens read before they are dealt out, tokens in a partition of pairs, and tokens of it that are counted in one step, about.
FLUSH, PART, STEP = 500_000, 4_000_000, 500_000
#: A word with more than this part of all tokens is dealt by both words.
HOT = 0.001

_U = np.uint64
START, END = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
_DOC = np.dtype([("uid", "<i8"), ("tokens", "<u4"), ("known", "<u4"), ("seen", "<u4", (K,)), ("base", "<f8"), ("rest", "<f8")])
_CONTEXT = np.dtype([("h", "<u8"), ("m", "<u4", (K,)), ("many", "<u4"), ("sum", "<f8"), ("p", "<f8")])
_UNSEEN = np.dtype([("h", "<u8"), ("uid", "<i8"), ("n", "<u4")])


def planes(x: np.ndarray) -> bytes:
    """An array's bytes, all first bytes before all second ones and so on: small and sorted numbers then compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: str | np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def good_turing(n: list[int] | np.ndarray) -> np.ndarray:
    """r* of the counts 0 to K, from n[r], the number of types with count r (r up to K + 1).

    Where the counts of counts give no valid discount (few data), half a count is taken off.
    """
    out = np.zeros(K + 1)
    cut = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        d = (star / r - cut) / (1 - cut) if cut < 1 else 0.0
        out[r] = d * r if 0 < d < 1 else r - 0.5
    return out


def discounted(c: np.ndarray, star: np.ndarray) -> np.ndarray:
    return np.where(c > K, c - LARGE, star[np.minimum(c, K).astype(np.int64)])


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, each followed by END, and the texts' lengths with it."""
    h, n = word_hashes(texts)
    out = np.empty(len(h) + len(texts), _U)
    is_end = np.zeros(len(out), bool)
    is_end[np.cumsum(n + 1) - 1] = True
    out[~is_end] = h
    out[is_end] = END
    return out, n + 1


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        w, c = grouped_sum(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "c"])

    for batch in chunks(batches):
        held.append(list(np.unique(tokens_of(batch.column(0))[0], return_counts=True)))
        if sum(len(x[0]) for x in held) > 1_500_000:
            yield flush()
    if held:
        yield flush()


def _parts_of(w1: np.ndarray, w2: np.ndarray, parts: int, hot: dict[int, int], total: int) -> np.ndarray:
    b = mix(w2 + _U(1))
    if hot:
        keys = np.sort(np.array(list(hot), _U))
        at = np.minimum(np.searchsorted(keys, w2), len(keys) - 1)
        is_hot = keys[at] == w2
        spread = np.array([max(1, int(4 * hot[int(k)] / (HOT * total))) for k in keys], _U)[at]
        b = np.where(is_hot, b + (mix(w1 + _U(2)) % spread) * _U(0x9E3779B97F4A7C15), b)
        b = np.where(is_hot, mix(b), b)
    return (((b >> _U(32)) * _U(parts)) >> _U(32)).astype(np.uint32)


def _deal(parts: int, shared):
    """Documents to blobs by part: distinct (second word, first word, document) with how often."""

    def cut(w: np.ndarray, n: np.ndarray, uid: np.ndarray, train: np.ndarray) -> Iterator[pa.RecordBatch]:
        hot, total = shared.value
        words, code = np.unique(np.r_[w, START], return_inverse=True)
        code = code.astype(np.int32)
        size = len(words)
        first = np.r_[code[-1], code[: len(w) - 1]]
        first[np.r_[0, np.cumsum(n)[:-1]]] = code[-1]
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        pair = code[: len(w)].astype(np.int64) * size + first
        del w, code, first
        order = np.argsort(pair, kind="stable")
        pair, doc = pair[order], doc[order]
        del order
        new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])
        times = np.diff(np.r_[new, len(pair)])
        pair, doc = pair[new], doc[new]
        second, first = (pair // size).astype(np.int32), (pair % size).astype(np.int32)
        del pair, new
        part = _parts_of(words[first], words[second], parts, hot, total)
        order = np.argsort(part, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
        out = []
        for a, b in zip(at, np.r_[at[1:], len(order)]):
            i = order[a:b]
            docs, d = np.unique(doc[i], return_inverse=True)
            ones, o = np.unique(first[i], return_inverse=True)
            twos, t = np.unique(second[i], return_counts=True)  # ascending in i
            small = lambda x, top: planes(x.astype("<u2" if top <= 65_536 else "<u4"))
            out.append((int(part[i[0]]), planes(uid[docs]), train[docs].tobytes(), planes(words[ones]), planes(words[twos]), planes(t.astype("<u4")), small(o, len(ones)), small(d, len(docs)), small(times[i], int(times[i].max()) + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] + [pa.binary()] * 8)], ["part", "uids", "train", "ones", "twos", "runs", "o", "d", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, 2_000_000):
            w, n = tokens_of(batch.column(2))
            held.append((w, n, batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.uint8)))
            size += len(w)
            if size >= FLUSH:
                yield from cut(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
        if held:
            yield from cut(*(np.concatenate(c) for c in zip(*held)))

    return run


def _blob(kind: int, key: np.ndarray, rows: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Rows by the part that their key belongs to, column by column."""
    part = (((mix(key.astype(_U)) >> _U(32)) * _U(parts)) >> _U(32)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0]) if len(order) else []
    out = []
    for a, b in zip(at, [*at[1:], len(order)]):
        r = rows[order[a:b]]
        out.append((int(part[order[a]]), kind, b"".join(planes(r[c]) for c in rows.dtype.names)))
    return out


def _rows(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    out = np.empty(sum(len(b) for b in blobs) // kind.itemsize, kind)
    at = 0
    for b in blobs:
        n, pos = len(b) // kind.itemsize, 0
        for c in kind.names:
            field, shape = kind[c].base, kind[c].shape
            size = n * kind[c].itemsize
            out[c][at : at + n] = from_planes(b[pos : pos + size], field).reshape(n, *shape)
            pos += size
        at += n
    return out


def _count(parts: int, shared):
    """Counts the pairs of a part and scores them as far as the part knows.

    A part is counted in steps of about STEP tokens, by second words, so that it can be large: the more parts there are,
    the more often a document's sums are handed on.
    """

    def run(t: pa.Table) -> pa.Table:
        hot, total, star, unknown = shared.value
        hottest = np.array(list(hot), _U)
        read = lambda x, top: from_planes(x, "<u2" if top <= 65_536 else "<u4")
        uids = [from_planes(x.as_py(), np.int64) for x in t["uids"]]
        train = [np.frombuffer(x.as_py(), np.uint8) for x in t["train"]]
        bases = np.cumsum([0, *map(len, uids)])
        docs, tokens = int(bases[-1]), sum(int(from_planes(x.as_py(), "<u4").sum()) for x in t["runs"])
        uids, train = np.concatenate(uids), np.concatenate(train)
        rows = np.zeros(docs, _DOC)
        rows["uid"] = uids
        contexts, unseen, of_count = [], [], np.zeros(K + 2, np.int64)
        steps = max(1, -(-tokens // STEP))
        for step in range(steps):
            w1, w2, doc, times = [], [], [], []
            # blobs are read again in each step, and none is kept
            for *row, base, n_docs in zip(*(t[c] for c in ("ones", "twos", "runs", "o", "d", "times")), bases, np.diff(bases)):
                ones, twos, runs, o, d, m = (x.as_py() for x in row)
                ones, twos, runs = from_planes(ones, _U), from_planes(twos, _U), from_planes(runs, "<u4")
                o, d, m = read(o, len(ones)), read(d, n_docs), from_planes(m, "<u2" if len(m) == 2 * int(runs.sum()) else "<u4")
                mine = mix(twos + _U(3)) % _U(steps) == _U(step)
                at = np.repeat(mine, runs)
                w1.append(ones[o[at]])
                w2.append(np.repeat(twos[mine], runs[mine]))
                doc.append(d[at].astype(np.uint32) + np.uint32(base))
                times.append(m[at].astype(np.uint32))
            w1, w2 = np.concatenate(w1), np.concatenate(w2)
            doc, times = np.concatenate(doc), np.concatenate(times)
            if not len(w1):
                continue
            key = mix(w1 * _U(0x9E3779B97F4A7C15) + w2)
            order = np.argsort(key)
            key = key[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            del key
            doc, times = doc[order], times[order]
            w1, w2 = w1[order[new]], w2[order[new]]
            size = np.diff(np.r_[new, len(order)])
            del order
            c = np.add.reduceat((times * train[doc]).astype(np.int64), new)  # of each pair, in training
            twos, code = np.unique(w2, return_inverse=True)
            c2 = np.bincount(code, c, len(twos)).astype(np.int64)
            for i in np.flatnonzero(np.isin(twos, hottest)) if hot else ():
                c2[i] = hot[int(twos[i])]
            p1 = np.where(c2 > 0, discounted(c2, star) / max(total, 1), unknown)[code]
            c2 = c2[code]
            seen = c > 0
            rest = np.where(seen, np.where(c > K, np.log10(np.maximum(c, K + 1) - LARGE), 0.0), np.log10(p1))
            rest -= np.where((c2 > 0) & (w2 != END), np.log10(np.maximum(c2, 1)), 0.0)  # the word as the next one's context
            of = np.repeat(np.arange(len(new)), size)
            times = times.astype(np.float64)
            total_by = lambda value: np.bincount(doc, times * value[of], docs)  # noqa: E731, B023
            rows["tokens"] += np.bincount(doc, times, docs).astype(np.uint32)
            rows["known"] += total_by((c2 > 0).astype(np.float64)).astype(np.uint32)
            rows["base"] += total_by(np.log10(c2 + 1.0))
            rows["rest"] += total_by(rest)
            for r in range(K):
                rows["seen"][:, r] += total_by((c == r + 1).astype(np.float64)).astype(np.uint32)
            ones, code = np.unique(w1[seen], return_inverse=True)
            cs, some = c[seen], np.zeros(len(ones), _CONTEXT)
            some["h"], some["p"] = ones, np.bincount(code, p1[seen], len(ones))
            for r in range(K):
                some["m"][:, r] = np.bincount(code[cs == r + 1], minlength=len(ones))
            some["many"], some["sum"] = np.bincount(code[cs > K], minlength=len(ones)), np.bincount(code, np.where(cs > K, cs, 0), len(ones))
            contexts.append(some)
            gone = np.flatnonzero(~seen[of])
            pair = np.stack([w1[of[gone]], uids[doc[gone]].view(_U)], 1)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            pair, many = pair[order], times[gone][order]
            at = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]).any(1)]) if len(pair) else np.zeros(0, np.int64)
            some = np.zeros(len(at), _UNSEEN)
            if len(at):
                some["h"], some["uid"], some["n"] = pair[at, 0], pair[at, 1].view(np.int64), np.add.reduceat(many, at)
            unseen.append(some)
            of_count += np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2]
        out = _blob(0, rows["uid"], rows, parts) + _blob(1, (every := _merged(np.concatenate(contexts)))["h"], every, parts)
        out += _blob(2, (every := np.concatenate(unseen))["h"], every, parts)
        out += [(p, 3, of_count.tobytes()) for p in range(parts)]  # every part gets the counts of counts of all
        give_back()
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], ["part", "kind", "rows"])

    return run


def _merged(rows: np.ndarray) -> np.ndarray:
    """Contexts, each once, with their sums."""
    rows = rows[np.argsort(rows["h"], kind="stable")]
    at = np.flatnonzero(np.r_[True, rows["h"][1:] != rows["h"][:-1]]) if len(rows) else np.zeros(0, np.int64)
    out = rows[at].copy()
    for c in _CONTEXT.names[1:] if len(at) else ():
        out[c] = np.add.reduceat(rows[c], at, axis=0)
    return out


def _combine(starts: int):
    """Contexts of a part: their backoff weights, applied to the unseen pairs; and the documents of the part."""

    def run(t: pa.Table) -> pa.Table:
        kinds, blobs = t["kind"].to_pylist(), t["rows"].to_pylist()
        take = lambda k: [b for x, b in zip(kinds, blobs) if x == k]
        star = good_turing(sum(np.frombuffer(b, np.int64) for b in take(3)))
        docs, contexts, unseen = _rows(take(0), _DOC), _rows(take(1), _CONTEXT), _rows(take(2), _UNSEEN)
        out = []
        uid, code = np.unique(docs["uid"], return_inverse=True)
        if len(uid):
            add = lambda v: np.bincount(code, v, len(uid))
            # an unseen count has no logarithm, but then nothing has it
            value = docs["rest"] + docs["seen"] @ np.log10(star[1:])
            out.append((uid, add(docs["tokens"]), add(docs["known"]), add(docs["base"]), add(value)))
        if len(unseen):
            h, code = np.unique(contexts["h"], return_inverse=True)
            add = lambda v: np.bincount(code, v, len(h))
            m = np.stack([add(contexts["m"][:, r]) for r in range(K)], 1) if len(h) else np.zeros((0, K))
            many, total, p = add(contexts["many"]), add(contexts["sum"]) + m @ np.arange(1, K + 1), add(contexts["p"])
            left = (m * (np.arange(1, K + 1) - star[1:])).sum(1) + LARGE * many  # the mass the context leaves, times its total
            weight = np.log10(left) - np.log10(1 - p)  # log alpha + log C(h): the latter was taken off for all tokens
            at = np.minimum(np.searchsorted(h, unseen["h"]), max(0, len(h) - 1))
            known = h[at] == unseen["h"] if len(h) else np.zeros(len(unseen), bool)
            value = np.where(known, weight[at] if len(h) else 0.0, 0.0) * unseen["n"]
            uid, code = np.unique(unseen["uid"], return_inverse=True)
            zero = np.zeros(len(uid))
            out.append((uid, zero, zero, zero, np.bincount(code, value, len(uid))))
        if not out:
            return pa.table({c: pa.array([], k) for c, k in (("uid", pa.int64()), ("tokens", pa.float64()), ("known", pa.float64()), ("base", pa.float64()), ("score", pa.float64()))})
        return pa.table([np.concatenate(c) for c in zip(*out)], ["uid", "tokens", "known", "base", "score"])

    return run


def katz_scores(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds) == held_out
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text")).withColumn("held_out", out)
    learnt = ~F.coalesce("held_out", F.lit(True))
    unigrams = store(rows.where(learnt).select("text").mapInArrow(_unigrams, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "unigrams")
    class_ = F.least("c", F.lit(K + 2))
    of_count = {r.k: r.n for r in unigrams.groupBy(class_.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, types, large = unigrams.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("c") > K, F.col("c") - LARGE))).first()
    total = total or 0
    star = good_turing(np.array([of_count.get(r, 0) for r in range(K + 2)]))
    mass = sum(of_count.get(r, 0) * star[r] for r in range(1, K + 1)) + (large or 0.0)
    unknown = 1 - mass / total if total else 1.0
    starts = (unigrams.where(F.col("w") == int(END.view(np.int64))).agg(F.sum("c")).first()[0] or 0) if total else 0
    hot = {r.w % 2**64: r.c for r in unigrams.where(F.col("c") > HOT * total).collect()} if total else {}  # under 1/HOT words
    every = rows.select("uid", F.when(learnt, 1).otherwise(0).cast("tinyint").alias("train"), "text")
    # held-out rows have about a share of 1 / folds of the tokens
    parts = max(2 * spark.sparkContext.defaultParallelism, int(total * folds / max(1, folds - 1)) // PART)
    blobs = every.mapInArrow(_deal(parts, spark.sparkContext.broadcast((hot, total))), "part long, uids binary, train binary, ones binary, twos binary, runs binary, o binary, d binary, times binary")
    counted = blobs.groupBy("part").applyInArrow(_count(parts, spark.sparkContext.broadcast((hot, total, star, unknown))), "part long, kind int, rows binary")
    sums = counted.groupBy("part").applyInArrow(_combine(starts), "uid long, tokens double, known double, base double, score double")
    sums = sums.groupBy("uid").agg(*(F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")))
    # rows that are equal in id and text were added up
    copies = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"))
    each = store(sums.join(copies, "uid").select("uid", *((F.col(c) / F.col("copies")).alias(c) for c in ("tokens", "known", "base", "score"))), "sums")
    size, first = float(np.log10(total + types + 1)), float(np.log10(starts)) if starts else 0.0
    return rows.select("uid", "doc_id", "held_out").join(each, "uid").select(
        "doc_id",
        "held_out",
        F.round("tokens").cast("long").alias("n_tokens"),
        F.round("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.round("tokens") * size).alias("base_score"),
        (F.col("score") - first).alias("score"),
    )
