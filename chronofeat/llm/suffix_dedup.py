"""Removal of repeated byte strings by longest-previous-factor arrays.

A string of WIDTH bytes that starts at two places contains, at both, the same smallest GRAM-byte gram
(by hash, leftmost of equals). So every start of a WIDTH-byte string belongs to one anchor gram, and equal
strings have equal anchors at equal offsets. The starts that share an anchor form a run; the bytes from its
first start to the end of its last string are its span. Spans are grouped by anchor:

* Spans equal as a whole form a class. All strings of a class with two members are repeated.
* Where an anchor has several classes, one span of each is laid out, earliest first, in a text with its
  neighbours' and the longest-previous-factor array is computed: suffix order by prefix doubling, then
  for each suffix the nearest ones before and after it in suffix order that start earlier in the text
  (previous and next smaller position); the longer common prefix is the factor, and its place an earlier
  match. A factor of WIDTH bytes marks the start as a later copy and its match as an earlier one.
* An anchor with more than HOT classes is not laid out, as one task would hold them all: its strings are counted by
  anchor and 64-bit hash, over all tasks. This is exact, too, but no longest-previous-factor array.

Spans and strings are told apart by two 64-bit hashes, of the anchor and of the content: among the k different ones
that share an anchor the chance of a mistake is k * k / 2**65.

Either every repeated byte goes, or (keep_first) the earliest place, by (doc_id, offset), is kept.

The same is done with words (between white space) in place of bytes where a number of words is asked for: the
symbols are then the words' 64-bit hashes, and the symbols' intervals are turned into bytes at the end.

Results for unusual input: null or empty text: nothing to remove; texts under WIDTH bytes: kept whole; a text
that repeats itself: as for two texts; very long texts: whole, read in overlapping pieces; repeated rows: copies of each
other; rows of one doc_id with different texts: as other rows; null doc_id: comes before
all others; ties: (doc_id, a hash of the row, offset) decides which copy is first; an empty table gives an empty
result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.llm._common import chunks, give_back, hashes_at, out_schema, release, store, with_row, words_in

WIDTH, GRAM = 400, 128
#: Words in an anchor gram where strings of words are looked for (less for short strings).
WORD_GRAM = 16
HOT = 4000
#: Bytes of spans in one suffix array, about.
BUCKET = 400_000
#: A longer text is read in overlapping pieces of so many bytes.
PIECE = 4_000_000

_U = np.uint64
_BYTE = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)


def symbols(text: str | None, words: bool) -> np.ndarray:
    """A text's bytes, or the hashes of its words."""
    b = text.encode("utf-8", "surrogatepass") if text else b""
    raw = np.frombuffer(b, np.uint8)
    return hashes_at(raw, *words_in(raw, np.array([0, len(raw)]))[:2]) if words else raw


def window_hashes(a: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of `width` symbols, by doubling."""

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = x * _U(0x9E3779B97F4A7C15)
        z += y
        z ^= z >> _U(29)
        z *= _U(0xBF58476D1CE4E5B9)
        return z

    h, have = _BYTE[a] if a.dtype == np.uint8 else a, 1
    while have * 2 <= width:
        h, have = joined(h[:-have], h[have:]), have * 2
    if have < width:
        shift = width - have
        h = joined(h[:-shift], h[shift:])
    return h


def runs_of(raw: np.ndarray, piece_ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For texts one after another: anchor hash, anchor place, first and last start of each run."""
    empty = tuple(np.zeros(0, t) for t in (_U, np.int64, np.int64, np.int64))
    if len(raw) < width:
        return empty
    h = window_hashes(raw, gram)
    bits = _U(24)
    m = ((h >> bits) << bits) | np.arange(len(h), dtype=_U)
    over, have = width - gram + 1, 1
    while have * 2 <= over:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    if have < over:
        m = np.minimum(m[: len(m) - (over - have)], m[over - have :])
    piece = np.repeat(np.arange(len(piece_ends)), np.diff(np.r_[0, piece_ends]))[: len(m)]
    start = np.flatnonzero(np.arange(len(m)) + width <= piece_ends[piece])
    if not len(start):
        return empty
    place, piece = (m[start] & _U(2**24 - 1)).astype(np.int64), piece[start]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])])
    last = np.r_[new[1:], len(start)] - 1
    return h[place[new]], place[new], start[new], start[last]


def _anchors(width: int, words: bool = False):
    gram = min(WORD_GRAM, width) if words else GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1_000_000):
            pieces = []  # (row, offset in the text, symbols)
            for i, t in enumerate(batch.column(2)):
                b = symbols(t.as_py(), words)
                if len(b) >= width:
                    pieces += [(i, at, b[at : at + PIECE + width - 1]) for at in range(0, max(1, len(b) - width + 1), PIECE)]
            while pieces:
                some, size = [], 0
                while pieces and (not some or size + len(pieces[0][2]) <= 2 * PIECE):
                    some.append(pieces.pop(0))
                    size += len(some[-1][2])
                data = np.concatenate([p[2] for p in some])
                ends = np.cumsum([len(p[2]) for p in some])
                h, place, first, last = runs_of(data, ends, width, gram)
                if not len(h):
                    continue
                digest = [xxhash.xxh3_64_intdigest(memoryview(data[a : b + width]).cast("B"), o) for a, b, o in zip(first.tolist(), last.tolist(), (place - first).tolist())]
                of = np.searchsorted(ends, first, "right")
                row = np.array([p[0] for p in some])[of]
                shift = np.array([p[1] for p in some])[of] - np.r_[0, ends[:-1]][of]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.array(digest, _U).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(first + shift), pa.array(last + shift)],
                    ["h", "dig", "uid", "doc_id", "i0", "i1"],
                )

    return run


def suffix_ranks(text: np.ndarray, cap: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix order by the first `cap` symbols or more, and the ranks by 1, 2, 4 ... symbols on the way."""
    n = len(text)
    rank, levels, have = np.unique(text, return_inverse=True)[1].astype(np.int64), [], 1
    while True:
        levels.append((have, rank.astype(np.int32)))
        if have >= cap:
            return np.argsort(rank, kind="stable"), levels
        key = rank * (n + 1)
        if have < n:
            key[: n - have] += rank[have:] + 1
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]])
        rank, have = new, have * 2


def smaller_before(position: np.ndarray) -> np.ndarray:
    """For each slot the nearest slot before it that holds a smaller position, or -1."""
    p = np.r_[np.int64(-(2**62)), position]
    at = np.arange(len(p)) - 1
    at[0] = 0
    todo = np.arange(1, len(p))
    while len(todo):
        todo = todo[p[at[todo]] > p[todo]]
        at[todo] = at[at[todo]]
    return at[1:] - 1


def longest_previous_factor(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length (up to cap) of the longest factor that also starts earlier, and where; -1: nowhere."""
    n = len(text)
    order, levels = suffix_ranks(text, cap)
    before = smaller_before(order)
    after = n - 1 - smaller_before(order[::-1])[::-1]  # n: none

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        length = np.zeros(len(i), np.int64)
        for have, rank in reversed(levels):
            a, b = i + length, j + length
            ok = (a < n) & (b < n)
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            # a rank by `have` symbols may count the text's end as a symbol
            ok &= np.maximum(a, b) + have <= n
            length[ok] += have
        return np.minimum(length, cap)

    best, where = np.zeros(n, np.int64), np.full(n, -1)
    for near in (before, after):
        has = np.flatnonzero((near >= 0) & (near < n))
        i, j = order[has], order[near[has]]
        c = common(i, j)
        better = c > best[i]
        best[i[better]], where[i[better]] = c[better], j[better]
    return best, where


def _intervals(starts: np.ndarray) -> bytes:
    """Ascending starts as runs [first, last]."""
    if not len(starts):
        return b""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([np.r_[starts[0], starts[cut + 1]], np.r_[starts[cut], starts[-1]]], 1).astype("<i4").tobytes()


def _factors(width: int, words: bool = False):
    """Starts, within each span of a bucket, of strings that occur earlier, and of those that occur elsewhere at all."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in ("h", "doc_id", "uid", "i0", "dig", "content"))), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3]))
        out, at = [], 0
        while at < len(rows):  # anchors are independent: they share an array only to save calls
            stop, size = at, 0
            while stop < len(rows) and (size < BUCKET or rows[stop][0] == rows[stop - 1][0]):
                size += len(rows[stop][5])
                stop += 1
            some = rows[at:stop]
            contents = [np.frombuffer(r[5], np.uint64 if words else np.uint8) for r in some]
            length = np.array([len(c) for c in contents])
            ends = 256
            if words:
                known, number = np.unique(np.concatenate(contents), return_inverse=True)
                contents, ends = np.split(number, np.cumsum(length)[:-1]), len(known)
            first = np.r_[0, np.cumsum(length + 1)[:-1]]
            text = np.empty(int((length + 1).sum()), np.int64)
            for i, (c, f) in enumerate(zip(contents, first)):
                text[f : f + len(c)] = c
                text[f + len(c)] = ends + i  # ends match nothing
            lpf, where = longest_previous_factor(text, width)
            later = lpf >= width
            either = later.copy()
            either[where[later]] = True
            for r, f, n in zip(some, first, length):
                starts = slice(f, f + n - width + 1)
                out.append((r[0], r[4], _intervals(np.flatnonzero(later[starts])), _intervals(np.flatnonzero(either[starts]))))
            at = stop
        give_back()
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["h", "dig", "later", "either"])

    return run


def repeated_spans(rows: DataFrame, width: int = WIDTH, keep_first: bool = False, words: bool = False) -> DataFrame | None:
    """(uid, spans) of rows (uid, doc_id, text): the intervals of bytes (or words) to remove, as pairs of 32-bit integers; None if there are none."""
    spark = rows.sparkSession
    anchors = store(rows.select("uid", "doc_id", "text").mapInArrow(_anchors(width, words), "h long, dig long, uid long, doc_id long, i0 long, i1 long"), "anchors")
    shared = store(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "shared")
    found = store(anchors.join(shared, "h"), "found")
    release(anchors)
    classes = store(found.groupBy("h", "dig").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "uid", "i0", "i1")).alias("r")).select("h", "dig", "c", F.col("r.doc_id").alias("doc_id"), F.col("r.uid").alias("uid"), F.col("r.i0").alias("i0"), F.col("r.i1").alias("i1")), "classes")
    several = store(classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "several")
    tested = store(classes.join(several, "h"), "tested")
    size = tested.agg(F.sum(F.col("i1") - F.col("i0") + width)).first()[0]
    verdict = classes.where("c > 1").select("h", "dig", "c", "doc_id", "uid", "i0").withColumn("later", F.lit(None).cast("binary")).withColumn("either", F.lit(None).cast("binary"))
    if size:
        buckets = max(2 * spark.sparkContext.defaultParallelism, size // BUCKET)
        wanted = store(tested.groupBy("uid").agg(F.collect_list(F.struct("h", "dig", "doc_id", "i0", "i1", (F.col("k") > HOT).alias("hot"))).alias("spans")), "wanted")
        texts = rows.select("uid", "text").join(wanted, "uid")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                out = []
                for uid, text, spans in zip(*(c for c in batch.columns)):
                    b = symbols(text.as_py(), words)
                    for s in spans.as_py():
                        part = b[s["i0"] : s["i1"] + width]
                        if s["hot"]:
                            for i, w in enumerate(window_hashes(part, width).view(np.int64).tolist()):
                                out.append((s["h"], s["dig"], s["doc_id"], uid.as_py(), s["i0"] + i, None, w, s["i0"]))
                        else:
                            out.append((s["h"], s["dig"], s["doc_id"], uid.as_py(), s["i0"], part.tobytes(), None, s["i0"]))
                    if len(out) > 20_000:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["h", "dig", "doc_id", "uid", "i0", "content", "w", "base"])

        parts = texts.select("uid", "text", "spans").mapInArrow(cut, "h long, dig long, doc_id long, uid long, i0 long, content binary, w long, base long")
        any_hot = bool(tested.where(F.col("k") > HOT).take(1))
        if any_hot:
            parts = store(parts, "parts")
        # rows that are equal in all columns give one text twice
        laid = parts.where("content is not null").select("h", "dig", "doc_id", "uid", "i0", "content")
        marks = laid.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInArrow(_factors(width, words), "h long, dig long, later binary, either binary")
        if any_hot:
            windows = parts.where("w is not null")
            least = windows.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "uid", "i0")).alias("first")).where("n > 1")
            hit = windows.join(least, ["h", "w"]).select("h", "dig", (F.col("i0") - F.col("base")).cast("int").alias("at"), (F.struct("doc_id", "uid", "i0") > F.col("first")).alias("is_later"))

            def as_intervals(t: pa.Table) -> pa.Table:
                at, late = t["at"].to_numpy(), t["is_later"].to_numpy(zero_copy_only=False).astype(bool)
                row = (t["h"][0].as_py(), t["dig"][0].as_py(), _intervals(np.unique(at[late])), _intervals(np.unique(at)))
                return pa.table([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["h", "dig", "later", "either"])

            marks = marks.union(hit.groupBy("h", "dig").applyInArrow(as_intervals, "h long, dig long, later binary, either binary"))
        marks = store(marks.groupBy("h", "dig").agg(F.max("later").alias("later"), F.max("either").alias("either")).where("length(either) > 0"), "marks")
        verdict = classes.select("h", "dig", "c", "doc_id", "uid", "i0").join(marks, ["h", "dig"], "left").where("c > 1 or either is not null")
    verdict = store(verdict.select("h", "dig", "c", F.col("doc_id").alias("d0"), F.col("uid").alias("u0"), F.col("i0").alias("s0"), "later", "either"), "verdict")
    if not verdict.take(1):
        return None
    hit = found.join(verdict, ["h", "dig"])
    if keep_first:
        first = F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("uid") == F.col("u0")) & (F.col("i0") == F.col("s0"))
        hit = hit.withColumn("runs", F.when(first, F.coalesce("later", F.lit(b"")))).where("runs is null or length(runs) > 0")
    else:
        hit = hit.withColumn("runs", F.when(F.col("c") == 1, F.col("either")))
    spans = store(hit.groupBy("uid").agg(F.collect_list(F.struct("i0", "i1", "runs")).alias("spans")), "spans")
    release(found, shared, classes, several, tested, verdict)
    return spans


def _marked(spans: list[dict] | None, width: int) -> list[tuple[int, int]]:
    """The intervals of symbols that spans mark."""
    every = []
    for s in spans or ():
        if s["runs"] is None:
            every.append((s["i0"], s["i1"] + width))
        else:
            every += [(s["i0"] + a, s["i0"] + z + width) for a, z in np.frombuffer(s["runs"], "<i4").reshape(-1, 2).tolist()]
    return every


#: Bytes of a word at a cut's end up to which the word stays whole.
WORD = 40
_HEAD, _TAIL = re.compile(rb"\S{0,%d}" % (WORD + 1)), re.compile(rb"\S*\Z")


def _whole_words(b: bytes, a: int, z: int) -> tuple[int, int]:
    """The interval without the words that it would cut in two; longer ones, as in scripts without blanks, are cut."""
    if a and not b[a - 1 : a].isspace() and (n := len(_HEAD.match(b, a)[0])) <= WORD:
        a += n
    if z < len(b) and not b[z : z + 1].isspace() and (n := len(_TAIL.search(b, max(a, z - WORD - 1), z)[0])) <= WORD:
        z -= n
    return a, z


def _removed(text: str | None, spans: list[dict] | None, width: int, word_spans: list[dict] | None = None, n_words: int = 0, whole_words: bool = False) -> tuple[bytes, list[tuple[int, int]]]:
    """A text's bytes, and the ascending intervals to remove from them, apart from each other."""
    b = text.encode("utf-8", "surrogatepass") if text else b""
    every = _marked(spans, width)
    if whole_words:
        joined: list[tuple[int, int]] = []
        for a, z in sorted(every):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(z, joined[-1][1]))
            else:
                joined.append((a, z))
        every = [(a, z) for a, z in (_whole_words(b, *x) for x in joined) if z > a]
    if word_spans:
        # a word's bytes reach to the next word; what stands before the first word goes with it
        at = [0, *[m.start() for m in re.finditer(rb"\S+", b)][1:], len(b)]
        every += [(at[a], at[z]) for a, z in _marked(word_spans, n_words)]
    merged: list[tuple[int, int]] = []
    for a, z in sorted(every):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(z, merged[-1][1]))
        else:
            merged.append((a, z))
    return b, merged


def _with_spans(docs: DataFrame, width: int, keep_first: bool, n_words: int = 0) -> DataFrame:
    rows = with_row(docs, keep_first).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    none = F.lit(None).cast("array<struct<i0:bigint,i1:bigint,runs:binary>>")
    spans = repeated_spans(rows, width, keep_first)
    by_words = repeated_spans(rows, n_words, keep_first, True) if n_words else None
    if by_words is not None:
        by_words = by_words.withColumnRenamed("spans", "word_spans")
        spans = by_words if spans is None else spans.join(by_words, "uid", "full")
    if spans is None:
        return rows.withColumn("spans", none).withColumn("word_spans", none)
    out = rows.join(spans, "uid", "left")
    for c in ("spans", "word_spans"):
        if c not in spans.columns:
            out = out.withColumn(c, none)
    return out


def repeat_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row when every repeated byte goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                b, cuts = _removed(text, spans, width)
                digest, at = hashlib.sha256(), 0
                for a, z in cuts:
                    digest.update(b[at:a])
                    at = z
                digest.update(b[at:])
                out.append((len(b), sum(z - a for a, z in cuts), len(cuts), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, width, False).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_later_copies(docs: DataFrame, width: int = WIDTH, n_words: int = 0) -> DataFrame:
    """Each row of docs as a struct `row`, and `kept`: its text without later copies of repeated strings.

    With n_words, later copies of strings of so many words go, too, however few bytes they have.
    Words (up to WORD bytes of them) that a cut would go through stay whole; characters that are cut in two go as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = []
            for text, spans, word_spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                b, cuts = _removed(text, spans, width, word_spans, n_words, True)
                kept, at = [], 0
                for a, z in cuts:
                    kept.append(b[at:a])
                    at = z
                out.append(b"".join([*kept, b[at:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(4)], ["kept", "row"])

    return _with_spans(docs, width, True, n_words).select("doc_id", "text", "spans", "word_spans", "row").mapInArrow(run, out_schema(docs, "kept string", True))
