"""N-gram Jaccard self-join by vertical partitioning.

Every distinct 5-word shingle has a place in one global order (its 64-bit hash). The order is cut into
fragments; a document's set falls into one segment per fragment. Each fragment counts partial overlaps
of its own segments, and the counts are summed per pair.

Exact reductions keep that near linear:

* Documents with the same set (by a 64-bit digest of it) are one class from the start.
* A document of n shingles can only link if at least 0.8 n of them occur in other documents. The head of
  the order (its first 30 %) is counted first; a document with more than 0.2 n shingles of its own there
  can link with nothing and leaves.
* In a shingle's list, overlaps are first counted against one pivot (the document whose shingles are the
  most common). Such a sum is a lower bound, so what reaches the threshold is a link. Of a document's links of a
  round two go on, so that a group gives no more edges than twice its members. Documents already in
  one component need no further comparison.
* The shingles that a document shares with documents of other components (`shared`, counted in each round) bound
  its overlap with any of them, and so the size of what it can link with; shingles shared with documents of no such
  size do not count in the next round. Two documents whose smaller bound can't reach the threshold aren't paired.
* What is left after the pivot rounds is put in a second order, the rarest shingles first. A document links only with what has
  0.8 n of its n shingles, so what two linked documents share begins, in this order, among the first of either:
  of the u that it shares with others, the first u - 0.8 n + 1. Fragments pair documents by these alone, so lists of
  frequent shingles give no pairs, and the pairs are compared by their whole sets.

Documents pass from task to task as whole sets, and are cut into fragments many at a time: a row holds what a few thousand
documents have in a fragment, so that rows don't grow with documents times fragments. What a fragment counts goes on in the same way,
to be added up for a bucket of documents; of the head only what is shared, as the rest is the document's own.

Results for unusual input: null, empty or blank text: no shingles, linked with nothing; fewer than five
words: the whole sequence is one shingle; very long texts: whole; repeated rows: each row is returned; rows of one
doc_id with different texts: each is a document of its own, which may fall into different components; a row with
null doc_id is returned, links others, and never gives its component the id (null if all ids of it are null); an
empty table gives an empty result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.llm._common import BROADCAST_ROWS, chunks, components, documents, fit_for_broadcast, give_back, grouped_sum, mix, release, store, word_hashes

WORDS, PERCENT = 5, 80
#: Part of the global order that is counted for every document.
HEAD = 0.3
#: Shingles in a fragment, about; and in one of the head, where they are only counted.
FRAGMENT, HEAD_FRAGMENT = 1_000_000, 2_000_000
STAR_ROUNDS = 3
#: Pivots of a list, and of a document, that a fragment reports in a pivot round.
PIVOTS = 2
#: Documents for which one task adds up what the fragments counted, about.
BUCKET = 10_000
#: Bits of a document in a bitmap, at least, and how many of them it sets.
BITS, SET = 16, 3

_U = np.uint64
SHARED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("sids", "shareds", "weights"))])
PARTIAL = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("a", "b", "na", "nb", "overlap"))])
ENTRIES = "sids binary, ns binary, labels binary, counts binary, s binary"


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, concatenated, and where each text's end."""
    h, n = word_hashes(texts)
    ends = np.r_[0, np.cumsum(n)]
    if not len(h):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), n)
    place = np.arange(len(h)) - np.repeat(ends[:-1], n)
    s = np.zeros(len(h), _U)
    for j in range(k):
        s[: len(s) - j] = s[: len(s) - j] * _U(0x9E3779B97F4A7C15) + h[j:]
    keep = place + k <= n[owner]
    for i in np.flatnonzero((n > 0) & (n < k)):  # the whole sequence, whose length is part of its hash
        v = int(n[i])
        for x in h[ends[i] : ends[i + 1]].tolist():
            v = (v * 0x9E3779B97F4A7C15 + x) % 2**64
        s[ends[i]], keep[ends[i]] = v, True
    s, owner = mix(s[keep]), owner[keep]
    stops = np.cumsum(np.bincount(owner, minlength=len(texts)))
    for a, b in zip(np.r_[0, stops[:-1]].tolist(), stops.tolist()):
        s[a:b].sort()  # many short sorts take a third of the time of a long one by two keys
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[first], np.cumsum(np.bincount(owner[first], minlength=len(texts)))


def set_digests(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    starts = np.r_[0, ends[:-1]]
    n = ends - starts
    digest = np.zeros(len(n), _U)
    full = n > 0
    if full.any():
        digest[full] = np.add.reduceat(mix(s + _U(0x632BE59BD9B4E019)), starts[full])
    return mix(digest + n.astype(_U)).view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and uid of a row, number of shingles, digest of the set, how many shingles its head has, and the head."""
    bound = _U(int(HEAD * 2**64))
    for batch in chunks(batches):
        s, ends = shingle_sets(batch.column(2))
        starts = np.r_[0, ends[:-1]]
        heads = [s[a : a + np.searchsorted(s[a:b], bound)].tobytes() for a, b in zip(starts, ends)]
        own = [batch.column(0), batch.column(1), pa.array(ends - starts), pa.array(set_digests(s, ends)), pa.array([len(h) // 8 for h in heads], pa.int64()), pa.array(heads, pa.binary())]
        yield pa.RecordBatch.from_arrays(own, ["doc_id", "uid", "n", "sid", "in_head", "head"])


def fragment_of(s: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of the global order that a shingle is in; equal ranges of the order."""
    return (((s >> _U(32)) * _U(fragments)) >> _U(32)).astype(np.int64)


def _cut(key: np.ndarray, owner: np.ndarray, name: str, of_document: dict[str, np.ndarray], of_entry: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Entries cut by key: one row for each with its documents (those of owner), how many entries each has, and the entries."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(at, np.r_[at[1:], len(key)]):
        own, counts = np.unique(owner[a:b], return_counts=True)
        rows.append((int(key[a]), *(v[own].tobytes() for v in of_document.values()), counts.astype(np.int32).tobytes(), *(v[order[a:b]].tobytes() for v in of_entry.values())))
    names = [name, *of_document, "counts", *of_entry]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * (len(names) - 1))], names) if rows else None


def _joined(t: pa.Table, **kinds: type) -> list[np.ndarray]:
    """Columns of bytes as arrays, rows one after another."""
    return [np.concatenate([np.frombuffer(x, kind) for x in t[name].to_pylist()]) for name, kind in kinds.items()]


def _dealt(key: np.ndarray, buckets: int, schema: pa.Schema, *columns: np.ndarray) -> pa.Table:
    """Rows dealt by key: one row for each bucket with the bytes of its part of the columns."""
    bucket = (mix(key.view(_U)) % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    parts = [[x[a:b].tobytes() for a, b in zip(at, np.r_[at[1:], len(bucket)])] for x in (c[order] for c in columns)]
    return pa.Table.from_arrays([pa.array(bucket[at], pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], schema=schema)


def _head_segments(fragments: int):
    """Cuts heads into fragments: per batch and fragment one row with the documents, their sizes, counts and shingles."""

    def cut(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        s = np.concatenate([r[2] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        of_document = {"sids": np.array([r[0] for r in rows], np.int64), "ns": np.array([r[1] for r in rows], np.int32)}
        if (out := _cut(fragment_of(s, fragments), owner, "frag", of_document, {"s": s})) is not None:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, size = set(), [], 0
        for batch in batches:
            for sid, n, head in zip(*(c.to_pylist() for c in batch.columns)):
                if sid in seen or not head:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sid)
                rows.append((sid, n, np.frombuffer(head, _U)))
                size += len(rows[-1][2])
                if size > 1_000_000:
                    yield from cut(rows)
                    rows, size = [], 0
        if rows:
            yield from cut(rows)

    return run


def _own_shingles(t: pa.Table) -> pa.Table:
    """Of each document in a fragment: its shingles that no other document has, and the list lengths of all."""
    sids, ns, counts, s = _joined(t, sids=np.int64, ns=np.int32, counts=np.int32, s=_U)
    sid, index = np.unique(sids, return_index=True)
    once = np.zeros(len(sids), bool)  # copies of one set come from several tasks, each with all that the set has here
    once[index] = True
    s, owner = s[np.repeat(once, counts)], np.repeat(np.searchsorted(sid, sids[once]), counts[once])
    order = np.argsort(s)
    s, owner = s[order], owner[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    df = np.repeat(np.diff(np.r_[at, len(s)]), np.diff(np.r_[at, len(s)]))
    single = np.bincount(owner[df == 1], minlength=len(sid))
    weight = np.bincount(owner, weights=np.minimum(df, 1_000_000), minlength=len(sid)).astype(np.int64)
    del s, owner, order, df
    give_back()
    return pa.table({"sid": sid, "n": ns[index].astype(np.int64), "single": single.astype(np.int64), "weight": weight})


def _shared_shingles(buckets: int):
    """Of each document in a fragment that shares shingles there: how many, and the lengths of their lists; documents dealt to buckets."""

    def run(t: pa.Table) -> pa.Table:
        own = _own_shingles(t)
        sid, single, weight = (own[c].to_numpy() for c in ("sid", "single", "weight"))
        sids, counts = _joined(t, sids=np.int64, counts=np.int32)
        shared = counts[np.unique(sids, return_index=True)[1]] - single
        some = shared > 0
        return _dealt(sid[some], buckets, SHARED, sid[some], shared[some].astype(np.int32), (weight - single)[some])

    return run


def _shared_in_all(t: pa.Table) -> pa.Table:
    """What a bucket's documents share in all fragments."""
    sids, shareds, weights = _joined(t, sids=np.int64, shareds=np.int32, weights=np.int64)
    sid, shared, weight = grouped_sum(sids, shareds.astype(np.int64), weights)
    return pa.table({"sid": sid, "common": shared, "weight": weight})


def _places(uid: np.ndarray, bits: int) -> list[np.ndarray]:
    """The SET bits that a document sets in a bitmap of `bits` bits, a power of two."""
    h, out = uid.view(_U), []
    for _ in range(SET):
        h = mix(h + _U(0x9E3779B97F4A7C15))
        out.append((h & _U(bits - 1)).astype(np.int64))
    return out


def bitmap(uids: DataFrame, count: int) -> np.ndarray:
    """A bitmap (as bytes) of count documents (uid), made on the executors; holds them all, and of others at most one in a hundred."""
    bits, part = 1 << max(16, (BITS * count - 1).bit_length()), 1 << 16

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False), bits)))
            cuts = np.flatnonzero(np.r_[True, np.diff(at // part) > 0]) if len(at) else np.zeros(0, np.int64)
            rows = [(at[a:b] % part).astype("<u2").tobytes() for a, b in zip(cuts, np.r_[cuts[1:], len(at)])]
            yield pa.RecordBatch.from_arrays([pa.array((at[cuts] // part).astype(np.int32)), pa.array(rows, pa.binary())], ["part", "at"])

    def merge(t: pa.Table) -> pa.Table:
        on = np.zeros(part, bool)
        for x in t["at"].to_pylist():
            on[np.frombuffer(x, "<u2")] = True
        return pa.table({"part": t["part"][:1], "bits": [np.packbits(on).tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for r in uids.mapInArrow(places, "part int, at binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect():
        out[r.part * part // 8 : (r.part + 1) * part // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def held(bits: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """Whether a bitmap holds documents."""
    ok = np.ones(len(uid), bool)
    for at in _places(uid, 8 * len(bits)):
        ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and all shingles of the texts."""
    for batch in chunks(batches):
        s, ends = shingle_sets(batch.column(0))
        sets = [s[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)]
        yield pa.RecordBatch.from_arrays([pa.array(set_digests(s, ends)), pa.array(sets, pa.binary())], ["sid", "s"])


def _texts(docs: DataFrame, uids: DataFrame, count: int) -> DataFrame:
    """The texts of docs (doc_id, uid, text) whose uid is in uids (count rows), if these are too many for a broadcast with a few others.

    Texts are not shuffled for this.
    """
    if count <= BROADCAST_ROWS:
        return docs.join(F.broadcast(uids), "uid", "left_semi").select("text")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(uids, count))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(held(shared.value, batch.column(0).to_numpy(zero_copy_only=False))))], ["text"])

    return docs.select("uid", "text").mapInArrow(some, "text string")


def _segments(fragments: int):
    """Cuts sets into fragments: per some documents and fragment one row with them, what is known of them, counts and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def cut() -> Iterator[pa.RecordBatch]:
            s = np.concatenate([r[-1] for r in rows])
            columns = {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(("sids", "ns", "labels", "weights", "shareds"))}
            if (out := _cut(fragment_of(s, fragments), np.repeat(np.arange(len(rows)), [len(r[-1]) for r in rows]), "frag", columns, {"s": s})) is not None:
                yield out

        for batch in batches:
            for *known, s in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((*known, np.frombuffer(s, _U)))
                size += len(rows[-1][-1])
                if size > 1_000_000:
                    yield from cut()
                    rows, size = [], 0
                    give_back()
        if rows:
            yield from cut()

    return run


def _enough(overlap: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether an overlap (or a bound of it) reaches the similarity."""
    return (100 + PERCENT) * overlap >= PERCENT * (na + nb)


def _most_of_others(value: np.ndarray, label: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each entry the largest value in its list among entries of other labels; -inf if there are none.

    which: the list of each entry; at: where each list starts.
    """
    order = np.lexsort((-value, which))
    v, l, first = value[order], label[order], label[order[at]]
    other = np.where(l != first[which], np.arange(len(v)), len(v))  # lists keep their places in this order
    second = np.minimum.reduceat(other, at)
    second = np.where(second < len(v), np.append(v, 0)[np.minimum(second, len(v))], -np.inf)
    return np.where(label == first[which], second[which], v[at][which])


def _fragment(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Documents of a fragment (ids ascending), what is known of them, and all their entries."""
    sids, *known, counts, s = _joined(t, sids=np.int64, ns=np.int64, labels=np.int64, weights=np.int64, shareds=np.int64, counts=np.int32, s=_U)
    sid, of_row, row = np.unique(sids, return_index=True, return_inverse=True)
    return sid, *(x[of_row] for x in known), np.repeat(row, counts), s


def _of_several(label: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are in lists of several labels, and which lists are."""
    if not len(at):
        return np.zeros(0, bool), np.zeros(0, bool)
    mixed = np.minimum.reduceat(label, at) != np.maximum.reduceat(label, at)
    return np.repeat(mixed, length), mixed


def _useful(n: np.ndarray, label: np.ndarray, shared: np.ndarray, owner: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether an entry's list holds a document of another label that its owner could link with, by their sizes and by what either shares."""
    if not len(owner):
        return np.zeros(0, bool)
    # what a document can link with at most, by its size: size * PERCENT <= (100 + PERCENT) * overlap - PERCENT * own size
    most = (100 + PERCENT) * shared / PERCENT - n
    which = np.repeat(np.arange(len(at)), length)
    lab, size = label[owner], n[owner]
    return (_most_of_others(most[owner], lab, which, at) >= size) & (-_most_of_others(-size.astype(np.float64), lab, which, at) <= most[owner])


def _partial_overlaps(round_: int, buckets: int):
    """Partial overlaps of one fragment: of each document with the pivots it meets most; documents dealt to buckets.

    Rows are (document a, pivot b, sizes, overlap), b before a in an order that all fragments share; rows with b = a
    hold in place of b's size the lengths of a's lists together, and as overlap the number of a's shingles that a document
    of another component has that could link with it by their sizes and by what either shares at all. Pivots are the
    documents that are most like many others: those with the longest lists, then those with the fewest shingles of their own,
    at last others by a hash.
    """

    def run(t: pa.Table) -> pa.Table:
        sid, n, label, weight, shared, owner, s = _fragment(t)
        del t
        m = len(sid)
        rank = np.empty(m, np.int64)
        by = {0: (sid, -weight), 1: (sid, -weight), 2: (sid, -(shared / n))}.get(round_, (mix(sid.view(_U) + _U(round_)),))
        rank[np.lexsort(by)] = np.arange(m)
        order = np.lexsort((rank[owner], s))
        s, owner = s[order], owner[order]
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        length = np.diff(np.r_[at, len(s)])
        lists = np.bincount(owner, weights=np.repeat(np.minimum(length, 1_000_000), length), minlength=m).astype(np.int64)
        keep, mixed = _of_several(label[owner], at, length)
        owner, at, length = owner[keep], np.r_[0, np.cumsum(length[mixed])][:-1].astype(np.int64), length[mixed]
        del s, order, keep
        here = np.bincount(owner[_useful(n, label, shared, owner, at, length)], minlength=m)
        own = np.arange(m)
        keys, sums = [own * m + own], [here]

        def add(a: np.ndarray, b: np.ndarray) -> None:
            ok = (label[a] != label[b]) & _enough(np.minimum(shared[a], shared[b]), n[a], n[b]) & (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
            k, c = np.unique(a[ok] * m + b[ok], return_counts=True)
            keys.append(k)
            sums.append(c)
            if sum(map(len, keys[1:])) > 2_000_000:
                k, c = grouped_sum(np.concatenate(keys[1:]), np.concatenate(sums[1:]))
                keys[1:], sums[1:] = [k], [c]

        if len(owner):
            place = np.arange(len(owner)) - np.repeat(at, length)
            for pivot in range(1 if not round_ else PIVOTS):
                i = np.flatnonzero(place > pivot)
                add(owner[i], owner[i - place[i] + pivot])
        k, c = grouped_sum(np.concatenate(keys), np.concatenate(sums).astype(np.int64))
        a, b = k // m, k % m
        order = np.lexsort((rank[b], -c, a == b, a))  # a document's pivots, best first; its own row last
        place = np.arange(len(a)) - np.repeat(*((x := np.flatnonzero(np.r_[True, np.diff(a[order]) > 0])), np.diff(np.r_[x, len(a)])))
        order = order[((place < PIVOTS) | (a == b)[order]) & (c[order] > 0)]
        a, b, c = a[order], b[order], c[order]
        give_back()
        return _dealt(sid[a], buckets, PARTIAL, sid[a], sid[b], n[a].astype(np.int32), np.where(a == b, lists[a], n[b]), c.astype(np.int32))

    return run


def _overlaps(t: pa.Table) -> pa.Table:
    """What the fragments counted for a bucket's documents, added up: the links, and of each document that can still link its own row."""
    a, b, na, nb, c = _joined(t, a=np.int64, b=np.int64, na=np.int32, nb=np.int64, overlap=np.int32)
    order = np.lexsort((b, a))
    a, b, na, nb, c = a[order], b[order], na[order].astype(np.int64), nb[order], c[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    a, b, na, first, lists, c = a[at], b[at], na[at], nb[at], np.add.reduceat(nb, at), np.add.reduceat(c.astype(np.int64), at)
    keep = np.where(a == b, 100 * c >= PERCENT * na, _enough(c, na, first))
    out = pa.table({"a": a[keep], "b": b[keep], "na": na[keep], "lists": lists[keep], "overlap": c[keep]})
    give_back()
    return out


def _frequencies(buckets: int):
    """Of a fragment's entries that a document of another component has: how many documents have them; documents dealt to buckets."""

    def run(t: pa.Table) -> pa.Table:
        sid, n, label, _, shared, owner, s = _fragment(t)
        order = np.argsort(s, kind="stable")
        s, owner = s[order], owner[order]
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        length = np.diff(np.r_[at, len(s)])
        keep, mixed = _of_several(label[owner], at, length)
        s, owner, at, length = s[keep], owner[keep], np.r_[0, np.cumsum(length[mixed])][:-1].astype(np.int64), length[mixed]
        df = np.repeat(length, length).astype(np.int64)
        keep = _useful(n, label, shared, owner, at, length)
        s, owner, df = s[keep], owner[keep], df[keep]
        bucket = (mix(sid.view(_U)) % _U(buckets)).astype(np.int64)
        out = _cut(bucket[owner], owner, "bucket", {"sids": sid, "ns": n, "labels": label}, {"s": s, "df": df})
        give_back()
        return pa.Table.from_batches([out]) if out else _FREQUENCIES.empty_table()

    return run


_FREQUENCIES = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("sids", "ns", "labels", "counts", "s", "df"))])
_PREFIXES = pa.schema([("frag", pa.int32()), *((c, pa.binary()) for c in ("sids", "ns", "labels", "counts", "s", "left"))])


def _prefixes(fragments: int):
    """The entries by which a bucket's documents are paired, the rarest that they share, and how many such entries there are from each on."""

    def run(t: pa.Table) -> pa.Table:
        sids, ns, labels, counts, s, df = _joined(t, sids=np.int64, ns=np.int64, labels=np.int64, counts=np.int32, s=_U, df=np.int64)
        sid, of_row, row = np.unique(sids, return_index=True, return_inverse=True)
        n, label, owner = ns[of_row], labels[of_row], np.repeat(row, counts)
        order = np.lexsort((s, df, owner))
        s, owner = s[order], owner[order]
        u = np.bincount(owner, minlength=len(sid))
        left = np.repeat(np.cumsum(u), u) - np.arange(len(owner))
        keep = left >= ((PERCENT * n + 99) // 100)[owner]
        s, owner, left = s[keep], owner[keep], left[keep]
        out = _cut(fragment_of(s, fragments), owner, "frag", {"sids": sid, "ns": n, "labels": label}, {"s": s, "left": left})
        give_back()
        return pa.Table.from_batches([out]) if out else _PREFIXES.empty_table()

    return run


def _candidates(t: pa.Table) -> pa.Table:
    """Pairs (a, b) of different components that share one of these entries and could link by their sizes and what is left in either."""
    sids, ns, labels, counts, s, left = _joined(t, sids=np.int64, ns=np.int64, labels=np.int64, counts=np.int32, s=_U, left=np.int64)
    sid, of_row, row = np.unique(sids, return_index=True, return_inverse=True)
    n, label, owner = ns[of_row], labels[of_row], np.repeat(row, counts)
    order = np.lexsort((n[owner], s))  # smaller documents first: a partner of over 100 / PERCENT times the size ends a search
    s, owner, left = s[order], owner[order], left[order]
    end = np.searchsorted(s, s, "right")
    m, keys, i, shift = len(sid), [np.zeros(0, np.int64)], np.arange(len(s)), 1
    while len(i := i[end[i] - i > shift]):
        a, b = owner[i], owner[i + shift]
        near = 100 * n[a] >= PERCENT * n[b]
        i, a, b = i[near], a[near], b[near]
        ok = (label[a] != label[b]) & _enough(np.minimum(left[i], left[i + shift]), n[a], n[b])
        keys.append(np.unique(np.maximum(a, b)[ok] * m + np.minimum(a, b)[ok]))
        if sum(map(len, keys[1:])) > 1_000_000:
            keys = [np.unique(np.concatenate(keys))]
        shift += 1
    k = np.unique(np.concatenate(keys))
    give_back()
    return pa.table({"a": sid[k // m], "b": sid[k % m]})


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those rows (a, b and their sets) that link."""
    for batch in batches:
        a, b, left, right = batch.columns
        ok = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(left, right)):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            ok[i] = _enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], ["a", "b"])


def jaccard_components(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    carry: also uid, a hash of doc_id and text, and label, which is equal for rows of a component and null for rows
    without shingles.
    """
    spark = docs.sparkSession
    docs = documents(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")
    profile = store(docs.mapInArrow(_profile, "doc_id long, uid long, n long, sid long, in_head long, head binary"), "profile")
    rows, total = profile.agg(F.count("n"), F.sum("n")).first()
    total, least = total or 0, 2 * spark.sparkContext.defaultParallelism

    # the head of the order, cut so that the head itself gives that many fragments
    wanted = max(least, int(total * HEAD) // HEAD_FRAGMENT)
    cut = profile.where("n > 0").select("sid", "n", "head").mapInArrow(_head_segments(int(wanted / HEAD) + 1), "frag int, sids binary, ns binary, counts binary, s binary")
    heads = cut.groupBy("frag").applyInArrow(_shared_shingles(max(least, rows // BUCKET)), "bucket int, sids binary, shareds binary, weights binary")
    stats = store(heads.groupBy("bucket").applyInArrow(_shared_in_all, "sid long, common long, weight long"), "stats")
    members = profile.where("n > 0").groupBy("sid").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("least_id"), F.max("n").alias("n"), F.max("in_head").alias("in_head"))
    classes = store(members.join(stats, "sid", "left").fillna(0, ["common", "weight"]), "classes")
    single = F.col("in_head") - F.col("common")
    alive = classes.where(100 * (F.col("n") - single) >= PERCENT * F.col("n"))
    alive = store(alive.select("sid", "rep", "n", (F.col("n") - single).alias("shared"), ((F.col("weight") + single) * 1024 / F.col("n")).cast("long").alias("weight")), "alive")
    left, size = alive.agg(F.count("n"), F.sum("n")).first()
    links = None
    if size:
        fragments = max(least, size // FRAGMENT)
        kept = _texts(docs, alive.select(F.col("rep").alias("uid")), left).mapInArrow(_sets, "sid long, s binary")
        # rows that are equal in id and text give the same set
        sets = store(kept.dropDuplicates(["sid"]).join(fit_for_broadcast(alive.drop("rep")), "sid"), "sets")
        links = store(links, "links") if (links := _links(sets, fragments, max(least, left // BUCKET), least)) is not None else None
        release(sets)
    found = components(links) if links is not None else None
    classes_ = classes.select("sid", "least_id")
    if found is not None:
        labelled = store(classes_.join(found.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least_id", F.coalesce("label", "sid").alias("label")), "labelled")
        smallest = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
        classes_ = store(labelled.join(smallest, "label").select("sid", "label", "component_id"), "classes")
        release(labelled, classes)
    else:
        classes_ = classes_.select("sid", F.col("sid").alias("label"), F.col("least_id").alias("component_id"))
    release(stats, alive)
    out = profile.select("doc_id", "uid", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(classes_, "sid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, *(["uid", "label"] if carry else []))


def _links(sets: DataFrame, fragments: int, buckets: int, least: int) -> DataFrame | None:
    """Edges (a, b) between set digests that connect what links at that similarity connect, and nothing else."""
    every, sets = sets.withColumn("label", F.col("sid")), sets.select("sid", "s")
    active, links = every.drop("s"), None

    def segments(fragments: int) -> DataFrame:
        known = every if round_ == 0 else sets.join(fit_for_broadcast(active), "sid")
        known = known.select("sid", "n", "label", "weight", "shared", "s")
        return known.mapInArrow(_segments(fragments), "frag int, sids binary, ns binary, labels binary, weights binary, shareds binary, counts binary, s binary")

    round_ = 0
    while round_ < STAR_ROUNDS:
        counted = segments(fragments).groupBy("frag").applyInArrow(_partial_overlaps(round_, buckets), "bucket int, a binary, b binary, na binary, nb binary, overlap binary")
        counted = store(counted.groupBy("bucket").applyInArrow(_overlaps, "a long, b long, na long, lists long, overlap long"), "overlaps")
        new = counted.where("a <> b")
        # two links of a document go on; what the others would connect is compared again
        best = new.groupBy("a").agg(F.max(F.struct("overlap", "b")).alias("most"), F.min("b").alias("least"))
        new = store(best.select("a", F.explode(F.array_distinct(F.array("most.b", "least"))).alias("b")), "links")
        any_new = bool(new.take(1))
        near = counted.where("a = b").select(F.col("a").alias("sid"), F.col("na").alias("n"), F.col("overlap").alias("shared"), (F.col("lists") * 16 / F.col("na")).cast("long").alias("weight"))
        if any_new:
            labels = components(new if links is None else links.union(new)).withColumnRenamed("node", "sid")
            links = labels.select(F.col("sid").alias("a"), F.col("label").alias("b"))  # the same components in fewest edges
        label = F.lit(None).cast("long").alias("label") if links is None else F.col("label")
        if links is not None:
            near = near.join(links.select(F.col("a").alias("sid"), F.col("b").alias("label")), "sid", "left")
        active = store(near.select("sid", "n", "weight", "shared", F.coalesce(label, F.col("sid")).alias("label")), "active")
        release(counted)
        if not active.take(1):
            return links
        if not any_new and round_:  # another pivot round would find nothing
            break
        round_ += 1
    # what is left, by its rarest shingles
    few = max(least, (active.agg(F.sum("n")).first()[0] or 0) // FRAGMENT)
    shared = segments(few).groupBy("frag").applyInArrow(_frequencies(few), f"bucket int, {ENTRIES}, df binary")
    first = shared.groupBy("bucket").applyInArrow(_prefixes(few), f"frag int, {ENTRIES}, left binary")
    pairs = store(first.groupBy("frag").applyInArrow(_candidates, "a long, b long").distinct(), "pairs")
    rest = sets.join(fit_for_broadcast(active.select("sid")), "sid")
    of = lambda c: rest.select(F.col("sid").alias(c), F.col("s").alias(f"s{c}"))
    new = store(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_linked, "a long, b long"), "links")
    release(pairs)
    of_label = lambda c: active.select(F.col("sid").alias(c), F.col("label").alias(f"l{c}"))
    # edges between components, each once
    new = new.join(of_label("a"), "a").join(of_label("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    return new if links is None else links.union(new)
