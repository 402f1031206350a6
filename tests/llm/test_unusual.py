"""Unusual rows, paths that small tables do not reach, and rows that only hashes tell apart."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from chronofeat.llm import suffix_dedup
from chronofeat.llm.queries import LLM_QUERIES
from chronofeat.llm.token_counts import count_tokens
from chronofeat.llm.topk_search import topk
from test_operators import DOCS, components_by_force, prose, removed_by_force


def test_equal_contents_are_encoded_once(spark, tmp_path):
    rows = [(1, "one two three")] * 5 + [(2, "one  two\tthree"), (3, "one two three"), (None, None), (None, "")]
    cache = str(tmp_path / "cache")
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), cache=cache).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows) and {r.n_tokens for r in out if r.doc_id} == {3}
    assert spark.read.parquet(cache).count() == 2


def test_vectors_of_different_lengths_are_apart(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 4 + 3 * (i % 3 == 0)) / 4], "clash") for i in range(120)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string"), k=50).collect())
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v, _ in vectors}
    want = []
    for i in range(0, 120, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:50]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want


def suffix_digests(spark, rows):
    out = suffix_dedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return Counter(tuple(r) for r in out)


def shared_passages(seed):
    """Texts that share passages of many lengths, at many places, in groups with and without whole copies."""
    rng = np.random.default_rng(seed)
    passages = [prose(100 + seed * 10 + k, 40 + 30 * k) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(1000 * seed + i, int(rng.integers(1, 60)))]
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(6))]
            a = int(rng.integers(0, 80))
            parts.append(p[a : a + int(rng.integers(200, 1200))])
        rows.append((i, " ".join(parts)))
    return rows + [(70, rows[3][1]), (71, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, rows[4][1])]


@pytest.mark.parametrize("hot", [1, 4000])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    for seed in (1, 2):
        rows = shared_passages(seed)
        assert suffix_digests(spark, rows) == removed_by_force(rows)


def test_repeated_strings_of_a_larger_table(spark):
    """sf0.01 against the definition, by digests of all strings of 400 bytes."""
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    hashes = [suffix_dedup.window_hashes(np.frombuffer(b, np.uint8), 400) if len(b) >= 400 else np.zeros(0, np.uint64) for _, b in rows]
    value, count = np.unique(np.concatenate(hashes), return_counts=True)
    twice = value[count > 1]
    want = Counter()
    for (i, b), h in zip(rows, hashes):
        gone = np.zeros(len(b) + 1, np.int64)
        for at in np.flatnonzero(np.isin(h, twice)):
            gone[at] += 1
            gone[at + 400 if at + 400 <= len(b) else len(b)] -= 1
        marked = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~marked].tobytes()
        want[i, len(b), int(marked.sum()), int((np.diff(np.r_[0, marked.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in LLM_QUERIES["op10_suffix_dedup"](spark, d).collect()) == want


def test_pipeline_judges_rows_of_one_id_apart(spark, tmp_path):
    item = "Mr Miller buys 12 km of rope and gives away three pieces of it before the evening comes to town 40"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, prose(1, 60)), (1, f"{prose(2, 30)} {item}"), (None, f"{item} {prose(3, 30)}"), (None, prose(4, 60)), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, uid string")
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([rows[0], rows[3], rows[4]])


def test_pipeline_leaves_one_row_of_a_group(spark):
    a, b, c = prose(5, 80), prose(6, 80), prose(7, 80)
    near = a + " tail"
    rows = [(4, a), (4, a), (None, a), (2, near), (9, b), (9, b), (None, c), (None, c), (5, "x"), (5, "y"), (6, ""), (6, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    out = Counter((r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect())
    assert out == Counter([(2, near), (9, b), (None, c), (5, "x"), (5, "y"), (6, ""), (6, ""), (None, None)])
    assert {c for _, _, c in components_by_force(rows) if c is not None} >= {d for d, _ in out if d is not None}


def test_pipeline_keeps_the_first_of_repeated_rows(spark):
    a, b = prose(8, 120), prose(9, 120)
    rows = [(3, a), (3, a), (7, f"{b} {a}"), (8, f"{b} {prose(10, 20)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    out = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert out[3] == a and out[7].split() == b.split() and out[8].split() == prose(10, 20).split()


def test_leaks_of_repeated_long_and_partial_texts(spark):
    from chronofeat.llm.decontamination import find_leaks

    item = "The old farmer walked 3 miles along the muddy river bank every morning and The children followed him for 3 hours until the sun was high"
    part = " ".join(item.split()[:19])  # its later 3 and The have no place in the text
    rows = [(1, item), (1, item), (1, prose(1, 50)), (2, f"{prose(2, 40_000)} {item} {prose(3, 40_000)}"), (3, f"so {part} and nothing of any use here"), (None, item), (5, item.replace("walked 3", "walked 4")), (6, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item_id string, n_windows long")
    bench = spark.createDataFrame([(7, item, "x"), (7, item, "y"), (None, item, "z"), (8, "", "z")], "item_id long, text string, words string")
    out = find_leaks(docs, bench).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.reparameterised) for r in out) == [(-1, 7, False), (1, 7, False), (2, 7, False), (3, 7, False)]
