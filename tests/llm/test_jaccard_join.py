"""The Jaccard join where components, ids and groups are awkward; brute force is in test_operators."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from chronofeat.llm import jaccard_join
from chronofeat.llm.jaccard_join import jaccard_components
from test_operators import components_by_force

VOCABULARY = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return " ".join(VOCABULARY[i] for i in rng.integers(0, len(VOCABULARY), n))


def changed(rng, text, n):
    words = text.split()
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"x{rng.integers(1 << 40)}"
    return " ".join(words)


def run(spark, rows):
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in out)


def test_rows_of_one_id_with_different_texts_are_different_documents(spark):
    rng = np.random.default_rng(0)
    a, b = prose(rng, 100), prose(rng, 100)
    x = f"{a} {b}"
    rows = [(1, a), (1, b), (20, changed(rng, a, 1)), (30, changed(rng, b, 1)), (50, x), (51, changed(rng, x, 1))]
    got = run(spark, rows)
    assert got == components_by_force(rows)
    assert {c for d, _, c in got if d in (50, 51)} == {50}


def test_rows_without_id_link_others(spark):
    rng = np.random.default_rng(1)
    a = prose(rng, 300)
    left, right = " ".join(a.split()[:270]), " ".join(a.split()[30:])  # 0.8 of the whole each, less of one another
    rows = [(None, a), (7, left), (9, right), (None, prose(rng, 50))]
    got = run(spark, rows)
    assert got == components_by_force(rows)
    assert {c for d, _, c in got if d in (7, 9)} == {7}


@pytest.mark.parametrize("fragment", [300, 2_000_000])
def test_groups_of_copies_that_nearly_link(spark, fragment, monkeypatch):
    """Groups whose members are at all distances from one another, also without what they were copied from."""
    monkeypatch.setattr(jaccard_join, "FRAGMENT", fragment)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        base = prose(rng, 80 + 20 * g)
        if g % 2:
            rows.append(base)
        for k in range(40):
            rows.append(changed(rng, base, int(rng.integers(0, 5))) + (" " + prose(rng, int(rng.integers(0, 12))) if k % 3 == 0 else ""))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)]
    assert run(spark, rows) == components_by_force(rows)


def passages(rng, documents):
    """Documents of passages that many share, a few of which link; all begin with one passage, as with a notice."""
    known = [prose(rng, 30) for _ in range(60)]
    texts = [" ".join([known[0], *(known[i] for i in rng.choice(np.arange(1, 60), 9, replace=False))]) for _ in range(documents)]
    return texts + [changed(rng, t, 2) for t in texts[:10]]


def test_the_last_step_alone(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 0)
    rng = np.random.default_rng(3)
    base = prose(rng, 150)
    texts = passages(rng, 60) + [changed(rng, base, int(rng.integers(0, 8))) for _ in range(30)] + [prose(rng, 100) for _ in range(5)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    assert run(spark, rows) == components_by_force(rows)


def test_a_passage_of_all_documents_gives_no_pairs():
    rng = np.random.default_rng(4)
    s, ends = jaccard_join.shingle_sets(pa.array(passages(rng, 300)))
    sets = [s[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)]
    shared = [int(sum(np.isin(x, np.concatenate(sets[:i] + sets[i + 1 :])))) for i, x in enumerate(sets)]
    rows = pa.RecordBatch.from_pylist([{"sid": i, "n": len(x), "label": i, "weight": 0, "shared": shared[i], "s": x.tobytes()} for i, x in enumerate(sets)])
    tables = list(jaccard_join._segments(3)([rows]))
    joined = lambda parts, name: [t.filter(pc.equal(t[name], k)) for t in [pa.concat_tables(parts)] for k in t[name].unique()]
    found = pa.concat_tables(map(jaccard_join._frequencies(4), joined([pa.Table.from_batches(tables)], "frag")))
    first = pa.concat_tables(map(jaccard_join._prefixes(3), joined([found], "bucket")))
    pairs = {tuple(sorted(p.values())) for t in joined([first], "frag") for p in jaccard_join._candidates(t).to_pylist()}
    overlap = lambda a, b: len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    links = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * overlap(a, b) >= 80 * (len(sets[a]) + len(sets[b]) - overlap(a, b))}
    assert len(links) >= 10 and links <= pairs
    assert len(pairs) < 0.25 * len(sets) * (len(sets) - 1) / 2  # all of them share the first passage


def test_own_shingles_count_a_set_once_that_comes_from_several_tasks():
    rng = np.random.default_rng(5)
    shared = prose(rng, 30)
    s, ends = jaccard_join.shingle_sets(pa.array([f"{shared} {prose(rng, 20)}", f"{shared} {prose(rng, 40)}", prose(rng, 25)]))
    rows = [{"sid": i, "n": int(b - a), "head": s[a:b].tobytes()} for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends))]
    tasks = [pa.RecordBatch.from_pylist(part) for part in (rows, rows[1:], rows[:2])]
    found = jaccard_join._own_shingles(pa.Table.from_batches([out for t in tasks for out in jaccard_join._head_segments(1)([t])]))
    sets = [set(s[a:b].tolist()) for a, b in zip(np.r_[0, ends[:-1]], ends)]
    df = {x: sum(x in y for y in sets) for y in sets for x in y}
    assert found.to_pylist() == [{"sid": i, "n": len(x), "single": sum(df[y] == 1 for y in x), "weight": sum(df[y] for y in x)} for i, x in enumerate(sets)]


def test_shingle_sets_are_sorted_and_distinct_text_by_text():
    rng = np.random.default_rng(6)
    known = [prose(rng, 6) for _ in range(4)]
    texts = [None, "", "one two", *(" ".join(rng.choice(known, 30)) for _ in range(50)), "", prose(rng, 5)]
    s, ends = jaccard_join.shingle_sets(pa.array(texts))
    for text, a, b in zip(texts, np.r_[0, ends[:-1]], ends):
        words = (text or "").lower().split()
        expected = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        own = s[a:b]
        assert len(own) == len(expected) and (own[1:] > own[:-1]).all()


def test_what_fragments_count_is_added_up_in_buckets():
    """A fragment hands on one row a bucket, whatever its documents, and nothing of documents that share nothing there."""
    rng = np.random.default_rng(7)
    known = [prose(rng, 30) for _ in range(10)]
    texts = [" ".join([*rng.choice(known, 3, replace=False), prose(rng, 20)]) for _ in range(100)] + [prose(rng, 60) for _ in range(100)]
    s, ends = jaccard_join.shingle_sets(pa.array(texts))
    sets = [s[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)]
    tasks = list(jaccard_join._head_segments(7)([pa.RecordBatch.from_pylist([{"sid": i, "n": len(x), "head": x.tobytes()} for i, x in enumerate(sets)])]))
    parts = [t.filter(pc.equal(t["frag"], k)) for t in [pa.Table.from_batches(tasks)] for k in t["frag"].unique()]
    counted = [jaccard_join._shared_shingles(3)(t) for t in parts]
    assert len(counted) == 7 and all(len(t) <= 3 for t in counted)
    counted = pa.concat_tables(counted)
    found = pa.concat_tables([jaccard_join._shared_in_all(counted.filter(pc.equal(counted["bucket"], k))) for k in counted["bucket"].unique()])
    df = Counter(x for y in sets for x in y.tolist())
    expected = {i: (sum(df[x] > 1 for x in y.tolist()), sum(df[x] for x in y.tolist() if df[x] > 1)) for i, y in enumerate(sets)}
    assert {r["sid"]: (r["common"], r["weight"]) for r in found.to_pylist()} == {i: v for i, v in expected.items() if v[0]}


@pytest.mark.parametrize("most", [0, 400_000])
def test_texts_are_not_shuffled_however_many_are_compared(spark, monkeypatch, capsys, most):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", most)
    docs = spark.range(5000).selectExpr("id AS doc_id", "id * 7919 AS uid", "concat('text ', id) AS text")
    some = docs.where("doc_id % 5 = 0").select("uid")
    kept = jaccard_join._texts(docs, some, 1000)
    found = Counter(r.text for r in kept.collect())
    assert max(found.values()) == 1 and {f"text {i}" for i in range(0, 5000, 5)} <= set(found) and len(found) <= 1040
    kept.explain()
    assert "hashpartitioning" not in capsys.readouterr().out


def test_join_equals_brute_force_by_a_bitmap(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard_join, "BUCKET", 20)
    monkeypatch.setattr(jaccard_join, "FRAGMENT", 500)
    rng = np.random.default_rng(8)
    bases = [prose(rng, 60) for _ in range(12)]
    texts = [changed(rng, bases[i % 12], int(rng.integers(0, 4))) for i in range(150)] + [prose(rng, 40) for _ in range(50)] + ["", "one two"]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    assert run(spark, rows) == components_by_force(rows)
