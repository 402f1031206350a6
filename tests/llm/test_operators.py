"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronofeat.llm import decontamination, packing, suffix_dedup, topk_search
from chronofeat.llm.queries import LLM_QUERIES, LLM_SQL
from chronofeat.llm.tokenization import path_of
from chronofeat.llm.topk_search import topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["uid", "row", "label", "spans", "words", "component_id", "score", "w", "digest"]
WORDS = [f"word{i}" for i in range(400)]
LONG = " ".join(WORDS[i * i % 397] + str(i % 1013) for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(80))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}" for i in rng.integers(0, 400, n))


def edge_texts():
    a = prose(1, 60)
    near = a.split()
    near[3] = "changed"
    texts = [None, "", "   ", "one two", "ONE two", "one two three", "été 漢字 🙂 a\tb\nc", LONG, a, a, a.upper(), " ".join(near), prose(2, 50) + " " + PASSAGE, PASSAGE + " " + prose(3, 50)]
    texts += ["ab" * 600, "ab" * 600, "<|endoftext|> x <|startoftext|>", "12 34 -- !!", prose(4, 300), prose(4, 300) + " tail"]
    return [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None) for i, t in enumerate(texts)] + [(8, a, "en", "s", 1), (None, a, None, None, None), (None, None, None, None, None)]


class Tables:
    """Reads the tables of a folder that tests fill."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        edges = spark.createDataFrame(edge_texts(), DOCS).select("*", *(F.lit(f"x{c}").alias(c) for c in CLASHES))
        labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(20)] + [(None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")
        item = "Mr Miller buys 12 km of rope and gives away three pieces of it before the evening comes to town 40"
        bench = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (None, item)], "item_id long, text string")
        rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0]), (6, []), (20, [0.1, 0.9]), (20, [0.1, 0.9]), (None, [1.0, 1.0])]
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        page = "<html><body><nav>menu here</nav><article><h1>T{0}</h1><p>Body &amp; text {0} with  many words, and so on.</p></article><footer>foot</footer></body></html>"
        pages = spark.createDataFrame([(i, f"http://h/{i}", page.format(i)) for i in range(6)] + [(7, None, None), (8, "http://h/8", ""), (9, "x", "<p>broken <b>open"), (None, None, "plain")], "page_id long, url string, html string")
        for name, df in {"documents": edges, "labels": labels, "benchmark": bench, "embeddings": vectors, "pages": pages}.items():
            df.write.parquet(f"{root}/edge/{name}.parquet")
            df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return Tables(spark, str(tmp_path_factory.mktemp("tables")))


@pytest.fixture(scope="module")
def edge_rows():
    return edge_texts()


@pytest.mark.parametrize("name", list(LLM_QUERIES))
def test_empty_tables_give_empty_results(spark, tables, name):
    assert LLM_QUERIES[name](spark, f"{tables.root}/empty").count() == 0


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_ngram_jaccard_join", "op6_language_id", "op7_token_counts", "op9_lm_scoring", "op10_suffix_dedup"])
def test_unusual_documents_are_returned_row_by_row(spark, tables, edge_rows, name):
    out = LLM_QUERIES[name](spark, f"{tables.root}/edge").collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in edge_rows)
    if "score" in out[0].asDict():
        assert all(r.score is not None and math.isfinite(r.score) for r in out)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_by_force(rows):
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("where", ["edge", "sf"])
def test_jaccard_join_equals_brute_force(spark, tables, sf, edge_rows, where):
    d = f"{tables.root}/edge" if where == "edge" else sf
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in LLM_QUERIES["op3_ngram_jaccard_join"](spark, d).collect())
    assert got == components_by_force(rows)


def removed_by_force(rows, width=400):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("where", ["edge", "sf"])
def test_suffix_dedup_equals_brute_force(spark, tables, sf, where):
    d = f"{tables.root}/edge" if where == "edge" else sf
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in LLM_QUERIES["op10_suffix_dedup"](spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == removed_by_force(rows)


def test_dropping_later_copies_keeps_the_first(spark):
    rows = [(2, f"{prose(9, 20)} {PASSAGE} {PASSAGE[:200]}"), (1, f"{PASSAGE} {prose(10, 30)}"), (3, f"{prose(11, 30)} {PASSAGE}")]
    out = {r.row.doc_id: r.kept for r in suffix_dedup.drop_later_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert PASSAGE in out[1] and out[1] == rows[1][1]
    assert all(PASSAGE not in out[i] for i in (2, 3)) and prose(11, 30) in out[3]


def test_pipeline_drops_later_copies_of_51_words(spark):
    import corpus_pipeline

    short = " ".join(f"w{i}" for i in range(51))  # 193 bytes
    under = " ".join(f"v{i}" for i in range(49))
    long = "".join(f"long{i}" for i in range(80))  # over 400 bytes, one word
    texts = [(1, f"{prose(20, 30)} {short} {under}"), (2, f'{prose(21, 30)} "{short} {prose(22, 5)} {under}'), (3, f"{prose(23, 9)} {short[:-5]} {long}"), (4, f" {short}\n"), (5, f"{prose(24, 9)}\n{long}"), (6, f"{short} x {short}")]
    rows = [(i, t, "en", None, len(t)) for i, t in texts]
    out = {r.doc_id: r for r in corpus_pipeline.suffix_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert out[1].text == rows[0][1]
    assert "w1 w2" not in out[2].text and prose(22, 5) in out[2].text and under in out[2].text
    assert out[3].text == rows[2][1] and 4 not in out
    assert prose(24, 9) in out[5].text and long not in out[5].text
    assert out[6].text.split() == ["x"] and all(r.n_chars == len(r.text) for r in out.values())


@pytest.mark.parametrize("width", [3, 8])
def test_longest_previous_factors_equal_brute_force(width):
    text = np.random.default_rng(5).integers(0, 2, 120).astype(np.uint8)
    lpf, source = suffix_dedup.longest_previous_factor(text, 64)
    for i in range(len(text)):
        best = max((next((k for k in range(len(text) - i) if text[j + k] != text[i + k]), len(text) - i) for j in range(i)), default=0)
        assert min(int(lpf[i]), width) == min(best, width)
        if lpf[i]:
            assert source[i] < i and (text[source[i] : source[i] + lpf[i]] == text[i : i + lpf[i]]).all()


def test_token_counts_equal_the_library(spark, tables, sf):
    tok = Tokenizer.from_file(path_of("word_bpe_49k.json"))
    for d in (f"{tables.root}/edge", sf):
        texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        n = [len(e.ids) for e in tok.encode_batch([t for _, t in texts], add_special_tokens=False)]
        want = Counter((i, len(t.encode()), k, k > 2048) for (i, t), k in zip(texts, n))
        assert Counter(tuple(r) for r in LLM_QUERIES["op7_token_counts"](spark, d).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want


def test_token_cache_is_used_and_appended_to(spark, tables, tmp_path):
    from chronofeat.llm.token_counts import count_tokens

    docs, cache = spark.read.parquet(f"{tables.root}/edge/documents.parquet"), str(tmp_path / "cache")
    first = sorted(map(tuple, count_tokens(docs.where("doc_id < 9"), cache=cache).collect()))
    size = spark.read.parquet(cache).count()
    assert sorted(map(tuple, count_tokens(docs.where("doc_id < 9"), cache=cache).collect())) == first
    assert spark.read.parquet(cache).count() == size
    count_tokens(docs, cache=cache).count()
    assert spark.read.parquet(cache).count() > size


def check_packing(spark, pieces, texts):
    tok = Tokenizer.from_file(path_of("word_bpe_49k.json"))
    want = Counter()
    ids = {}
    for d, t in texts:
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        ids.setdefault((d, len(x)), []).append(x)
        want[(d, len(x))] += len(x)
    got = Counter()
    for p in pieces:
        got[(p.doc_id, p.doc_tokens)] += p.length
        assert any(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[(p.doc_id, p.doc_tokens)])
    assert got == want
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    slack = 0
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end and length > 0
            end += length
        assert end <= 4096
        slack += 0 if end & (end - 1) == 0 else 4096 - end
    assert slack <= 0.01 * sum(want.values()) + 4096


def test_packing_places_every_token_once(spark, tables, sf):
    for d in (f"{tables.root}/edge", sf):
        texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        check_packing(spark, LLM_QUERIES["op8_packing"](spark, d).collect(), texts)


def test_retrieval_uses_all_terms_and_all_neighbours_of_a_seed():
    seed = np.arange(40)
    others = [np.array([1000 + i] * 3) for i in range(50)]
    near = [np.array([39 - i % 40, 2000 + i]) for i in range(120)]
    order, _ = packing.retrieval_order([seed, *others, *near], 0)
    assert order[0] == 0 and set(order[1:121]) == set(range(51, 171)) and sorted(order) == list(range(171))


def test_lm_scoring_counts_and_base_equal_brute_force(spark, tables, sf):
    for d in (f"{tables.root}/edge", sf):
        rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        counts = Counter(w for i, t in rows if i is not None and not held(i) for w in [*t, None])
        n, v = sum(counts.values()), len(counts)
        out = LLM_QUERIES["op9_lm_scoring"](spark, d).collect()
        want = {(i, len(t) + 1, sum(counts[w] > 0 for w in [*t, None]), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*t, None]), 4)) for i, t in rows if i is not None}
        assert {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out if r.doc_id is not None} == want
        assert {r.train_tokens for r in out} == {n} and all(r.score <= 0 for r in out)
    fresh = [r for r in out if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def accuracy(rows, guess, truth):
    return sum(guess(r) == truth[r.doc_id] for r in rows) / len(rows)


def test_language_of_held_out_documents(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text rlike '[a-z]{3}'").collect()}
    rows = [r for r in LLM_QUERIES["op6_language_id"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert accuracy(rows, lambda r: r.lang_pred, truth) >= 0.9


def test_texts_without_letters_have_no_language(spark, tables):
    out = {r.doc_id: r.lang_pred for r in LLM_QUERIES["op6_language_id"](spark, f"{tables.root}/edge").collect() if r.doc_id is not None}
    assert out[0] == out[1] == out[2] == out[17] == "und"


def test_toxicity_ranks_held_out_documents(spark):
    d = "/root/testdata/sf0.1"  # sf0.01 has 6 labelled toxic rows in the held-out part, too few to judge by
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(r.score, truth[r.doc_id]) for r in LLM_QUERIES["op1_toxicity"](spark, d).collect() if r.held_out and truth.get(r.doc_id) is not None]
    good, bad = [s for s, t in rows if t == 0], [s for s, t in rows if t == 1]
    assert np.mean([b > g for b in bad for g in good]) >= 0.95
    assert np.mean([s >= 0.5 for s in bad]) >= 0.85 and np.mean([s >= 0.5 for s in good]) <= 0.02


def test_top_k_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(0)
    vectors = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in rng.permutation(300)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect())
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors}
    want = []
    for i in sorted(q):
        if i % 20 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:20]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want


@pytest.mark.parametrize("stride", [7, 64, 2048])
@pytest.mark.parametrize("largest", [2, 100, 10**5, 10**9])
def test_a_block_of_queries_finds_what_brute_force_finds(monkeypatch, stride, largest):
    """Sums in float32, float64 and integers; equal ids and scores; terms of all sizes, so that few are essential."""
    monkeypatch.setattr(topk_search, "STRIDE", stride)
    rng = np.random.default_rng(stride + largest)
    for skewed in (False, True):
        m = (rng.integers(-largest, largest + 1, (300, 20)) * (rng.random(20) ** 8 if skewed else 1)).astype(np.int64)
        ids, of = np.sort(rng.integers(0, 500, 300)), rng.integers(0, 300, 40)
        row, score, vec_id = topk_search.maxscore(topk_search.smallest(m).astype(np.int64), ids, m[of], ids[of], 20)
        for place, i in enumerate(of):
            best = sorted((-int(s), int(j)) for s, j in zip(m @ m[i], ids) if j != ids[i])[:20]
            assert [(-int(s), int(j)) for s, j in zip(score[row == place], vec_id[row == place])] == best


def test_odd_vectors_take_no_part(spark, tables):
    out = LLM_QUERIES["op4_topk_search"](spark, f"{tables.root}/edge").collect()
    assert {r.vec_id for r in out} <= {0, 1, 20} and all(r.query_id != r.vec_id for r in out)


def test_pages_lose_what_surrounds_the_article(spark, tables):
    out = {r.page_id: r for r in LLM_QUERIES["op2_html_extraction"](spark, f"{tables.root}/edge").collect()}
    assert out[3].text == "T3 Body & text 3 with many words, and so on." and out[3].n_chars == len(out[3].text)
    assert out[7].text == out[8].text == "" and len(out) == 10


def test_reparameterised_questions_are_leaks(spark):
    item = "Mr Miller buys 12 km of rope and gives away three pieces of it before the evening comes to town 40"
    other = item.replace("12", "15").replace("Miller", "Baker").replace("km", "m")
    uneven = item.replace("12", "15") + " " + item.replace("rope", "wool")
    docs = spark.createDataFrame([(1, f"text before {item} and after"), (2, f"Before it {other}."), (3, prose(1, 80)), (4, None), (5, ""), (6, uneven)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    out = {r.doc_id: r.reparameterised for r in decontamination.find_leaks(docs, bench).collect()}
    assert out[1] is False and out[2] is True and not {3, 4, 5} & set(out)


def test_inconsistent_slots_are_no_leak(spark):
    item = "Anna has 3 pears and then Anna eats 3 pears while the others look on and say nothing at all"
    docs = spark.createDataFrame([(1, item.replace("3", "7")), (2, item.replace("eats 3", "eats 9"))], "doc_id long, text string")
    out = {r.doc_id for r in decontamination.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1}


def left_by_pipeline(spark, folder, item, texts):
    import corpus_pipeline

    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(folder)).collect()}


def test_pipeline_drops_partial_and_shifted_copies(spark, tmp_path):
    item = "The old farmer walked 3 miles along the muddy river bank every morning and The children followed him for 3 hours until the sun was high"
    words = item.split()
    inserted = " ".join([*words[:18], "quietly", *words[18:]])
    uneven = item.replace("walked 3", "walked 7").replace("him for 3", "him for 9")
    texts = [f"so it goes {' '.join(words[:19])} and nothing else is of any use here at all today", inserted, item, prose(1, 80), uneven]
    assert left_by_pipeline(spark, tmp_path, item, texts) == {3, 4}


def test_pipeline_drops_questions_with_values_of_other_lengths(spark, tmp_path):
    item = "an old merchant from the town of Paris sells all of 12 pears and then he gives away the rest"
    texts = [*(item.replace("12", x) for x in ("1,200", "3.5", "1 200")), item.replace("12", "1,200").replace("Paris", "New York"), f"Somewhere else. Old text {item}", prose(1, 80)]
    assert left_by_pipeline(spark, tmp_path, item, texts) == {5}


@pytest.mark.parametrize("name", list(LLM_SQL))
def test_operator_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(LLM_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(tuple, LLM_QUERIES[name](spark, sf).select(*columns).collect())) == sorted(cursor.fetchall())


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, sf)
    scores = {r.doc_id: r.predicted for r in LLM_QUERIES["op1_toxicity"](spark, sf).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, p in scores.items() if p == 0} and kept.schema == docs.schema
    single = corpus_pipeline.ngram_jaccard_join(spark, docs, sf)
    groups = components_by_force([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in single.collect()} == {d for d, _, c in groups if d == c} and single.columns == docs.columns
    clean = corpus_pipeline.decontamination(spark, docs, sf)
    leaks = {r.doc_id for r in LLM_QUERIES["op5_decontamination"](spark, sf).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - leaks
    cut = corpus_pipeline.suffix_dedup(spark, docs, sf)
    assert cut.schema.names == docs.schema.names and all(len(r.text) == r.n_chars for r in cut.where("text is not null and n_chars is not null").collect())
    check_packing(spark, corpus_pipeline.packing(spark, clean, sf).collect(), [(r.doc_id, r.text) for r in clean.collect()])


@pytest.mark.parametrize("where", ["edge", "empty"])
def test_pipeline_runs_on_unusual_documents(spark, tables, where):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, f"{tables.root}/{where}")
    assert (out.count() > 0) == (where == "edge")
