"""Token counts of prefixes, hard negatives and whitening, against the tokenizers library, SQL, plain loops and numpy."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import hard_negatives, queries, token_counts, whitening

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = token_counts.PrefixCounter(FILE, token_counts.unsure(), keep=50)
LIBRARY = Tokenizer.from_file(FILE)
BITS = ["the ", "hello", " ", "  ", "\n", "\t", "'ll", "'re", "'s", "'", "aaaa", "123", "ö", "日本", "<|endoftext|>", "<|endof", "\xa0", "====", "'v", "\x85", "\U00016ea0", "\U00030000", "zq"]


def every_prefix(text):
    return [len(LIBRARY.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=6)), max_size=9))
def test_prefixes_of_any_text(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert COUNTER(text).tolist() == every_prefix(text)


def test_long_pieces():
    rng = random.Random(3)
    for letters in ("a", "ab", "0", "=-", "abcdefgh", "éa"):
        text = "".join(rng.choice(letters) for _ in range(400))
        assert COUNTER(text).tolist() == every_prefix(text)


def test_counts_of_all_documents(spark):
    found = {r.doc_id: r for r in queries.op11_token_counts(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        n, r = len(LIBRARY.encode(d.text or "", add_special_tokens=False).ids), found[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 512)
        if n > 512:
            tokens = lambda k, d=d: len(LIBRARY.encode(d.text[:k], add_special_tokens=False).ids)
            assert tokens(r.fitting_chars) <= 512 < min(tokens(r.fitting_chars + k) for k in range(1, 40) if r.fitting_chars + k <= len(d.text))


def test_token_edges(spark):
    rows = [(None, "a b"), (1, None), (1, None), (2, ""), (3, "word " * 30_000), (3, "x" * 5000)]
    docs = spark.createDataFrame([(str(i) if i else None, t, 0, "y") for i, t in rows], "doc_id string, text string, counts int, n_bytes string")
    found = token_counts.count(docs, 10).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.fitting_chars) for r in found) == sorted(
        (str(i), len(t or ""), n := len(LIBRARY.encode(t or "", add_special_tokens=False).ids), len(t or "") if n <= 10 else max(k for k in range(200) if len(LIBRARY.encode(t[:k]).ids) <= 10)) for i, t in rows)
    assert token_counts.count(docs.limit(0)).count() == 0
    table = token_counts.prefix_counts(docs.where("doc_id is null")).select(token_counts.tokens(F.col("counts"), 1), token_counts.tokens(F.col("counts"), 99), token_counts.longest_prefix(F.col("counts"), 1))
    assert tuple(table.first()) == (1, 2, 1)


# --- hard negatives


def plain_negatives(rows, positives=5, negatives=10):
    dims = max((len(r[1]) for r in rows if r[1] is not None), default=0)
    whole = []
    for i, (vec, v, label) in enumerate(rows):
        if label is None or v is None or len(v) < dims or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole.append((i, vec, [int(np.floor(256 * np.float32(x).astype(float))) for x in v], (label + 1) % 10 if vec is not None and vec % 7 == 0 else label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for i, vec, v, label in whole:
        if vec is None or vec % 100:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w, strict=True)), o, j, k) for j, o, w, k in whole if j != i), key=order)
        for s, o, _, k in [x for x in scored if x[3] == label][:positives]:
            found = [x for x in scored if x[3] != label and 30 * s <= 100 * x[0] <= 90 * s][:negatives]
            out += [(vec, o, rank + 1, x[1], s, x[0]) for rank, x in enumerate(found)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(0.2, 0.5, (40, 11)) * 4) / 4  # coarse, so that scores are often equal
    rows = [(i, base[rng.integers(0, 40)].tolist(), int(rng.integers(0, 3))) for i in range(0, 700, 2)]
    rows += [(100, base[0].tolist(), 1), (100, base[0].tolist(), 1), (None, base[1].tolist(), 1), (None, base[2].tolist(), 0), (5, None, 1), (200, base[3].tolist(), None)]
    rows += [(300, [float("nan"), *base[4][1:].tolist()], 1), (9, [None, *base[4][1:].tolist()], 1), (400, base[5][:4].tolist(), 1), (11, [float("inf"), *base[4][1:].tolist()], 2), (13, [], 1)]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, planes string, position int").repartition(5)


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "chunk": 17}])
def test_negatives_match_plain_loops(vectors, sizes):
    rows, df = vectors
    assert sorted((tuple(r) for r in hard_negatives.mine(df, **sizes).collect()), key=repr) == plain_negatives(rows)


def test_negatives_match_sql(spark):
    found = queries.op12_hard_negatives(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE_SQL['op12_hard_negatives']})").fetchall()
    assert want and sorted(map(tuple, found.collect())) == sorted(want)


def test_scores_are_exact_whatever_the_width():
    rng = np.random.default_rng(2)
    for high, kind in ((1, np.int32), (300, np.int32), (1 << 28, np.int64)):
        a, b = rng.integers(-high, high + 1, (5, 21)), rng.integers(-high, high + 1, (300, 21))
        planes = int(high).bit_length() + 1
        packed = hard_negatives.bit_planes(a, planes)
        wide = hard_negatives.from_planes(packed, planes)
        assert (wide[:, :21] == a).all() and (wide[:, 21:] == 0).all()
        assert (hard_negatives.scores(hard_negatives.subset_sums(wide, kind), hard_negatives.bit_planes(b, planes), planes) == b @ a.T).all()


def test_negative_edges(spark, vectors):
    _, df = vectors
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.where("label is null")).count() == 0
    assert hard_negatives.mine(df.where("embedding is null or size(embedding) = 0")).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(100, [1e30], 1)], "vec_id long, embedding array<double>, label int"))


# --- whitening


def whitened_plainly(rows, components=16):
    dims = max((len(v) for _, v in rows if v is not None), default=0)
    kept = [(i, [int(np.floor(64 * np.float32(c).astype(float))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(0)
    y = (n * fit - s) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return kept, n, s, values[::-1][:components], axes[:, ::-1][:, :components], np.trace(y.T @ y / n)


@pytest.mark.parametrize("dims", [2, 7, 24])
def test_whitening_matches_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(300, dims)) * np.geomspace(3, 0.05, dims)
    rows = [(i, base[i].tolist()) for i in range(300)] + [(7, base[7].tolist())] * 40
    rows += [(None, base[1].tolist()), (1000, None), (1001, [None] * dims), (1002, [float("nan")] * dims), (1003, base[0][:-1].tolist()), (1004, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, component int, x string").repartition(4)
    found = whitening.whiten(df).orderBy("vec_id", "component").collect()
    kept, n, s, values, axes, trace = whitened_plainly(rows)
    most = min(16, dims)
    assert len(found) == len(kept) * most and {r.n for r in found} == {n}
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, x in kept:
        away = n * np.array(x, object) - s.astype(object)
        for k in range(most):
            r = by[i, k + 1][0]
            assert r.deviation == int((away * away).sum())
            assert r.explained == pytest.approx(values[k] / trace, rel=1e-9)
            want = (away / n).astype(float) @ axes[:, k] / np.sqrt(values[k])
            signs.setdefault(k, np.sign(want * r.whitened) or 1.0)
            assert r.whitened == pytest.approx(signs[k] * want, abs=1e-8)
    assert {r.identity_error for r in found} and max(r.identity_error for r in found) < 1e-9


def test_factor_and_rotations():
    rng = np.random.default_rng(0)
    for dims, rank in ((1, 1), (6, 6), (9, 4), (30, 30)):
        half = rng.normal(size=(dims, rank)) * np.geomspace(1, 1e-5, rank)
        c = half @ half.T
        factor = whitening.pivoted_cholesky(c)
        order = np.argsort([np.flatnonzero(row)[-1] if row.any() else -1 for row in factor], kind="stable")
        assert np.allclose(factor[order][: factor.shape[1]], np.tril(factor[order][: factor.shape[1]]))
        values, axes = whitening.one_sided_jacobi(factor)
        assert np.allclose(factor @ factor.T, c, atol=1e-12 * c.max()) and np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)
        assert np.allclose(values[:rank], np.linalg.eigvalsh(c)[::-1][: len(values)][:rank], rtol=1e-4, atol=1e-14)


def test_whitening_edges(spark):
    schema = "vec_id string, embedding array<double>"
    empty = spark.createDataFrame([], schema)
    assert whitening.whiten(empty).count() == 0
    same = spark.createDataFrame([("a", [1.0, 2.0])] * 3 + [("b", None), (None, [])], schema)
    assert whitening.whiten(same).count() == 0  # no variance
    line = spark.createDataFrame([(str(i), [float(i), 1.0, 2.0 * i]) for i in range(9)], schema)
    found = whitening.whiten(line).collect()
    assert {r.component for r in found} == {1} and len(found) == 9 and found[0].explained == pytest.approx(1)
    with pytest.raises(ValueError, match="64 bits"):
        whitening.whiten(spark.createDataFrame([("a", [0.0]), ("b", [1e12])], schema))
