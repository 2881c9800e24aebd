"""Stages of the pipeline decide by row, near copies by their exact similarity."""

from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.plain import groups, shingles
from tidemark.llm import decontaminate, language, near_copies, simhash

SF = "/root/testdata/sf0.01"


def test_near_dedup_is_jaccard_of_all_pairs(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())
    left = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert {r.doc_id for r in left.collect()} == set(groups({i: shingles(t) for i, t in texts.items()}).values())


def test_near_dedup_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.85 all meet, those just below stay apart."""
    rng, rows, want = np.random.default_rng(3), [], set()
    for k in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 100)]
        cut = int(rng.integers(8, 15))  # the last words are others: 96 - cut shingles stay of 96
        other = words[:-cut] + [f"v{x}" for x in rng.integers(0, 10**9, cut)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want |= {2 * k} | ({2 * k + 1} if (96 - cut) / (96 + cut) < 0.8 else set())
    left = near_copies.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in left.collect()} == want
    assert 400 < len(want) < 800


def test_near_dedup_of_rows_without_id_and_repeated_rows(spark):
    """One row stays of each group, whether its rows have ids, the same id or none."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, a), (5, b), (5, b), (5, c), (None, c), (9, a + " more"), (None, None), (None, "")]
    left = near_copies.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text or "") for r in left) == Counter([(9, a + " more"), (5, b), (5, c), (None, "")])


def test_language_and_decontamination_of_rows_without_id_and_of_one_id(spark):
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(None, item, "en"), (None, "no item in this text", "en"), (4, f"before {item}", "en"), (4, "the clean one of two rows", "en"), (None, "", "en"), (6, "12 34", "en"), (6, "a text with letters", "en"), (None, None, None)]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((r[0], r[1]) for r in rows if item not in (r[1] or ""))
    left = language.keep_identified(docs, language.train(docs))
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or ""))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 40, int(rng.integers(0, 900)), np.uint64) << np.uint64(20)) for _ in range(2))
        b = np.union1d(b, a[: int(rng.integers(0, len(a) + 1))])
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(near_copies.parity(a), near_copies.parity(b), strict=True))
        assert bits <= len(np.setxor1d(a, b))


def test_near_dedup_without_drawn_links(spark, monkeypatch):
    """Edits of one text, below and above the threshold to each other: the exact comparison alone finds the groups, as do links to drawn nodes before it."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 150)]
    texts = {}
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(1, 8))):
            words[at] = f"v{rng.integers(0, 10**9)}"
        texts[i] = " ".join(words)
    want = set(groups({i: shingles(t) for i, t in texts.items()}).values())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for rounds in (0, 2):
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        assert {r.doc_id for r in near_copies.keep_representatives(docs).collect()} == want
    assert len(want) < 150


def test_near_dedup_by_fingerprints_and_pivot_tables(spark, monkeypatch):
    """Copies with one other word are found without any band; without the tables' cells and bands only equal fingerprints are."""
    rng, rows = np.random.default_rng(4), []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1] + ["other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: [])
    left = {r.doc_id for r in near_copies.keep_representatives(docs).collect()}
    assert left >= set(range(0, 80, 2)) and len(left) < 48
    monkeypatch.setattr(simhash, "cell_keys", lambda blocks, distance: [F.xxhash64("fp")])
    prints = [near_copies.fingerprint(near_copies.shingles(t)) for _, t in rows]
    equal = sum(a == b for a, b in zip(prints[::2], prints[1::2], strict=True))
    assert near_copies.keep_representatives(docs).count() == 80 - equal and equal < 20


def test_fingerprint_is_the_majority_of_bits(monkeypatch):
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 37):
        hashes = rng.integers(0, 1 << 64, n, np.uint64)
        want = [2 * sum(int(b) for b in column) > n for column in zip(*(f"{int.from_bytes(int(h).to_bytes(8, 'little'), 'big'):064b}" for h in hashes), strict=True)] or [False] * 64
        for chunk in (8192, 5):
            monkeypatch.setattr(near_copies, "CHUNK", chunk)
            bits = near_copies.fingerprint(hashes) & (1 << 64) - 1
            assert f"{int.from_bytes(bits.to_bytes(8, 'little'), 'big'):064b}" == "".join(str(int(x)) for x in want)
