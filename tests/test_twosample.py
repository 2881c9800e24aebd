"""The two-sample test against a plain version, label by label and tree by tree."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import twosample


def plain(x, side, fold, ids, permutations, trees, depth, bins, seed):
    cuts = [np.quantile(x[:, j], [k / bins for k in range(1, bins)]) for j in range(x.shape[1])]
    b = np.column_stack([(x[:, [j]] > cuts[j]).sum(1) for j in range(x.shape[1])])
    out = []
    for p in range(permutations + 1):
        y = side
        if p:
            u = np.array([int(hashlib.md5(f"{seed}/{p}/{i}".encode()).hexdigest()[:13], 16) for i in ids])
            y = np.zeros(len(side), int)
            y[np.argsort(u)[: side.sum()]] = 1
        scores = []
        for f in range(5):
            train, test = fold != f, fold == f
            if any((y[m] == c).sum() == 0 for m in (train, test) for c in (0, 1)):
                continue
            w = np.array([train.sum() / (2 * (y[train] == c).sum()) for c in (0, 1)])
            votes = np.zeros(test.sum())
            for t in range(trees):
                chosen = twosample.subset(seed, t, x.shape[1])

                def grow(rows, asked, left, chosen=chosen, w=w):
                    mass = np.array([w[c] * (y[rows] == c).sum() for c in (0, 1)])
                    if left:
                        best = None
                        for j in chosen:
                            for cut in range(bins - 1):
                                parts = [rows[b[rows, j] <= cut], rows[b[rows, j] > cut]]
                                if min(map(len, parts)) == 0:
                                    continue
                                gain = -(mass**2).sum() / mass.sum()
                                for part in parts:
                                    own = np.array([w[c] * (y[part] == c).sum() for c in (0, 1)])
                                    gain += (own**2).sum() / own.sum()
                                if gain > (best[0] if best else 0) + 1e-12:
                                    best = gain, j, cut, parts
                        if best:
                            _, j, cut, parts = best
                            return np.where(b[asked, j] <= cut, grow(parts[0], asked, left - 1), grow(parts[1], asked, left - 1))
                    return np.full(len(asked), mass[1] / mass.sum() if mass.sum() else 0.5)

                votes += grow(np.flatnonzero(train), np.flatnonzero(test), depth)
            hit = (votes / trees > 0.5) == (y[test] == 1)
            scores.append(np.mean([hit[y[test] == c].mean() for c in (0, 1)]))
        out.append(np.mean(scores))
    return out


@pytest.mark.parametrize("shift", [0.0, 1.2])
def test_accuracies_match_a_plain_version(spark, shift):
    rng = np.random.default_rng(4)
    n = 120
    side = (np.arange(n) % 3 == 0).astype(int)
    x = rng.normal(size=(n, 5))
    x[side == 1, 2] += shift
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "s": side, "cycle": np.arange(n) // 7, **{f"x{j}": x[:, j] for j in range(5)}})).repartition(4)
    found = twosample.accuracies(df, "id", "s", "cycle", [f"x{j}" for j in range(5)], permutations=3, trees=3, depth=2, bins=6, seed=9)
    want = plain(x, side, np.arange(n) // 7 % 5, np.arange(n), 3, 3, 2, 6, 9)
    assert [r.accuracy for r in found.orderBy("permutation").collect()] == pytest.approx(want, abs=1e-9)
    v = twosample.verdict(found).first()
    assert v.null_limit == pytest.approx(np.quantile(want[1:], 0.95)) and v.told_apart == (want[0] > v.null_limit)


def test_nothing_to_tell(spark):
    empty = spark.createDataFrame([], "id long, s int, cycle long, x double")
    assert twosample.accuracies(empty, "id", "s", "cycle", ["x"]).count() == 0
    one = spark.createDataFrame([(i, 0, i, float(i)) for i in range(20)], "id long, s int, cycle long, x double")
    assert {r.accuracy for r in twosample.accuracies(one, "id", "s", "cycle", ["x"], permutations=2, trees=2).collect()} == {None}
