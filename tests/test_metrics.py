import numpy as np
import pytest

from hydrorisk.operators import metrics


def brute(pairs):
    """Metrics of (true, predicted) pairs by their textbook definitions."""
    classes = sorted({c for pair in pairs for c in pair})
    place = {c: i for i, c in enumerate(classes)}
    k, n = len(classes), len(pairs)
    seen = np.zeros((k, k))
    for t, p in pairs:
        seen[place[t], place[p]] += 1
    w = np.subtract.outer(np.arange(k), np.arange(k)) ** 2
    chance = np.outer(seen.sum(1), seen.sum(0)) / n
    f1 = []
    for i in range(k):
        size = seen[i].sum() + seen[:, i].sum()
        f1.append(2 * seen[i, i] / size if size else 0.0)
    kappa = 1 - (w * seen).sum() / (w * chance).sum() if (w * chance).sum() else None
    return (
        np.trace(seen) / n,
        float(np.mean(f1)),
        float(np.dot(f1, seen.sum(1)) / n),
        kappa,
    )


CASES = {
    "hand": [(0, 0)] * 50 + [(0, 1)] * 5 + [(1, 1)] * 7 + [(1, 3)] * 2 + [(2, 2)] * 3 + [(3, 0)] * 4,
    "missing class": [(0, 0)] * 5 + [(0, 3)] * 2 + [(3, 3)] * 4 + [(1, 3)],
    "one class": [(0, 0)] * 6,
    "never right": [(0, 1)] * 3 + [(1, 2)] * 4,
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(name, t, p) for name, pairs in CASES.items() for t, p in pairs]
    df = spark.createDataFrame(rows, "name string, y_true int, y_pred int")
    counts = metrics.confusion(df, by=["name"])
    return {r["name"]: r for r in metrics.metric_table(counts, ["name"]).collect()}


@pytest.mark.parametrize("name", CASES)
def test_metric_table(table, name):
    row = table[name]
    got = (row["accuracy"], row["f1_macro"], row["f1_weighted"], row["kappa"])
    assert got == pytest.approx(brute(CASES[name]))


def test_hand_worked_values(table):
    assert table["hand"]["accuracy"] == pytest.approx(60 / 71)
    assert table["missing class"]["f1_macro"] == pytest.approx((10 / 12 + 0 + 8 / 11) / 3)
    assert table["one class"]["kappa"] is None


def test_ungrouped_metrics(spark):
    df = spark.createDataFrame(CASES["hand"], "y_true int, y_pred int")
    counts = metrics.confusion(df)
    expected = brute(CASES["hand"])
    assert metrics.accuracy(counts).first()[0] == pytest.approx(expected[0])
    assert tuple(metrics.f1_scores(counts).first()) == pytest.approx(expected[1:3])
    assert metrics.quadratic_kappa(counts).first()[0] == pytest.approx(expected[3])


def test_evaluation_of_three_horizons(spark):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 4, (500, 3))
    guess = np.where(rng.random((500, 3)) < 0.6, rows, rng.integers(0, 4, (500, 3)))
    df = spark.createDataFrame(
        [tuple(map(int, [*a, *b])) for a, b in zip(rows, guess)],
        ", ".join([f"target_day{h} int" for h in (1, 2, 3)] + [f"predicted_day{h} int" for h in (1, 2, 3)]),
    )
    got = {r["horizon"]: r for r in metrics.evaluate_predictions(df, "flood").collect()}
    exact = (rows == guess).all(axis=1).mean()
    for h in (1, 2, 3):
        expected = brute(list(zip(rows[:, h - 1].tolist(), guess[:, h - 1].tolist())))
        row = got[h]
        assert row["hazard"] == "flood" and row["exact_match"] == pytest.approx(exact)
        assert (row["accuracy"], row["f1_macro"], row["f1_weighted"], row["kappa"]) == pytest.approx(expected)


def test_against_the_majority_class(spark):
    counts = spark.createDataFrame(
        [(1, 0, 0, 6), (1, 1, 1, 2), (1, 1, 0, 2), (2, 0, 1, 3), (2, 1, 1, 3)],
        "horizon int, y_true int, y_pred int, rows bigint",
    )
    found = {r["horizon"]: r for r in metrics.against_majority(counts, ["horizon"]).collect()}
    # Always 0: F1 12/16 and 0; a tie goes to the smaller class: F1 6/9 and 0.
    assert found[1]["majority_f1_macro"] == pytest.approx(0.375)
    assert found[1]["f1_macro"] == pytest.approx((12 / 14 + 4 / 6) / 2)
    assert found[2]["majority_f1_macro"] == pytest.approx(1 / 3)
