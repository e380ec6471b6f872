from hydrorisk.operators import forecast
from hydrorisk.plans import risk_queries
from tests.test_forecast import SMALL, frame, labelled, prepared  # noqa: F401


class Counted:
    """A classifier that notes the rows it is fitted on."""

    def __init__(self, inner, fitted):
        self.inner, self.fitted = inner, fitted

    def copy(self):
        return Counted(self.inner.copy(), self.fitted)

    def fit(self, rows):
        self.fitted.append(rows.count())
        return self.inner.fit(rows)


def test_folds_are_fitted_on_all_rows_of_the_others(spark, prepared, monkeypatch):  # noqa: F811
    """Every row is in the training of two folds of three; a classifier sees no sample of them."""
    rows, fitted, make = prepared.count(), [], forecast._classifier
    monkeypatch.setattr(risk_queries, "FIT_ROWS", 100)
    monkeypatch.setattr(risk_queries, "_prepared", lambda *_: prepared)
    monkeypatch.setattr(forecast, "draw_params", lambda *_: SMALL)
    monkeypatch.setattr(forecast, "_classifier", lambda *a: Counted(make(*a), fitted))
    counts = risk_queries.cross_validated_model(spark, "").collect()
    assert len(fitted) == 3 and sum(fitted) == 2 * rows
    assert sum(r["rows"] for r in counts) == rows


def test_settings_are_fitted_on_all_rows_before_the_hold_out(spark, prepared, monkeypatch):  # noqa: F811
    """Each of the five settings sees the first 80 % of the rows, no sample of them."""
    rows, fitted, fit = prepared.count(), [], forecast.fit_hazard
    monkeypatch.setattr(risk_queries, "FIT_ROWS", 100)
    monkeypatch.setattr(risk_queries, "_prepared", lambda *_: prepared)
    monkeypatch.setattr(forecast, "draw_params", lambda *_: SMALL)
    monkeypatch.setattr(forecast, "fit_hazard", lambda df, *a: (fitted.append(df.count()), fit(df, *a))[1])
    tried = risk_queries.tuned_model(spark, "").collect()
    assert fitted == [int(0.8 * rows)] * 5
    assert {r["holdout_rows"] for r in tried} == {rows - int(0.8 * rows)}
