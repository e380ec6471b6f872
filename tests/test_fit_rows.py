from hydrorisk.operators import forecast
from hydrorisk.operators.metrics import confusion
from hydrorisk.plans import risk_queries
from hydrorisk.session import settle
from tests.test_forecast import SMALL, frame, labelled, prepared  # noqa: F401


def test_queries_score_all_rows_held_out(spark, prepared, monkeypatch):  # noqa: F811
    """The bound of the rows fitted on leaves the rows that are scored alone."""
    rows, scored, fitted = prepared.count(), [], []
    monkeypatch.setattr(risk_queries, "FIT_ROWS", 100)
    monkeypatch.setattr(risk_queries, "_prepared", lambda *_: prepared)
    monkeypatch.setattr(forecast, "draw_params", lambda *_: SMALL)

    def counted(predicted, *args, **kwargs):
        scored.append(predicted.count())
        return confusion(predicted, *args, **kwargs)

    monkeypatch.setattr(forecast, "confusion", counted)
    risk_queries.cross_validated_model(spark, "")
    assert scored == [rows]

    match, fit = forecast.exact_match, forecast.fit_hazard
    scored.clear()
    monkeypatch.setattr(forecast, "exact_match", lambda p: (scored.append(p.count()), match(p))[1])
    monkeypatch.setattr(
        forecast, "fit_hazard", lambda df, *a: (fitted.append(df.count()), fit(df, *a))[1]
    )
    forecast.tune_hazard(settle(prepared), candidates=[SMALL], fit_rows=100)
    assert fitted == [100] and abs(scored[0] - rows / 5) <= 1
