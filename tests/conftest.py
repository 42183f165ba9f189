import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidegauge.session import local_session, materialise, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session("8", 4))
    yield session
    session.stop()


def walk(n: int, symbol: str = "A", seed: int = 0, gaps: bool = False) -> pd.DataFrame:
    """Hourly random-walk bars; with ``gaps`` some hours are missing."""
    rng = np.random.default_rng(seed)
    hours = np.arange(n) if not gaps else np.sort(rng.choice(2 * n, n, replace=False))
    close = 2000 * np.exp(np.cumsum(rng.normal(0, 0.004, n)))
    open_ = close + rng.normal(0, 1, n)
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"),
            "open": open_,
            "high": np.maximum(open_, close) + np.abs(rng.normal(0, 2, n)),
            "low": np.minimum(open_, close) - np.abs(rng.normal(0, 2, n)),
            "close": close,
            "volume": 0.0,
        }
    )


@pytest.fixture(scope="session")
def bars_pdf():
    return pd.concat([walk(700, "A", 0, gaps=True), walk(450, "B", 1)], ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    return materialise(spark.createDataFrame(bars_pdf))


def same(got, want, tol=1e-9):
    got, want = np.asarray(got, dtype="float64"), np.asarray(want, dtype="float64")
    assert (np.isnan(got) == np.isnan(want)).all(), "missing values differ"
    scale = np.maximum(np.abs(want), 1.0)
    assert np.nanmax(np.abs(got - want) / scale, initial=0.0) < tol
