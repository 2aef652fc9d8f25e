"""Small random fixtures."""

from __future__ import annotations

import numpy as np
import pandas as pd


def random_bars(n: int, symbols=("EUR_USD", "USD_JPY"), seed: int = 42, step: str = "1h") -> pd.DataFrame:
    """Random walk whose open is the close before, with a high/low envelope."""
    rng = np.random.default_rng(seed)
    parts = []
    for s in symbols:
        close = 1.1 + np.cumsum(rng.normal(0, 0.001, n))
        open_ = np.concatenate([[1.1], close[:-1]])
        pad = rng.uniform(0, 0.0005, n)
        parts.append(
            pd.DataFrame(
                {
                    "symbol": s,
                    "ts": pd.date_range("2024-01-01", periods=n, freq=step),
                    "open": open_,
                    "high": np.maximum(open_, close) + pad,
                    "low": np.minimum(open_, close) - pad,
                    "close": close,
                    "volume": rng.integers(1, 1000, n),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def same(a: pd.Series, b: pd.Series, tol: float = 1e-9) -> None:
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.nanmax(np.abs(a - b), initial=0) <= tol
