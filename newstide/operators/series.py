"""Stationarity and dependence of one series: ADF, KPSS, autocorrelations, Ljung-Box, ARCH-LM and CUSUM."""

from __future__ import annotations

import math


def acf(x, lags: int):
    import numpy as np

    d = np.asarray(x, float) - np.mean(x)
    return np.array([(d[k:] @ d[: len(d) - k]) / (d @ d) for k in range(1, lags + 1)])


def pacf(x, lags: int):
    """Partial autocorrelations by Durbin and Levinson's recursion over the biased autocorrelations."""
    import numpy as np

    r = np.concatenate(([1.0], acf(x, lags)))
    phi, out = np.zeros((lags + 1, lags + 1)), []
    for k in range(1, lags + 1):
        before = phi[k - 1, 1:k]
        phi[k, k] = (r[k] - before @ r[k - 1 : 0 : -1]) / (1 - before @ r[1:k])
        phi[k, 1:k] = before - phi[k, k] * before[::-1]
        out.append(phi[k, k])
    return np.array(out)


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom: the regularised incomplete gamma function, by series or continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def ljung_box(x, lags: int) -> tuple[float, float]:
    import numpy as np

    n, r = len(x), acf(x, lags)
    q = float(n * (n + 2) * (r**2 / (n - np.arange(1, lags + 1))).sum())
    return q, chi2_sf(q, lags)


def arch_lm(x, lags: int) -> tuple[float, float]:
    """Engle's test: R2 times n of the squared values' regression on their lags."""
    import numpy as np

    e = (np.asarray(x, float)) ** 2
    y = e[lags:]
    a = np.column_stack([np.ones(len(y)), *(e[lags - k : len(e) - k] for k in range(1, lags + 1))])
    rest = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    lm = float(len(y) * (1 - rest @ rest / ((y - y.mean()) ** 2).sum()))
    return lm, chi2_sf(lm, lags)


def _adf_fit(x, k: int, start: int):
    """t of the level, residual sum, rows and columns of the regression with k differences, over rows from start."""
    import numpy as np

    d = np.diff(x)
    y = d[start:]
    a = np.column_stack([np.ones(len(y)), x[start:-1], *(d[start - j : len(d) - j] for j in range(1, k + 1))])
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    rest = y - a @ b
    s2 = rest @ rest / (len(y) - a.shape[1])
    return float(b[1] / math.sqrt(s2 * np.linalg.inv(a.T @ a)[1, 1])), float(rest @ rest), len(y), a.shape[1]


#: MacKinnon's (2010) response surface of the Dickey-Fuller distribution with a constant, by level.
ADF_CRITICAL = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}
#: Levels of the KPSS statistic about a constant, and of the CUSUM's supremum.
KPSS_CRITICAL = {0.10: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}


def adf(x) -> tuple[float, int, float]:
    """(statistic, lags by AIC, 5 % critical value) of the augmented Dickey-Fuller test with a constant."""
    import numpy as np

    x = np.asarray(x, float)
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    aic = []
    for k in range(most + 1):  # all on the same rows
        _, rss, rows, cols = _adf_fit(x, k, most)
        aic.append(rows * math.log(rss / rows) + 2 * cols)
    k = int(np.argmin(aic))
    t, _, rows, _ = _adf_fit(x, k, k)
    b = ADF_CRITICAL[0.05]
    return t, k, b[0] + b[1] / rows + b[2] / rows**2 + b[3] / rows**3


def kpss(x) -> tuple[float, int, float]:
    """(statistic, lags, p within 0.01 to 0.10) about a constant, lags by Hobijn, Franses and Ooms."""
    import numpy as np

    e = np.asarray(x, float) - np.mean(x)
    n = len(e)
    most = int(n ** (2 / 9))
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, most + 1):
        c = 2 * float(e[i:] @ e[: n - i]) / n
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0, n - 1)
    v = float(e @ e)
    for i in range(1, lags + 1):
        v += 2 * (1 - i / (lags + 1)) * float(e[i:] @ e[: n - i])
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / (v / n))
    levels = sorted(KPSS_CRITICAL.items(), key=lambda kv: kv[1])
    return stat, lags, float(np.interp(stat, [c for _, c in levels], [p for p, _ in levels]))


def cusum(x) -> tuple[float, float]:
    """(supremum, p) of the cumulated residuals about a constant mean, against the Brownian bridge."""
    import numpy as np

    e = np.asarray(x, float) - np.mean(x)
    sup = float(np.abs(np.cumsum(e)).max() / math.sqrt((e @ e) / (len(e) - 1) * len(e)))
    p = 2 * sum((-1) ** (k + 1) * math.exp(-2 * k * k * sup * sup) for k in range(1, 101)) if sup > 0.2 else 1.0
    return sup, min(1.0, max(0.0, p))


def battery(x, lags: int = 20) -> list[tuple[str, int, float, float | None]]:
    """(test, lag, statistic, p or critical value) of the whole battery for one series."""
    a, p = acf(x, lags), pacf(x, lags)
    out = [("acf", k, float(v), None) for k, v in enumerate(a, 1)] + [("pacf", k, float(v), None) for k, v in enumerate(p, 1)]
    out += [("ljung_box", k, *ljung_box(x, k)) for k in (5, 10, 20)]
    out += [("arch_lm", k, *arch_lm(x, k)) for k in (5, 10)]
    stat, k, bar = adf(x)
    out.append(("adf", k, stat, bar))
    stat, k, level = kpss(x)
    out += [("kpss", k, stat, level), ("cusum", 0, *cusum(x))]
    return out
