"""Beta-binomial damage fits: bounded quasi-Newton in numpy, restarts, bootstrap and confidence intervals."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of A, q, c and phi.
LOW, HIGH = np.array([1e-8, 1e-8, 1e-8, 2.0]), np.array([1 - 1e-8, 1 - 1e-8, 0.25, 1e7])
START = np.array([0.1, 0.1, 0.01, 1000.0])
NAMES = ("A", "q", "c", "phi")


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive arguments: shift beyond 8, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    for _ in range(8):
        small = x < 8
        shift = np.where(small, shift * x, shift)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def log_likelihood(p: np.ndarray, x: np.ndarray, k: np.ndarray, n: np.ndarray) -> float:
    a, q, c, phi = p
    d = np.clip(a * (1 - q) ** np.abs(x) + c, 1e-12, 1 - 1e-12)
    al, be = d * phi, (1 - d) * phi
    return float(np.sum(lgamma(n + 1) + lgamma(k + al) + lgamma(n - k + be) + lgamma(al + be) - lgamma(k + 1) - lgamma(n - k + 1) - lgamma(al) - lgamma(be) - lgamma(n + al + be)))


def _free(p):  # bounded -> unbounded: logit, and log for phi
    u = (p - LOW) / (HIGH - LOW)
    u = np.clip(u, 1e-12, 1 - 1e-12)
    out = np.log(u / (1 - u))
    out[3] = math.log(max(p[3] - LOW[3], 1e-6))
    return out


def _bound(y):
    y = np.clip(y, -40, 40)
    out = LOW + (HIGH - LOW) / (1 + np.exp(-y))
    out[3] = min(HIGH[3], LOW[3] + math.exp(min(y[3], 16)))
    return out


def minimise(f, y: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float, int]:
    """BFGS with a numeric gradient and backtracking; arguments, value, calls."""
    calls = 0

    def value(v):
        nonlocal calls
        calls += 1
        out = f(v)
        return out if np.isfinite(out) else 1e300

    def gradient(v, at):
        out = np.empty(len(v))
        for i in range(len(v)):
            h = 1e-6 * max(1.0, abs(v[i]))
            w = v.copy()
            w[i] += h
            out[i] = (value(w) - at) / h
        return out

    n = len(y)
    inverse, now = np.eye(n), value(y)
    g = gradient(y, now)
    for _ in range(steps):
        way = -inverse @ g
        if way @ g >= 0:
            inverse, way = np.eye(n), -g
        t, slope = min(1.0, 5 / (np.abs(way).max() + 1e-12)), way @ g
        while t > 1e-10:
            new = y + t * way
            then = value(new)
            if then <= now + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        g2 = gradient(new, then)
        s, d = new - y, g2 - g
        gain = now - then
        y, now, g = new, then, g2
        if np.abs(g).max() < 1e-4 or gain < 1e-10 * (abs(now) + 1):
            break
        sd = s @ d
        if sd > 1e-12:
            rho = 1 / sd
            left = np.eye(n) - rho * np.outer(s, d)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
    return y, now, calls


def best_fit(x, k, n, restarts: int, rng) -> tuple[np.ndarray, float, int]:
    """Parameters, log-likelihood and calls of the best of 1 + restarts runs."""
    f = lambda y: -log_likelihood(_bound(y), x, k, n)
    best, calls = None, 0
    for i in range(restarts + 1):
        p = START if i == 0 else np.array([rng.uniform(0.1, 0.9), rng.uniform(), 0.01 + 0.1 * rng.uniform(), 2 + 8 * rng.uniform()])
        y, low, c = minimise(f, _free(p))
        calls += c
        if best is None or low < best[1]:
            best = (_bound(y), low)
    return best[0], -best[1], calls


def spread(p: np.ndarray, x: np.ndarray, n: np.ndarray) -> dict:
    """Old and new standard deviation and Z of A, the curve, and its normalised deviation by position."""
    a, q, c, phi = p
    w = (1 - q) ** np.abs(x)
    out = {}
    for name, m in (("old", max(1.0, float(n[0]))), ("new", max(1.0, float((n * w * w).sum())))):
        sd = math.sqrt(a * (1 - a) * (phi + m) / ((phi + 1) * m))
        out[f"sigmaD_{name}"], out[f"Zfit_{name}"] = sd, a / sd
    d = a * w + c
    al, be = d * phi, (1 - d) * phi
    with np.errstate(divide="ignore", invalid="ignore"):
        out["dx_conf"] = np.sqrt(n * al * be * (al + be + n) / ((al + be) ** 2 * (al + be + 1))) / n
    out["dx"] = d
    return out


def spreads(kn: DataFrame, p: np.ndarray) -> DataFrame:
    """kn(taxid, k, n, total: arrays) -> the deviations and Z of `spread` at the parameters p."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                n = np.asarray(r.n, float)
                rows.append((int(r.taxid), *(spread(p, np.tile(np.arange(len(n) // 2), 2), n)[s] for s in ("sigmaD_old", "Zfit_old", "sigmaD_new", "Zfit_new"))))
            yield pd.DataFrame(rows, columns=["taxid", "sigmaD_old", "Zfit_old", "sigmaD_new", "Zfit_new"])

    return kn.mapInPandas(run, "taxid long, sigmaD_old double, Zfit_old double, sigmaD_new double, Zfit_new double")


def interval(values: np.ndarray, level: float, kind: int) -> tuple[float, float]:
    """kind 1: normal, around the mean; kind 2: order statistics."""
    if kind == 1:
        half = NormalDist().inv_cdf(1 - (1 - level) / 2) * values.std(ddof=1)
        return values.mean() - half, values.mean() + half
    ordered, cut = np.sort(values), math.ceil(len(values) * ((1 - level) / 2))
    return ordered[min(cut, len(values) - 1)], ordered[max(0, len(values) - cut - 1)]


def resample(kind: int, k: np.ndarray, n: np.ndarray, total: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """1: k of fixed n; 2 and 3: n of all bases too."""
    share = np.divide(k, n, out=np.zeros_like(k), where=n > 0)
    if kind == 1:
        return rng.binomial(n.astype(np.int64), share).astype(float), n
    m = rng.binomial(total.astype(np.int64), np.divide(n, total, out=np.zeros_like(n), where=total > 0))
    return rng.binomial(m, share).astype(float), m.astype(float)


def fit_row(taxid: int, k, n, total, restarts: int, boots: int, kind: int, level: float, ci: int, seed: int, printed: bool = False) -> dict:
    """One taxon's fit. k, n, total: 5' positions, then 3' positions."""
    k, n, total = (np.asarray(v, float) for v in (k, n, total))
    x = np.tile(np.arange(len(k) // 2), 2)
    rng = np.random.default_rng([seed, taxid])
    p, llh, calls = best_fit(x, k, n, restarts, rng)
    got = spread(p, x, n)
    out = {"taxid": taxid, **dict(zip(NAMES, map(float, p))), "llh": llh, "ncall": calls, **{s: got[s] for s in ("sigmaD_old", "Zfit_old", "sigmaD_new", "Zfit_new")}}
    out |= {"K": k.tolist(), "N": n.tolist(), "f": np.divide(k, n, out=np.zeros_like(k), where=n > 0).tolist(), "dx": got["dx"].tolist(), "dx_conf": got["dx_conf"].tolist()}
    if boots > 1:
        runs = np.array([best_fit(x, *resample(kind, k, n, total, rng), restarts, rng)[0] for _ in range(boots)])
        out["boot"] = runs.ravel().tolist()
        for i, name in enumerate(NAMES):
            out[f"{name}_b"] = float(runs[:, i].mean())
            out[f"{name}_CI_l"], out[f"{name}_CI_h"] = map(float, interval(runs[:, i], level, ci))
    return out


FIELDS = "taxid int, A double, q double, c double, phi double, llh double, ncall int, sigmaD_old double, Zfit_old double, sigmaD_new double, Zfit_new double, K array<double>, N array<double>, f array<double>, dx array<double>, dx_conf array<double>"
BOOT = ", boot array<double>, " + ", ".join(f"{n}_b double, {n}_CI_l double, {n}_CI_h double" for n in NAMES)


def fit(kn: DataFrame, nopt: int = 10, nbootstrap: int = 1, sigtype: int = 1, ci: float = 0.95, do_ci: int = 2, seed: int = 1) -> DataFrame:
    """kn(taxid, k, n, total: arrays) -> one row of fit for each taxon. Taxa are dealt evenly; no shuffle by group is needed."""
    names = [f.split()[0] for f in (FIELDS + (BOOT if nbootstrap > 1 else "")).split(", ")]

    def run(frames):
        for frame in frames:
            rows = [fit_row(int(r.taxid), r.k, r.n, r.total, nopt, nbootstrap, sigtype, ci, do_ci, seed) for r in frame.itertuples()]
            yield pd.DataFrame(rows, columns=names)

    return kn.repartition("taxid").mapInPandas(run, FIELDS + (BOOT if nbootstrap > 1 else ""))


def llh_udf():
    """Arrow UDF (A, q, c, phi, k array, n array) -> log-likelihood at fixed parameters."""

    @F.pandas_udf("double")
    def run(a: pd.Series, q: pd.Series, c: pd.Series, phi: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for *p, kk, nn in zip(a, q, c, phi, k, n, strict=True):
            kk, nn = np.asarray(kk, float), np.asarray(nn, float)
            out.append(log_likelihood(np.array(p), np.tile(np.arange(len(kk) // 2), 2), kk, nn))
        return pd.Series(out)

    return run


def softmax_fit(x: np.ndarray, counts: np.ndarray, order: int = 6, steps: int = 300) -> np.ndarray:
    """Multinomial logit of counts (rows, classes) on a polynomial of x; coefficients (order + 1, classes - 1), last class as base."""
    scaled = x / max(1.0, np.abs(x).max())
    basis = np.vander(scaled, order + 1, increasing=True)
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    beta = np.linalg.lstsq(basis, np.log(share[:, :-1] / share[:, -1:]), rcond=None)[0]
    total = counts.sum(1, keepdims=True)
    for _ in range(steps):  # Newton with a little damping, class by class
        p = softmax(basis @ beta)
        grad = basis.T @ (counts[:, :-1] - total * p[:, :-1])
        move = np.stack([np.linalg.solve(basis.T @ (basis * (total[:, 0] * p[:, j] * (1 - p[:, j]))[:, None]) + 1e-6 * np.eye(order + 1), grad[:, j]) for j in range(beta.shape[1])], 1)
        beta = beta + 0.5 * move
        if np.abs(move).max() < 1e-8:
            break
    return beta


def logit_fits(x: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares by a linear fit of the log ratios to the last class, shares by the multinomial fit, and its coefficients."""
    basis = np.vander(x / max(1.0, np.abs(x).max()), order + 1, increasing=True)
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    linear = np.linalg.lstsq(basis, np.log(share[:, :-1] / share[:, -1:]), rcond=None)[0]
    beta = softmax_fit(x, counts, order)
    return softmax(basis @ linear), softmax(basis @ beta), beta


def softmax(eta: np.ndarray) -> np.ndarray:
    full = np.concatenate([eta, np.zeros((len(eta), 1))], 1)
    full = np.exp(full - full.max(1, keepdims=True))
    return full / full.sum(1, keepdims=True)
