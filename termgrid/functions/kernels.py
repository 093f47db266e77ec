"""Small numpy kernels that tasks run on one series or one sample: unit-root regressions and mixture fits."""

from __future__ import annotations

import numpy as np

from .special import unit_root_p


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their deviations and the residuals."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = e @ e / max(len(y) - x.shape[1], 1)
    return beta, np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)) * s2, 0)), e


def adf(y: np.ndarray, constant: bool = True, variables: int = 1) -> tuple[float, float, int, int] | None:
    """Statistic, p, lags by AIC and observations of an augmented Dickey-Fuller regression; null for a constant or short series."""
    n = len(y)
    longest = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    if n < 12 or np.ptp(y) == 0 or longest < 0:
        return None
    d = np.diff(y)

    def design(lags: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        columns = [y[first:-1]] + [d[first - k : len(d) - k] for k in range(1, lags + 1)] + ([np.ones(len(d) - first)] if constant else [])
        return np.column_stack(columns), d[first:]

    def aic(lags: int) -> float:
        x, z = design(lags, longest)
        e = ols(x, z)[2]
        return len(z) * np.log(max(e @ e / len(z), 1e-300)) + 2 * x.shape[1]

    lags = min(range(longest + 1), key=lambda k: (aic(k), k))
    x, z = design(lags, lags)
    beta, se, _ = ols(x, z)
    if se[0] == 0:
        return None
    stat = float(beta[0] / se[0])
    return stat, unit_root_p(stat, variables), lags, len(z)


def coint(y: np.ndarray, x: np.ndarray) -> tuple[float, float] | None:
    """Statistic and p of the unit-root test on the residuals of y on x with a constant."""
    e = ols(np.column_stack([x, np.ones(len(x))]), y)[2]
    got = adf(e, constant=False, variables=2)
    return got and got[:2]


# ---------------------------------------------------------------- mixtures


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Of each row and component the log of the density: all components' whitened rows come from one product."""
    k, d = means.shape
    low = np.linalg.cholesky(covs)
    white = np.linalg.inv(low)
    z = x @ white.reshape(k * d, d).T - np.einsum("kij,kj->ki", white, means).ravel()
    np.multiply(z, z, out=z)
    scale = np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1) + 0.5 * d * np.log(2 * np.pi)
    return -0.5 * z.reshape(len(x), k, d).sum(axis=2) - scale


def covariances_of(full: np.ndarray, n: np.ndarray, kind: str, floor: float) -> np.ndarray:
    """Covariances of a kind from the components' own full ones and their weights n."""
    d = full.shape[1]
    if kind == "tied":
        full = np.repeat((full * n[:, None, None]).sum(axis=0, keepdims=True) / n.sum(), len(full), axis=0)
    elif kind == "diag":
        full = np.stack([np.diag(np.diag(c)) for c in full])
    elif kind == "spherical":
        full = np.stack([np.eye(d) * np.trace(c) / d for c in full])
    return full + np.eye(d) * floor


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        far = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]])
    label = None
    for _ in range(rounds):
        new = ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
        if label is not None and (new == label).all():
            break
        label = new
        of = np.eye(k)[label]
        n = of.sum(axis=0)
        centres = np.where(n[:, None] > 0, (of.T @ x) / np.maximum(n, 1)[:, None], centres)
    return label


def gmm(x: np.ndarray, k: int, kind: str = "full", seed: int = 0, starts: int = 10, rounds: int = 100, floor: float = 1e-5, labels: list[np.ndarray] | None = None) -> dict:
    """The best of several EM fits, from k-means clusterings or from given labels: loglik, weights, means, covs, post."""
    best, products = None, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    for s in range(len(labels) if labels else starts):
        rng = np.random.default_rng([seed, s])
        r = np.eye(k)[labels[s] if labels else kmeans(x, k, rng)]
        before = -np.inf
        for _ in range(rounds):
            n = r.sum(axis=0) + 1e-12
            weights, means = n / len(x), (r.T @ x) / n[:, None]
            own = (r.T @ products).reshape(k, x.shape[1], -1) / n[:, None, None] - means[:, :, None] * means[:, None, :]
            covs = covariances_of(own, n, kind, floor)
            joint = log_density(x, means, covs) + np.log(weights)
            top = joint.max(axis=1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
            r = np.exp(joint - total[:, None])
            if total.sum() - before < 1e-4 * len(x):
                break
            before = total.sum()
        if best is None or total.sum() > best["loglik"]:
            best = {"loglik": float(total.sum()), "weights": weights, "means": means, "covs": covs, "post": r}
    return best


def posteriors(fit: dict, x: np.ndarray) -> np.ndarray:
    joint = log_density(x, fit["means"], fit["covs"]) + np.log(fit["weights"])
    r = np.exp(joint - joint.max(axis=1, keepdims=True))
    return r / r.sum(axis=1, keepdims=True)


def assign(fit: dict, x: np.ndarray) -> np.ndarray:
    return (log_density(x, fit["means"], fit["covs"]) + np.log(fit["weights"])).argmax(axis=1)


def n_params(k: int, d: int, kind: str) -> int:
    cov = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[kind]
    return k - 1 + k * d + cov


def silhouette(x: np.ndarray, label: np.ndarray) -> float | None:
    """Mean Euclidean silhouette; null with one cluster. For one sample in one task."""
    names = np.unique(label)
    if len(names) < 2:
        return None
    size = np.array([(label == a).sum() for a in names])
    own = np.searchsorted(names, label)
    total = 0.0
    for lo in range(0, len(x), 512):
        d = np.sqrt(np.maximum(((x[lo : lo + 512, None] - x[None]) ** 2).sum(axis=2), 0))
        sums = np.stack([d[:, label == a].sum(axis=1) for a in names], axis=1)
        i = np.arange(len(d))
        o = own[lo : lo + 512]
        a = sums[i, o] / np.maximum(size[o] - 1, 1)
        mean = sums / size
        mean[i, o] = np.inf
        b = mean.min(axis=1)
        total += np.where(size[o] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).sum()
    return float(total / len(x))


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    _, i = np.unique(a, return_inverse=True)
    _, j = np.unique(b, return_inverse=True)
    table = np.zeros((i.max() + 1, j.max() + 1))
    np.add.at(table, (i, j), 1)
    pairs = lambda v: float((v * (v - 1) / 2).sum())
    both, rows, cols, all_ = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0)), pairs(np.array([len(a)]))
    expected, top = rows * cols / all_ if all_ else 0.0, (rows + cols) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by Ward's criterion, nearest-neighbour chain. For one sample in one task."""
    n = len(x)
    centre, size, alive, label = x.astype(float).copy(), np.ones(n), np.ones(n, dtype=bool), np.arange(n)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        d = size * size[a] / (size + size[a]) * ((centre - centre[a]) ** 2).sum(axis=1)
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
            chain = chain[:-2]
            merges.append((float(d[b]), a, b))
            centre[b] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
            size[b] += size[a]
            alive[a] = False
        else:
            chain.append(b)
    for _, a, b in sorted(merges)[: n - k]:
        label[label == label[a]] = label[b]
    return np.unique(label, return_inverse=True)[1]
