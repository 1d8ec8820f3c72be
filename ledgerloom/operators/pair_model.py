"""A small neural pair classifier: fitted in numpy on a bounded sample, applied by an Arrow-batched UDF."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled pairs that a model is fitted on at most.
SAMPLE_ROWS = 50_000


@dataclass
class PairModel:
    features: list[str]
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    threshold: float = 0.5

    def probability(self, x: np.ndarray) -> np.ndarray:
        for w, b in zip(self.weights[:-1], self.biases[:-1]):
            x = np.maximum(x @ w + b, 0)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[-1] + self.biases[-1], -40, 40)))[:, 0]


def fit(x: np.ndarray, y: np.ndarray, features: list[str], hidden: tuple[int, ...] = (32, 16), epochs: int = 60, batch: int = 64, rate: float = 1e-3, decay: float = 1e-4, patience: int = 10, seed: int = 42) -> PairModel:
    """Decoupled-decay Adam on weighted logistic loss; the epoch of lowest loss on a fifth of the rows is kept."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    val, tr = order[: len(y) // 5], order[len(y) // 5 :]
    sizes = [x.shape[1], *hidden, 1]
    params = [p for a, b in zip(sizes, sizes[1:]) for p in (r.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pos = max(1.0, (y[tr] == 0).sum() / max(1, (y[tr] == 1).sum()))
    best, kept, wait, step = np.inf, [p.copy() for p in params], 0, 0

    def forward(rows: np.ndarray) -> list[np.ndarray]:
        acts = [rows]
        for i in range(0, len(params), 2):
            z = acts[-1] @ params[i] + params[i + 1]
            acts.append(np.maximum(z, 0) if i < len(params) - 2 else z)
        return acts

    for _ in range(epochs):
        for at in range(0, len(tr), batch):
            rows = r.permutation(tr)[:batch] if at == 0 and len(tr) <= batch else tr[at : at + batch]
            acts = forward(x[rows])
            q = 1 / (1 + np.exp(-np.clip(acts[-1][:, 0], -40, 40)))
            w = np.where(y[rows] == 1, pos, 1.0)
            g = ((q - y[rows]) * w / len(rows))[:, None]
            step += 1
            for i in range(len(params) - 2, -1, -2):
                gw, gb = acts[i // 2].T @ g, g.sum(axis=0)
                if i:
                    g = (g @ params[i].T) * (acts[i // 2] > 0)
                for k, grad in ((i, gw), (i + 1, gb)):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    params[k] -= rate * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * params[k])
        q = 1 / (1 + np.exp(-np.clip(forward(x[val])[-1][:, 0], -40, 40)))
        loss = -(np.where(y[val] == 1, pos * np.log(q + 1e-9), np.log(1 - q + 1e-9))).mean() if len(val) else 0.0
        if loss < best - 1e-5:
            best, kept, wait = loss, [p.copy() for p in params], 0
        else:
            wait += 1
            if wait >= patience:
                break
        tr = r.permutation(tr)
    return PairModel(features, kept[0::2], kept[1::2])


def fit_sample(df: DataFrame, features: list[str], label: str, key: str, rows: int = SAMPLE_ROWS) -> PairModel:
    """Fit on the ``rows`` labelled pairs that come first by a hash of their key: bounded and deterministic."""
    sample = df.where(F.col(label).isNotNull()).orderBy(F.xxhash64(key), key).limit(rows).select(*features, label).toPandas()
    if sample[label].nunique() < 2:
        raise ValueError("both labels are needed")
    return fit(sample[features].to_numpy(np.float64), sample[label].to_numpy(np.float64), features)


def score(model: PairModel, *columns: Column | str) -> Column:
    """Probability that a pair is a duplicate, from the model's features in their order."""

    @F.pandas_udf(T.DoubleType())
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.stack([c.to_numpy(np.float64) for c in cols], axis=1)))

    return run(*columns)


def save(model: PairModel, path: str) -> str:
    """Write the model as JSON with a checksum over its content; an existing file is never replaced."""
    body = {"features": model.features, "threshold": model.threshold, "weights": [w.tolist() for w in model.weights], "biases": [b.tolist() for b in model.biases]}
    digest = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
    with Path(path).open("x") as f:
        json.dump(body | {"sha256": digest}, f)
    return digest


def load(path: str, features: list[str]) -> PairModel:
    """Read a model; damaged files and other feature lists are refused."""
    raw = json.loads(Path(path).read_text())
    digest = raw.pop("sha256", None)
    if digest != hashlib.sha256(json.dumps(raw, sort_keys=True).encode()).hexdigest():
        raise ValueError("the checksum does not fit")
    if raw["features"] != features:
        raise ValueError("the model was fitted on other features")
    return PairModel(raw["features"], [np.array(w) for w in raw["weights"]], [np.array(b) for b in raw["biases"]], raw["threshold"])
