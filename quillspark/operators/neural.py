"""Small networks as batch functions, and vector math as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let


def log_softmax(v: Column) -> Column:
    """Shifted by the largest, so no exponent overflows; the largest and the sum are computed once."""

    def shifted(x: Column, top: Column) -> Column:
        total = F.ln(F.aggregate(x, F.lit(0.0), lambda a, e: a + F.exp(e - top)))
        return let(total, lambda t: F.transform(x, lambda e: e - top - t))

    return let(v.cast("array<double>"), lambda x: let(F.array_max(x), lambda top: shifted(x, top)))


def dense(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """``W x + b`` inside the JVM; for small layers."""
    rows = [F.aggregate(F.zip_with(v, F.array(*map(F.lit, w)), lambda a, c: a * c), F.lit(float(b)), lambda s, x: s + x) for w, b in zip(weights, bias)]
    return F.array(*rows)


def rmsnorm(v: Column, eps: float = 1e-6) -> Column:
    def scaled(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e) / F.size(x)
        return let(F.sqrt(mean + eps), lambda r: F.transform(x, lambda e: e / r))

    return let(v.cast("array<double>"), scaled)


def silu(v: Column) -> Column:
    return F.transform(v.cast("array<double>"), lambda x: x / (1 + F.exp(-x)))


def rope(v: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotate the halves of a vector by position; element i pairs with i + n / 2."""
    v = v.cast("array<double>")
    half = (F.size(v) / 2).cast("int")
    angle = lambda i: position / F.pow(F.lit(base), i / half)
    first = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.get(v, i) * F.cos(angle(i)) - F.get(v, i + half) * F.sin(angle(i)))
    second = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.get(v, i + half) * F.cos(angle(i)) + F.get(v, i) * F.sin(angle(i)))
    return F.concat(first, second)


def kl(p_logits: Column, q_logits: Column) -> Column:
    """Divergence of two softmax distributions."""
    return F.aggregate(F.zip_with(log_softmax(p_logits), log_softmax(q_logits), lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda a, x: a + x)


class Convolutional:
    """conv 3x3, relu, pool, conv 3x3, relu, pool, concatenated features, dense, relu, dense, log-softmax."""

    def __init__(self, side: int, features: int, classes: int, channels=(4, 8), hidden: int = 16, seed: int = 0):
        import numpy as np

        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(np.prod(s[1:])), s)
        flat = channels[1] * (side // 4) ** 2
        self.w = [draw(channels[0], 1, 3, 3), draw(channels[1], channels[0], 3, 3), draw(hidden, flat + features), draw(classes, hidden)]

    @staticmethod
    def conv(x, w):
        """Zero-padded, same size; ``x`` is (n, channels, h, w)."""
        import numpy as np

        n, _, h, k = x.shape
        p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
        return sum(np.einsum("nchw,oc->nohw", p[:, :, a : a + h, b : b + k], w[:, :, a, b]) for a in range(3) for b in range(3))

    @staticmethod
    def pool(x):
        n, c, h, w = x.shape
        return x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).max((3, 5))

    def forward(self, x, features):
        import numpy as np

        for w in self.w[:2]:
            x = self.pool(np.maximum(self.conv(x, w), 0))
        z = np.maximum(np.concatenate([x.reshape(len(x), -1), features], 1) @ self.w[2].T, 0) @ self.w[3].T
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def classify(images: DataFrame, network: Convolutional, raster: str, features: str, side: int) -> Column:
    """Log-probabilities of a batch; the weights are bounded and travel with the function."""

    @F.pandas_udf("array<double>")
    def run(a, b):
        import numpy as np
        import pandas as pd

        x = np.array(a.tolist(), float).reshape(-1, 1, side, side)
        return pd.Series(network.forward(x, np.array(b.tolist(), float)).tolist())

    return run(raster, features)


def load_status(table: dict | None, version: int) -> str:
    """Absent, unsupported, malformed or loaded; anything but loaded falls back to the prototypes."""
    if table is None:
        return "absent"
    if table.get("version") != version:
        return "unsupported"
    return "loaded" if table.get("layers") and all(len(x) for x in table["layers"]) else "malformed"


def load_status(present: Column, supported: Column, well_formed: Column) -> Column:
    """What loading a network's tables comes to; anything but ``Loaded`` falls back to prototypes."""
    return F.when(~present, "Absent").when(~supported, "Unsupported").when(~well_formed, "Malformed").otherwise("Loaded")
