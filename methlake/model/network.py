"""The network on one batch of rows inside a task.

first.0 (features to rank, no bias) > first.1 > ln1 > SiLU > residual blocks trunk.i.lin > trunk.i.ln > SiLU >
heads.<head>.0 > heads.<head>.1 > SiLU > heads.<head>.4. In training a dropout factor follows each LayerNorm.
"""

from __future__ import annotations

import numpy as np

from methlake.functions.numeric import LAYER_NORM_EPS, MASK_PENALTY

FIRST = "first.0.weight"


def stage_names(head: str, depth: int) -> list[tuple[str, str]]:
    """(linear, norm) of every stage, in forward order."""
    trunk = [(f"trunk.{i}.lin", f"trunk.{i}.ln") for i in range(depth)]
    return [("first.1", "ln1"), *trunk, (f"heads.{head}.0", f"heads.{head}.1")]


def trunk_depth(names) -> int:
    depth = 0
    while f"trunk.{depth}.lin.weight" in names:
        depth += 1
    return depth


def head_names(names) -> list[str]:
    return sorted(n[len("heads.") : -len(".4.weight")] for n in names if n.startswith("heads.") and n.endswith(".4.weight"))


def trainable_names(head: str, depth: int) -> list[str]:
    """Every parameter above the first projection."""
    stages = [f"{part}.{kind}" for pair in stage_names(head, depth) for part in pair for kind in ("weight", "bias")]
    return [*stages, f"heads.{head}.4.weight", f"heads.{head}.4.bias"]


def project(w0: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """A ternary row times the first matrix: sums of the columns it names, in double precision."""
    return w0[:, plus].sum(1, dtype=np.float64) - w0[:, minus].sum(1, dtype=np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def forward(w: dict, z: np.ndarray, head: str, depth: int, drop: list[np.ndarray] | None = None):
    """Logits of projected rows, and what `backward` needs of every stage."""
    kept, h = [], z
    for i, (lin, norm) in enumerate(stage_names(head, depth)):
        u = h @ w[f"{lin}.weight"].T + w[f"{lin}.bias"]
        centred = u - u.mean(1, keepdims=True)
        inv = 1.0 / np.sqrt((centred * centred).mean(1, keepdims=True) + LAYER_NORM_EPS)
        xhat = centred * inv
        a = xhat * w[f"{norm}.weight"] + w[f"{norm}.bias"]
        if drop is not None:
            a = a * drop[i]
        kept.append((h, xhat, inv, a))
        out = a * _sigmoid(a)
        h = h + out if 0 < i <= depth else out
    logits = h @ w[f"heads.{head}.4.weight"].T + w[f"heads.{head}.4.bias"]
    return logits, (kept, h)


def backward(w: dict, trace, dlogits: np.ndarray, head: str, depth: int, drop: list[np.ndarray] | None = None):
    """Gradients of every trainable parameter, summed over the rows, and that of the projected rows."""
    kept, act = trace
    last = f"heads.{head}.4"
    grads = {f"{last}.weight": dlogits.T @ act, f"{last}.bias": dlogits.sum(0)}
    dh = dlogits @ w[f"{last}.weight"]
    for i, (lin, norm) in reversed(list(enumerate(stage_names(head, depth)))):
        h, xhat, inv, a = kept[i]
        s = _sigmoid(a)
        da = dh * (s * (1.0 + a * (1.0 - s)))
        if drop is not None:
            da = da * drop[i]
        grads[f"{norm}.weight"], grads[f"{norm}.bias"] = (da * xhat).sum(0), da.sum(0)
        dx = da * w[f"{norm}.weight"]
        du = inv * (dx - dx.mean(1, keepdims=True) - xhat * (dx * xhat).mean(1, keepdims=True))
        grads[f"{lin}.weight"], grads[f"{lin}.bias"] = du.T @ h, du.sum(0)
        below = du @ w[f"{lin}.weight"]
        dh = dh + below if 0 < i <= depth else below
    return grads, dh


def log_softmax(z: np.ndarray, temperature: float | np.ndarray = 1.0) -> np.ndarray:
    s = z / temperature
    s = s - s.max(1, keepdims=True)
    return s - np.log(np.exp(s).sum(1, keepdims=True))


def softmax(z: np.ndarray, temperature: float | np.ndarray = 1.0) -> np.ndarray:
    return np.exp(log_softmax(z, temperature))


def _lse(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


def set_nll(z: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed negative log mass of each row's allowed classes, and its gradient."""
    held = z + (mask - 1.0) * MASK_PENALTY
    return float((_lse(z) - _lse(held)).sum()), softmax(z) - softmax(held)


def training_loss(z, log_t, weight, levels, temperature: float, level_weight: float, shallow=None, labelled=None, consistency: float = 0.0):
    """Row losses (classification, consistency) and gradients (deep view, shallow view) of one batch.

    Classification: T^2 KL of softened targets from softened predictions, plus the cross entropy of the mass under
    every node of every tree level. Consistency: KL of the shallow view from the deep one, which stays fixed.
    levels: nodes x classes, 0/1.
    """
    lp, soft = log_softmax(z, temperature), softmax(z, temperature)
    t = softmax(log_t, temperature)
    kd = temperature**2 * (t * (np.log(t + 1e-12) - lp)).sum(1)
    p, q = softmax(z), np.exp(log_t)
    q = q / np.maximum(q.sum(1, keepdims=True), 1e-8)
    qm, pm = q @ levels.T, p @ levels.T
    hier = -level_weight * (qm * np.log(np.maximum(pm, 1e-8))).sum(1)
    pull = np.where(pm > 1e-8, -level_weight * qm / np.maximum(pm, 1e-8), 0.0) @ levels
    dz = temperature * (soft * t.sum(1, keepdims=True) - t) + p * (pull - (p * pull).sum(1, keepdims=True))
    loss, dz = weight * (kd + hier), weight[:, None] * dz
    if shallow is None:
        return loss, np.zeros_like(loss), dz, None
    ls = log_softmax(shallow)
    share = consistency * labelled
    cons = share * (p * (np.log(p + 1e-12) - ls)).sum(1)
    return loss, cons, dz, share[:, None] * (np.exp(ls) * p.sum(1, keepdims=True) - p)
