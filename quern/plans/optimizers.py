"""Gradient steps on a flat parameter vector."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class SGD:
    """Nesterov form: d = mu v; v = d + lr g; x += d - (1 + mu) v."""

    rate: float = 0.001
    momentum: float = 0.9
    velocity: np.ndarray | None = None

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        v = self.velocity if self.velocity is not None else np.zeros_like(x)
        d = self.momentum * v
        self.velocity = d + self.rate * g
        return x + d - (1 + self.momentum) * self.velocity


@dataclass
class Adam:
    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    m: np.ndarray | None = None
    v: np.ndarray | None = None
    power1: float = 1.0
    power2: float = 1.0

    def restart(self) -> None:
        """A new training run starts the bias correction again and keeps the moments."""
        self.power1 = self.power2 = 1.0

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        m = self.m if self.m is not None else np.zeros_like(x)
        v = self.v if self.v is not None else np.zeros_like(x)
        self.power1 *= self.beta1
        self.power2 *= self.beta2
        self.m = self.beta1 * m + (1 - self.beta1) * g
        self.v = self.beta2 * v + (1 - self.beta2) * g * g
        return x - self.rate * self.m / ((1 - self.power1) * (np.sqrt(self.v / (1 - self.power2)) + self.epsilon))


@dataclass
class Adadelta:
    """``decay`` is the weight of the new value."""

    decay: float = 0.05
    epsilon: float = 1e-6
    g2: np.ndarray | None = None
    dx2: np.ndarray | None = None

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        g2 = self.g2 if self.g2 is not None else np.zeros_like(x)
        dx2 = self.dx2 if self.dx2 is not None else np.zeros_like(x)
        self.g2 = g * g * self.decay + g2 * (1 - self.decay)
        dx = -np.sqrt(dx2 + self.epsilon) / np.sqrt(self.g2 + self.epsilon) * g
        self.dx2 = dx * dx * self.decay + dx2 * (1 - self.decay)
        return x + dx


@dataclass
class PlainSGD:
    rate: float = 0.1

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return x - self.rate * g


OPTIMIZERS = {"sgd": SGD, "adam": Adam, "adadelta": Adadelta, "plain": PlainSGD}


@dataclass
class Descent:
    """Descent on a function until a limit of steps, parameter change, value or gradient."""

    value: object
    gradient: object
    optimizer: object
    max_steps: int = 1000
    min_move: float = 0.0
    min_value: float = -np.inf
    min_gradient: float = 0.0
    every: int = 1
    history: list[tuple[int, float]] = field(default_factory=list)

    def run(self, x: np.ndarray) -> np.ndarray:
        for k in range(self.max_steps):
            g = np.asarray(self.gradient(x))
            f = float(self.value(x))
            if k % self.every == 0:
                self.history.append((k, f))
            if f <= self.min_value or np.linalg.norm(g) <= self.min_gradient:
                break
            new = self.optimizer.step(x, g)
            moved = float(np.linalg.norm(new - x))
            x = new
            if moved <= self.min_move:
                break
        return x


def numeric_gradient(f, x: np.ndarray, h: float = 1e-4) -> np.ndarray:
    """Central differences."""
    out = np.zeros_like(x, float)
    for i in range(x.size):
        step = np.zeros_like(x, float)
        step.flat[i] = h
        out.flat[i] = (f(x + step) - f(x - step)) / (2 * h)
    return out
