"""Numpy kernels for one piece of a trace: filter design and zero-phase filtering."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LOW_HZ = 1.0
HIGH_HZ = 5.0
ORDER = 5
# Samples added at each trace end: three times the number of coefficients of the whole filter.
EDGE = 3 * (2 * ORDER + 1)
# After this many seconds the response of the 1-5 Hz filter has died away below double precision at any rate.
SETTLE_SECONDS = 41
_STEP = 128


@lru_cache(maxsize=64)
def bandpass_sections(fs: float, low: float = LOW_HZ, high: float = HIGH_HZ, order: int = ORDER) -> np.ndarray:
    """Butterworth band-pass as second-order sections (gain, a1, a2); every numerator is gain * (1 - z**-2)."""
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    centre, width = np.sqrt(w1 * w2), w2 - w1
    angles = np.pi * (2 * np.arange(order) + order + 1) / (2 * order)
    prototype = np.exp(1j * angles)
    half = prototype * width / 2
    root = np.sqrt(half * half - centre * centre)
    analog = np.concatenate([half + root, half - root])
    poles = (2 * fs + analog) / (2 * fs - analog)
    # A wide band relative to the rate turns one conjugate pair into two real poles; they share a section too.
    real = np.abs(poles.imag) < 1e-9
    upper = poles[~real & (poles.imag > 0)]
    pairs = [(p, p.conjugate()) for p in upper] + [tuple(poles[real])] * int(real.any())
    pairs.sort(key=lambda pq: abs(pq[0] * pq[1]))
    z = np.exp(2j * np.arctan(centre / (2 * fs)))
    rows = []
    for p, q in pairs:
        a1, a2 = -(p + q).real, (p * q).real
        response = (1 - z**-2) / (1 + a1 / z + a2 / z**2)
        rows.append((1 / abs(response), a1, a2))
    return np.array(rows)


@lru_cache(maxsize=64)
def _state_space(fs: float) -> tuple[np.ndarray, ...]:
    """The cascade for ``_STEP`` samples at once: input to output, state to output, input to state, state to state."""
    sections = bandpass_sections(fs)
    size = 2 * len(sections)

    def step(state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.empty_like(state)
        for i, (g, a1, a2) in enumerate(sections):
            y = g * x + state[2 * i]
            new[2 * i] = state[2 * i + 1] - a1 * y
            new[2 * i + 1] = -g * x - a2 * y
            x = y
        return new, x

    # Columns: the unit states, then one impulse at each time of the step.
    state = np.hstack([np.eye(size), np.zeros((size, _STEP))])
    out = np.empty((_STEP, size + _STEP))
    for n in range(_STEP):
        x = np.zeros(size + _STEP)
        x[size + n] = 1.0
        state, out[n] = step(state, x)
    steady = np.linalg.solve(np.eye(size) - step(np.eye(size), np.zeros(size))[0], step(np.zeros((size, 1)), np.ones(1))[0])
    return out[:, size:], out[:, :size], state[:, size:], state[:, :size], steady[:, 0]


def filter_forward(x: np.ndarray, fs: float, settled_on: float | None) -> np.ndarray:
    """One pass of the filter, from rest or as if ``settled_on`` had been the input forever."""
    through, observe, reach, carry, steady = _state_space(fs)
    n = len(x)
    blocks = -(-n // _STEP)
    padded = np.zeros(blocks * _STEP)
    padded[:n] = x
    padded = padded.reshape(blocks, _STEP)
    gains = padded @ reach.T
    states = np.empty((blocks, carry.shape[0]))
    state = np.zeros(carry.shape[0]) if settled_on is None else steady * settled_on
    for b in range(blocks):
        states[b] = state
        state = carry @ state + gains[b]
    return (padded @ through.T + states @ observe.T).reshape(-1)[:n]


def zero_phase(x: np.ndarray, fs: float, at_start: bool = True, at_end: bool = True) -> np.ndarray:
    """Forward and backward pass over a piece of a trace.

    At a true trace end the input is extended by odd reflection and the pass starts settled. At a cut the pass
    starts from rest; the caller adds ``SETTLE_SECONDS`` of neighbouring samples there and drops them afterwards.
    """
    head = 2 * x[0] - x[EDGE:0:-1] if at_start else x[:0]
    tail = 2 * x[-1] - x[-2:-EDGE - 2:-1] if at_end else x[:0]
    y = np.concatenate([head, x, tail])
    y = filter_forward(y, fs, y[0] if at_start else None)[::-1]
    y = filter_forward(y, fs, y[0] if at_end else None)[::-1]
    return y[len(head):len(y) - len(tail)]


def bandpass_reason(n: int, fs: float) -> str | None:
    """Why a trace cannot be filtered, or None."""
    if not fs > 2 * HIGH_HZ:
        return "rate"
    if n <= EDGE:
        return "short"
    return None
