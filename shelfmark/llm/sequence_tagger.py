"""A character tagger in numpy: embeddings, a bidirectional LSTM and CRF transitions."""

from __future__ import annotations

import numpy as np

#: Sizes of the embedding and of each direction's state.
EMBEDDED, HIDDEN = 12, 16
#: ASCII stands for itself, any other character for one of two classes; 0 pads.
SYMBOLS = 130


def symbols(text: str, length: int) -> np.ndarray:
    """Symbol numbers of a text, padded to a length."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.zeros(length, np.int64)
    out[: len(points)] = np.where(points < 128, points + 1, 129)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials."""
    most = x.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))


class Tagger:
    """Weights by name; ``train`` fits them, ``decode`` gives the best tag sequence of each window."""

    def __init__(self, tags: int, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        near = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.tags = tags
        self.weights = {"embed": draw.normal(0, 0.5, (SYMBOLS, EMBEDDED)), "out": near(2 * HIDDEN, tags),
                        "bias": np.zeros(tags), "step": np.zeros((tags, tags)), "start": np.zeros(tags)}
        for side in "fb":
            self.weights[f"{side}w"] = near(EMBEDDED + HIDDEN, 4 * HIDDEN)
            self.weights[f"{side}c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def _lstm(self, side: str, inputs: np.ndarray, keep: bool):
        """States of one direction; inputs are (time, window, feature) in that direction's order."""
        w, c = self.weights[f"{side}w"], self.weights[f"{side}c"]
        steps, count, _ = inputs.shape
        state, cell = np.zeros((count, HIDDEN)), np.zeros((count, HIDDEN))
        states, kept = np.empty((steps, count, HIDDEN)), []
        fed = inputs @ w[:EMBEDDED] + c
        for t in range(steps):
            z = fed[t] + state @ w[EMBEDDED:]
            gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            before = (state, cell)
            cell = gates[:, HIDDEN : 2 * HIDDEN] * cell + gates[:, :HIDDEN] * new
            held = np.tanh(cell)
            state = gates[:, 2 * HIDDEN :] * held
            states[t] = state
            if keep:
                kept.append((*before, gates, new, held))
        return states, kept

    def _lstm_slopes(self, side: str, inputs: np.ndarray, kept: list, wanted: np.ndarray, slopes: dict) -> np.ndarray:
        w = self.weights[f"{side}w"]
        steps, count, _ = inputs.shape
        dw, dinputs = np.zeros_like(w), np.empty_like(inputs)
        dc = np.zeros(4 * HIDDEN)
        dstate, dcell = np.zeros((count, HIDDEN)), np.zeros((count, HIDDEN))
        for t in range(steps - 1, -1, -1):
            state, cell, gates, new, held = kept[t]
            enter, forget, leave = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            dstate = dstate + wanted[t]
            dcell = dcell + dstate * leave * (1 - held**2)
            dz = np.concatenate([
                dcell * new * enter * (1 - enter), dcell * cell * forget * (1 - forget),
                dstate * held * leave * (1 - leave), dcell * enter * (1 - new**2),
            ], axis=1)
            dw[:EMBEDDED] += inputs[t].T @ dz
            dw[EMBEDDED:] += state.T @ dz
            dc += dz.sum(axis=0)
            dinputs[t] = dz @ w[:EMBEDDED].T
            dstate, dcell = dz @ w[EMBEDDED:].T, dcell * forget
        slopes[f"{side}w"], slopes[f"{side}c"] = dw, dc
        return dinputs

    def _scores(self, x: np.ndarray, keep: bool = False):
        inputs = self.weights["embed"][x.T]
        ahead, kept_f = self._lstm("f", inputs, keep)
        back, kept_b = self._lstm("b", inputs[::-1], keep)
        states = np.concatenate([ahead, back[::-1]], axis=2)
        return states @ self.weights["out"] + self.weights["bias"], (inputs, states, kept_f, kept_b)

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag sequences and its gradient."""
        w, count = self.weights, len(x)
        emitted, (inputs, states, kept_f, kept_b) = self._scores(x, True)
        steps, tags = len(emitted), y.T
        ahead = np.empty_like(emitted)
        ahead[0] = emitted[0] + w["start"]
        for t in range(1, steps):
            ahead[t] = emitted[t] + _total(ahead[t - 1][:, :, None] + w["step"], 1)
        behind = np.zeros_like(emitted)
        for t in range(steps - 2, -1, -1):
            behind[t] = _total(w["step"] + (emitted[t + 1] + behind[t + 1])[:, None, :], 2)
        whole = _total(ahead[-1], 1)
        rows = np.arange(count)
        gold = w["start"][tags[0]] + np.take_along_axis(emitted, tags[:, :, None], 2)[:, :, 0].sum(axis=0)
        gold = gold + w["step"][tags[:-1], tags[1:]].sum(axis=0)
        share = np.exp(ahead + behind - whole[None, :, None])
        np.subtract.at(share, (np.arange(steps)[:, None], rows[None, :], tags), 1)
        share /= count
        slopes: dict[str, np.ndarray] = {"start": share[0].sum(axis=0)}
        step = np.zeros_like(w["step"])
        for t in range(1, steps):
            both = ahead[t - 1][:, :, None] + w["step"] + (emitted[t] + behind[t])[:, None, :] - whole[:, None, None]
            step += np.exp(both).sum(axis=0)
        np.subtract.at(step, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        slopes["step"] = step / count
        slopes["out"] = states.reshape(-1, 2 * HIDDEN).T @ share.reshape(-1, self.tags)
        slopes["bias"] = share.sum(axis=(0, 1))
        dstates = share @ w["out"].T
        dinputs = self._lstm_slopes("f", inputs, kept_f, dstates[:, :, :HIDDEN], slopes)
        dinputs = dinputs + self._lstm_slopes("b", inputs[::-1], kept_b, dstates[::-1, :, HIDDEN:], slopes)[::-1]
        slopes["embed"] = np.zeros_like(w["embed"])
        np.add.at(slopes["embed"], x.T, dinputs)
        return float((whole - gold).mean()), slopes

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 260, batch: int = 64, rate: float = 0.02, seed: int = 3) -> float:
        """Adam over random batches; returns the last loss."""
        draw = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        loss = 0.0
        for r in range(1, rounds + 1):
            chosen = draw.integers(0, len(x), batch)
            loss, slopes = self.slopes(x[chosen], y[chosen])
            norm = np.sqrt(sum(float((g**2).sum()) for g in slopes.values()))
            for k, g in slopes.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-12))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g**2
                move = mean[k] / (1 - 0.9**r) / (np.sqrt(square[k] / (1 - 0.99**r)) + 1e-8)
                self.weights[k] = self.weights[k] - rate * (1 - r / (rounds + 1)) * move
        return loss

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequence of each window (Viterbi)."""
        emitted, _ = self._scores(x)
        steps, count, _ = emitted.shape
        best, source = emitted[0] + self.weights["start"], np.empty((steps, count, self.tags), np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + self.weights["step"]
            source[t] = options.argmax(axis=1)
            best = options.max(axis=1) + emitted[t]
        tags = np.empty((count, steps), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(count)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = source[t][rows, tags[:, t]]
        return tags
