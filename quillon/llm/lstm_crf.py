"""A character tagger in numpy: bidirectional LSTM, linear-chain CRF, trained by gradient descent on labelled spans.

Arrays are laid out (feature, window), so that each step over the characters works on contiguous rows for all windows at once.
The gates are piecewise linear, clip(x / 4 + 1 / 2, 0, 1), and so is the cell's squashing, clip(x, -1, 1): numpy clips an
array in a tenth of the time that an exponential takes.
"""

from __future__ import annotations

import numpy as np

#: Characters that have a class of their own; others fall into one class each for digits, other letters, other marks and padding.
SINGLE = "abcdefghijklmnopqrstuvwxyz \n@.-_+()[]{}<>:;/,%'\"=#"
PAD, DIGIT, LETTER, MARK = 0, 1, 2, 3
CLASSES = 4 + len(SINGLE)
HIDDEN = 6


def _class_table() -> np.ndarray:
    out = np.full(0x250, LETTER, np.uint8)
    for c in range(128):
        ch = chr(c).lower()
        out[c] = DIGIT if ch.isdigit() else 4 + SINGLE.index(ch) if ch in SINGLE else MARK
    for c in range(128, len(out)):
        out[c] = LETTER if chr(c).isalpha() else MARK
    return out


_TABLE = _class_table()


def char_classes(text: str) -> np.ndarray:
    """The class of each code point; beyond the table all count as letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Tag 0 is outside; the others are the kinds of spans."""

    def __init__(self, tags: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        self.p = {}
        for d in "fb":
            self.p["X" + d] = rng.normal(0, 0.3, (4 * hidden, CLASSES))
            self.p["U" + d] = rng.normal(0, 0.3, (4 * hidden, hidden))
            self.p["X" + d][hidden : 2 * hidden] += 1.0  # forget gates start open
            self.p["W" + d] = rng.normal(0, 0.3, (tags, hidden))
        self.p["b"] = np.zeros((tags, 1))
        self.p["A"] = np.eye(tags) * 2.0
        self.fast = None

    # -- training --------------------------------------------------------------------------------------------------------
    def _run(self, d: str, cls: np.ndarray) -> list:
        """The steps of one direction: (gates, cell before, cell, hidden before, hidden) for each character."""
        h, n = self.hidden, cls.shape[1]
        hid, cell, out = np.zeros((h, n)), np.zeros((h, n)), []
        for t in range(len(cls)):
            z = self.p["X" + d][:, cls[t]] + self.p["U" + d] @ hid
            g = np.concatenate([np.clip(0.25 * z[: 3 * h] + 0.5, 0, 1), np.clip(z[3 * h :], -1, 1)])
            new = g[h : 2 * h] * cell + g[:h] * g[3 * h :]
            old, hid_old = cell, hid
            cell, hid = new, g[2 * h : 3 * h] * np.clip(new, -1, 1)
            out.append((g, old, cell, hid_old, hid))
        return out

    def _back(self, d: str, cls: np.ndarray, steps: list, up: list, grad: dict) -> None:
        h = self.hidden
        dh, dc = np.zeros_like(up[0]), np.zeros_like(up[0])
        for t in range(len(cls) - 1, -1, -1):
            g, old, cell, hid_old, _ = steps[t]
            i, f, o, c = g[:h], g[h : 2 * h], g[2 * h : 3 * h], g[3 * h :]
            dh = dh + up[t]
            tc = np.clip(cell, -1, 1)
            dc = dc + dh * o * (np.abs(cell) < 1)
            inside = 0.25 * ((g[: 3 * h] > 0) & (g[: 3 * h] < 1))
            dz = np.concatenate([np.concatenate([dc * c, dc * old, dh * tc]) * inside, dc * i * (np.abs(c) < 1)])
            grad["X" + d] += dz @ np.eye(CLASSES)[cls[t]]
            grad["U" + d] += dz @ hid_old.T
            dh, dc = self.p["U" + d].T @ dz, dc * f

    def loss(self, cls: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood a window and its gradient; ``cls`` and ``gold`` are (character, window)."""
        length, n = cls.shape
        fwd, bwd = self._run("f", cls), self._run("b", cls[::-1])[::-1]
        emit = [self.p["Wf"] @ f[4] + self.p["Wb"] @ b[4] + self.p["b"] for f, b in zip(fwd, bwd)]
        a, cols, one = self.p["A"], np.arange(n), np.eye(self.tags)
        alpha = [emit[0]]
        for t in range(1, length):
            alpha.append(_logsumexp(alpha[-1][:, None, :] + a[:, :, None], 0) + emit[t])
        z = _logsumexp(alpha[-1], 0)
        beta = [np.zeros_like(emit[0])]
        for t in range(length - 1, 0, -1):
            beta.append(_logsumexp(a[:, :, None] + (emit[t] + beta[-1])[None], 1))
        beta = beta[::-1]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        path = sum(emit[t][gold[t], cols] for t in range(length)) + sum(a[gold[t - 1], gold[t]] for t in range(1, length))
        down = []
        for t in range(length):
            e = np.exp(alpha[t] + beta[t] - z)
            e[gold[t], cols] -= 1
            alone = np.exp(emit[t] - _logsumexp(emit[t], 0))  # each character also by itself: scores are then clear without transitions
            alone[gold[t], cols] -= 1
            down.append((e + alone) / n)
            if t:
                pair = np.exp(alpha[t - 1][:, None, :] + a[:, :, None] + (emit[t] + beta[t])[None] - z)
                grad["A"] += pair.sum(axis=2) / n
                grad["A"] -= one[gold[t - 1]].T @ one[gold[t]] / n
        for t in range(length):
            grad["Wf"] += down[t] @ fwd[t][4].T
            grad["Wb"] += down[t] @ bwd[t][4].T
            grad["b"] += down[t].sum(axis=1, keepdims=True)
        self._back("f", cls, fwd, [self.p["Wf"].T @ e for e in down], grad)
        self._back("b", cls[::-1], bwd[::-1], [self.p["Wb"].T @ e for e in down[::-1]], grad)
        return float((z - path).mean()), grad

    def fit(self, windows: np.ndarray, gold: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random batches of (window, character) rows; deterministic for a seed."""
        rng, m, v, history = np.random.default_rng(seed), {}, {}, []
        for k, x in self.p.items():
            m[k], v[k] = np.zeros_like(x), np.zeros_like(x)
        for s in range(1, steps + 1):
            pick = rng.choice(len(windows), min(batch, len(windows)), replace=False)
            value, grad = self.loss(np.ascontiguousarray(windows[pick].T), np.ascontiguousarray(gold[pick].T))
            history.append(value)
            norm = max(1.0, np.sqrt(sum((g * g).sum() for g in grad.values())) / 5)
            pace = rate * min(1.0, 2 * (1 - s / (steps + 1)))
            for k, g in grad.items():
                g = g / norm
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= pace * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)
        self.fast = None
        return history

    # -- decoding --------------------------------------------------------------------------------------------------------
    def _prepare(self) -> dict:
        if self.fast is None:
            h, fast = self.hidden, {k: np.ascontiguousarray(x, np.float32) for k, x in self.p.items()}
            for d in "fb":  # the gates' slope and offset go into the weights
                fast["X" + d][: 3 * h] = fast["X" + d][: 3 * h] * 0.25 + 0.5
                fast["U" + d][: 3 * h] *= 0.25
                fast["W" + d] = np.ascontiguousarray(fast["W" + d][1:] - fast["W" + d][:1])
            fast["b"] = fast["b"][1:] - fast["b"][:1]
            self.fast = fast
        return self.fast

    def _emit(self, d: str, cls: np.ndarray, out: np.ndarray) -> None:
        """Add to ``out`` what one direction scores for each tag over tag 0."""
        h, (length, n), w = self.hidden, cls.shape, self._prepare()
        x, u, top = w["X" + d], w["U" + d], w["W" + d]
        z, g = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
        cell, part, hid, score = np.zeros((h, n), np.float32), np.empty((h, n), np.float32), np.zeros((h, n), np.float32), np.empty(out.shape[1:], np.float32)
        gates, fresh = z[: 3 * h], z[3 * h :]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            np.take(x, cls[t], axis=1, out=g, mode="clip")
            np.matmul(u, hid, out=z)
            z += g
            np.clip(gates, 0, 1, out=gates)
            np.clip(fresh, -1, 1, out=fresh)
            cell *= z[h : 2 * h]
            np.multiply(z[:h], fresh, out=part)
            cell += part
            np.clip(cell, -1, 1, out=part)
            np.multiply(z[2 * h : 3 * h], part, out=hid)
            np.matmul(top, hid, out=score)
            out[t] += score

    def inside(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores): the windows of which the best path may leave tag 0, and their scores of each tag over tag 0, (row, character, tag).

        The best path stays outside if all gains of tags together don't make up for entering and leaving, or for holding the
        first or last character. A path with several spans enters and leaves for each, which costs it more than staying; a tagger that has learnt otherwise
        gets no such shortcut."""
        w = self._prepare()
        cls = np.ascontiguousarray(windows.T)
        over = np.empty((len(cls), self.tags - 1, len(windows)), np.float32)
        over[:] = w["b"]
        self._emit("f", cls, over)
        self._emit("b", cls, over)
        b = w["A"] - w["A"][0, 0]  # what a transition adds to a path outside; a path may start or end inside at no cost
        stay, enter, leave = float(b[1:, 1:].max()), float(b[0, 1:].max()), float(b[1:, 0].max())
        rows = np.arange(len(windows))
        if enter + leave <= stay:
            gain = over.max(axis=1) + stay
            most = np.maximum(gain, 0).sum(axis=0)
            first, last = np.minimum(gain[0], 0), np.minimum(gain[-1], 0)
            held = np.maximum(enter + leave, np.maximum(first + leave, last + enter))
            rows = np.flatnonzero(most - stay + np.maximum(held, first + last) > 0)
        scores = np.zeros((len(rows), len(cls), self.tags), np.float32)
        scores[:, :, 1:] = over[:, :, rows].transpose(2, 0, 1)
        return rows, scores

    def best_paths(self, chains: list[np.ndarray], begins: list[bool], stops: list[bool]) -> list[np.ndarray]:
        """The best path of each chain of scores, (character, tag). What does not begin or stop at the end of a text is entered from outside, or left to it."""
        a = self._prepare()["A"]
        order = sorted(range(len(chains)), key=lambda k: -len(chains[k]))
        sizes = np.array([len(chains[k]) for k in order])
        out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(chains)
        if not len(order):
            return out
        e = np.zeros((int(sizes[0]), self.tags, len(order)), np.float32)
        for col, k in enumerate(order):
            e[: sizes[col], :, col] = chains[k]
        score = e[0] + np.where([begins[k] for k in order], 0, a[0][:, None])
        back, final = np.zeros(e.shape, np.uint8), np.empty_like(score)
        for t in range(1, len(e) + 1):
            active = int(np.searchsorted(-sizes, -t, side="left"))  # the chains longer than t
            final[:, active : score.shape[1]] = score[:, active:]
            score = score[:, :active]
            if not active:
                break
            step = score[:, None, :] + a[:, :, None]
            back[t, :, :active] = step.argmax(axis=0)
            score = step.max(axis=0) + e[t, :, :active]
        tag = (final + np.where([stops[k] for k in order], 0, a[:, 0][:, None])).argmax(axis=0)
        tags = np.zeros((len(e), len(order)), np.uint8)
        cols = np.arange(len(order))
        for t in range(len(e) - 1, -1, -1):
            active = cols[: int(np.searchsorted(-sizes, -t, side="left"))]
            tags[t, active] = tag[active]
            tag[active] = back[t][tag[active], active]
        for col, k in enumerate(order):
            out[k] = tags[: sizes[col], col]
        return out

    def margin(self, scores: np.ndarray, tag: int, start: int, end: int) -> float:
        """What a path scores that holds ``tag`` from ``start`` to ``end`` of a chain and is outside on both sides, beyond the path that stays outside there."""
        a = self._prepare()["A"]
        return float(scores[start:end, tag].sum() + a[0, tag] + (end - start - 1) * a[tag, tag] + a[tag, 0] - (end - start + 1) * a[0, 0])

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tags): the windows of which the best path leaves tag 0, and their best paths, (row, character)."""
        rows, scores = self.inside(windows)
        paths = self.best_paths(list(scores), [True] * len(rows), [True] * len(rows))
        some = [k for k, path in enumerate(paths) if path.any()]
        return rows[some], np.array([paths[k] for k in some], np.uint8).reshape(len(some), windows.shape[1])
