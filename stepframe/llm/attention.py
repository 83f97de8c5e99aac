"""A causal self-attention language model in numpy over subword symbols (part of operator 6).

Embeddings and places, one masked attention with a residual path, and a softmax in two steps: the class of the next symbol,
then the symbol within its class, both from the same state.
"""

from __future__ import annotations

import numpy as np

#: Ids of a window; windows of a text that is scored overlap by half.
WIDTH, STRIDE = 16, 8
DIM = 32
#: Windows scored together.
SCORED = 512
#: Logarithms of unnormalised probabilities stay within these bounds, in training and in scoring.
CAP = np.float32(40)
_LOW = np.tril(np.ones((WIDTH, WIDTH), np.float32))
_ONES = np.ones(WIDTH, np.float32)


class Symbols:
    """Ranks of symbols by falling count, and classes of neighbouring ranks.

    Classes have about the same sum of square roots of counts, and there are about half as many as the root of the
    number of symbols, so both steps of the softmax are short. Symbols that training lacks share the last rank and a class of
    their own, with equal parts.
    """

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.used = int((counts > 0).sum())
        self.unseen = max(len(counts) - self.used, 1)
        self.rank = np.full(len(counts), self.used, np.int32)
        self.rank[order[: self.used]] = np.arange(self.used)
        c = counts[order[: self.used]].astype(np.float64)
        mass = np.cumsum(np.sqrt(c))
        wanted = max(1, round(self.used**0.5 / 2))
        cls = np.minimum((mass - np.sqrt(c) / 2) / max(mass[-1] if len(c) else 1.0, 1e-300) * wanted, wanted - 1).astype(np.int64)
        cls = np.unique(cls, return_inverse=True)[1]
        self.classes = int(cls.max()) + 1 if len(cls) else 0
        self.cls = np.append(cls, self.classes)
        self.low = np.searchsorted(self.cls, np.arange(self.classes + 2))
        self.share = np.append(c, 0.5) / (c.sum() + 0.5)
        #: Of the symbols without a rank of their own, each one's part of their probability.
        self.rest = -float(np.log(self.unseen))


class Attention:
    """The model's parameters, and Adagrad's sums beside them, as one flat vector for sending and averaging."""

    def __init__(self, symbols: Symbols, seed: int = 0):
        """Before any training each symbol has about its share of the counts."""
        self.symbols = symbols
        r = np.random.default_rng(seed)

        def small(scale, *shape):
            return r.normal(0, scale, shape).astype(np.float32)

        share = np.bincount(symbols.cls, symbols.share, symbols.classes + 1)
        n = symbols.used + 1
        self.embed, self.place = small(0.3, n, DIM), small(0.1, WIDTH, DIM)
        # Queries, keys and values side by side.
        self.qkv = np.concatenate([small(0.25 * DIM**-0.5, DIM, DIM), small(DIM**-0.5, DIM, 2 * DIM)], 1)
        # The last row of the outputs is their constant part.
        self.top = np.concatenate([small(0.1, DIM, len(share)), np.log(share)[None].astype(np.float32)])
        self.leaf = np.concatenate([small(0.1, n, DIM), np.log(symbols.share / share[symbols.cls])[:, None].astype(np.float32)], 1)
        self.sums = {k: np.full_like(getattr(self, k), 1e-3) for k in self.NAMES}
        #: Made when texts are scored, as parameters don't change then.
        self._projected = None

    NAMES = ("embed", "leaf", "place", "qkv", "top")

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for k in self.NAMES for x in (getattr(self, k), self.sums[k])])

    def load(self, flat: np.ndarray) -> "Attention":
        at, self._projected = 0, None
        for k in self.NAMES:
            own = getattr(self, k)
            for put in (lambda x, k=k: setattr(self, k, x), lambda x, k=k: self.sums.__setitem__(k, x)):
                put(flat[at : at + own.size].reshape(own.shape).astype(np.float32))
                at += own.size
        return self

    def rows_of(self) -> np.ndarray:
        """For each place of the flat vector, the rank whose row it belongs to; -1 for what all windows use."""
        out = []
        for k in self.NAMES:
            own = getattr(self, k)
            of = np.repeat(np.arange(len(own)), own.shape[1]) if k in ("embed", "leaf") else np.full(own.size, -1)
            out += [of, of]
        return np.concatenate(out)

    def _project(self, embed: np.ndarray) -> list[np.ndarray]:
        """Queries, keys and values of some symbols without their places, each in one piece."""
        return [embed @ np.ascontiguousarray(self.qkv[:, i : i + DIM]) for i in range(0, 3 * DIM, DIM)]

    def _states(self, embed: np.ndarray, projected: list[np.ndarray], rows: np.ndarray, first: int = 0):
        """rows: of ``embed`` and ``projected``, (windows, WIDTH); states are made from place ``first`` of each window on.

        A symbol's part of queries, keys and values is the same at all places, so it is made once for each symbol and a place's
        part is added.
        """
        n, own = len(rows), rows[:, first:]
        x = np.take(embed, own, axis=0)
        x += self.place[first:]
        q, k, v = (np.take(e, own if i == 0 else rows, axis=0) for i, e in enumerate(projected))
        for part, place in zip((q, k, v), self._project(self.place)):
            part += place[WIDTH - part.shape[1] :]
        a = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(a, -CAP, CAP, out=a)
        np.exp(a, out=a)
        a *= _LOW[first:]
        a /= (a.reshape(-1, WIDTH) @ _ONES).reshape(n, WIDTH - first, 1)
        flat = x.reshape(-1, DIM)
        state = np.empty((len(flat), DIM + 1), np.float32)
        state[:, DIM] = 1
        np.add(np.matmul(a, v).reshape(-1, DIM), flat, out=state[:, :DIM])
        return flat, q, k, v, a, state

    def _leaves(self, state: np.ndarray, goals: np.ndarray, cls: np.ndarray):
        """Unnormalised probabilities of each class's symbols for goals sorted by rank: (all values in one row after
        another, width of each row, where rows start, where the goals lie, parts: (class, first row, last row, first value,
        last value))."""
        s = self.symbols
        width = (s.low[1:] - s.low[:-1])[cls]
        starts = np.cumsum(width) - width
        y = np.empty(int(width.sum()), np.float32)
        bounds = np.searchsorted(cls, np.arange(s.classes + 2))
        parts = []
        for c in np.flatnonzero(bounds[1:] > bounds[:-1]):
            a, b = bounds[c], bounds[c + 1]
            first = starts[a]
            last = first + (b - a) * width[a]
            parts.append((c, a, b, first, last))
            np.matmul(state[a:b], self.leaf[s.low[c] : s.low[c + 1]].T, out=y[first:last].reshape(b - a, -1))
        np.clip(y, -CAP, CAP, out=y)
        np.exp(y, out=y)
        return y, width, starts, starts + goals - s.low[cls], parts

    def _order(self, ranks: np.ndarray) -> np.ndarray:
        """Numbers of 16 bits are sorted by digits."""
        return np.argsort(ranks.astype(np.uint16) if self.symbols.used < 1 << 16 else ranks, kind="stable")

    def _adapt(self, name: str, gradient: np.ndarray, rate: np.float32) -> None:
        total, own = self.sums[name], getattr(self, name)
        total += gradient * gradient
        gradient /= np.sqrt(total)
        gradient *= rate
        own -= gradient

    def step(self, windows: np.ndarray, rate: float) -> None:
        """One step of Adagrad over windows of WIDTH + 1 ranks, -1 where a text has ended."""
        s, rate, self._projected = self.symbols, np.float32(rate), None
        inputs, goals = np.maximum(windows[:, :-1], 0).ravel(), windows[:, 1:].ravel()
        order = self._order(inputs)
        ranks = inputs[order]
        new = np.concatenate([[True], ranks[1:] != ranks[:-1]])
        begins = np.flatnonzero(new)
        ranks, number = ranks[begins], np.empty(len(inputs), np.intp)
        number[order] = np.cumsum(new) - 1
        embed = np.take(self.embed, ranks, axis=0)
        flat, q, k, v, a, state = self._states(embed, self._project(embed), number.reshape(-1, WIDTH))
        live = np.flatnonzero(goals >= 0)
        live = live[self._order(goals[live])]
        goals = goals[live]
        cls = s.cls[goals]
        own = np.take(state, live, axis=0)
        # Losses are summed and divided by the root of their number: larger batches have a better gradient.
        n, scale = len(live), np.float32(len(live) ** -0.5)
        rows = np.arange(n)
        z = own @ self.top
        np.clip(z, -CAP, CAP, out=z)
        np.exp(z, out=z)
        z *= (scale / (z @ np.ones(z.shape[1], np.float32)))[:, None]
        z[rows, cls] -= scale
        back = z @ self.top.T
        y, width, starts, at, parts = self._leaves(own, goals, cls)
        y *= np.repeat(scale / np.add.reduceat(y, starts), width)
        y[at] -= scale
        leaf = np.zeros_like(self.leaf)
        for c, i, j, first, last in parts:
            part, where = y[first:last].reshape(j - i, -1), slice(s.low[c], s.low[c + 1])
            back[i:j] += part @ self.leaf[where]
            np.matmul(part.T, own[i:j], out=leaf[where])
        d = np.zeros((len(state), DIM), np.float32)
        d[live] = back[:, :DIM]
        dense = {"top": own.T @ z, "leaf": leaf}
        wide = d.reshape(-1, WIDTH, DIM)
        da = np.matmul(wide, v.transpose(0, 2, 1))
        da *= a
        da -= a * (da.reshape(-1, WIDTH) @ _ONES).reshape(len(a), WIDTH, 1)
        g = np.concatenate([x.reshape(-1, DIM) for x in (np.matmul(da, k), np.matmul(da.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), wide))], 1)
        dense["qkv"] = flat.T @ g
        dx = g @ self.qkv.T
        dx += d
        dense["place"] = dx.reshape(-1, WIDTH, DIM).sum(0)
        for name, g in dense.items():
            self._adapt(name, g, rate)
        g = np.add.reduceat(np.take(dx, order, axis=0), begins, axis=0)
        total = np.take(self.sums["embed"], ranks, axis=0)
        total += g * g
        self.sums["embed"][ranks] = total
        g /= np.sqrt(total)
        g *= rate
        self.embed[ranks] -= g

    def logs(self, windows: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Log probabilities of each window's goals, (windows, WIDTH); 0 for the first ``skip`` of a window and where its text has
        ended."""
        s = self.symbols
        out = np.zeros((len(windows), WIDTH))
        if self._projected is None:
            self._projected = self._project(self.embed)
        # Goals that the window before has need no states here.
        states, goals, places = [], [], []
        for first in np.unique(skip).tolist():
            which = np.flatnonzero(skip == first)
            own = np.take(windows, which, axis=0)
            states.append(self._states(self.embed, self._projected, np.maximum(own[:, :-1], 0), first)[-1])
            goals.append(own[:, first + 1 :].ravel())
            places.append((which[:, None] * WIDTH + np.arange(first, WIDTH)).ravel())
        state, goals, places = (np.concatenate(x) if len(x) > 1 else x[0] for x in (states, goals, places))
        live = np.flatnonzero(goals >= 0)
        if not len(live):
            return out
        live = live[self._order(goals[live])]
        goals, places = goals[live], places[live]
        cls = s.cls[goals]
        own = np.take(state, live, axis=0)
        z = own @ self.top
        np.clip(z, -CAP, CAP, out=z)
        np.exp(z, out=z)
        picked = z[np.arange(len(z)), cls] / (z @ np.ones(z.shape[1], np.float32))
        y, _, starts, at, _ = self._leaves(own, goals, cls)
        picked *= y[at] / np.add.reduceat(y, starts)
        out.ravel()[places] = np.log(picked.astype(np.float64)) + np.where(goals == s.used, s.rest, 0.0)
        return out


class Windows:
    """Windows of WIDTH inputs and their next ranks over texts that each stand between two ends; they begin every ``stride``
    places of a text and are made only as they are taken."""

    def __init__(self, ranks: np.ndarray, bounds: np.ndarray, end: int, stride: int):
        self.seq, self.stride = np.insert(ranks, bounds, end), stride
        self.first, self.goals = bounds[:-1] + np.arange(len(bounds) - 1), np.diff(bounds) + 1
        self.ends = np.cumsum(1 + np.maximum(0, -(-(self.goals - WIDTH) // stride)))

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, ranks, skip) of windows by number: -1 where a text has ended; ``skip`` first goals of a window are those of
        the one before it."""
        text = np.searchsorted(self.ends, which, "right")
        start = (which - np.concatenate([[0], self.ends])[text]) * self.stride
        at = start[:, None] + np.arange(WIDTH + 1)
        where = np.minimum(self.first[text][:, None] + at, len(self.seq) - 1)
        return text, np.where(at <= self.goals[text][:, None], self.seq[where], -1), np.where(start == 0, 0, WIDTH - self.stride)


def score_texts(model: Attention, ranks: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """Log probability of each text's symbols and its end. Windows overlap, so that each symbol after a text's first ones has
    at least WIDTH - STRIDE before it; each is scored once."""
    n = len(bounds) - 1
    out, windows = np.zeros(n), Windows(ranks, bounds, end, STRIDE)
    for at in range(0, len(windows), SCORED):
        text, own, skip = windows.take(np.arange(at, min(at + SCORED, len(windows))))
        out += np.bincount(text, model.logs(own, skip).sum(1), n)
    return out
