"""A small causal self-attention model over units of subword ids, in numpy.

One layer: embeddings with positions, one attention head over the window, a hidden layer and a
softmax in two steps (group of units, unit within the group). Windows overlap: of each
``SPAN`` positions the last ``STRIDE`` are scored, so every token is scored once and sees at
least ``SPAN - STRIDE`` tokens before it where the text has them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GROUPS, EACH = 16, 16
UNITS = GROUPS * EACH
WIDTH, HIDDEN = 16, 16
SPAN, STRIDE = 16, 12
LOOK = SPAN - STRIDE
#: Windows that are scored together; their arrays stay in the processor's cache.
TOGETHER = 512
#: 1 where a scored place may look; the scores are small, so that no maximum is taken off
CAUSAL = (np.arange(SPAN)[None] <= np.arange(LOOK, SPAN)[:, None]).astype(np.float32)


def input_windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First scored position and text of every window; ends of the texts' inputs, which
    are all of their units but the last."""
    inputs = np.stack([bounds[:-1], bounds[1:] - 1], 1)
    number = -(-(inputs[:, 1] - inputs[:, 0]) // STRIDE)
    text = np.repeat(np.arange(len(inputs)), number)
    order = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    return inputs[text, 0] + order * STRIDE, text, inputs


def places(first: np.ndarray, limits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each window and which of them belong to its text."""
    at = first[:, None] + np.arange(-LOOK, STRIDE)
    inside = (at >= limits[:, :1]) & (at < limits[:, 1:])
    return np.clip(at, 0, n - 1), inside


class Model:
    """Weights by name."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        one = WIDTH**-0.5
        return cls({
            "embed": normal(UNITS, WIDTH, scale=0.3), "place": normal(SPAN, WIDTH, scale=0.1),
            "query": normal(WIDTH, WIDTH, scale=one / 4), "key": normal(WIDTH, WIDTH, scale=one),
            "value": normal(WIDTH, WIDTH, scale=one), "mix": normal(2 * WIDTH, HIDDEN, scale=one),
            "shift": np.zeros(HIDDEN, np.float32),
            "group": normal(HIDDEN, GROUPS, scale=HIDDEN**-0.5),
            "group_bias": np.zeros(GROUPS, np.float32),
            "unit": normal(GROUPS, HIDDEN, EACH, scale=HIDDEN**-0.5),
            "unit_bias": np.zeros((GROUPS, EACH), np.float32),
        })

    def hidden(self, units: np.ndarray, inside: np.ndarray):
        """Hidden rows of the scored places (one after the other), and what training needs."""
        w = self.w
        x = w["embed"].take(units, 0)
        x += w["place"]
        flat = x.reshape(-1, WIDTH)
        own = np.ascontiguousarray(x[:, LOOK:]).reshape(-1, WIDTH)
        q = (own @ w["query"]).reshape(-1, STRIDE, WIDTH)
        k = (flat @ w["key"]).reshape(x.shape)
        v = (flat @ w["value"]).reshape(x.shape)
        a = q @ k.transpose(0, 2, 1)
        np.exp(a, out=a)
        a *= CAUSAL
        if not inside.all():
            a *= inside[:, None, :]
        total = (a.reshape(-1, SPAN) @ np.ones(SPAN, a.dtype)).reshape(len(x), STRIDE, 1)
        total += np.float32(1e-20)
        both = np.empty((len(own), 2 * WIDTH), a.dtype)
        np.divide((a @ v).reshape(-1, WIDTH), total.reshape(-1, 1), out=both[:, :WIDTH])
        both[:, WIDTH:] = own
        h = both @ w["mix"]
        h += w["shift"]
        np.maximum(h, 0, out=h)
        return h, (x, q, k, v, a, total, both)

    def gradient(self, units, inside, target) -> tuple[float, dict[str, np.ndarray]]:
        """Loss per scored unit and the gradient of all weights."""
        w = self.w
        h, (x, q, k, v, a, total, both) = self.hidden(units, inside)
        scored = inside[:, LOOK:].ravel().astype(np.float32)
        target = target.ravel()
        rows, group = np.arange(len(h)), target // EACH
        n = max(float(scored.sum()), 1.0)
        weight = scored / n
        p = _softmax(h @ w["group"] + w["group_bias"])
        loss = -(np.log(p[rows, group]) * weight).sum()
        p[rows, group] -= 1
        p *= weight[:, None]
        g = {
            "group": h.T @ p, "group_bias": p.sum(0),
            "unit": np.zeros_like(w["unit"]), "unit_bias": np.zeros_like(w["unit_bias"]),
        }
        dh = p @ w["group"].T
        order = np.argsort(group.astype(np.uint8), kind="stable")  # rows of one group share a product
        ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        for one, (first, last) in enumerate(zip([0, *ends], ends, strict=False)):
            if first == last:
                continue
            mine = order[first:last]
            some, each = h.take(mine, 0), target.take(mine) % EACH
            u = _softmax(some @ w["unit"][one] + w["unit_bias"][one])
            at = np.arange(len(mine))
            loss -= (np.log(u[at, each]) * weight.take(mine)).sum()
            u[at, each] -= 1
            u *= weight.take(mine)[:, None]
            g["unit"][one], g["unit_bias"][one] = some.T @ u, u.sum(0)
            dh[mine] += u @ w["unit"][one].T
        dh *= h > 0
        g |= {"mix": both.T @ dh, "shift": dh.sum(0)}
        d_both = dh @ w["mix"].T
        do = d_both[:, :WIDTH].reshape(-1, STRIDE, WIDTH)
        own = both[:, WIDTH:]
        a = a / total
        da = do @ v.transpose(0, 2, 1)
        dv = a.transpose(0, 2, 1) @ do
        ds = a * (da - (da * a).sum(2, keepdims=True))
        dq, dk = (ds @ k).reshape(-1, WIDTH), (ds.transpose(0, 2, 1) @ q).reshape(-1, WIDTH)
        flat = x.reshape(-1, WIDTH)
        dv = dv.reshape(-1, WIDTH)
        g |= {"query": own.T @ dq, "key": flat.T @ dk, "value": flat.T @ dv}
        dx = (dk @ w["key"].T + dv @ w["value"].T).reshape(x.shape)
        dx[:, LOOK:] += (dq @ w["query"].T + d_both[:, WIDTH:]).reshape(-1, STRIDE, WIDTH)
        g["place"] = dx.sum(0)
        g["embed"] = np.zeros_like(w["embed"])
        order = np.argsort(units.ravel().astype(np.uint16), kind="stable")
        kinds, first = np.unique(units.ravel().take(order), return_index=True)
        g["embed"][kinds] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, 0), first, axis=0)
        return float(loss), g

    def _log_softmax_at(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """ln P(target) from hidden rows; rows of one group share a product."""
        w = self.w
        group = (target // EACH).astype(np.uint8)
        rows = np.arange(len(h))
        ones = np.ones(max(GROUPS, EACH), h.dtype)
        out = h @ w["group"]
        out += w["group_bias"]
        result = out.ravel().take(rows * GROUPS + group)
        total = np.exp(out, out=out) @ ones[:GROUPS]
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        h = h.take(order, 0)
        part = np.empty((len(h), EACH), h.dtype)
        a = 0
        for k, b in enumerate(ends):
            if b > a:
                np.matmul(h[a:b], w["unit"][k], out=part[a:b])
                part[a:b] += w["unit_bias"][k]
            a = b
        found = part.ravel().take(rows * EACH + (target % EACH).take(order))
        found -= np.log(np.exp(part, out=part) @ ones[:EACH])
        result -= np.log(total)
        result[order] += found
        return result

    def log_probabilities(self, units: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """ln P(unit | what comes before in the text) of every unit; each text begins and
        ends with unit 0, the first of which is not scored (0)."""
        out = np.zeros(len(units))
        first, text, inputs = input_windows(bounds)
        for a in range(0, len(first), TOGETHER):
            some = slice(a, a + TOGETHER)
            at, inside = places(first[some], inputs[text[some]], len(units))
            h, _ = self.hidden(units[at], inside)
            scored = inside[:, LOOK:].ravel()
            target = (at[:, LOOK:].ravel() + 1)[scored]
            h = h if scored.all() else h[scored]
            out[target] = self._log_softmax_at(h, units[target])
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


#: Windows of a training step, and the share of the learning rate's climb in steps.
BATCH, CLIMB, RATE = 128, 20, 0.015


@dataclass
class State:
    """A model in training: weights, the means that Adam keeps of their gradients, and the
    windows learned from so far. States of the same round add up to one."""

    weights: dict[str, np.ndarray]
    mean: dict[str, np.ndarray]
    power: dict[str, np.ndarray]
    steps: float = 0

    @classmethod
    def fresh(cls) -> State:
        w = Model.fresh().w
        return cls(w, *({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2)))

    def flat(self) -> np.ndarray:
        parts = [x.ravel() for d in (self.weights, self.mean, self.power) for x in d.values()]
        return np.concatenate(parts).astype(np.float64)

    @classmethod
    def of(cls, flat: np.ndarray, steps: float) -> State:
        own, at = cls.fresh(), 0
        for d in (own.weights, own.mean, own.power):
            for n, x in d.items():
                d[n] = flat[at : at + x.size].reshape(x.shape).astype(x.dtype)
                at += x.size
        own.steps = steps
        return own

    def learn(self, units: np.ndarray, bounds: np.ndarray, rng, rate, passes: int = 1,
              batch: int = BATCH) -> int:
        """Adam on every window of the given texts, ``passes`` times in an order drawn anew;
        ``rate(steps)`` is the learning rate. Returns the steps taken."""
        first, text, inputs = input_windows(bounds)
        model, taken = Model(self.weights), 0
        for _ in range(passes):
            order = rng.permutation(len(first))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                at, inside = places(first[pick], inputs[text[pick]], len(units))
                target = units[np.minimum(at[:, LOOK:] + 1, len(units) - 1)]
                _, g = model.gradient(units[at], inside, target)
                self.steps += 1
                taken += 1
                now, k = rate(self.steps), self.steps
                for n, x in self.weights.items():
                    mean, power = self.mean[n], self.power[n]
                    mean *= 0.9
                    mean += 0.1 * g[n]
                    power *= 0.99
                    power += 0.01 * g[n] ** 2
                    x -= now * (mean / (1 - 0.9**k)) / (np.sqrt(power / (1 - 0.99**k)) + 1e-8)
        return taken


def train(units: np.ndarray, bounds: np.ndarray, steps: int, batch: int = BATCH, rate: float = RATE,
          seed: int = 3) -> Model:
    """Adam on all windows of the given texts, in as many passes as make ``steps`` steps."""
    state = State.fresh()
    each = -(-len(input_windows(bounds)[0]) // batch)
    if each:
        passes = -(-steps // each)
        state.learn(units, bounds, np.random.default_rng(seed),
                    lambda k: rate * min(1.0, k / CLIMB) * (1 - k / (passes * each + 1)), passes, batch)
    return Model(state.weights)
