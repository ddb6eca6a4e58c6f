"""A character-level bidirectional LSTM with a CRF on top, in numpy.

Training (gradients by hand, Adam) is for the offline script; decoding is what tasks run.
Sequences are arrays of character ids padded with 0 at the end; the padding is a character
like any other and carries the outside tag.
"""

from __future__ import annotations

import numpy as np

TYPES = ("email", "phone", "id_number", "address", "name")
TAGS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
N_IDS = 96 + 800
WINDOW, STRIDE = 192, 160
#: Cells (texts times characters) that are decoded together at most.
CELLS = 400_000
#: Rows that run through the network together: their gates stay in a core's cache.
ROWS = 256


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII has ids of its own; other characters share 800 places by code point."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    ascii_ = (cp >= 32) & (cp < 127)
    return np.where(ascii_, cp - 31, 96 + cp % 800).astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Parameters by name; ``f_`` runs forward in time and ``b_`` backward."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = {k: v.astype(np.float32) for k, v in params.items()}
        self.hidden = self.p["f_U"].shape[0]
        self._tables: dict[str, np.ndarray] | None = None

    @classmethod
    def fresh(cls, embedding: int = 16, hidden: int = 32, seed: int = 7) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"E": r.normal(0, 0.3, (N_IDS, embedding))}
        for d in "fb":
            p[f"{d}_W"] = r.normal(0, 1 / np.sqrt(embedding), (embedding, 4 * hidden))
            p[f"{d}_U"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            p[f"{d}_b"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        p["O"] = r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, len(TAGS)))
        p["o"] = np.zeros(len(TAGS))
        p["T"] = np.zeros((len(TAGS), len(TAGS)))
        return cls(p)

    @classmethod
    def load(cls, file) -> Tagger:
        with np.load(file) as z:
            return cls({k: z[k] for k in z.files})

    def save(self, file) -> None:
        np.savez_compressed(file, **{k: v.astype(np.float16) for k, v in self.p.items()})

    # -- forward ---------------------------------------------------------------------------

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (B, T, tags) of a batch of id rows.

        What a character adds to the gates is looked up, so a step costs one small product.
        """
        if self._tables is None:
            # half of the gates' argument for the three sigmoids, written as tanh
            self._tables = {}
            scale = np.concatenate([np.full(3 * self.hidden, 0.5, np.float32), np.ones(self.hidden, np.float32)])
            for d in "fb":
                self._tables[d] = (self.p["E"] @ self.p[f"{d}_W"] + self.p[f"{d}_b"]) * scale
                self._tables[d + "U"] = self.p[f"{d}_U"] * scale
        return np.concatenate([self._scores(ids[at : at + ROWS]) for at in range(0, max(len(ids), 1), ROWS)])

    def _scores(self, ids: np.ndarray) -> np.ndarray:
        B, T = ids.shape
        H = self.hidden
        out = np.empty((T, B, 2 * H), np.float32)
        step = np.ascontiguousarray(ids.T, dtype=np.intp)
        # the gates of a step, beside what its characters add, and gate by gate
        g, x, q, u = np.empty((B, 4 * H), np.float32), np.empty((B, 4 * H), np.float32), np.empty((4, B, H), np.float32), np.empty((B, H), np.float32)
        by_gate, gates = g.reshape(B, 4, H).transpose(1, 0, 2), q[:3]
        for k, d in enumerate("fb"):
            table, U = self._tables[d], self._tables[d + "U"]
            h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                np.matmul(h, U, out=g)
                np.take(table, step[t], axis=0, out=x, mode="clip")
                g += x
                np.tanh(g, out=g)
                np.copyto(q, by_gate)
                gates *= 0.5
                gates += 0.5
                c *= q[1]
                np.multiply(q[0], q[3], out=u)
                c += u
                np.tanh(c, out=h)
                h *= q[2]
                out[t, :, k * H : (k + 1) * H] = h
        return np.ascontiguousarray((out @ self.p["O"] + self.p["o"]).transpose(1, 0, 2))

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best tag rows (B, T) under the CRF's transitions."""
        B, T, K = scores.shape
        # Where outside leads by more than any change of two transitions could gain, at
        # every character, no other path can win, and nothing is left to search.
        gain = 2 * max(float(self.p["T"].max() - self.p["T"][0, 0]), 0.0)
        hard = np.flatnonzero(~((scores[:, :, 0] - scores[:, :, 1:].max(2)) > gain).all(1))
        if len(hard) < B:
            tags = np.zeros((B, T), np.int8)
            if len(hard):
                tags[hard] = self._search(scores[hard])
            return tags
        return self._search(scores)

    def _search(self, scores: np.ndarray) -> np.ndarray:
        B, T, K = scores.shape
        best = np.ascontiguousarray(scores.transpose(1, 2, 0))  # the rows side by side
        into = np.ascontiguousarray(self.p["T"].T)
        over = np.empty((K, K, B), best.dtype)
        for t in range(1, T):
            np.add(best[t - 1], into[:, :, None], out=over)
            best[t] += over.max(1)
        tags = np.empty((B, T), np.int8)
        tags[:, T - 1] = best[T - 1].argmax(0)
        # where a path came from is asked only along it
        for t in range(T - 1, 0, -1):
            tags[:, t - 1] = (best[t - 1].T + into[tags[:, t]]).argmax(1)
        return tags

    def decode(self, texts: list[str], batch: int = 512) -> list[np.ndarray]:
        """Tag ids of every character of every text.

        Texts longer than a window are cut into overlapping ones. Their scores are blended,
        weighing a window's middle over its rims, and one path is then decoded over the
        whole text, so neighbouring windows cannot disagree.
        """
        windows: list[tuple[int, int, np.ndarray]] = []
        ids = [char_ids(t) for t in texts]
        for i, x in enumerate(ids):
            for at in range(0, max(len(x) - WINDOW + STRIDE, 1), STRIDE):
                windows.append((i, at, x[at : at + WINDOW]))
        windows.sort(key=lambda w: len(w[2]))
        out: list[np.ndarray] = [np.zeros(len(x), np.int8) for x in ids]
        pending: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rim = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
        for at in range(0, len(windows), batch):
            part = windows[at : at + batch]
            T = max(len(part[-1][2]), 1)
            rows = np.zeros((len(part), T), np.int32)
            for r, (_, _, x) in enumerate(part):
                rows[r, : len(x)] = x
            scores = self.emissions(rows)
            whole = [r for r, (i, _, _) in enumerate(part) if len(ids[i]) <= WINDOW]
            if whole:
                for r, tags in zip(whole, self.viterbi(scores[whole])):
                    i = part[r][0]
                    out[i] = tags[: len(ids[i])]
            for r, (i, start, x) in enumerate(part):
                if len(ids[i]) > WINDOW:
                    total, weight = pending.setdefault(i, (np.zeros((len(ids[i]), len(TAGS)), np.float32), np.zeros((len(ids[i]), 1), np.float32)))
                    total[start : start + len(x)] += scores[r, : len(x)] * rim[: len(x), None]
                    weight[start : start + len(x)] += rim[: len(x), None]
        # texts of similar length are decoded together; behind a text's end stands the outside tag
        order = sorted(pending, key=lambda i: len(ids[i]))
        while order:
            n = 1
            while n < min(len(order), batch) and (n + 1) * len(ids[order[n]]) <= CELLS:
                n += 1
            some, order = order[:n], order[n:]
            scores = np.zeros((n, len(ids[some[-1]]), len(TAGS)), np.float32)
            scores[:, :, 0] = 30
            for r, i in enumerate(some):
                total, weight = pending[i]
                scores[r, : len(ids[i])] = total / weight
            for i, tags in zip(some, self.viterbi(scores)):
                out[i] = tags[: len(ids[i])]
        return out

    # -- training --------------------------------------------------------------------------

    def loss_and_gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag rows, and its gradient."""
        p, H = self.p, self.hidden
        B, T = ids.shape
        x = p["E"][ids]
        runs = {}
        for d in "fb":
            order = range(T) if d == "f" else range(T - 1, -1, -1)
            h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
            z = x @ p[f"{d}_W"] + p[f"{d}_b"]
            G, C, Hs, P = np.empty((T, B, 4 * H), np.float32), np.empty((T, B, H), np.float32), np.empty((T, B, H), np.float32), np.empty((T, B, H), np.float32)
            for t in order:
                P[t] = h
                g = z[:, t] + h @ p[f"{d}_U"]
                g[:, : 3 * H] = sigmoid(g[:, : 3 * H])
                g[:, 3 * H :] = np.tanh(g[:, 3 * H :])
                G[t] = g
                c = g[:, H : 2 * H] * c + g[:, :H] * g[:, 3 * H :]
                C[t] = c
                h = g[:, 2 * H : 3 * H] * np.tanh(c)
                Hs[t] = h
            runs[d] = (order, G, C, Hs, P)
        hidden = np.concatenate([runs["f"][3], runs["b"][3]], axis=2)
        s = hidden @ p["O"] + p["o"]
        # forward and backward sums of the CRF
        A, Z = np.empty_like(s), np.empty_like(s)

        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            m = v.max(axis, keepdims=True)
            return (m + np.log(np.exp(v - m).sum(axis, keepdims=True))).squeeze(axis)

        A[0] = s[0]
        for t in range(1, T):
            A[t] = lse(A[t - 1][:, :, None] + p["T"], 1) + s[t]
        Z[T - 1] = 0
        for t in range(T - 2, -1, -1):
            Z[t] = lse(p["T"] + (s[t + 1] + Z[t + 1])[:, None, :], 2)
        log_z = lse(A[T - 1], 1)
        rows = np.arange(B)
        gold = sum(s[t, rows, tags[:, t]] for t in range(T)) + sum(p["T"][tags[:, t - 1], tags[:, t]] for t in range(1, T))
        ds = np.exp(A + Z - log_z[None, :, None])
        dT = np.zeros_like(p["T"])
        for t in range(1, T):
            pair = np.exp(A[t - 1][:, :, None] + p["T"] + (s[t] + Z[t])[:, None, :] - log_z[:, None, None])
            dT += pair.sum(0)
            np.add.at(dT, (tags[:, t - 1], tags[:, t]), -1)
            ds[t, rows, tags[:, t]] -= 1
        ds[0, rows, tags[:, 0]] -= 1
        ds /= B
        g: dict[str, np.ndarray] = {"T": dT / B, "O": np.einsum("tbh,tbk->hk", hidden, ds), "o": ds.sum((0, 1))}
        dh_all = ds @ p["O"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            order, G, C, _, P = runs[d]
            dh, dc = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
            dG = np.empty_like(G)
            steps = list(order)
            for n in range(T - 1, -1, -1):
                t = steps[n]
                i, f, o, u = (G[t][:, j * H : (j + 1) * H] for j in range(4))
                tc = np.tanh(C[t])
                dh = dh + dh_all[t][:, k * H : (k + 1) * H]
                dc = dc + dh * o * (1 - tc * tc)
                before = C[steps[n - 1]] if n else 0
                dG[t] = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
                dh = dG[t] @ p[f"{d}_U"].T
                dc = dc * f
            flat = dG.reshape(-1, 4 * H)
            g[f"{d}_U"] = P.reshape(-1, H).T @ flat
            g[f"{d}_b"] = flat.sum(0)
            g[f"{d}_W"] = x.transpose(1, 0, 2).reshape(-1, x.shape[2]).T @ flat
            dx += (dG @ p[f"{d}_W"].T).transpose(1, 0, 2)
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], ids, dx)
        return float((log_z - gold).mean()), g

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 3, tell=None) -> list[float]:
        """Adam over examples of (ids, tags); rows of similar length share a batch. Returns
        the mean loss of each epoch."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order = sorted(range(len(examples)), key=lambda i: len(examples[i][0]))
        parts = [order[i : i + batch] for i in range(0, len(order), batch)]
        n, history = 0, []
        for e in range(epochs):
            lr = rate * (1 - 0.9 * e / max(epochs - 1, 1))
            losses = []
            for j in r.permutation(len(parts)):
                rows = parts[j]
                T = max(len(examples[i][0]) for i in rows)
                ids, tags = np.zeros((len(rows), T), np.int32), np.zeros((len(rows), T), np.int64)
                for a, i in enumerate(rows):
                    ids[a, : len(examples[i][0])] = examples[i][0]
                    tags[a, : len(examples[i][1])] = examples[i][1]
                loss, g = self.loss_and_gradients(ids, tags)
                n += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                clip = min(1.0, 5.0 / (norm + 1e-9))
                for k, x in g.items():
                    x = x * clip
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
                losses.append(loss)
            history.append(float(np.mean(losses)))
            if tell:
                tell(e, history[-1])
        self._tables = None
        return history


def spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of the tagged stretches; an inside tag after another type opens one."""
    out: list[list] = []
    previous = ""
    for i in np.flatnonzero(tags):
        prefix, kind = TAGS[tags[i]].split("-", 1)
        if out and out[-1][1] == i and previous == kind and prefix == "I":
            out[-1][1] = i + 1
        else:
            out.append([int(i), int(i) + 1, kind])
        previous = kind
    return [(a, b, k) for a, b, k in out]
