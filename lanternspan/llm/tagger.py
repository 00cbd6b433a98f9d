"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Characters of a window, and how many of them two neighbours share.
WINDOW, OVERLAP = 112, 32


_DIGITS = re.compile(r"\d")


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _logsumexp(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Tags each character; `tags[0]` is the outside tag. Deterministic under its seed."""

    def __init__(self, tags: list[str], chars: str, emb: int = 20, hidden: int = 28, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tags, self.emb, self.hidden = tags, emb, hidden
        self.index = {c: i + 2 for i, c in enumerate(chars)}  # 0 pads, 1 is any other character
        k, h = len(tags), hidden
        mat = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"E": (0.3 * rng.standard_normal((len(chars) + 2, emb))).astype(np.float32), "O": mat(2 * h, k), "o": np.zeros(k, np.float32), "T": np.zeros((k, k), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": mat(emb, 4 * h), f"U{d}": mat(h, 4 * h), f"c{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}

    def encode(self, texts: list[str]) -> np.ndarray:
        """(longest text, number of texts) character numbers; all digits are one character."""
        length = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((int(length.max(initial=0)), len(texts)), np.int32)
        if getattr(self, "_number", None) is None:  # the last entry stands for all characters beyond
            self._number = np.ones(max(map(ord, self.index), default=0) + 2, np.int32)
            self._number[[ord(c) for c in self.index]] = list(self.index.values())
        codes = np.frombuffer(_DIGITS.sub("0", "".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
        out[place, np.repeat(np.arange(len(texts)), length)] = self._number[np.minimum(codes, len(self._number) - 1)]
        return out

    def _lstm(self, x, d, keep):
        p, h = self.p, self.hidden
        steps, b = x.shape[:2]
        g = x @ p[f"W{d}"] + p[f"c{d}"]
        hs, cs = np.zeros((steps + 1, b, h), np.float32), np.zeros((steps + 1, b, h), np.float32)
        gates = np.empty((steps, b, 4 * h), np.float32) if keep else None
        u = p[f"U{d}"]
        for t in range(steps):
            z = g[t] + hs[t] @ u
            s, n = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            cs[t + 1] = s[:, h : 2 * h] * cs[t] + s[:, :h] * n
            hs[t + 1] = s[:, 2 * h :] * np.tanh(cs[t + 1])
            if keep:
                gates[t, :, : 3 * h], gates[t, :, 3 * h :] = s, n
        return hs, cs, gates

    def emissions(self, ids, keep=False):
        x = self.p["E"][ids]
        f, b = self._lstm(x, "f", keep), self._lstm(x[::-1], "b", keep)
        both = np.concatenate([f[0][1:], b[0][:0:-1]], axis=2)
        return both @ self.p["O"] + self.p["o"], (x, f, b, both)

    def _fast(self):
        """Weights for decoding, those of both directions behind each other: from a state, a character's embedding and 1 to
        the gates, scaled so that one tanh serves all gates; the embeddings; the output weights and their bias. States come out twice
        their size, so the weights that they meet are halved. Values of one kind lie together, texts side by side."""
        if getattr(self, "_ready", None) is None:
            p, h = self.p, self.hidden
            scale = np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(np.float32)
            w = np.stack([(np.concatenate([0.5 * p[f"U{d}"], p[f"W{d}"], p[f"c{d}"][None]]) * scale).T for d in "fb"])
            o = np.stack([0.5 * p["O"][:h].T, 0.5 * p["O"][h:].T])
            self._ready = np.ascontiguousarray(w, np.float32), np.ascontiguousarray(p["E"].T), np.ascontiguousarray(o, np.float32), p["o"][:, None]
        return self._ready

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_ready", "_number")}

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Most likely tags (Viterbi) of (characters, n)."""
        return self.decode_with_confidence(ids)[0]

    def decode_with_confidence(self, ids: np.ndarray, lean: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Most likely tags (Viterbi) of (characters, n), and the probability that the network alone gives each; 1 in texts
        without any but the outside tag. `lean` is taken from the outside tag's scores: more spans come out, and a later
        check decides. Texts end where their padding (0) begins, so a text's tags don't depend on those beside it."""
        w, emb, o, bias = self._fast()
        h, (steps, n) = self.hidden, ids.shape
        if not ids.size:
            return np.zeros((steps, n), np.int8), np.ones((steps, n), np.float32)
        ids, real = ids.astype(np.intp), ids > 0
        padded = int(real.sum(0).min())  # from here on some texts have ended
        # state, embedding and 1 of both directions for one character: what a step touches stays in the core's cache
        x, z, e = np.ones((2, w.shape[2], n), np.float32), np.empty((2, 4 * h, n), np.float32), np.empty((steps, 2, len(self.tags), n), np.float32)
        cell, part = np.zeros((2, h, n), np.float32), np.empty((2, h, n), np.float32)
        gates, state = z[:, : 3 * h], x[:, :h]
        state[:] = 0
        for t in range(steps):
            np.take(emb, ids[t], axis=1, out=x[0, h:-1], mode="clip")
            np.take(emb, ids[steps - 1 - t], axis=1, out=x[1, h:-1], mode="clip")
            np.matmul(w, x, out=z)
            np.tanh(z, out=z)
            gates += 1  # twice the sigmoid
            cell *= z[:, h : 2 * h]
            np.multiply(z[:, :h], z[:, 3 * h :], out=part)
            cell += part
            cell *= 0.5
            np.tanh(cell, out=part)
            np.multiply(part, z[:, 2 * h : 3 * h], out=state)
            if (at := steps - 1 - t) >= padded:  # backwards, shorter texts haven't begun
                cell[1] *= real[at]
                state[1] *= real[at]
            np.matmul(o, state, out=e[t])
        for t in range(steps):
            e[t, 0] += e[steps - 1 - t, 1]
            e[t, 0] += bias
        e = e[:, 0]
        e[:, 0] -= lean
        out, sure = np.zeros((steps, n), np.int8), np.ones((steps, n), np.float32)
        open_ = np.flatnonzero(self._gain(e, padded) > -1e-3)
        if len(open_):
            out[:, open_], sure[:, open_] = self._viterbi(e[:, :, open_], real[:, open_], padded)
        return out, sure

    def _gain(self, e: np.ndarray, padded: int) -> np.ndarray:
        """What any stretch off the outside tag can gain over it at most, with the best of the tags that begin spans, the best
        of those that continue them and the best transitions between the two kinds: where that is below 0, the outside tag is
        best everywhere. From `padded` on a text may end, after which it needs no way back."""
        trans, steps = self.p["T"] - self.p["T"][0, 0], len(e)
        kinds = [k for k in (slice(1, None, 2), slice(2, None, 2)) if e[0, k].size]
        best_of = lambda to: np.array([trans[a, to].max() for a in (0, *kinds)], np.float32)
        start, *by = zip(*(best_of(k) for k in kinds))
        start, same, cross = np.array(start)[:, None], np.array([by[i][i] for i in range(len(kinds))])[:, None], np.array([by[len(kinds) - 1 - i][i] for i in range(len(kinds))])[:, None]
        end = np.array([trans[k, 0].max() for k in kinds], np.float32)[:, None]
        d = np.stack([e[:, k].max(1) for k in kinds], 1)
        d -= e[:, :1]
        run, part = d[0].copy(), np.empty_like(d[0])
        free = np.maximum(end, 0)
        best = run + (end if padded > 1 else free)
        for t in range(1, steps):
            np.add(run[::-1], cross, out=part)
            run += same
            np.maximum(run, part, out=run)
            np.maximum(run, start, out=run)
            run += d[t]
            np.add(run, end if t < padded - 1 else free, out=part)
            np.maximum(best, part, out=best)
        return best.max(0)

    def _viterbi(self, e: np.ndarray, real: np.ndarray, padded: int) -> tuple[np.ndarray, np.ndarray]:
        """e: (characters, tags, n); real: which characters are no padding, of which there is none before `padded`."""
        steps, k, n = e.shape
        trans = self.p["T"]
        s, new, only = np.empty_like(e), np.empty((k, k, n), np.float32), e[0, 0].copy()
        s[0], ways = e[0], np.ascontiguousarray(np.broadcast_to(trans[:, :, None], (k, k, n)))
        for t in range(1, steps):
            np.add(s[t - 1][:, None], ways, out=new)
            np.maximum.reduce(new, axis=0, out=s[t])
            s[t] += e[t]
            new_only = only + trans[0, 0] + e[t, 0]
            if t >= padded:  # scores stay as they are where a text has ended
                np.copyto(s[t], s[t - 1], where=~real[t])
                np.copyto(new_only, only, where=~real[t])
            only = new_only
        out, sure = np.zeros((steps, n), np.int8), np.ones((steps, n), np.float32)
        at = np.flatnonzero(s[-1].max(0) > only)  # elsewhere the path of outside tags is as good as any
        if len(at):
            # each text's scores lie together, as do those of the ways to a tag
            s, e, path = np.ascontiguousarray(s[:, :, at].transpose(0, 2, 1)), e[:, :, at], np.empty((steps, len(at)), np.int64)
            into, part = np.ascontiguousarray(trans.T), np.empty((len(at), k), np.float32)
            s[-1].argmax(1, out=path[-1])
            for t in range(steps - 1, 0, -1):
                np.take(into, path[t], axis=0, out=part, mode="clip")
                part += s[t - 1]
                part.argmax(1, out=path[t - 1])
                if t >= padded:
                    np.copyto(path[t - 1], path[t], where=~real[t, at])
            p = np.exp(e - e.max(1, keepdims=True))
            path[padded:] *= real[padded:, at]
            out[:, at], sure[:, at] = path, np.take_along_axis(p, path[:, None], 1)[:, 0] / p.sum(1)
        return out, sure

    def _gradients(self, ids, gold):
        p, h = self.p, self.hidden
        e, (x, f, b, both) = self.emissions(ids, keep=True)
        steps, n, k = e.shape
        mask = (ids > 0).astype(np.float32)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + p["T"], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(p["T"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        np.put_along_axis(de, gold[:, :, None], np.take_along_axis(de, gold[:, :, None], 2) - 1, 2)
        dt = np.zeros_like(p["T"])
        for t in range(1, steps):
            dt += np.exp(alpha[t - 1][:, :, None] + p["T"] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(dt, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        de *= mask[:, :, None] / n
        out = {"T": dt / n, "O": both.reshape(-1, 2 * h).T @ de.reshape(-1, k), "o": de.sum((0, 1))}
        dh = de @ p["O"].T
        dx = np.zeros_like(x)
        for d, (hs, cs, gates), grad, flip in (("f", f, dh[:, :, :h], False), ("b", b, dh[::-1, :, h:], True)):
            dz = np.empty_like(gates)
            hn, cn = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in range(steps - 1, -1, -1):
                i, fg, o, g = (gates[t, :, j * h : (j + 1) * h] for j in range(4))
                hn = hn + grad[t]
                tc = np.tanh(cs[t + 1])
                cn = cn + hn * o * (1 - tc * tc)
                dz[t, :, :h], dz[t, :, h : 2 * h] = cn * g * i * (1 - i), cn * cs[t] * fg * (1 - fg)
                dz[t, :, 2 * h : 3 * h], dz[t, :, 3 * h :] = hn * tc * o * (1 - o), cn * i * (1 - g * g)
                hn, cn = dz[t] @ p[f"U{d}"].T, cn * fg
            flat = dz.reshape(-1, 4 * h)
            xs = x[::-1] if flip else x
            out |= {f"W{d}": xs.reshape(-1, self.emb).T @ flat, f"U{d}": hs[:-1].reshape(-1, h).T @ flat, f"c{d}": flat.sum(0)}
            back = (flat @ p[f"W{d}"].T).reshape(x.shape)
            dx += back[::-1] if flip else back
        de_ = np.zeros_like(p["E"])
        np.add.at(de_, ids.ravel(), dx.reshape(-1, self.emb))
        out["E"] = de_
        return out

    def fit(self, texts: list[str], labels: list[np.ndarray], epochs: int = 8, batch: int = 48, rate: float = 8e-3, seed: int = 11) -> Tagger:
        """Adam with clipped gradients and a falling rate; texts of at most WINDOW characters, a tag number for each.
        Batches hold texts of about one length."""
        rng = np.random.default_rng(seed)
        length = np.array([len(t) for t in texts])
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = np.lexsort((rng.random(len(texts)), length // 12))
            starts = rng.permutation(np.arange(0, len(order), batch))
            for at in starts:
                j = order[at : at + batch]
                ids = self.encode([texts[i] for i in j])
                gold = np.zeros(ids.shape, np.int64)
                for c, i in enumerate(j):
                    gold[: len(labels[i]), c] = labels[i]
                g = self._gradients(ids, gold)
                norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
                step += 1
                lr = rate * (1 - 0.9 * step / total)
                for k, x in g.items():
                    x = (x * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        self._ready = None
        return self


def shape(word: str) -> str:
    """Form of a word: X, x and 0 for capitals, other letters and digits, signs as they are; runs of letters as two."""
    if word.islower() and word.isalpha():
        return "xx" if len(word) > 1 else "x"
    out = "".join("0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:24])
    return _LONG.sub(r"\1\1", out)


_LONG = re.compile(r"([Xx])\1{2,}")


class Gate:
    """A logistic model over the words of a line: which windows the tagger reads.

    A word is judged by itself, its form, its first and last letters, and the forms beside it (hashed). The threshold
    lets all but `lost` of the labelled spans of the sample through, less a margin (labels are weak, and the last few
    hundredths are mostly false); a span needs one word that passes. No operator uses it: `pii` has every window read.
    """

    BUCKETS = 1 << 17

    def __init__(self, lost: float = 0.04, margin: float = 0.0):
        self.w, self.floor, self.lost, self.margin = np.zeros(self.BUCKETS, np.float32), -1e9, lost, margin
        self._clear()

    def _clear(self):
        self._words: dict[str, tuple[str, float]] = {}
        self._list = self.w.tolist()  # single numbers come out of a list sooner
        self._scores: dict[tuple[str, str, str], float] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_words", "_scores", "_list")}

    def __setstate__(self, d):
        self.__dict__.update(d)
        self._clear()

    def _hash(self, *keys: str) -> list[int]:
        return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % self.BUCKETS for k in keys]

    def _of_word(self, word: str) -> list[int]:
        low = _DIGITS.sub("0", word.lower())
        return self._hash("w" + low, "s" + shape(word), "a" + low[:3], "z" + low[-4:])

    def _of_place(self, before: str, own: str, after: str) -> list[int]:
        return self._hash(f"b{before}|{own}", f"n{own}|{after}", f"t{before}|{own}|{after}")

    def _word(self, word: str) -> tuple[str, float]:
        found = self._words.get(word)
        if found is None:
            if len(self._words) > 300_000:
                self._words.clear()
            found = self._words[word] = (shape(word), sum(map(self._list.__getitem__, self._of_word(word))))
        return found

    def hits(self, words: list[str]) -> list[int]:
        """Which words pass."""
        known = list(map(self._words.get, words))
        if None in known:
            known = list(map(self._word, words))
        forms = [k[0] for k in known]
        places, floor, scores, out = zip(["", *forms[:-1]], forms, [*forms[1:], ""]), self.floor, self._scores, []
        for i, place in enumerate(places):
            x = scores.get(place)
            if x is None:
                if len(scores) > 300_000:
                    scores.clear()
                x = scores[place] = sum(map(self._list.__getitem__, self._of_place(*place)))
            if x + known[i][1] >= floor:
                out.append(i)
        return out

    def fit(self, lines: list[list[str]], inside: list[list[int]], rounds: int = 150, seed: int = 13) -> Gate:
        """lines: words; inside: for each word the number of the span it lies in (from 0 in each line), or -1."""
        rows = []
        for ws in lines:
            forms = ["", *map(shape, ws), ""]
            rows += [self._of_word(w) + self._of_place(*forms[i : i + 3]) for i, w in enumerate(ws)]
        if not rows:
            return self
        x, y = np.array(rows), np.array([s >= 0 for line in inside for s in line], np.float32)
        rng, g2 = np.random.default_rng(seed), np.full(self.BUCKETS, 1e-3, np.float32)
        weight = np.where(y > 0, max(1.0, (y == 0).sum() / max(1, y.sum()) / 10), 1.0).astype(np.float32)
        for _ in range(rounds):
            keep = np.ones(x.shape, np.float32)
            keep[:, 0] = rng.random(len(x)) < 0.3  # most of the time a word has to do without itself
            p = 1 / (1 + np.exp(-(self.w[x] * keep).sum(1)))
            g = (((p - y) * weight)[:, None] * keep).ravel()
            grad = np.bincount(x.ravel(), g, self.BUCKETS).astype(np.float32) / len(x) + 1e-6 * self.w
            g2 += grad * grad
            self.w -= 0.3 * grad / np.sqrt(g2)
        score, at, best = self.w[x].sum(1), 0, []
        for line in inside:
            spans: dict[int, float] = {}
            for s, v in zip(line, score[at : at + len(line)]):
                if s >= 0:
                    spans[s] = max(v, spans.get(s, -1e9))
            best += spans.values()
            at += len(line)
        self._clear()
        if best:
            self.floor = float(np.quantile(best, self.lost)) - self.margin
        return self
