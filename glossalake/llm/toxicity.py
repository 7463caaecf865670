"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors side by side: one of the whole word (hashed) and the mean
of those of its character trigrams (hashed, word ends marked). All overlapping windows of a
text are scored; the text's score is that of its most toxic window. Training sees whole
texts with one label each, so the gradient flows to the windows in proportion to how
toxic they look already.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossalake.llm.common import bounded_sample, inputs, small_batches

_f = np.float32
WINDOW = 24
#: Words from one window to the next in training; scoring takes every window.
STRIDE = 12
HIDDEN, EMBED, BUCKETS = 8, 12, 1 << 14
#: Bound on the labelled documents the network is trained on: a third with label 1, where there are so many.
MAX_DOCS = 2400
#: Windows that run side by side.
LANES = 2048
#: Exponents of gates and candidates are held within this: twice it is less than a float32 can take, and what lies beyond changes none.
STEEP = 40.0
#: Of the inputs of both gates and of the candidate in the exponents.
FACTOR = np.repeat(np.array([-1, -1, -2], np.float32), HIDDEN)
#: Turn an exponent of e into the bits of a float32 that lies within 3 % of the exponential: bits, read as a whole number, grow nearly as the logarithm does.
BITS, ZERO = _f(2**23 * np.log2(np.e)), _f(127 * 2**23 - 366_393)
#: Words that the coarse pass reads up to a word, that one included, from either side.
SPAN = 16
#: Logits below the highest of a text's coarse ones within which windows are computed in full; twice the largest error met, where that is more.
REACH = 0.5
#: Pieces beyond which a task forgets those it met: up to 67 MB of input parts.
MOST_WORDS = 1 << 18
_WORD = re.compile(r"\w+")


def _vectorised(name: str) -> bool:
    """Whether numpy computes a function of float32 many at once on this machine."""
    known = np.lib.introspect.opt_func_info(f"^{name}$", "float32") if hasattr(np.lib, "introspect") else {}  # numpy 2.1 and later tell
    return any("AVX512" in x["current"] for x in known.get(name, {}).values())


#: Exponentials to the base 2 take half the time where AVX-512 has them, and three times as long elsewhere; SCALE turns exponents of e into its own.
EXP, SCALE = (np.exp2, _f(np.log2(np.e))) if _vectorised("exp2") else (np.exp, _f(1))


def pieces(text: str | None) -> list[str]:
    """What white space parts, in lower case."""
    return (text or "").lower().split()


def inside(piece: str) -> list[str]:
    """Runs of word characters; a piece is looked at closely only where it holds signs."""
    return [piece] if piece.isalnum() else _WORD.findall(piece)


def words(text: str | None) -> list[str]:
    """Runs of word characters in lower case."""
    return [w for piece in pieces(text) for w in inside(piece)]


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; trigram buckets of all words end to end; where each word's trigrams begin."""
    word = np.fromiter([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in vocabulary], np.int64, len(vocabulary)) & (BUCKETS - 1)
    codes = np.frombuffer(("\n" + "\n".join(vocabulary) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
    h = ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)
    inside = codes[1:-1] != 10  # the middle character belongs to a word
    lengths = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
    return word, h[inside], np.concatenate(([0], np.cumsum(lengths)[:-1]))


def windows(n: int, stride: int = STRIDE) -> np.ndarray:
    """Starts of the windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + 1, stride)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def layout(texts: list[list[str]], stride: int = STRIDE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words; window x place -> number of the word (-1 past the end); the text of each window. Texts without words have none."""
    numbers: dict[str, int] = {}
    ids = [np.fromiter([numbers.setdefault(w, len(numbers)) for w in t], np.int64, len(t)) for t in texts]
    rows, owner = [], []
    for k, x in enumerate(ids):
        if not len(x):
            continue
        starts = windows(len(x), stride)
        if len(x) < WINDOW:
            x = np.concatenate([x, np.full(WINDOW - len(x), -1)])
        rows.append(x[starts[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(starts), k))
    if not rows:
        return [], np.empty((0, WINDOW), np.int64), np.empty(0, np.int64)
    return list(numbers), np.concatenate(rows), np.concatenate(owner)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return _f(0.5) * np.tanh(_f(0.5) * x) + _f(0.5)


class Network:
    """Parameters by name; ``directions`` 0 reads forwards, 1 backwards."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)

        def small(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(_f)

        d, h = 2 * EMBED, HIDDEN
        self.p = {"word": small(BUCKETS, EMBED, scale=0.1), "char": small(BUCKETS, EMBED, scale=0.3), "v": small(2 * h, scale=0.3), "o": small(2 * h, scale=0.5), "c": np.full(1, -1.0, _f)}
        for k in (0, 1):
            self.p |= {f"W{k}": small(d, 3 * h, scale=0.4), f"U{k}": small(h, 3 * h, scale=0.3), f"b{k}": np.zeros(3 * h, _f)}

    def embed(self, vocabulary: list[str]) -> tuple[np.ndarray, tuple]:
        word, char, at = features(vocabulary)
        n = np.diff(np.append(at, len(char))).astype(_f)
        x = np.concatenate([self.p["word"][word], np.add.reduceat(self.p["char"][char], at, axis=0) / n[:, None]], axis=1)
        return x, (word, char, at, n)

    def run(self, projected: list[np.ndarray], rows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
        """Logits of windows, from the input parts of all words (the last row stands for -1)."""
        n, h = len(rows), HIDDEN
        out = np.empty((WINDOW, n, 2 * h), _f)
        tape: list = [[None] * WINDOW, [None] * WINDOW]
        for k in (0, 1):
            u, state = self.p[f"U{k}"], np.zeros((n, h), _f)
            for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
                x = projected[k][rows[:, t]]
                hu = state @ u
                gates = sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
                if keep:
                    tape[k][t] = (state, z, r, new, hu[:, 2 * h :])
                state = new + z * (state - new)
                out[t, :, k * h : (k + 1) * h] = state
        score = np.where((rows >= 0).T, out @ self.p["v"], _f(-1e9))
        a = np.exp(score - score.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * out).sum(axis=0)
        return pooled @ self.p["o"] + self.p["c"], (out, a, pooled, tape) if keep else None

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.concatenate([x @ self.p[f"W{k}"] + self.p[f"b{k}"], self.p[f"b{k}"][None]]) for k in (0, 1)]

    def scores(self, texts: list[list[str]], met: Met | None = None) -> np.ndarray:
        """0 to 1 for each text, given as words or pieces; 0.0 without words. All overlapping windows count. met: the words of this network's texts before."""
        met = met or Met(self)
        ids, first, last = met.line_up(texts)
        best = np.full(len(texts), -np.inf)
        if len(ids):
            some = np.flatnonzero(last >= 0)
            bounds = np.stack([first[some], last[some] + 1], axis=1).ravel()
            best[some] = np.maximum.reduceat(self.logits(met, ids, bounds), bounds)[::2]
        return 1 / (1 + np.exp(-np.clip(best, -700, 700))) * np.isfinite(best)

    def logits(self, met: Met, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The logit of the window from each place on, where it may be the highest of its text; -inf for all others and behind the last.

        bounds: where the windows of a text begin and end, in turn. ``sweep`` computes all windows coarsely. Those within
        REACH of a text's highest are computed in full by ``run``; where that shows larger errors than REACH is made for, those within
        twice the largest error are too, until there are no more.
        """
        n = len(ids) - WINDOW + 1
        coarse = np.append(np.zeros(n, _f) if self.steep(met.steepest) else self.sweep(met.known, ids), _f(-np.inf))
        top = np.maximum.reduceat(coarse, bounds)
        top[1::2] = np.inf  # from one text to the next
        below = np.repeat(top, np.diff(np.append(bounds, n + 1))) - coarse
        logit, reach = np.full(n + 1, -np.inf, _f), REACH
        while len(left := np.flatnonzero((below <= reach) & (logit == -np.inf))):
            for at in range(0, len(left), LANES):
                some = left[at : at + LANES]
                found, rows = np.unique(np.append(0, ids[some[:, None] + np.arange(WINDOW)]), return_inverse=True)
                known = met.known[:, np.append(found[1:], 0), : 3 * HIDDEN] / (FACTOR * SCALE)
                logit[some] = self.run(list(known), rows[1:].reshape(-1, WINDOW) - 1)[0]
            reach = max(reach, 2 * float(np.abs(logit[left] - coarse[left]).max()))
        return logit

    def steep(self, steepest: float) -> bool:
        """Whether exponents, of words up to steepest, may pass STEEP: states lie between -1 and 1, which bounds them."""
        return steepest / float(SCALE) + max(np.abs(self.p[f"U{k}"] * FACTOR).sum(axis=0).max() for k in (0, 1)) > STEEP

    def parts(self, vocabulary: list[str]) -> tuple[np.ndarray, float]:
        """Direction x word -> exponents of gates and candidate, and the state that the word alone leaves, as ``sweep`` takes them; the highest exponent. No words: of the empty one."""
        h, x = HIDDEN, self.project(self.embed(vocabulary)[0] if vocabulary else np.empty((0, 2 * EMBED), _f))
        x = np.stack(x)[:, : len(vocabulary) or 1] * (FACTOR * SCALE)
        u, _, w = np.split(EXP(np.clip(x, -STEEP * SCALE, STEEP * SCALE)), 3, axis=2)
        return np.concatenate([x, (_f(0.5) + u / (1 + w)) / (1 + u)], axis=2), float(np.abs(x).max())

    def sweep(self, parts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """About the logit of the window from each place on, over words in a row, given by their parts (0: past the end of a text), unless it's ``steep``.

        Windows that start side by side run as lanes of one matrix, so that the inputs of a step are a slice
        of theirs; rows of both lie end to end, and the last lanes, which read on into the row below, are computed
        for nothing, as whole stretches cost less than rows. Of a place only its attention and its share of the output are kept. What ``run`` computes, but
        with exponentials: with u = e^-a for the update gate, w = e^-2b for the candidate and a state kept as half of what it is above -1, a step's state is
        (u / (1 + w) + state) / (1 + u). The factors -1 and -2 are in the weights, and so are attention and output of
        the state before; a last row of ones takes what that way of keeping the state adds. Two things make it coarse: exponentials are whole
        numbers read as a float32's bits, which cost a seventh of full ones, and a word is read from SPAN words before or behind it at most, so that windows
        share the states of words further inside. A logit is wrong by some hundredths.
        """
        n, h, p = len(ids) - WINDOW + 1, HIDDEN, self.p
        hidden = []
        for k in (0, 1):
            m = np.concatenate([p[f"U{k}"].T * (FACTOR * BITS)[:, None], *(p[x][None, k * h : (k + 1) * h] for x in ("v", "o"))])
            hidden.append(np.ascontiguousarray(np.concatenate([2 * m, -m.sum(axis=1, keepdims=True)], axis=1)))
        past = np.where(ids == 0, _f(-1e9), _f(0.0))
        out, one = np.empty(n, _f), np.ones(1, _f)
        for at in range(0, n, LANES):
            lanes = min(LANES, n - at)
            width = lanes + WINDOW - 1
            told = np.empty((2, SPAN, 2, width), _f)
            hu, new, kept = (np.empty((k, width), _f) for k in (3 * h + 2, h, h + 1))
            bits = np.empty((3 * h, width), np.int32)
            inputs = np.zeros(4 * h * width + WINDOW, _f)
            u, r, w = bits.view(_f).reshape(3, h, width)
            state, kept[h] = kept[:h], 1
            for k in (0, 1):
                rows = inputs[: 4 * h * width].reshape(-1, width)
                rows[:] = parts[k][ids[at : at + width]].T
                rows[: 3 * h] *= BITS / SCALE
                rows[: 3 * h] += ZERO
                places = list(range(SPAN) if k == 0 else range(SPAN - 1, -1, -1))
                state[:] = inputs[places[0] :][3 * h * width : 4 * h * width].reshape(h, width)
                with np.errstate(all="ignore"):  # of the last lanes
                    for before, t in zip(places, places[1:], strict=False):
                        x = inputs[t : t + 3 * h * width].reshape(-1, width)
                        np.matmul(hidden[k], kept, out=hu)
                        told[k, before] = hu[3 * h :]
                        np.add(hu[: 2 * h], x[: 2 * h], out=bits[: 2 * h], casting="unsafe")
                        r += one
                        np.divide(hu[2 * h : 3 * h], r, out=new)
                        np.add(new, x[2 * h :], out=bits[2 * h :], casting="unsafe")
                        w += one
                        np.divide(u, w, out=new)
                        state += new
                        u += one
                        state /= u
                    told[k, places[-1]] = hidden[k][3 * h :] @ kept
            both, rest = np.empty((WINDOW, 2, lanes), _f), WINDOW - SPAN
            for t in range(WINDOW):
                f, b = max(0, t - SPAN + 1), min(t, rest)  # how far into the window the reading that a word is told by begins
                np.add(told[0, t - f, :, f : f + lanes], told[1, t - b, :, b : b + lanes], out=both[t])
                both[t, 0] += past[at + t : at + t + lanes]
            a = np.exp(both[:, 0] - both[:, 0].max(axis=0))
            out[at : at + lanes] = (a * both[:, 1]).sum(axis=0) / a.sum(axis=0)
        return out + p["c"]

    def gradients(self, texts: list[list[str]], labels: np.ndarray, sharp: float) -> tuple[dict[str, np.ndarray], dict[str, tuple]]:
        """Of the cross-entropy of a batch: dense ones, and (rows, values) for the two embeddings."""
        vocabulary, rows, owner = layout(texts)
        x, (word, char, at, n) = self.embed(vocabulary)
        logit, (out, a, pooled, tape) = self.run(self.project(x), rows, keep=True)
        h, p = HIDDEN, self.p
        # a soft maximum over the windows of a text, by which the gradient is shared out
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, logit)
        share = np.exp(sharp * (logit - top[owner]))
        share /= np.bincount(owner, share, len(texts))[owner]
        soft = np.bincount(owner, share * logit, len(texts))
        d = ((1 / (1 + np.exp(-soft)) - labels) / len(texts))[owner] * share
        d = d.astype(_f)
        g: dict[str, np.ndarray] = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
        dpool = d[:, None] * p["o"]
        dout = a[:, :, None] * dpool
        da = (out * dpool).sum(axis=2)
        ds = a * (da - (a * da).sum(axis=0))
        dout += ds[:, :, None] * p["v"]
        g["v"] = np.einsum("tnh,tn->h", out, ds)
        dx = np.zeros((len(vocabulary) + 1, 2 * EMBED), _f)
        flat = rows.T.ravel()
        order = np.argsort(flat, kind="stable")
        found, starts = np.unique(flat[order], return_index=True)
        for k in (0, 1):
            u, back = p[f"U{k}"], np.zeros((len(rows), h), _f)
            g[f"U{k}"] = np.zeros_like(u)
            din = np.empty((WINDOW, len(rows), 3 * h), _f)
            for t in range(WINDOW - 1, -1, -1) if k == 0 else range(WINDOW):
                state, z, r, new, hn = tape[k][t]
                dh = back + dout[t, :, k * h : (k + 1) * h]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (state - new) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                din[t] = np.concatenate([dz, dr, dn], axis=1)
                g[f"U{k}"] += state.T @ du
                back = dh * z + du @ u.T
            summed = np.zeros((len(vocabulary) + 1, 3 * h), _f)
            summed[found] = np.add.reduceat(din.reshape(-1, 3 * h)[order], starts, axis=0)
            g[f"b{k}"] = summed.sum(axis=0)
            summed = summed[:-1]
            g[f"W{k}"] = x.T @ summed
            dx[:-1] += summed @ p[f"W{k}"].T
        dx = dx[:-1]
        sparse = {"word": (word, dx[:, :EMBED]), "char": (char, np.repeat(dx[:, EMBED:] / n[:, None], n.astype(np.int64), axis=0))}
        return g, {k: _by_row(*v) for k, v in sparse.items()}


class Met(dict):
    """Pieces that a network met, while it doesn't change, by the number of the word inside; -1, -2 ... are the first, second ... with several or none. When they are too many, all are forgotten.

    A word is a piece too. ``known`` holds the parts of all words, by number.
    """

    def __init__(self, net: Network) -> None:
        super().__init__({"": 0})
        self.net, self.size = net, 1
        self.several: list[list[int]] = []
        self.new: list[str] = []
        self.known, self.steepest = net.parts([])

    def __missing__(self, piece: str) -> int:
        found = inside(piece)
        if len(found) != 1:
            self.several.append([self[w] for w in found])
            code = -len(self.several)
        elif found[0] != piece:
            code = self[found[0]]
        else:
            code = self.size
            self.size += 1
            self.new.append(piece)
        self[piece] = code
        return code

    def line_up(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of all words in a row, texts shorter than a window filled up to one by 0; the first and last window of each text (-1 without words)."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.__init__(self.net)
        held = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, held.sum())
        if self.new:
            self.learn()
        lengths = np.ones(len(codes), np.int64)
        other = np.flatnonzero(codes < 0)
        lists = [self.several[-1 - c] for c in codes[other].tolist()]
        lengths[other] = np.fromiter(map(len, lists), np.int64, len(lists))
        row = np.repeat(codes, lengths)
        row[row < 0] = np.fromiter(chain.from_iterable(lists), np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(held)))]
        n = np.diff(begins)
        places = np.concatenate(([0], np.cumsum(np.where(n > 0, np.maximum(n, WINDOW), 0))))
        ids = np.zeros(places[-1], np.int64)
        ids[np.arange(len(row)) + np.repeat(places[:-1] - begins[:-1], n)] = row
        return ids, places[:-1], np.where(n > 0, places[1:] - WINDOW, -1)

    def learn(self) -> None:
        """The parts of new words, behind those of the words before, in room that doubles."""
        x, steepest = self.net.parts(self.new)
        before = self.size - len(self.new)
        if self.size > self.known.shape[1]:
            room = np.empty((2, 2 * self.size, 4 * HIDDEN), _f)
            room[:, :before] = self.known[:, :before]
            self.known = room
        self.known[:, before : self.size] = x
        self.steepest, self.new = max(self.steepest, steepest), []


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    found, starts = np.unique(rows[order], return_index=True)
    return found, np.add.reduceat(values[order], starts, axis=0)


def fit(rows: list[tuple[str | None, int]], epochs: int = 5, batch: int = 8, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the dense parameters, AdaGrad on the rows of the embeddings, over (text, label) rows; rows without words are left out."""
    net, rng = Network(), np.random.default_rng(seed)
    data = [(w, y) for w, y in ((words(t), y) for t, y in rows) if w]
    dense = [k for k in net.p if k not in ("word", "char")]
    m, v = ({k: np.zeros_like(net.p[k]) for k in dense} for _ in range(2))
    seen = {k: np.full((BUCKETS, EMBED), 1e-6, _f) for k in ("word", "char")}
    passes = max(epochs, min(40, 6000 // max(1, len(data))))  # few rows are seen more often
    step = 0
    for e in range(passes if data else 0):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            some = [data[j] for j in order[at : at + batch]]
            g, sparse = net.gradients([w for w, _ in some], np.array([y for _, y in some], float), sharp=min(3.0, 0.5 + e))
            step += 1
            norm = max(1.0, float(np.sqrt(sum((x * x).sum() for x in g.values()))))
            for k in dense:
                x = g[k] / norm
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.001 * (x * x - v[k])
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            for k, (r, x) in sparse.items():
                seen[k][r] += x * x
                net.p[k][r] -= 0.05 * x / np.sqrt(seen[k][r])
    return net


def train(df: DataFrame, label_col: str = "toxic", max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit on df's rows labelled 0 or 1: about max_docs / 3 of label 1 and twice as many of label 0, as far as there are any.

    Rows with a null text or another label are left out. Without any row the network is untrained.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("text is not null")
    some = [r for y, n in ((1, max_docs // 3), (0, max_docs - max_docs // 3)) for r in bounded_sample(rows.where(F.col("label") == y), n, "toxicity")]
    return fit([(r["text"], r["label"]) for r in sorted(some, key=lambda r: (str(r["doc_id"]), r["text"], r["label"]))])


def score(df: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for every row of df, repeated ones and those with a null id too; null, empty and wordless texts score 0.0."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        met = Met(shared.value)
        for texts in batches:
            out, group, size = [], [], 0
            distinct = list(dict.fromkeys(texts))  # copies within a batch are scored once
            for text in distinct:  # a group's words stay within bounds, whatever the texts' lengths
                group.append(pieces(text))
                size += len(text or "")
                if size > 600_000:
                    out.append(shared.value.scores(group, met))
                    group, size = [], 0
            got = np.concatenate([*out, shared.value.scores(group, met)])
            scores = dict(zip(distinct, got.tolist(), strict=True))
            yield pd.Series([scores[t] for t in texts], dtype=float)

    return inputs(df, id_col, text_col).select("doc_id", run("text").alias("score"))
