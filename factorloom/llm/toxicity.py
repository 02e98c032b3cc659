"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are a learnt vector of its own (words of fewer than ``MIN_ROWS`` training
rows have none, nor has a share of words in each step of the fit) and the mean of learnt vectors of its character four-grams.  All windows of
``WINDOW`` words, overlapping by a quarter, are scored; a document's logit is that of its
worst window.  Vectors and network are trained together: a toxic row speaks through its
worst window, at first the one with the most uncommon words among clean rows, later the
one that the network itself finds worst.

The network and its tables have a fixed size.  One executor task fits it, on at most about
``MAX_ROWS`` labelled rows (those least by a hash of doc_id), of each of which at most
``MAX_WINDOWS`` windows, drawn over its whole text, take part.  Scoring has no bounds.

Defined results: null, empty and wordless texts are one window of padding; equal texts
have equal scores; a doc_id with both labels counts as toxic; labels other than 0 and 1 and
null ids teach nothing; without labels of both kinds every score is the share of toxic
labels; an empty table gives no rows; other columns are carried along by ``score``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import ALNUM_SEPARATORS, binary_columns, chunks, lower_ascii, only, read_table, small_batches, word_hashes, word_spans

WINDOW = 32
STRIDE = 24
HIDDEN = 8
#: Size of a word's vector, and of its characters'.
VECTOR = 8
#: Labelled rows that the network is fitted on, about.
MAX_ROWS = 5000
#: Windows of one row that take part in fitting.
MAX_WINDOWS = 512
#: Training rows that hold a word with a vector of its own.
MIN_ROWS = 6
THRESHOLD = 0.7
EPOCHS = 4
#: Steps of the vectors, their spread at the start, their decay a step, and the share of words unseen in a step.
WORD_RATE, GRAM_RATE, START, DECAY, DROP = 0.05, 0.02, 0.02, 1e-3, 0.3
_WORD_BITS = 20
_GRAM_BITS = 15
_PRIOR = 4.0
FEATURES = 2 * VECTOR


class Words:
    """Distinct words of some texts: their numbers, and the buckets of their character four-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = lower_ascii(data)
        start, end, doc = word_spans(low, offsets, ALNUM_SEPARATORS)
        self.ends = np.searchsorted(doc, np.arange(len(offsets)))
        hashes = word_hashes(low, start, end)
        _, first, index = np.unique(hashes, return_index=True, return_inverse=True)
        self.index = index.reshape(-1)
        self.word = (hashes[first] >> np.uint64(64 - _WORD_BITS)).astype(np.int64)
        s, e = start[first], end[first]
        size = e - s
        # Each word between spaces; its four-grams are the 32-bit values at its bytes.
        at = np.concatenate(([0], np.cumsum(size + 3)))
        flat = np.full(int(at[-1]) + 4, 0x20, np.uint8)
        owner = np.repeat(np.arange(len(s)), size)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        flat[at[owner] + 1 + inner] = low[s[owner] + inner]
        wide = flat.astype(np.uint64)
        grams = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)
        # A word of m letters has m four-grams or, being short, one.
        gi = at[owner] + np.where(size[owner] >= 2, np.minimum(inner, np.maximum(size[owner] - 2, 0)), 0)
        self.gram = (grams[gi] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)
        self.size = size


def _means(table: np.ndarray, gram: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean gram vector of each word; every word has a gram."""
    if not len(size):
        return np.zeros((0, table.shape[1]), np.float32)
    return np.add.reduceat(table[gram], np.cumsum(size) - size) / size[:, None].astype(np.float32)


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows of ``n`` words, the last one ending with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Two gated recurrent layers (one per direction), attention over their states, one logit."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": draw(FEATURES, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": draw(2 * HIDDEN, HIDDEN), "a": draw(HIDDEN, 1), "o": draw(2 * HIDDEN, 1), "z": np.full(1, -1.0, np.float32)}

    def _pass(self, d: str, proj: np.ndarray, tape: list | None):
        """States (T, B, H) from input projections (T, B, 3H), which have their bias."""
        U = self.p[f"U{d}"]
        h = np.zeros((proj.shape[1], HIDDEN), np.float32)
        out = np.empty((*proj.shape[:2], HIDDEN), np.float32)
        for t in range(len(proj)) if d == "f" else range(len(proj) - 1, -1, -1):
            gates = _sigmoid(proj[t, :, : 2 * HIDDEN] + h @ U[:, : 2 * HIDDEN])
            r, u = gates[:, :HIDDEN], gates[:, HIDDEN:]
            cand = np.tanh(proj[t, :, 2 * HIDDEN :] + (r * h) @ U[:, 2 * HIDDEN :])
            if tape is not None:
                tape.append((t, h, r, u, cand))
            h = h + u * (cand - h)
            out[t] = h
        return out

    def logits(self, proj_f, proj_b, mask, keep: bool = False):
        """Logits of windows; ``mask`` (T, B) tells words from padding."""
        tf, tb = ([], []) if keep else (None, None)
        H = np.concatenate([self._pass("f", proj_f, tf), self._pass("b", proj_b, tb)], 2)
        m = np.tanh(H @ self.p["A"])
        e = (m @ self.p["a"])[..., 0] + np.where(mask, 0, -30).astype(np.float32)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[..., None] * H).sum(0)
        y = (pooled @ self.p["o"])[:, 0] + self.p["z"][0]
        return (y, (tf, tb, H, m, w, pooled)) if keep else y

    def step(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted log loss for windows x (T, B, FEATURES): of the weights, and of x."""
        p = self.p
        y, (tf, tb, H, m, w, pooled) = self.logits(x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"], mask, True)
        dy = ((_sigmoid(y) - target) * weight / len(y)).astype(np.float32)
        g = {"o": pooled.T @ dy[:, None], "z": np.array([dy.sum()], np.float32)}
        dpool = dy[:, None] * p["o"][:, 0]
        dH = w[..., None] * dpool
        dw = (H * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        dm = de[..., None] * p["a"][:, 0] * (1 - m * m)
        g["a"] = np.einsum("tbh,tb->h", m, de)[:, None]
        g["A"] = np.einsum("tbi,tbh->ih", H, dm)
        dH = dH + dm @ p["A"].T
        dx = np.zeros_like(x)
        for d, tape, part in (("f", tf, dH[..., :HIDDEN]), ("b", tb, dH[..., HIDDEN:])):
            U, dh = p[f"U{d}"], np.zeros_like(part[0])
            dproj, dU = np.zeros((*part.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(p[f"U{d}"])
            for t, h, r, u, cand in reversed(tape):
                dh = dh + part[t]
                dc = dh * u * (1 - cand * cand)
                drh = dc @ U[:, 2 * HIDDEN :].T
                dgates = np.concatenate([drh * h * r * (1 - r), dh * (cand - h) * u * (1 - u)], 1)
                dU[:, : 2 * HIDDEN] += h.T @ dgates
                dU[:, 2 * HIDDEN :] += (r * h).T @ dc
                dproj[t, :, : 2 * HIDDEN], dproj[t, :, 2 * HIDDEN :] = dgates, dc
                dh = dh * (1 - u) + drh * r + dgates @ U[:, : 2 * HIDDEN].T
            g[f"U{d}"], g[f"c{d}"] = dU, dproj.sum((0, 1))
            g[f"W{d}"] = np.einsum("tbi,tbh->ih", x, dproj)
            dx = dx + dproj @ p[f"W{d}"].T
        return g, dx


class Model:
    """A fitted network with its word and character vectors and scale."""

    def __init__(self, rows: np.ndarray, words: np.ndarray, grams: np.ndarray, net: Network, scale: tuple[float, float]):
        self.rows, self.words, self.grams, self.net, self.scale = rows, words, grams, net, scale

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, rows=self.rows, words=self.words, grams=self.grams, scale=np.array(self.scale), **{f"p_{k}": v for k, v in self.net.p.items()})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        z = np.load(io.BytesIO(raw))
        net = Network()
        net.p = {k: z[f"p_{k}"] for k in net.p}
        return cls(z["rows"], z["words"], z["grams"], net, tuple(z["scale"].tolist()))

    def document_logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1, np.float32)
        p = self.net.p
        for lo, hi in chunks(offsets):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            f = np.hstack([self.words[self.rows[words.word]], _means(self.grams, words.gram, words.size)])
            # The last row is padding.
            pf = np.vstack([f @ p["Wf"], np.zeros((1, 3 * HIDDEN), np.float32)]) + p["cf"]
            pb = np.vstack([f @ p["Wb"], np.zeros((1, 3 * HIDDEN), np.float32)]) + p["cb"]
            index = np.append(words.index, len(f))
            each = [windows(int(n)) for n in np.diff(words.ends)]
            begin = np.concatenate([w + a for w, a in zip(each, words.ends[:-1], strict=True)])
            limit = np.repeat(words.ends[1:], [len(w) for w in each])
            logit = np.empty(len(begin), np.float32)
            for k in range(0, len(begin), 4096):
                at = begin[None, k : k + 4096] + np.arange(WINDOW)[:, None]
                mask = at < limit[None, k : k + 4096]
                ids = index[np.where(mask, at, len(index) - 1)]
                logit[k : k + 4096] = self.net.logits(pf[ids], pb[ids], mask)
            first = np.concatenate(([0], np.cumsum([len(w) for w in each])[:-1]))
            out[lo:hi] = np.maximum.reduceat(logit, first)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return _sigmoid(a * self.document_logits(data, offsets).astype(np.float64) + b)


class _Sample:
    """Training rows, each as the words of some of its windows; whole texts are not kept."""

    def __init__(self):
        self.rows: list[tuple[tuple, int, np.ndarray, np.ndarray]] = []  # order, label, distinct words, windows (W, n)
        self.grams: dict[int, np.ndarray] = {}

    def add(self, order: tuple, label: int, text: bytes) -> None:
        w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        at = 0
        for word, n in zip(w.word.tolist(), w.size.tolist(), strict=True):
            if word not in self.grams:
                self.grams[word] = w.gram[at : at + n].astype(np.int32)
            at += n
        starts = windows(len(w.index))
        if len(starts) > MAX_WINDOWS:
            starts = np.sort(np.random.default_rng(len(text)).choice(starts, MAX_WINDOWS, replace=False))
        place = starts[None, :] + np.arange(WINDOW)[:, None]
        ids = np.append(w.word[w.index], -1)[np.minimum(place, len(w.index))]
        self.rows.append((order, label, np.unique(w.word), ids.astype(np.int32)))


def fit_sample(sample: _Sample, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    rows = sorted(sample.rows, key=lambda r: r[0])
    y = np.array([r[1] for r in rows], np.int64)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    # Words by number; number 0 of the vectors is for words without one.
    vocabulary = np.array(sorted(sample.grams), np.int64)
    held = np.zeros((2, len(vocabulary)))
    place = [np.searchsorted(vocabulary, r[2]) for r in rows]
    for at, label in zip(place, y, strict=True):
        held[label, at] += 1
    known = np.flatnonzero(held.sum(0) >= MIN_ROWS)
    table = np.zeros(1 << _WORD_BITS, np.int32)
    table[vocabulary[known]] = np.arange(1, len(known) + 1)
    net = Network()
    vectors = (START * rng.standard_normal((len(known) + 1, VECTOR))).astype(np.float32)
    vectors[0] = 0
    grams = (START * rng.standard_normal((1 << _GRAM_BITS, VECTOR))).astype(np.float32)
    if not n1 or not n0:
        base = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(table, vectors, grams, net, (0.0, float(np.log(base / (1 - base)))))
    size = np.array([len(sample.grams[w]) for w in vocabulary.tolist()], np.int64)
    flat = np.concatenate([sample.grams[w] for w in vocabulary.tolist()]).astype(np.int64)
    gram_from = np.cumsum(size) - size
    # Windows as places in the vocabulary; the place after the last is padding.
    ids = [np.where(r[3] < 0, len(vocabulary), np.searchsorted(vocabulary, np.maximum(r[3], 0))) for r in rows]
    row_of = np.append(table[vocabulary], 0)

    def batch_inputs(at: np.ndarray):
        """Inputs (T, B, FEATURES) of windows, some of their words unseen, and what their gradients need."""
        some, back = np.unique(at, return_inverse=True)
        some = some[some < len(vocabulary)]
        n = size[some]
        g = flat[np.arange(int(n.sum())) + np.repeat(gram_from[some] - (np.cumsum(n) - n), n)]
        rows_w = np.where(rng.random(len(some)) < DROP, 0, row_of[some])
        x = np.vstack([np.hstack([vectors[rows_w], _means(grams, g, n)]), np.zeros((1, FEATURES), np.float32)])
        back = np.minimum(back.reshape(at.shape), len(some))
        return x[back], (rows_w, n, g, back)

    def all_logits() -> list[np.ndarray]:
        """Logits of every window of every row, many windows at a time."""
        x = np.vstack([np.hstack([vectors[row_of[:-1]], _means(grams, flat, size)]), np.zeros((1, FEATURES), np.float32)])
        pf, pb = x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"]
        out, lo = [], 0
        while lo < len(ids):
            hi, n = lo, 0
            while hi < len(ids) and (not n or n + ids[hi].shape[1] <= 2048):
                n += ids[hi].shape[1]
                hi += 1
            at = np.concatenate(ids[lo:hi], 1)
            logit = net.logits(pf[at], pb[at], at < len(vocabulary))
            out += np.split(logit, np.cumsum([x.shape[1] for x in ids[lo:hi]])[:-1])
            lo = hi
        return out

    def first_guess(k: int) -> np.ndarray:
        """Before the network knows anything: how far the words of a window lean to the other toxic rows."""
        own = np.zeros(2)
        own[y[k]] = 1
        toxic, clean = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
        some = place[k]
        base = max(n1 - own[1], 0.5) / max(len(y) - 1, 1)
        toxic[some], clean[some] = held[1, some] - own[1], held[0, some] - own[0]
        lean = np.log((toxic[some] + _PRIOR * base) / (clean[some] + _PRIOR * (1 - base))) - np.log(base / (1 - base))
        odds = np.zeros(len(vocabulary) + 1)
        odds[some] = np.maximum(lean, 0) ** 2
        return odds[ids[k]].sum(0)

    guess = [first_guess(k) for k in range(len(y))]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    tables = {"w": (vectors, np.full(len(vectors), 1e-6, np.float32)), "g": (grams, np.full(len(grams), 1e-6, np.float32))}

    def learn(name: str, at: np.ndarray, grad: np.ndarray, rate: float):
        """A step for the vectors ``at`` (rows may repeat), each scaled by its own past gradients."""
        v, past = tables[name]
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        some, total = at[order][first], np.add.reduceat(grad[order], first)
        past[some] += (total * total).mean(1)
        v[some] -= rate * total / (np.sqrt(past[some]) + 1e-4)[:, None] + DECAY * v[some]

    count = 0
    for epoch in range(EPOCHS):
        ranks = guess if epoch < 2 else all_logits()
        picks, targets = [], []
        for k, label in enumerate(y):
            # The worst window speaks for a toxic row; for a clean one, it and a random one.
            worst = int(ranks[k].argmax())
            for j in [worst] if label else {worst, int(rng.integers(ids[k].shape[1]))}:
                picks.append(ids[k][:, j])
                targets.append(label)
        at, t = np.stack(picks, 1), np.array(targets)
        weight = np.where(t == 1, (t == 0).sum() / max(1, (t == 1).sum()) * 0.5, 1.0)
        step = 64 if len(t) < 2000 else 256
        for _ in range(6 if len(t) < 2000 else 2):
            order = rng.permutation(len(t))
            for a in range(0, len(t), step):
                b = order[a : a + step]
                count += 1
                x, (rows_w, n, g, back) = batch_inputs(at[:, b])
                grads, dx = net.step(x, at[:, b] < len(vocabulary), t[b], weight[b])
                for name, grad in grads.items():
                    m, v = moments[name]
                    grad = np.clip(grad, -1, 1) + 1e-4 * net.p[name]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    net.p[name] -= (0.01 * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-6)).astype(np.float32)
                # Gradients of the distinct words, then of their vectors and grams.
                flat_back, flat_dx = back.reshape(-1), dx.reshape(-1, FEATURES)
                near = np.argsort(flat_back, kind="stable")
                first = np.flatnonzero(np.diff(flat_back[near], prepend=-1))
                per_word = np.add.reduceat(flat_dx[near], first)[: len(rows_w)]
                if (rows_w > 0).any():
                    learn("w", rows_w[rows_w > 0], per_word[rows_w > 0, :VECTOR], WORD_RATE)
                if len(g):
                    learn("g", g, np.repeat(per_word[:, VECTOR:] / n[:, None].astype(np.float32), n, axis=0), GRAM_RATE)
    logit = np.array([r.max() for r in all_logits()], np.float64)
    # Scale of the document logits, by Newton steps on the log loss with a weak prior.
    theta = np.array([1.0, 0.0])
    z = np.stack([logit, np.ones_like(logit)], 1)
    for _ in range(25):
        q = _sigmoid(z @ theta)
        grad = z.T @ (q - y) + 0.1 * (theta - [1.0, 0.0])
        hess = (z * (q * (1 - q))[:, None]).T @ z + 0.1 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return Model(table, vectors, grams, net, (float(max(theta[0], 0.05)), float(theta[1])))


def fit(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    sample = _Sample()
    for k, (text, label) in enumerate(zip(texts, labels, strict=True)):
        sample.add((k,), int(label), (text or "").encode())
    return fit_sample(sample, seed)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows outside the held-out third, about MAX_ROWS at most, in an executor."""
    marks = only(labels, doc_id="long", toxic="int").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out())
    total = marks.count()
    if total > MAX_ROWS:
        # Hash order: the rows least by hash, about MAX_ROWS of them.
        cut = (1 << 31) * MAX_ROWS // total
        marks = marks.where(F.expr("xxhash64(doc_id, 3) & 2147483647L") < cut)
    rows = only(docs, doc_id="long", text="string").join(F.broadcast(marks.limit(2 * MAX_ROWS)), "doc_id")
    small_batches(docs.sparkSession, 128)

    def fit_rows(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = _Sample()
        for b in batches:
            data, offsets = binary_columns(b, "text")
            ids, labels = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "toxic"))
            for doc, label, lo, hi in zip(ids, labels, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = data[lo:hi].tobytes()
                sample.add((doc, text[:64], len(text)), label, text)
        yield pa.RecordBatch.from_arrays([pa.array([fit_sample(sample).to_bytes()], pa.binary())], names=["model"])

    # A bounded sample: one task fits, so that the driver holds nothing but the finished tables.
    found = rows.select("doc_id", "toxic", "text").groupBy(F.lit(0).alias("all")).applyInArrow(fit_rows, "model binary").collect()
    return Model.from_bytes(bytes(found[0].model)) if found else fit([], [])


def score(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and the score, and the name of the score's column."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = "__score"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            text = b.column(at).cast(pa.string())
            plain = pa.RecordBatch.from_arrays([text], names=["text"])
            s = shared.value.scores(*binary_columns(plain, "text")) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def clean_documents(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """The documents whose score is below THRESHOLD."""
    model = train(docs if train_docs is None else train_docs, labels)
    scored, name = score(docs, model)
    return scored.where(F.col(name) < THRESHOLD).drop(name)


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = only(read_table(spark, sf_dir, "documents"), doc_id="long", text="string")
    scored, name = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted")
    )
