"""Document quality from a linear-chain conditional random field over lines.

Each line of a text is labelled good or bad.  A line's evidence is made of its
own features and those of the lines before and after it; a transition score
links neighbouring labels.  Forward-backward gives each line's probability of
being good, and a document's score is their mean weighted by line length.

The field is fitted by gradient ascent on every line of every labelled
document; a document's label is taken for all its lines.  The lines' features
are stored once.  In each of the ``STEPS`` steps every task adds up the
gradient of its own documents, ``LINES`` lines at a time, and the driver gets
one row of sums a task.  Nothing but the text enters a score.  Scoring reads
whole texts.

A null or empty text is one empty line.  Without any labelled document, or with
labels of one kind only, every line is scored 0.5.  Rows whose label is null
are not learnt from; repeated labels or documents count as often as they come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import chunks, ship
from ledgerflow.session import store

SHOWN_DOCS = 3_000
LINES = 32_768
STEPS = 150
RATE = 0.1
RIDGE = 1e-4
THRESHOLD = 0.7

_PLAIN = ".,;:'\"()-?"
_KINDS: list[np.ndarray] = []
OWN = 11  # features of a line itself


def _kinds() -> np.ndarray:
    """Bit per code point: 1 letter, 2 upper case, 4 digit, 8 white space, 16 plain mark, 32 other."""
    if not _KINDS:
        k = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                k[c] = 3 if s.isupper() else 1
            elif s.isdigit():
                k[c] = 4
            elif s.isspace():
                k[c] = 8
            else:
                k[c] = 16 if s in _PLAIN else 32
        _KINDS.append(k)
    return _KINDS[0]


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines in order, their lengths, and lines per text."""
    joined = "\n".join([t or "" for t in texts])
    per = np.fromiter(((t or "").count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    cp = np.frombuffer((joined + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kinds()[cp]
    end = np.flatnonzero(cp == 10)
    start = np.r_[0, end[:-1] + 1]
    n = (end - start).astype(np.float64)

    def count(marks: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(marks)]
        return (c[end] - c[start]).astype(np.float64)

    size = np.maximum(n, 1)
    letters, upper = count(kind & 1 > 0), count(kind & 2 > 0)
    gap = kind == 8
    begins = ~gap & np.r_[True, gap[:-1]]
    words = np.maximum(count(begins), 1)
    # a word equal to the one before it in its line
    w = np.flatnonzero(begins)
    w_end = np.r_[w[1:], len(cp)]
    with np.errstate(over="ignore"):
        code = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code = np.where(gap, np.uint64(0), code ^ (code >> np.uint64(31)))
        place = np.arange(len(cp)) - np.repeat(w, w_end - w) if len(w) and w[0] == 0 else \
            np.arange(len(cp)) - np.r_[np.zeros(w[0] if len(w) else len(cp), np.int64), np.repeat(w, w_end - w)]
        code = code * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        total = np.r_[np.uint64(0), np.cumsum(code)]
    word = total[w_end] - total[w]
    twin = np.zeros(len(cp), dtype=bool)
    if len(w) > 1:
        line = np.searchsorted(end, w)
        twin[w[1:][(word[1:] == word[:-1]) & (line[1:] == line[:-1])]] = True
    line_code = total[end] - total[start]
    ends_well = np.zeros(len(n))
    some = n > 0
    ends_well[some] = kind[end[some] - 1] == 16
    f = np.empty((len(n), OWN))
    f[:, 0] = np.minimum(np.log1p(n) / 8, 1.5)
    f[:, 1] = letters / size
    f[:, 2] = upper / np.maximum(letters, 1)
    f[:, 3] = count(kind == 4) / size
    f[:, 4] = count(kind == 16) / size * 4
    f[:, 5] = np.minimum(count(kind == 32) / size * 4, 2)
    f[:, 6] = count(twin) / words * 2
    f[:, 7] = np.minimum(letters / words / 8, 2)
    f[:, 8] = ends_well
    same = np.r_[False, line_code[1:] == line_code[:-1]] & some
    same[np.cumsum(per) - per] = False  # the first line of a text has none before it
    f[:, 9] = same
    f[:, 10] = words < 4
    return f, n, per


def with_neighbours(own: np.ndarray, per: np.ndarray) -> np.ndarray:
    """A constant, own features and those of the lines before and after in the text."""
    end = np.cumsum(per)
    first = np.zeros(len(own), dtype=bool)
    last = np.zeros(len(own), dtype=bool)
    first[end - per], last[end - 1] = True, True
    before = np.where(first[:, None], 0.0, np.r_[own[:1], own[:-1]])
    after = np.where(last[:, None], 0.0, np.r_[own[1:], own[-1:]])
    return np.concatenate([np.ones((len(own), 1)), own, before, after, first[:, None], last[:, None]], axis=1)


def _step(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds that a label sends to the next line: t = scores (good->good, good->bad, bad->good, bad->bad)."""
    return np.logaddexp(x + t[0], t[2]) - np.logaddexp(x + t[1], t[3])


def messages(unary: np.ndarray, per: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of every line given those before it, and what those after it add; all texts step together."""
    end = np.cumsum(per)
    start = end - per
    order = np.argsort(-per, kind="stable")
    s, e, size = start[order], end[order], per[order]
    most = int(size[0]) if len(size) else 0
    # texts with more than k lines are the first so many of the order
    live = np.searchsorted(-size, -np.arange(1, most + 1), "right")
    forward, backward = np.array(unary, dtype=np.float64), np.zeros(len(unary))
    back = t[[0, 2, 1, 3]]
    for k in range(1, most):
        m = live[k]
        at = s[:m] + k
        forward[at] += _step(forward[at - 1], t)
        at = e[:m] - 1 - k
        backward[at] = _step(unary[at + 1] + backward[at + 1], back)
    return forward, backward


def _good(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))


def marginals(unary: np.ndarray, per: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Probability of good for every line."""
    forward, backward = messages(unary, per, t)
    return _good(forward + backward)


def _pair_marginals(u, forward, backward, t, inner) -> np.ndarray:
    i = np.flatnonzero(inner)
    a, b = forward[i - 1], u[i] + backward[i]
    s4 = np.stack([a + b + t[0], a + t[1], b + t[2], np.full(len(i), t[3])])
    s4 -= s4.max(axis=0, initial=-np.inf) if len(i) else 0
    z = np.exp(s4)
    return z / z.sum(axis=0)


def gradient(own: np.ndarray, per: np.ndarray, labels: np.ndarray, share: np.ndarray,
             w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sum over whole texts of the gradient by ``w`` and ``t``; ``share`` is the weight of a text of either label."""
    x = with_neighbours(own, per)
    doc = np.repeat(np.arange(len(per)), per)
    y = labels[doc].astype(np.float64)
    weight = (share[labels] / per)[doc]
    inner = np.ones(len(doc), dtype=bool)
    inner[np.cumsum(per) - per] = False  # lines with one before them
    u = x @ w
    forward, backward = messages(u, per, t)
    g_w = x.T @ (weight * (y - _good(forward + backward)))
    # pair marginals: both lines of a pair share their text's label
    pair = _pair_marginals(u, forward, backward, t, inner)
    yy = y[inner]
    seen = np.stack([yy, 0 * yy, 0 * yy, 1 - yy])
    return np.r_[g_w, (seen - pair) @ weight[inner]]


class Field:
    """Weights of the lines' features and of the transitions."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    @property
    def fitted(self) -> bool:
        """Whether there were labels of both kinds to learn from."""
        return bool(self.w.any() or self.t.any())

    @classmethod
    def _ascend(cls, n: np.ndarray, total) -> Field:
        """Gradient ascent on the labels' conditional likelihood, classes weighing alike.

        ``n`` counts the texts labelled bad and good; ``total`` gives the
        gradient over all of them from their shares and the weights.
        """
        dim = 3 * OWN + 3
        w, t = np.zeros(dim), np.zeros(4)
        if not n.all():
            return cls(w, t)
        share = 0.5 / n  # each class and each document of it weighs alike
        m1, m2 = np.zeros(dim + 4), np.zeros(dim + 4)
        for step in range(1, STEPS + 1):
            # rounded: in what order texts were added up does not show in a sum that should be 0
            g = np.round(total(share, w, t), 12) - RIDGE * np.r_[w, t]
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.99 * m2 + 0.01 * g * g
            move = RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-12)
            w, t = w + move[:dim], np.clip(t + move[dim:], -3, 3)
        return cls(w, t)

    @classmethod
    def fit(cls, own: list[np.ndarray], labels: np.ndarray) -> Field:
        """The field of a few texts held in memory."""
        per = np.array([len(x) for x in own], dtype=np.int64)
        return cls._ascend(np.bincount(labels, minlength=2), lambda share, w, t: gradient(
            np.concatenate(own), per, labels, share, w, t))

    @classmethod
    def learn(cls, lines: DataFrame) -> Field:
        """The field of all labelled texts, given by ``labelled_lines``."""
        lines = store(lines.select("y", "f"))
        n = np.zeros(2, dtype=np.int64)
        for r in lines.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect():
            n[r["y"]] = r["n"]

        def total(share, w, t):
            def part(batches):
                g = np.zeros(len(w) + len(t))
                for b in batches:
                    f, y = b.column("f").to_pylist(), b.column("y").to_numpy()
                    for lo, hi in chunks(f, LINES * 4 * OWN):
                        own = np.frombuffer(b"".join(f[lo:hi]), dtype=np.float32).reshape(-1, OWN)
                        per = np.array([len(x) for x in f[lo:hi]], dtype=np.int64) // (4 * OWN)
                        g += gradient(own.astype(np.float64), per, y[lo:hi], share, w, t)
                yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.list_(pa.float64()))})

            return np.sum([r["g"] for r in lines.mapInArrow(part, "g array<double>").collect()], axis=0)

        return cls._ascend(n, total)

    @staticmethod
    def _pairs(u, per, t, inner) -> np.ndarray:
        return _pair_marginals(u, *messages(u, per, t), t, inner)

    def scores(self, texts: list) -> np.ndarray:
        """Length-weighted mean of the line marginals of each text."""
        own, n, per = features(texts)
        p = marginals(with_neighbours(own, per) @ self.w, per, self.t)
        end = np.cumsum(per)
        at = end - per
        return np.add.reduceat(p * (n + 1), at) / np.add.reduceat(n + 1, at)


def labelled_lines(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str,
                   label_col: str) -> DataFrame:
    """(id, y, f): every labelled document's label (0 or 1) and the own features of all its lines.

    Features are much shorter than texts, so they are what is joined.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def lines(texts: pa.Array) -> pa.Array:
        t, out = texts.to_pylist(), []
        for lo, hi in chunks(t):
            own, _, per = features(t[lo:hi])
            own, end = own.astype(np.float32), np.cumsum(per)
            out += [own[a:z].tobytes() for a, z in zip(end - per, end)]
        return pa.array(out, pa.binary())

    chosen = (labels.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{label_id}`").isNotNull())
              .select(F.col(f"`{label_id}`").alias("id"), (F.col(f"`{label_col}`").cast("int") > 0).cast("int").alias("y")))
    return docs.select(F.col(f"`{id_col}`").alias("id"), lines(F.col(f"`{text_col}`")).alias("f")).join(chosen, "id")


def sample(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str,
           size: int = SHOWN_DOCS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of a few documents for a look at them; no query is fitted on these."""
    rows = (labelled_lines(docs, id_col, text_col, labels, label_id, label_col)
            .orderBy(F.xxhash64("id"), "id", "y", "f").limit(size).collect())
    own = [np.frombuffer(r["f"], dtype=np.float32).reshape(-1, OWN).astype(np.float64) for r in rows]
    return own, np.array([r["y"] for r in rows], dtype=np.int64)


def score_column(df: DataFrame, text_col: str, field: Field) -> F.Column:
    """Column: quality of each whole text, 0 to 1."""
    ship(df.sparkSession)
    w, t = field.w.copy(), field.t.copy()

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own, x = Field(w, t), texts.to_pylist()
        parts = [own.scores(x[lo:hi]) for lo, hi in chunks(x)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return score(F.col(f"`{text_col}`"))
