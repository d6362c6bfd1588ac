"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read in windows of ``WIDTH`` words that overlap by half, so every passage of
half that length lies whole in one of them; the last window ends with the text. Each word
comes in as two vectors: one of its own, if training has met it often enough, and the
mean over its character trigrams, which also speaks for words never met. One recurrent
pass runs each way over a window, attention weighs the states, and their weighted sum
gives the window's odds. The score of a text is that of its most toxic window.

Training is plain numpy on a bounded sample of labelled rows (``most_rows`` of each
class, those whose ids hash lowest, and of these as many as ``most_chars`` allows). A label
speaks of a whole text, so of a toxic text the window with the highest score stands for it,
and of a clean one its highest and another; which they are is settled by how surely words
tell toxic texts at first and by the network itself from then on. Equal texts of one label count once.

Scoring is the same arithmetic over thousands of windows at once inside the tasks: what
reaches the recurrent pass from a word is made once for each distinct word of a stretch
of texts. Texts are read whole.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z
lower-cased. Null counts as empty; a text without words is one window without words. Null
and repeated ids are allowed; of several labels for an id toxic wins, null labels are
left out. If there are labels of one class only, its share is every score; without
labels it is 0. Columns named ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from proofline.llm.common import give_back, lowest_by_hash
from proofline.llm.lexical import terms_of

WIDTH, STEP = 32, 16
WORD_DIMS, CHAR_DIMS, HIDDEN, ATTENTION = 8, 8, 8, 8
TRIGRAMS = 4096  # cells that trigrams are hashed to
MOST_WORDS = 20_000  # with a vector of their own
MOST_ROWS, MOST_CHARS = 3000, 32_000_000
CHUNK = 500_000  # characters of text scored at once, or one longer text
BATCH = 2048  # windows in a recurrent pass

_F = np.float32


class Network(NamedTuple):
    """``vocabulary`` numbers the words with vectors of their own from 1; 0 is any other."""

    vocabulary: dict[bytes, int]
    params: dict[str, np.ndarray]
    constant: float | None = None  # the score of everything, if there was nothing to learn


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts): the hashed character trigrams of each word, with a mark at both its ends."""
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    counts = size - 2
    begin = np.repeat(np.cumsum(size) - size, counts)
    at = begin + np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts)
    h = (data[at] * np.uint32(0x9E3779B1)) ^ (data[at + 1] * np.uint32(0x85EBCA6B)) ^ (data[at + 2] * np.uint32(0xC2B2AE35))
    return ((h ^ (h >> np.uint32(15))) % np.uint32(TRIGRAMS)).astype(np.int64), counts


def means(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of each group of consecutive rows; groups are not empty."""
    if not len(counts):
        return np.zeros((0, rows.shape[1]), _F)
    return np.add.reduceat(rows, np.cumsum(counts) - counts, axis=0) / counts[:, None].astype(_F)


def windows_of(n: int) -> np.ndarray:
    """Where the windows of a text of ``n`` words begin."""
    if n <= WIDTH:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WIDTH + STEP, STEP)
    starts[-1] = n - WIDTH
    return starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(1) / (_F(1) + np.exp(-np.clip(x, -30, 30)))


class Passed(NamedTuple):
    """What a pass leaves for the way back."""

    x: np.ndarray
    mask: np.ndarray
    steps: list
    states: np.ndarray
    tanh: np.ndarray
    alpha: np.ndarray
    pooled: np.ndarray


def gates(params: dict, inputs: np.ndarray) -> np.ndarray:
    """(words, 2, 3 * HIDDEN): what each word sends to the gates of either direction."""
    return (inputs @ params["W"] + params["b"]).reshape(len(inputs), 2, 3 * HIDDEN)


def forward(params: dict, sent: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list, np.ndarray]:
    """States (windows, WIDTH, 2 * HIDDEN) of the two recurrent passes over words ``at``."""
    n, width = at.shape
    h = np.zeros((2, n, HIDDEN), _F)
    states = np.empty((n, width, 2 * HIDDEN), _F)
    steps = []
    full = bool(mask.all())
    for t in range(width):
        back = width - 1 - t
        g = np.stack([sent[at[:, t], 0], sent[at[:, back], 1]])
        a = h @ params["U"]
        zr = sigmoid(g[..., : 2 * HIDDEN] + a[..., : 2 * HIDDEN])
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        c = a[..., 2 * HIDDEN :] + params["c"][:, None]
        new = np.tanh(g[..., 2 * HIDDEN :] + r * c)
        m = None if full else np.stack([mask[:, t], mask[:, back]])[..., None]
        if keep:
            steps.append((h, z, r, c, new, m))
        moved = new + z * (h - new)
        h = moved if full else np.where(m, moved, h)
        states[:, t, :HIDDEN] = h[0]
        states[:, back, HIDDEN:] = h[1]
    return states, steps, mask


def attend(params: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tanh = np.tanh(states @ params["A"] + params["a"])
    s = np.where(mask, tanh @ params["v"], _F(-30))
    e = np.exp(s - s.max(1, keepdims=True)) * mask
    alpha = e / (e.sum(1, keepdims=True) + _F(1e-9))
    return tanh, alpha, np.einsum("nt,nth->nh", alpha, states)


def odds(params: dict, sent: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Log odds of windows."""
    states, _, _ = forward(params, sent, at, mask)
    return attend(params, states, mask)[2] @ params["w"] + params["o"]


def gradients(params: dict, inputs: np.ndarray, at: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Mean log loss, its gradients, and those by the words' inputs."""
    sent = gates(params, inputs)
    states, steps, _ = forward(params, sent, at, mask, keep=True)
    tanh, alpha, pooled = attend(params, states, mask)
    logit = pooled @ params["w"] + params["o"]
    loss = float(np.mean(np.logaddexp(0, logit) - truth * logit))
    d = ((sigmoid(logit) - truth) / len(at)).astype(_F)
    out = {"w": pooled.T @ d, "o": d.sum(keepdims=True)}
    dp = d[:, None] * params["w"]
    da = np.einsum("nh,nth->nt", dp, states)
    ds = alpha * (da - (alpha * da).sum(1, keepdims=True))
    dt = ds[..., None] * params["v"] * (1 - tanh**2)
    out |= {"v": np.einsum("nt,nta->a", ds, tanh), "A": np.einsum("nth,nta->ha", states, dt), "a": dt.sum((0, 1))}
    dstates = alpha[..., None] * dp[:, None] + dt @ params["A"].T
    n, width = at.shape
    dsent = np.zeros((n, width, 2, 3 * HIDDEN), _F)
    dh = np.zeros((2, n, HIDDEN), _F)
    dU, dc = np.zeros_like(params["U"]), np.zeros_like(params["c"])
    for t in reversed(range(width)):
        back = width - 1 - t
        h, z, r, c, new, m = steps[t]
        dh = dh + np.stack([dstates[:, t, :HIDDEN], dstates[:, back, HIDDEN:]])
        kept = 0 if m is None else dh * ~m
        dm = dh if m is None else dh * m
        dn = dm * (1 - z) * (1 - new**2)
        dz = dm * (h - new) * z * (1 - z)
        dr = dn * c * r * (1 - r)
        dc_ = dn * r
        dgate = np.concatenate([dz, dr, dc_], -1)
        dU += h.transpose(0, 2, 1) @ dgate
        dc += dc_.sum(1)
        dh = kept + dm * z + dgate @ params["U"].transpose(0, 2, 1)
        sentback = np.concatenate([dz, dr, dn], -1)
        dsent[:, t, 0], dsent[:, back, 1] = sentback[0], sentback[1]
    flat = dsent.reshape(-1, 6 * HIDDEN)
    order = np.argsort(at.ravel(), kind="stable")
    words, first = np.unique(at.ravel()[order], return_index=True)
    per_word = np.zeros((len(inputs), 6 * HIDDEN), _F)
    per_word[words] = np.add.reduceat(flat[order], first, axis=0)
    out |= {"U": dU, "c": dc, "W": inputs.T @ per_word, "b": per_word.sum(0)}
    return loss, out, per_word @ params["W"].T


def fresh(words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Parameters before training."""
    ins = WORD_DIMS + CHAR_DIMS
    shapes = {
        "word": (words + 1, WORD_DIMS), "char": (TRIGRAMS, CHAR_DIMS), "W": (ins, 6 * HIDDEN), "b": (6 * HIDDEN,),
        "U": (2, HIDDEN, 3 * HIDDEN), "c": (2, HIDDEN), "A": (2 * HIDDEN, ATTENTION), "a": (ATTENTION,),
        "v": (ATTENTION,), "w": (2 * HIDDEN,), "o": (1,),
    }
    scale = {"word": 0.1, "char": 0.1, "b": 0, "c": 0, "a": 0, "o": 0}
    return {
        k: (rng.normal(size=s) * scale.get(k, s[-2] ** -0.5 if len(s) > 1 else s[0] ** -0.5)).astype(_F) for k, s in shapes.items()
    }


def word_signs(texts: list[list[bytes]], truth: np.ndarray, least: int = 3, most: int = MOST_WORDS) -> dict[bytes, float]:
    """How surely each word in at least ``least`` texts tells toxic ones (above 0) or clean ones:
    the signed root of its log-likelihood ratio, less what chance reaches among so many words."""
    toxic, all_ = Counter(), Counter()
    for words, y in zip(texts, truth):
        each = set(words)
        all_.update(each)
        if y:
            toxic.update(each)
    # The most frequent ones, as they can be learned best.
    words = sorted((w for w, n in all_.items() if n >= least), key=lambda w: (-all_[w], w))[:most]
    n, p = np.array([all_[w] for w in words], float), np.array([toxic[w] for w in words], float)
    share = truth.mean()
    part = lambda x, of: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(of, 1e-9)), 0)
    ratio = np.sqrt(np.maximum(2 * (part(p, n * share) + part(n - p, n * (1 - share))), 0))
    sure = np.sign(p - n * share) * np.maximum(ratio - np.sqrt(2 * np.log(len(words) + 1)), 0)
    return dict(zip(words, np.clip(sure, -3, 3).tolist()))


def _padded(numbers: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WIDTH) of ``numbers`` from each start, and which of them are words."""
    offset = np.arange(WIDTH)
    mask = offset < size[:, None]
    at = np.where(mask, start[:, None] + offset, 0)
    return (numbers[at] if len(numbers) else np.zeros(at.shape, np.int64)), mask


class Sample:
    """The training texts as numbers of distinct words, and all their windows."""

    def __init__(self, texts: list[list[bytes]]):
        index: dict[bytes, int] = {}
        self.numbers = np.array([index.setdefault(w, len(index)) for t in texts for w in t], np.int64)
        self.words = list(index)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        starts = [windows_of(n) for n in sizes.tolist()]
        self.owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        self.start = np.concatenate(starts) + begins[self.owner]
        self.size = np.minimum(sizes[self.owner], WIDTH)
        self.cells, self.counts = trigrams(self.words) if self.words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.first_cell = np.cumsum(self.counts) - self.counts

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _padded(self.numbers, self.start[which], self.size[which])

    def highest(self, scores: np.ndarray) -> np.ndarray:
        """The window of the highest score of each text."""
        order = np.lexsort((-scores, self.owner))
        return order[np.unique(self.owner[order], return_index=True)[1]]


def train(texts: list[list[bytes]], truth: np.ndarray, steps: int | None = None, batch: int = 96, rate: float = 0.01, seed: int = 3) -> Network:
    """Fit the network to texts (lists of words) and their labels; both classes must occur."""
    steps = steps or 200 + len(texts) // 16
    rng = np.random.default_rng(seed)
    truth = truth.astype(_F)
    told = word_signs(texts, truth)
    vocabulary = {w: i + 1 for i, w in enumerate(told)}
    params = fresh(len(vocabulary), rng)
    params["word"][1:, 0] = np.array(list(told.values()), _F)
    params["o"][:] = -2
    sample = Sample(texts)
    own = np.array([vocabulary.get(w, 0) for w in sample.words], np.int64)
    of_word = np.array([told.get(w, 0.0) for w in sample.words] or [0.0])
    held, mask = sample.windows(np.arange(len(sample.owner)))
    chosen = sample.highest((np.maximum(of_word[held], 0) * mask).sum(1))
    toxic, clean = np.flatnonzero(truth == 1), np.flatnonzero(truth == 0)
    moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in params.items()}
    first_window = np.searchsorted(sample.owner, np.arange(len(texts)))
    windows_each = np.bincount(sample.owner, minlength=len(texts))
    for step in range(1, steps + 1):
        if step % (steps // 4 or 1) == 0 and step < steps:
            chosen = sample.highest(_sample_odds(params, sample, own))
        # A third toxic texts, a third clean ones at their highest, a third clean ones anywhere.
        n = batch // 3
        who = np.concatenate([rng.choice(toxic, n), rng.choice(clean, 2 * n)])
        which = chosen[who]
        some = who[2 * n :]
        which[2 * n :] = first_window[some] + (rng.random(len(some)) * windows_each[some]).astype(np.int64)
        at, mask = sample.windows(which)
        words, local = np.unique(at, return_inverse=True)
        local = local.reshape(at.shape)
        number = own[words] if len(own) else np.zeros(len(words), np.int64)
        counts = sample.counts[words] if len(own) else np.ones(len(words), np.int64)
        cells = (
            sample.cells[np.repeat(sample.first_cell[words] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            if len(own) else np.zeros(len(words), np.int64)
        )
        inputs = np.concatenate([params["word"][number], means(params["char"][cells], counts)], 1)
        # A part of the inputs is left out each time, but for the sign a word gives, so that
        # no word is learned by heart from the few texts that hold it.
        left = (rng.random(inputs.shape) < 0.7).astype(_F) / _F(0.7)
        left[:, 0] = 1
        _, grads, dx = gradients(params, inputs * left, local, mask, truth[who])
        dx = dx * left
        grads["word"] = np.zeros_like(params["word"])
        np.add.at(grads["word"], number, dx[:, :WORD_DIMS])
        grads["char"] = np.zeros_like(params["char"])
        np.add.at(grads["char"], cells, np.repeat(dx[:, WORD_DIMS:] / counts[:, None].astype(_F), counts, axis=0))
        pace = rate * min(1, step / 50) * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            a, b = moments[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            change = (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            own_pace = pace * (0.2 if k in ("word", "char") else 1)
            params[k] -= (own_pace * (change + 0.01 * params[k])).astype(_F)
    return Network(vocabulary, params)


def _sample_odds(params: dict, sample: Sample, own: np.ndarray) -> np.ndarray:
    inputs = np.concatenate([params["word"][own], means(params["char"][sample.cells], sample.counts)], 1)
    sent = gates(params, inputs if len(inputs) else np.zeros((1, WORD_DIMS + CHAR_DIMS), _F))
    parts = [
        odds(params, sent, *sample.windows(np.arange(a, min(a + BATCH, len(sample.owner))))) for a in range(0, len(sample.owner), BATCH)
    ]
    return np.concatenate(parts)


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """The scores of texts in UTF-8."""
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    index: dict[bytes, int] = {}
    known = index.setdefault
    flat: list[int] = []
    sizes = []
    for t in texts:
        words = terms_of(t)
        sizes.append(len(words))
        flat += [known(w, len(index)) for w in words]
    numbers = np.array(flat, np.int64)
    words = list(index)
    if words:
        own = np.array([net.vocabulary.get(w, 0) for w in words], np.int64)
        cells, counts = trigrams(words)
        inputs = np.concatenate([net.params["word"][own], means(net.params["char"][cells], counts)], 1)
    else:
        inputs = np.zeros((1, WORD_DIMS + CHAR_DIMS), _F)
    sent = gates(net.params, inputs)
    sizes = np.array(sizes, np.int64)
    starts = [windows_of(n) for n in sizes.tolist()]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    start = np.concatenate(starts) + (np.cumsum(sizes) - sizes)[owner] if len(texts) else np.zeros(0, np.int64)
    size = np.minimum(sizes[owner], WIDTH)
    # Short windows together, so that full ones need no mask.
    order = np.argsort(size, kind="stable")
    out = np.full(len(texts), -np.inf)
    for a in range(0, len(order), BATCH):
        some = order[a : a + BATCH]
        np.maximum.at(out, owner[some], odds(net.params, sent, *_padded(numbers, start[some], size[some])))
    return 1 / (1 + np.exp(-out))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_rows: int = MOST_ROWS,
    most_chars: int = MOST_CHARS,
    steps: int | None = None,
) -> Network:
    """Learn from ``labels`` (id, label 0 or 1). Runs jobs; training runs on the driver."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    rows, chars = [], F.sum("size").over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "text"))
    for value in (0, 1):
        wanted = lowest_by_hash(known.where(F.col("label") == value), "id", most_rows)
        # At most ``most_rows`` ids, so the join needs no shuffle of texts.
        mine = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(wanted), "id")
        mine = mine.withColumn("size", F.length("text"))
        few = mine.orderBy(F.xxhash64("id"), "text").limit(most_rows)
        rows += few.withColumn("chars", chars).where(F.col("chars") <= most_chars // 2).select("text", "label").collect()
    distinct = sorted({(r["label"], r["text"]) for r in rows})
    truth = np.array([y for y, _ in distinct], np.int64)
    if len(set(truth.tolist())) < 2:
        return Network({}, {}, float(truth.mean()) if len(truth) else 0.0)
    return train([terms_of(t.encode("utf-8", "surrogatepass")) for _, t in distinct], truth, steps)


def score_toxicity(docs: DataFrame, net: Network, text: str = "text", toxic: float = 0.7) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``score`` and ``predicted``."""
    docs = docs.drop("score", "predicted")
    kept = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = StructType([*docs.select(*kept).schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1).cast(pa.binary())
            sizes = column.fill_null(b"")
            scores = np.zeros(batch.num_rows)
            some, begin, size = [], 0, 0
            for i in range(batch.num_rows):
                some.append(sizes[i].as_py())
                size += len(some[-1])
                if size >= CHUNK or i == batch.num_rows - 1:
                    scores[begin : i + 1] = score_texts(net, some)
                    some, begin, size = [], i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores), pa.array((scores >= toxic).astype(np.int32))],
                names=[*kept, "score", "predicted"],
            )
        give_back()

    return docs.select(*kept, text).mapInArrow(run, schema)
