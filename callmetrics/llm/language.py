"""Operator 10, language identification: a bidirectional gated recurrent network over bytes.

The network reads a word's bytes forwards and backwards and gives every position a distribution over the languages;
a document's probabilities are the mean over all positions of its words. It is trained in numpy by backpropagation
through time on the driver, on a sample of labelled documents whose size is bounded by `SAMPLE_DOCS` documents a
language and `SAMPLE_CHARS` characters of each, taken at a place given by a hash. Every language that is given is learned.
It labels whole texts: a slice's distinct words are run once and their positions' labels counted as often as the words
occur.

A text that is null or has no letter is `und` with score 0. Without a single labelled document all texts are. Words
are runs of ASCII letters and bytes beyond ASCII, A-Z lower-cased; runs of more than `WORD_BYTES` bytes are read in
pieces. Of equal probabilities the language that sorts first wins. Repeated rows are judged each for itself. An empty
table gives no rows, and so does not teach; other columns stay, but those named like the results are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K

SAMPLE_DOCS = 300
SAMPLE_CHARS = 3000
WORD_BYTES = 24
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


@dataclass
class Network:
    """Two gated recurrent layers, one a direction, and a softmax over both states at each position.

    Weights of a direction: `x` (byte to update, reset and candidate), `u` (state to update and reset), `c` (reset
    state to candidate). Words of a batch are ordered by falling length, so the words that have a position t are
    the first ones.
    """

    names: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def new(names: list[str], hidden: int = 16, seed: int = 7, classes: int | None = None) -> Network:
        rng, classes = np.random.default_rng(seed), classes or len(names)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0] if shape[0] != 256 else 16)).astype(np.float32)
        w = {f"{d}{k}": make(*shape) for d in "fb" for k, shape in (("x", (256, 3 * hidden)), ("u", (hidden, 2 * hidden)), ("c", (hidden, hidden)))}
        return Network(names, w | {"out": make(2 * hidden, classes), "bias": np.zeros(classes, np.float32)})

    @property
    def hidden(self) -> int:
        return self.weights["fc"].shape[0]

    def _run(self, d: str, steps: list[np.ndarray], keep: bool) -> tuple[list[np.ndarray], list[tuple]]:
        """States after each step; step t has the bytes of the words that are longer than t."""
        h, w = self.hidden, self.weights
        state = np.zeros((len(steps[0]), h), np.float32)
        states, kept = [], []
        for b in steps:
            before, x = state[: len(b)], w[d + "x"][b]
            gates = _sigmoid(x[:, : 2 * h] + before @ w[d + "u"])
            update, reset = gates[:, :h], gates[:, h:]
            candidate = np.tanh(x[:, 2 * h :] + (reset * before) @ w[d + "c"])
            state = before + update * (candidate - before)
            states.append(state)
            if keep:
                kept.append((b, before, update, reset, candidate))
        return states, kept

    def label(self, words: np.ndarray, length: np.ndarray, keep: bool = False):
        """Probabilities at each position: for each step t an array (words longer than t, languages)."""
        longest = int(length[0])
        live = np.searchsorted(-length, -np.arange(longest), "left")
        forward = [words[:n, t] for t, n in enumerate(live)]
        backward = [words[np.arange(n), length[:n] - 1 - t] for t, n in enumerate(live)]
        f, kf = self._run("f", forward, keep)
        b, kb = self._run("b", backward, keep)
        both = np.zeros((longest, len(words), 2 * self.hidden), np.float32)
        for t, n in enumerate(live):
            both[t, :n, : self.hidden] = f[t]
            both[length[:n] - 1 - t, np.arange(n), self.hidden :] = b[t]
        out = []
        for t, n in enumerate(live):
            z = both[t, :n] @ self.weights["out"] + self.weights["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return (out, both, live, kf, kb) if keep else out

    def gradient(self, words: np.ndarray, length: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy over all positions."""
        out, both, live, kf, kb = self.label(words, length, keep=True)
        w, h, total = self.weights, self.hidden, float(length.sum())
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        into = np.zeros_like(both)
        for t, n in enumerate(live):
            dz = out[t].copy()
            dz[np.arange(n), target[:n]] -= 1
            dz /= total
            grad["out"] += both[t, :n].T @ dz
            grad["bias"] += dz.sum(axis=0)
            into[t, :n] = dz @ w["out"].T
        for d, kept in (("f", kf), ("b", kb)):
            carry = np.zeros((len(words), h), np.float32)
            for t in range(len(live) - 1, -1, -1):
                b, before, update, reset, candidate = kept[t]
                n = live[t]
                ds = carry[:n] + (into[t, :n, :h] if d == "f" else into[length[:n] - 1 - t, np.arange(n), h:])
                dc = ds * update * (1 - candidate**2)
                du = ds * (candidate - before) * update * (1 - update)
                through = dc @ w[d + "c"].T
                dr = through * before * reset * (1 - reset)
                gates = np.concatenate([du, dr], axis=1)
                grad[d + "c"] += (reset * before).T @ dc
                grad[d + "u"] += before.T @ gates
                np.add.at(grad[d + "x"], b, np.concatenate([gates, dc], axis=1))
                carry[:n] = ds * (1 - update) + through * reset + gates @ w[d + "u"].T
        return grad


def train(words: np.ndarray, length: np.ndarray, target: np.ndarray, names: list[str], *, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 7, classes: int | None = None) -> Network:
    """Adam over batches of words, for some hundred steps at least."""
    epochs = max(epochs, -(-400 // max(1, -(-len(words) // batch))))
    net, rng = Network.new(names, seed=seed, classes=classes), np.random.default_rng(seed)
    one, two, step = {k: np.zeros_like(v) for k, v in net.weights.items()}, {k: np.zeros_like(v) for k, v in net.weights.items()}, 0
    steps = epochs * -(-len(words) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(words))
        for i in range(0, len(words), batch):
            at = order[i : i + batch]
            at = at[np.argsort(-length[at], kind="stable")]
            step += 1
            for k, g in net.gradient(words[at], length[at], target[at]).items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g * g
                now = rate * (1 - 0.9 * step / steps)
                net.weights[k] -= (now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _words(t: K.Texts) -> K.Spans:
    """Runs of letters, cut into pieces of at most WORD_BYTES."""
    w = K.spans(t, _LETTER[t.data])
    n = -(-(w.end - w.start) // WORD_BYTES)
    if not len(n) or int(n.max()) == 1:
        return w
    row = np.repeat(np.arange(len(w)), n)
    start = w.start[row] + K.ranges(np.zeros(len(n), np.int64), n) * WORD_BYTES
    doc = w.doc[row]
    return K.Spans(start, np.minimum(start + WORD_BYTES, w.end[row]), np.searchsorted(doc, np.arange(len(t.starts) + 1)), doc)


def _matrix(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as rows of bytes by falling length, their lengths, and the order."""
    order = np.argsort(start - end, kind="stable")
    start, length = start[order], (end - start)[order]
    out = np.zeros((len(order), int(length[0]) if len(order) else 0), np.uint8)
    row = np.repeat(np.arange(len(order)), length)
    out[row, K.ranges(np.zeros(len(order), np.int64), length)] = data[K.ranges(start, length)]
    return out, length, order


def probabilities(net: Network, t: K.Texts) -> np.ndarray:
    """Mean over all positions of each text's words; rows of texts without words are 0."""
    t = t.lowered()
    w = _words(t)
    _, at, inverse = K.distinct(K.span_hash(t.data, w.start, w.end))
    sums = np.zeros((len(at), len(net.weights["bias"])))
    words, length, order = _matrix(t.data, w.start[at], w.end[at])
    for i in range(0, len(order), 8192):
        part = slice(i, i + 8192)
        for p in net.label(words[part], length[part]):
            sums[order[part][: len(p)]] += p
    sizes = np.bincount(w.doc, w.end - w.start, minlength=len(t.starts))
    out = np.stack([np.bincount(w.doc, sums[inverse, k], minlength=len(t.starts)) for k in range(sums.shape[1])], axis=1)
    return out / np.maximum(sizes, 1)[:, None]


def _thinned(labelled: DataFrame, sample: int) -> tuple[DataFrame, list[str]]:
    """`sample` rows of each language, or all if there are fewer: those with the least hashes of id and text. And the languages.

    The bound is exact whatever ids and texts repeat: first the largest hash that counts is found for each language, by the
    hashes alone, of which each task sends its least ones; rows up to it are then numbered, as equal rows have equal hashes.
    """
    names = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())  # a row for each language
    if not names:
        return labelled.limit(0), names
    rows = labelled.withColumn("_hash", F.xxhash64(F.lit("language sample"), "doc_id", "text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    least = rows.select("lang", "_hash").withColumn("_place", place).filter(F.col("_place") <= sample)
    last = least.groupBy(F.col("lang").alias("_lang")).agg(F.max("_hash").alias("_last"))
    near = rows.join(F.broadcast(last), F.col("lang") == F.col("_lang")).filter("_hash <= _last")
    return near.withColumn("_place", place).filter(F.col("_place") <= sample).select(*labelled.columns), names


def _chance_words(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters drawn by chance, half of them from a to z, half from one of many alphabets each: bytes, starts, ends."""
    out = []
    for _ in range(n):
        size, low = int(rng.integers(2, 11)), int(rng.integers(0xC0, 0xD000))
        letters = rng.integers(97, 123, size) if rng.random() < 0.5 else rng.integers(low, low + 64, size)
        out.append("".join(map(chr, letters)).encode()[:WORD_BYTES])
    ends = np.cumsum([len(w) for w in out])
    return np.frombuffer(b"".join(out), np.uint8), np.append(0, ends[:-1]), ends


def fit(labelled: DataFrame, *, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, words_each: int = 12_000, seed: int = 7, background: bool = False) -> Network | None:
    """A network from doc_id, text and lang; null if there is no language. With `background` it also learns words of chance letters, as a last class without a name.

    The sample has at most `sample` documents a language and at most `chars` characters of each. Of these, `words_each` words a language are learned.
    """
    chosen, names = _thinned(labelled.filter("text IS NOT NULL AND lang IS NOT NULL"), sample)
    if not names:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    got = chosen.select("doc_id", "lang", F.substr("text", place.cast("int"), F.lit(chars)).alias("text")).orderBy("doc_id", "text").toArrow()
    t = K.texts(got.column("text").combine_chunks()).lowered()
    w = _words(t)
    target = np.array([names.index(x) for x in got.column("lang").to_pylist()], np.int64)[w.doc] if len(w) else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    pick = [np.flatnonzero(target == k) for k in range(len(names))]
    pick = np.concatenate([rng.permutation(p)[:words_each] for p in pick]).astype(np.int64)
    if not len(pick):
        return None
    data, start, end, target = t.data, w.start[pick], w.end[pick], target[pick]
    if background:
        more, first, last = _chance_words(-(-len(pick) // len(names)), rng)  # as many as a language has
        data, start, end = np.append(data, more), np.append(start, first + len(data)), np.append(end, last + len(data))
        target = np.append(target, np.full(len(first), len(names)))
    words, length, order = _matrix(data, start, end)
    return train(words, length, target[order], names, seed=seed, classes=len(names) + background)


def identify(docs: DataFrame, net: Network | None, *, text_column: str = "text", names: tuple[str, str] = ("lang_pred", "score"), chance: str | None = None) -> DataFrame:
    """The rows with the language and its score, named `names`, and the probability of the class of chance letters, named `chance`; columns of these names are replaced."""
    (pred, score), extra = names, [chance] if chance else []
    kept = docs.drop(*names, *extra)
    if net is None:
        return kept.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)} | {c: F.lit(0.0) for c in extra})
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            for s in K.slices(batch, at):
                p = probabilities(network, K.texts(s.column(at)))
                other = p[:, len(network.names) :].sum(axis=1)
                p = p[:, : len(network.names)]
                best = p.argmax(axis=1)
                columns = [*s.columns, pa.array([network.names[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best])] + [pa.array(other)] * len(extra)
                yield pa.RecordBatch.from_arrays(columns, names=[*s.schema.names, pred, score, *extra])

    schema = T.StructType([*kept.schema.fields, T.StructField(pred, T.StringType()), *(T.StructField(c, T.DoubleType()) for c in (score, *extra))])
    found = kept.mapInArrow(rows, schema)
    letters = F.coalesce(F.rlike(F.col(text_column), F.lit(r"\p{L}")), F.lit(False)) & (F.col(score) > 0)
    return found.withColumns({pred: F.when(letters, F.col(pred)).otherwise(UNKNOWN), score: F.when(letters, F.least(score, F.lit(1.0))).otherwise(0.0)})


def held_out() -> Column:
    """crc32 of the id as text modulo 3 is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def accepted(docs: DataFrame, *, text_column: str = "text", most: float = 0.5) -> DataFrame:
    """The documents, all columns, whose text is in a language that was learned: texts without letters go, and those whose positions look more like chance than like any language."""
    net = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"), background=True)
    if net is None:
        return docs.limit(0)
    names = tuple(_free(docs, n) for n in ("language", "certainty", "chance"))
    found = identify(docs, net, text_column=text_column, names=names[:2], chance=names[2])
    return found.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[2]) <= most)).select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
