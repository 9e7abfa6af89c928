"""Operator 8, token counts: unigram segmentation over a trie of words.

The distinct words of a slice, each with the word-start mark before it, go into a trie, level by level. A node is a
prefix; its best score is the best way to cut the prefix into pieces, found from the nodes above it. Words that share
a prefix share its scores; the node at a word's end holds the word's number of tokens, which is then added up over
the words of each document.

Scores come from the vocabulary file alone. The file at hand is of merges: its own scores are ranks, no probabilities,
so a piece of rank r (in the file's order) has the log probability of Zipf's law, -ln(r) less a constant. Bytes that no piece covers cost one byte token each, dearer than any piece. Of equal
scores the cut with the shortest last piece counts.

Long words, as in scripts without spaces, are first cut wherever no piece of the vocabulary can span, which changes
nothing, and their parts go into a trie of their own; parts that are still long are scored by themselves, by the same
recurrence over the pieces that end at each place. Null and empty texts have no tokens. Repeated rows are counted each for
itself, an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K

#: Words of more bytes are cut first; parts of more bytes are scored by themselves. Neither changes a result.
CUT_BYTES, ALONE_BYTES = 48, 512
MARK = "▁".encode()


@dataclass
class Pieces:
    """A vocabulary: pieces' log probabilities, and a trie of the reversed pieces as a table of transitions."""

    score: dict[bytes, float]
    byte_score: float
    edge: np.ndarray  # state << 8 | byte, sorted
    target: np.ndarray
    state_score: np.ndarray  # -inf where no piece ends

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        return Pieces.of(names)

    @staticmethod
    def of(names: list[bytes]) -> Pieces:
        whole = math.log(sum(1 / r for r in range(1, len(names) + 1)))
        score = {name: -math.log(r) - whole for r, name in enumerate(names, 1)}
        states, edges, ends = {b"": 0}, [], {}
        for name, value in score.items():
            for k in range(1, len(name) + 1):
                tail = name[-k:]
                if tail not in states:
                    states[tail] = len(states)
                    edges.append((states[tail[1:]] << 8 | tail[0], states[tail]))
            ends[states[name]] = value
        edges.sort()
        state_score = np.full(len(states), -np.inf)
        state_score[list(ends)] = list(ends.values())
        edge, target = np.array(edges, np.int64).T
        return Pieces(score, -math.log(len(names)) - whole - 10.0, edge, target, state_score)


def matches(data: np.ndarray, begin: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in some bytes, each within the word that begins at `begin` of its last byte: where they end, their sizes and scores, by end and size."""
    live, state, k, found = np.arange(len(data)), np.zeros(len(data), np.int64), 0, []
    while len(live):
        k += 1
        inside = live + 1 - k >= begin[live]
        live, state = live[inside], state[inside]
        step = state << 8 | data[live + 1 - k]
        i = np.minimum(np.searchsorted(pieces.edge, step), len(pieces.edge) - 1)
        hit = pieces.edge[i] == step
        live, state = live[hit], pieces.target[i[hit]]
        whole = np.isfinite(pieces.state_score[state])
        found.append((live[whole] + 1, np.full(int(whole.sum()), k), pieces.state_score[state[whole]]))
    end, size, score = (np.concatenate([x[j] for x in found]) if found else np.zeros(0, np.int64) for j in range(3))
    order = np.lexsort((size, end))
    return end[order], size[order], score[order]


def segment(word: bytes, pieces: Pieces) -> tuple[int, float]:
    """Tokens and log probability of one word, mark included, by the recurrence over the pieces that end at each place."""
    data = np.frombuffer(word, np.uint8)
    end, size, score = matches(data, np.zeros(len(data), np.int64), pieces)
    cut = np.searchsorted(end, np.arange(1, len(data) + 2)).tolist()
    size, score = size.tolist(), score.tolist()
    best, count = [0.0], [0]
    for i in range(1, len(word) + 1):
        top, n = best[i - 1] + pieces.byte_score, count[i - 1] + 1
        for j in range(cut[i - 1], cut[i]):
            k = size[j]
            if best[i - k] + score[j] > top:
                top, n = best[i - k] + score[j], count[i - k] + 1
        best.append(top)
        count.append(n)
    return count[-1], best[-1]


def long_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and log probability of each word, cut first where no piece can span."""
    mark = np.frombuffer(MARK, np.uint8)
    length = end - start + len(mark)
    first = np.cumsum(length) - length
    text = np.zeros(int(length.sum()) + 8, np.uint8)  # the words with their marks, and padding
    for k, b in enumerate(mark):
        text[first + k] = b
    text[K.ranges(first + len(mark), end - start)] = data[K.ranges(start, end - start)]
    ends, size, _ = matches(text[:-8], np.repeat(first, length), pieces)
    cover = np.cumsum(np.bincount(ends - size + 1, minlength=len(text)) - np.bincount(ends, minlength=len(text)))
    free = cover[: len(text) - 8] <= 0  # no piece spans from before this place to behind it
    free[first] = True
    begin = np.flatnonzero(free)
    stop = np.append(begin[1:], len(text) - 8)
    word = np.searchsorted(first, begin, "right") - 1
    _, at, inverse = K.distinct(K.span_hash(text, begin, stop))
    tokens, scores = np.zeros(len(at), np.int64), np.zeros(len(at))
    short = stop[at] - begin[at] <= ALONE_BYTES
    tokens[short], scores[short] = trie_counts(text, begin[at[short]], stop[at[short]], pieces, mark=b"")
    for i in np.flatnonzero(~short):
        tokens[i], scores[i] = segment(text[begin[at[i]] : stop[at[i]]].tobytes(), pieces)
    return np.rint(np.bincount(word, tokens[inverse], minlength=len(start))).astype(np.int64), np.bincount(word, scores[inverse], minlength=len(start))


def trie_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces, mark: bytes = MARK) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and log probability of each word, with the mark before it."""
    words, mark = len(start), np.frombuffer(mark, np.uint8)
    length = end - start + len(mark)
    tokens, scores = np.zeros(words, np.int64), np.zeros(words)
    # Of all nodes so far, the root first: best score, tokens, node above, last byte.
    best, count = np.zeros(1), np.zeros(1, np.int64)
    above, byte = np.zeros(1, np.int64), np.zeros(1, np.uint8)
    node, live = np.zeros(words, np.int64), np.arange(words)
    for depth in range(1, int(length.max(initial=0)) + 1):
        live = live[length[live] >= depth]
        b = np.full(len(live), mark[depth - 1]) if depth <= len(mark) else data[start[live] + depth - 1 - len(mark)]
        key, _, inverse = K.distinct((node[live] << 8 | b).astype(K.U64))
        total, up = len(best), (key >> K.U64(8)).astype(np.int64)
        above, byte = np.append(above, up), np.append(byte, (key & K.U64(255)).astype(np.uint8))
        score, n = best[up] + pieces.byte_score, count[up] + 1
        at, state, who = np.arange(total, total + len(key)), np.zeros(len(key), np.int64), np.arange(len(key))
        while len(who):
            step = state << 8 | byte[at]
            i = np.searchsorted(pieces.edge, step)
            ok = i < len(pieces.edge)
            ok[ok] = pieces.edge[i[ok]] == step[ok]
            who, at, state = who[ok], above[at[ok]], pieces.target[i[ok]]
            value = best[at] + pieces.state_score[state]
            better = value > score[who]
            score[who[better]], n[who[better]] = value[better], count[at[better]] + 1
            more = at > 0  # the root has no byte above it
            who, at, state = who[more], at[more], state[more]
        best, count = np.append(best, score), np.append(count, n)
        node[live] = total + inverse
        done = live[length[live] == depth]
        tokens[done], scores[done] = count[node[done]], best[node[done]]
    return tokens, scores


_LOADED: dict[str, Pieces] = {}


def counted(docs: DataFrame, vocabulary_file: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, log_prob (natural logarithm) of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_file not in _LOADED:
            _LOADED[vocabulary_file] = Pieces.load(vocabulary_file)
        pieces = _LOADED[vocabulary_file]
        for batch in batches:
            for s in K.slices(batch, 1):
                t = K.texts(s.column(1))
                w = K.words(t)
                _, at, inverse = K.distinct(K.span_hash(t.data, w.start, w.end))
                start, end = w.start[at], w.end[at]
                tokens, scores = np.zeros(len(at), np.int64), np.zeros(len(at))
                short = end - start <= CUT_BYTES
                tokens[short], scores[short] = trie_counts(t.data, start[short], end[short], pieces)
                tokens[~short], scores[~short] = long_counts(t.data, start[~short], end[~short], pieces)
                per = lambda x: np.bincount(w.doc, x[inverse], minlength=s.num_rows)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(w.counts), pa.array(np.rint(per(tokens)).astype(np.int64)), pa.array(per(scores))], names=["doc_id", "n_words", "n_tokens", "log_prob"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long, log_prob double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: token counts of all documents."""
    import public_tokenizers

    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
