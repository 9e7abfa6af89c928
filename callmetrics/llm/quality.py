"""Operator 9, quality rules: a ledger of rule bits.

Every rule is evaluated once for every document. The ledger keeps the measurements and a mask in which bit i says
that rule i fails. A policy is a named set of rules, a mask of its own: a document passes if the two masks have no
bit in common. New versions of a policy, and the effect of leaving a rule out, are bitwise questions to the ledger;
the texts are not read again.

Null and empty texts have no words and no symbols. Lines are compared byte for byte. Repeated rows are judged each
for itself; columns other than the two named are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

#: Rules in the order of their bits, as SQL conditions under which a document fails.
RULES = {
    "too_short": "n_words < 20",
    "repeats_itself": "100 * n_repeat_words > 30 * n_words",
    "symbols_for_words": "10 * n_symbols > n_words",
    "lines_again": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
#: Versions of the policy, as names of rules.
POLICIES = {
    "base": ("too_short", "repeats_itself"),
    "v1": ("too_short", "repeats_itself", "symbols_for_words", "lines_again", "long_words", "short_words"),
}


def measure(t: K.Texts, window: int = 8) -> dict[str, np.ndarray]:
    """Measurements of each text; `n_repeat_words` counts words in windows found twice or more in their text."""
    data, n = t.data[: t.size], len(t.starts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return total[t.ends] - total[t.starts]

    ink = ~K.SPACE[data]
    w = K.spans(t, np.append(ink, np.zeros(8, bool)))
    h = K.span_hash(t.data, w.start, w.end)
    covered = np.zeros(len(w) + 1, np.int64)
    if len(w) >= window:
        inside = w.doc[: len(w) - window + 1] == w.doc[window - 1 :]
        at = np.flatnonzero(inside)
        keys = K.mix(K.gram_hash(h, window)[at] + w.doc[at].astype(K.U64) * K._M1)
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = np.bincount(at[twice], minlength=len(covered)) - np.bincount(at[twice] + window, minlength=len(covered))
    repeat = np.cumsum(covered[:-1]) > 0

    line = K.spans(t, t.data != 10)
    inked = np.append(0, np.cumsum(ink, dtype=np.int64))
    with_word = inked[line.end] > inked[line.start]
    lines = K.mix(K.span_hash(t.data, line.start, line.end) + line.doc.astype(K.U64) * K._M1)[with_word]
    _, first, _ = K.distinct(lines)
    n_lines = np.bincount(line.doc[with_word], minlength=n)
    return {
        "n_words": w.counts,
        "word_chars": per_text(ink & (data & 0xC0 != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": n_lines - np.bincount(line.doc[with_word][first], minlength=n),
        "n_repeat_words": np.bincount(w.doc[repeat], minlength=n),
        "n_lines": n_lines,
        "n_bytes": t.ends - t.starts,
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in K.slices(batch, 1):
            found = measure(K.texts(s.column(1)))
            yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame, rules: dict[str, str] = RULES, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the measurements, and `failed`, the mask of failed rules."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return rows.withColumn("failed", _mask_of(rules))


def _mask_of(rules: dict[str, str]) -> Column:
    """The mask of failed rules of a row with the measurements."""
    whole = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        whole = whole.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return whole


def booked(docs: DataFrame, rules: dict[str, str] = RULES, *, text_column: str = "text", book: str = "ledger") -> DataFrame:
    """The documents, all columns, with their ledger entry in one column: a struct of the measurements and `failed`. A column of that name is replaced."""
    kept = docs.drop(book)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            for s in K.slices(batch, at):
                found = measure(K.texts(s.column(at)))
                entry = pa.StructArray.from_arrays([pa.array(found[m].astype(np.int64)) for m in MEASURES], names=list(MEASURES))
                yield pa.RecordBatch.from_arrays([*s.columns, entry], names=[*s.schema.names, book])

    entry = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    wide = kept.mapInArrow(rows, T.StructType([*kept.schema.fields, T.StructField(book, entry)]))
    inside = {name: re.sub(r"\b(" + "|".join(MEASURES) + r")\b", lambda m: f"`{book}`.{m[1]}", condition) for name, condition in rules.items()}
    return wide.withColumn(book, F.col(book).withField("failed", _mask_of(inside)))


def passing(docs: DataFrame, policy: tuple[str, ...], rules: dict[str, str] = RULES, *, text_column: str = "text") -> DataFrame:
    """The documents, all columns, that pass a policy: its mask and their ledger's have no bit in common."""
    book = "ledger"
    while book in {c.lower() for c in docs.columns}:
        book += "_"
    found = booked(docs, rules, text_column=text_column, book=book)
    return found.filter(F.col(book)["failed"].bitwiseAND(F.lit(mask(policy, rules))) == 0).select(*docs.columns)


def mask(policy: tuple[str, ...], rules: dict[str, str] = RULES) -> int:
    """The policy's mask."""
    return sum(1 << list(rules).index(name) for name in policy)


def passes(policy: tuple[str, ...], rules: dict[str, str] = RULES) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules))) == 0


def ablation(book: DataFrame, policy: tuple[str, ...], rules: dict[str, str] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that it alone rejects."""
    whole = F.col("failed").bitwiseAND(F.lit(mask(policy, rules)))
    each = [F.struct(F.lit(name).alias("rule"), F.count_if(whole.bitwiseAND(F.lit(mask((name,), rules))) != 0).alias("n_failed"), F.count_if(whole == mask((name,), rules)).alias("n_alone")) for name in policy]
    return book.agg(F.array(*each).alias("rows")).select(F.inline("rows"))


def judged(docs: DataFrame) -> DataFrame:
    """Ledger rows with `base_failed` and `kept`."""
    return ledger(docs).select("doc_id", *MEASURES[:5], "failed", (~passes(POLICIES["base"])).alias("base_failed"), passes(POLICIES["v1"]).alias("kept"))


def ablated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect of each rule of the policy on all documents, from the ledger's bits alone."""
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), POLICIES["v1"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: rules on all documents."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), m AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM d
), l AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), ll AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), p AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), g AS (
  SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram,
         count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n
  FROM p
), c AS (
  SELECT r, i, CASE WHEN n = 8 AND count(*) OVER (PARTITION BY r, gram, n) > 1 THEN 1 ELSE 0 END AS twice FROM g
), q AS (
  SELECT r, i, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM c
), s AS (
  SELECT r, sum(hit) AS n_repeat_words FROM q GROUP BY r
), f AS (
  SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, CAST(coalesce(ll.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(s.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(ll.n_lines, 0) AS n_lines
  FROM m LEFT JOIN ll ON m.r = ll.r LEFT JOIN s ON m.r = s.r
), b AS (
  SELECT *, CAST(
      CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
       failed % 4 <> 0 AS base_failed, failed = 0 AS kept
FROM b
"""

ABLATION_SQL = "WITH q AS (" + ORACLE_SQL + """), rules AS (
  SELECT * FROM (VALUES ('too_short', 1), ('repeats_itself', 2), ('symbols_for_words', 4), ('lines_again', 8), ('long_words', 16), ('short_words', 32)) AS v(rule, bit)
)
SELECT rule, CAST(sum(CASE WHEN failed & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(sum(CASE WHEN failed = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_alone FROM q, rules GROUP BY rule
"""
