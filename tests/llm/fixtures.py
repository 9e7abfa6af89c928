"""Awkward documents, and plain Python versions of the primitives."""

import re
import zlib

from callmetrics.llm import kernel as K

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, slot string, shard string, lang_pred string, failed long, start long, part string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward():
    """Nulls, empty and long texts, copies, ties, odd characters, a word without end."""
    base = "the quick brown fox jumps over the lazy dog and then some more words follow it until the line is long enough to count"
    texts = [
        None, "", " \n\t ", "a", "one two three four", "one two three four", base, base, base + " indeed", base.upper(), base + "\n" + base + "\n" + base, "x" * 5000, "é ß İ ǅ 日本 語\nab　c d",
        "<|endoftext|> a <|startoftext|>\n's don't", "### $$ %% && ** || <> " * 5, "\x00 \x1c \x7f z", " ".join(f"w{i}" for i in range(3000)), "12345 678", "a b c d e f g h " * 30, base,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6]), (None, base), (None, None), (10**15, "far away id"), (-5, "negative id of a document")]
    return [(i, t, "en", "s", len(t) if t else None, "clash", "clash", "clash", 9, 9, "clash") for i, t in rows]


def crc_ids(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def small_slices(monkeypatch, size=300):
    """Makes slices tiny, so that documents spread over many."""
    monkeypatch.setattr(K.slices, "__defaults__", (size,))
