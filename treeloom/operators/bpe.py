"""Byte-pair merges from distributed word counts.

Words are counted on the executors; the table of distinct words (bounded by
``most_words``, the most frequent ones) is merged on the driver, and the
merges apply to texts in an Arrow UDF.  Ties take the pair that sorts first."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = r"(?U)\w+|[^\w\s]+"


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): runs of word characters, and of other marks."""
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def train(docs: DataFrame, vocab_size: int = 8000, most_words: int = 50_000, specials=("[UNK]", "[PAD]", "[BOS]", "[EOS]")) -> tuple[list[str], list[tuple[str, str]]]:
    """(vocabulary in id order, merges in order)."""
    rows = word_counts(docs).orderBy(F.desc("n"), "word").limit(most_words).collect()
    words = [(list(r["word"]), r["n"]) for r in rows]
    vocab = [*specials, *sorted({c for w, _ in words for c in w})]
    merges: list[tuple[str, str]] = []
    pairs, where = Counter(), {}
    for i, (w, n) in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            pairs[p] += n
            where.setdefault(p, set()).add(i)
    while len(vocab) < vocab_size and pairs:
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < 2:
            break
        merges.append(best)
        vocab.append(best[0] + best[1])
        for i in where.pop(best, ()):
            w, n = words[i]
            for p in zip(w, w[1:], strict=False):
                pairs[p] -= n
                if pairs[p] <= 0:
                    del pairs[p]
            words[i] = (join(w, best), n)
            for p in zip(words[i][0], words[i][0][1:], strict=False):
                pairs[p] += n
                where.setdefault(p, set()).add(i)
        pairs.pop(best, None)
    return vocab, merges


def join(word: list[str], pair: tuple[str, str]) -> list[str]:
    out, i = [], 0
    while i < len(word):
        if i + 1 < len(word) and (word[i], word[i + 1]) == pair:
            out.append(word[i] + word[i + 1])
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


def tokenizer(merges: list[tuple[str, str]]):
    """An Arrow UDF from a text to its pieces."""
    ranks = {p: i for i, p in enumerate(merges)}

    @F.arrow_udf(returnType="array<string>")
    def run(text: pa.Array) -> pa.Array:
        import regex

        pattern, known = regex.compile(r"\w+|[^\w\s]+"), {}

        def pieces(word: str) -> list[str]:
            if word not in known:
                out = list(word)
                while len(out) > 1:
                    pair = min(zip(out, out[1:], strict=False), key=lambda p: ranks.get(p, len(ranks)))
                    if pair not in ranks:
                        break
                    i, new = 0, []
                    while i < len(out):
                        hit = i + 1 < len(out) and (out[i], out[i + 1]) == pair
                        new.append(out[i] + out[i + 1] if hit else out[i])
                        i += 2 if hit else 1
                    out = new
                known[word] = out
            return known[word]

        return pa.array([[p for w in pattern.findall(t.as_py() or "") for p in pieces(w)] for t in text], pa.list_(pa.string()))

    return run


class TextTokenizer:
    """Pieces and merges as the text mode of ``encode``."""

    def __init__(self, pieces: list[str], merges: list[tuple[str, str]]):
        self._pieces, self.merges = list(pieces), [tuple(m) for m in merges]

    def vocabulary(self) -> list[str]:
        return self._pieces

    def pieces(self, text):
        return tokenizer(self.merges)(text)
