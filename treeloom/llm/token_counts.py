"""Token counts by offset-mapped attribution.

A document is encoded once as a whole.  Its tokens' spans are joined with the
spans of its sections by position, and a token that crosses a border goes to a
section by an explicit rule:

  first   the section that holds its first byte (the default)
  last    the section that holds its last byte
  most    the section that holds most of its bytes, the earlier one of two

Sections are the lines of a text, each with the newline that ends it; or the
fields of a row, which are encoded as one document with a newline after each
but the last; or the parts that a column of end positions gives.
"""

from __future__ import annotations

import base64
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most")
#: White space as the pattern's ``\s`` has it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 10_000  # from this length on, runs of white space are split off before the pattern sees them


class Encoder:
    """A byte-level vocabulary file (one base64 token and rank a line)."""

    def __init__(self, data: bytes, long: int = LONG):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.long = re.compile(f"[{WHITE}]{{{long},}}")

    def ids(self, text: str) -> list[int]:
        """Tokens of the whole text.  A very long run of white space, on which
        the pattern would go too deep, is encoded as the one piece that the
        pattern makes of it: all but its last character, which belongs to what
        follows, or all of it at the end of the text."""
        out, at = [], 0
        for m in self.long.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._core_bpe.encode_single_piece(text[m.start() : end].encode())
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def ends(self, text: str) -> np.ndarray:
        """End byte of every token of the whole text."""
        return np.cumsum(self.sizes[np.array(self.ids(text), np.int64)])


def line_bounds(raw: bytes) -> np.ndarray:
    """End byte of each line, its newline included; none for an empty text."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return at if len(at) and at[-1] == len(raw) or not raw else np.concatenate([at, [len(raw)]])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a border)."""
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    if rule == "first":
        to = first
    elif rule == "last":
        to = last
    else:
        to = first.copy()
        for i in np.flatnonzero(first != last):
            cuts = np.concatenate([[starts[i]], bounds[first[i] : last[i]], [ends[i]]])
            to[i] = first[i] + int(np.diff(cuts).argmax())
    return np.bincount(to, minlength=len(bounds)), int(np.count_nonzero(first != last))


def part_bounds(text: str, ends: list[int]) -> np.ndarray:
    """End byte of each part from end positions in code points, which may come
    in any order and lie beyond the text; what follows the last is one more
    part."""
    own = sorted({min(max(e, 0), len(text)) for e in ends if e is not None} | {len(text)})
    own = [e for e in own if e > 0]
    sizes = np.cumsum([len(text[a:b].encode()) for a, b in zip([0, *own[:-1]], own, strict=True)]) if own else []
    return np.array(sizes, np.int64)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "first", id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] | None = None, ends_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``n_sections``,
    ``n_crossing`` and ``section_tokens``, whose sum is ``n_tokens``.

    Sections are lines; or ``fields``, columns that are encoded as one text
    (``text_col`` is not read then; a null field is an empty one, and every
    field has a count); or the parts that end at the code points in the array
    ``ends_col`` (null: one part).  A null or empty text has no tokens and no
    sections; a section without tokens of its own (by the rule) has 0.  Null
    ids stay null, repeated rows are counted each; only the named columns are
    read."""
    if rule not in RULES:
        raise ValueError(rule)
    with open(vocabulary, "rb") as f:
        data = f.read()  # shipped with the tasks, which need not see the file

    def document(values: list) -> tuple[str, np.ndarray]:
        if fields is not None:
            texts = [(x or "") + ("\n" if k < len(fields) - 1 else "") for k, x in enumerate(values)]
            return "".join(texts), np.cumsum([len(x.encode()) for x in texts])
        text = values[0] or ""
        return text, line_bounds(text.encode()) if ends_col is None else part_bounds(text, values[1] or [])

    def run(batches):
        encoder = Encoder(data)
        for batch in batches:
            tokens, crossing, sections = [], [], []
            for values in zip(*batch.columns[1:], strict=True):
                text, bounds = document([x.as_py() for x in values])
                ends = encoder.ends(text)
                by, over = attribute(ends, bounds, rule)
                tokens.append(len(ends))
                crossing.append(over)
                sections.append(by)
            flat = np.concatenate(sections).astype(np.int32) if sections else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sections])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array([len(x) for x in sections], pa.int64()), pa.array(crossing, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    own = [F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(fields if fields is not None else (text_col,))]
    if ends_col is not None:
        own.append(F.col(ends_col).cast("array<bigint>").alias("ends"))
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *own)
    return picked.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<int>")
