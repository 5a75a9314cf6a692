"""Secret scans by multipart credential linking.

Base spans stand on their own: assignments to a secret's name, access
identifiers, long hexadecimal runs.  Weak candidates (account names, random
looking tokens, endpoints) are common in clean text; one is reported only if a
complementary part lies in the same scope, found by an interval join: spans
whose gap is at most ``scope`` code points share a scope.

  part        strong kinds   weak kinds   needs in its scope
  identifier  access         id           a secret
  secret      assign, hex    key          an identifier or an endpoint
  endpoint    -              endpoint     a secret and an identifier

The join runs inside each document over spans sorted by start, with a running
maximum of their ends, in n log n steps.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm._bytes import Words, text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
SCOPE = 200

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAME = re.compile(r"""(?ai)(?:access_key_id|client_id|account(?:_id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
ENDPOINT = re.compile(r"""(?ai)(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ssh)://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}""")
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
NAME_HINTS = (b"access_key_id", b"client_id", b"account", b"user", b"login")
ENDPOINT_HINTS = (b"://", b"host", b"endpoint", b"server")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


HEX = _table("0123456789abcdef")
RUN = _table("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-")


def random_looking(token: str) -> bool:
    """Digits, both cases and at least 3.5 bits a character."""
    if not (re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= 3.5


def _near(spans: list[tuple[int, int]], scope: int):
    """A test whether a span lies within ``scope`` of one of ``spans``."""
    spans = sorted(spans)
    starts = np.array([s for s, _ in spans], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in spans], np.int64)) if spans else starts

    def test(start: int, end: int) -> bool:
        k = int(np.searchsorted(starts, end + scope, "right"))
        return k > 0 and int(reach[k - 1]) >= start - scope

    return test


def link(strong: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """The weak candidates that have their complementary parts in scope."""
    if not weak:
        return []
    every = strong + weak
    part = {name: _near([(s, e) for k, s, e in every if k in kinds], scope) for name, kinds in (("identifier", ("access", "id")), ("secret", ("assign", "hex", "key")), ("endpoint", ("endpoint",)))}
    needs = {"id": lambda s, e: part["secret"](s, e), "key": lambda s, e: part["identifier"](s, e) or part["endpoint"](s, e), "endpoint": lambda s, e: part["secret"](s, e) and part["identifier"](s, e)}
    return [w for w in weak if needs[w[0]](w[1], w[2])]


def spans_of(text: str, low: bytes, hex_runs: list[tuple[int, int]], long_runs: list[tuple[int, int]], scope: int) -> list[tuple[str, int, int]]:
    """All spans of one text, in code points, by start and then kind."""
    strong = [("hex", s, e) for s, e in hex_runs]
    if any(h in low for h in ASSIGN_HINTS):
        strong += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"akia" in low:
        strong += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    weak = []
    if any(h in low for h in NAME_HINTS):
        weak += [("id", *m.span()) for m in NAME.finditer(text)]
    if any(h in low for h in ENDPOINT_HINTS):
        weak += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    weak += [("key", s, e) for s, e in long_runs if random_looking(text[s:e])]
    return sorted(strong + link(strong, weak, scope), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_column(column, scope: int = SCOPE) -> list[list[tuple[str, int, int]]]:
    """The spans of each text of an Arrow column; none for a null."""
    out: list[list[tuple[str, int, int]]] = []
    for _, buf, offsets in text_slices(column):
        raw, runs = buf.tobytes(), []
        low = raw.lower()
        points = None  # code points before each byte, made once a run of texts
        for table, least in ((HEX, 32), (RUN, 20)):
            found, by = Words(buf, offsets, table, False), {}
            points = found.points() if points is None else points
            at = np.flatnonzero(found.end - found.start >= least)
            owner = np.searchsorted(offsets, found.start[at], "right") - 1
            base = points[offsets[owner]]
            for doc, s, e in zip(owner.tolist(), (points[found.start[at]] - base).tolist(), (points[found.end[at]] - base).tolist(), strict=True):
                by.setdefault(doc, []).append((s, e))
            runs.append(by)
        for doc in range(len(offsets) - 1):
            a, b = int(offsets[doc]), int(offsets[doc + 1])
            own = low[a:b]
            if doc in runs[0] or doc in runs[1] or b"akia" in own or any(h in own for h in (*ASSIGN_HINTS, *NAME_HINTS, *ENDPOINT_HINTS)):
                out.append(spans_of(raw[a:b].decode(), own, runs[0].get(doc, []), runs[1].get(doc, []), scope))
            else:
                out.append([])
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``spans`` (kind, start, end in code
    points, end exclusive; by start, then kind).  A null or empty text has no
    spans, a null id stays null, repeated rows are scanned each, and columns
    besides the two named are not read."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = scan_column(batch.column(1), scope)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], kind)], ["doc_id", "spans"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``scan``'s rows."""
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The same rows with every span of ``text`` replaced by ``mark`` (spans
    that overlap or touch by one mark) and ``n_chars``, where there is such a
    column, counted anew.  Texts without spans stay as they are, nulls too."""
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            columns, changed = list(batch.columns), {}
            for i, spans in enumerate(scan_column(batch.column(text_at), scope)):
                if spans:
                    text, out, at = batch.column(text_at)[i].as_py(), [], 0
                    for _, s, e in spans:
                        if s > at or not out:
                            out += [text[at:s], mark]
                        at = max(at, e)
                    changed[i] = "".join([*out, text[at:]])
            if changed:
                rows = np.zeros(batch.num_rows, bool)
                rows[list(changed)] = True
                new = list(changed.values())
                columns[text_at] = pa.compute.replace_with_mask(columns[text_at], pa.array(rows), pa.array(new, columns[text_at].type))
                if chars_at is not None:
                    columns[chars_at] = pa.compute.replace_with_mask(columns[chars_at], pa.array(rows), pa.array([len(x) for x in new], columns[chars_at].type))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def sha(spans) -> str:
    return hashlib.sha256(_joined([x for x in spans if x[0] in ("assign", "access", "hex")]).encode()).hexdigest()
