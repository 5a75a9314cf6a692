"""License scans by an exact set-similarity join against templates.

A text block is a window of as many words as a template has.  The join finds
every block that contains at least ``threshold`` of the template's distinct
words: words are ordered by their frequency over all documents, rarest first;
by the prefix filter a match must hold one of the template's first
m - ceil(threshold * m) + 1 words, so only windows around such places are
looked at; the length filter asks for enough template words near the place;
the positional filter moves the window over the places of template words only.
Containment is then counted exactly.  From the left, the first window that
reaches the threshold and those that overlap it give one block, the window of
most distinct template words (the first of equals); the next block starts after
it.  So blocks do not overlap, copies in a row count each, and every window
that reaches the threshold overlaps a reported block.

Short templates share most words with other notices.  A block must therefore
hold a template's telling words, and none of the words that name another
licence: a rule on top of the similarity, and part of the join's definition.

The base rules (phrases of consecutive words) stand beside it.
"""

from __future__ import annotations

import math
import re
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm._bytes import ALNUM, Words, hash_words, text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Public licence notices: label, text, telling words, words that rule it out.
TEMPLATES = (
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public", "lesser affero library"),
    ("gpl-line", "This work is licensed under the GNU General Public License, version 3.", "gnu general public", "lesser affero library"),
    ("lgpl-line", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public", "affero"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache", ""),
    ("apache-line", "Licensed under the Apache License, Version 2.0.", "apache", ""),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "permission granted restriction", ""),
    ("mit-line", "Released under the MIT License.", "mit license", ""),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary forms", ""),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution", "sharealike share alike noncommercial non noderivatives noderivs"),
    ("cc-by-nc-line", "Licensed under CC BY-NC 4.0.", "cc by nc", "nd sa"),
)
THRESHOLD = 0.8


def split_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]


class Templates:
    """Templates and phrases as word numbers; number -1 is any other word."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.phrases = [(split_words(p), label) for p, label in phrases]
        self.templates = [(x[0], *(split_words(y) for y in (*x[1:], "", "")[:3])) for x in templates]
        self.vocabulary = sorted({w for ws, _ in self.phrases for w in ws} | {w for x in self.templates for ws in x[1:] for w in ws})
        hashes = hash_words(self.vocabulary)
        order = np.argsort(hashes)
        self.keys, self.numbers = hashes[order], order
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        self.phrase_ids = [(np.array([self.number[w] for w in ws]), label) for ws, label in self.phrases]
        ids = lambda ws: np.array(sorted({self.number[w] for w in ws}), np.int64)
        self.sets = [(label, len(ws), ids(ws), ids(telling), ids(barred)) for label, ws, telling, barred in self.templates]

    def numbered(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of the words that are in the vocabulary, by hash
        and length."""
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        places = np.flatnonzero(self.keys[at] == h)
        numbers = self.numbers[at[places]]
        size = words.end[places] - words.start[places]
        same = size == np.array([len(w.encode()) for w in self.vocabulary])[numbers]
        return places[same], numbers[same]

    def plan(self, counts: np.ndarray, threshold: float):
        """The rules of each template, with words ordered by ``counts``, rarest
        first."""
        out = []
        for label, window, members, telling, barred in self.sets:
            ranked = members[np.lexsort((members, counts[members]))]
            need = math.ceil(threshold * len(members) - 1e-9)
            masks = []
            for some in (ranked[: len(members) - need + 1], members, telling, barred):
                masks.append(np.zeros(len(self.vocabulary), bool))
                masks[-1][some] = True
            out.append(Rule(label, window, len(members), need, len(telling), *masks))
        return out


class Rule(NamedTuple):
    """``prefix``, ``held``, ``telling`` and ``barred`` are masks over the
    vocabulary; ``told`` is the number of telling words."""

    label: str
    window: int
    size: int
    need: int
    told: int
    prefix: np.ndarray
    held: np.ndarray
    telling: np.ndarray
    barred: np.ndarray


def _count(templates: Templates):
    def run(batches):
        total = np.zeros(len(templates.vocabulary), np.int64)
        for batch in batches:
            for _, buf, offsets in text_slices(batch.column(0)):
                _, numbers = templates.numbered(Words(buf, offsets, ALNUM, True))
                total += np.bincount(numbers, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["number", "n"])

    return run


def blocks_of(places: np.ndarray, numbers: np.ndarray, rule: Rule) -> list[tuple[int, int, int]]:
    """(first word, last word, most distinct template words in a window) of
    every block.  ``places`` ascend within one document."""
    mine = rule.held[numbers]
    at, who = places[mine], numbers[mine]
    if len(at) < rule.need:  # length filter
        return []
    reach = np.searchsorted(at, at + rule.window)  # exclusive end of the window that starts at each place
    rare = np.concatenate([[0], np.cumsum(rule.prefix[who])])
    bad = places[rule.barred[numbers]]
    free = np.searchsorted(bad, at) == np.searchsorted(bad, at + rule.window)
    starts = np.flatnonzero((reach - np.arange(len(at)) >= rule.need) & (rare[reach] > rare[:-1]) & free)
    found, counts, told, left, right = [], {}, 0, 0, 0
    at_list, who_list, tells = at.tolist(), who.tolist(), rule.telling[who].tolist()
    for s in starts.tolist():  # positional filter: windows start at a template word
        if s >= right:
            counts, told, left, right = {}, 0, s, s
        for k in range(right, int(reach[s])):
            counts[who_list[k]] = counts.get(who_list[k], 0) + 1
            told += tells[k] and counts[who_list[k]] == 1
        right = int(reach[s])
        for k in range(left, s):
            counts[who_list[k]] -= 1
            if not counts[who_list[k]]:
                del counts[who_list[k]]
                told -= tells[k]
        left = s
        if len(counts) >= rule.need and told == rule.told:
            found.append((at_list[s], at_list[right - 1], len(counts)))
    return disjoint(found)


def disjoint(windows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Windows (first, last, n) by first -> the blocks among them."""
    out, k = [], 0
    while k < len(windows):
        best, j = windows[k], k
        while j < len(windows) and windows[j][0] <= windows[k][1]:
            best = windows[j] if windows[j][2] > best[2] else best
            j += 1
        out.append(best)
        while k < len(windows) and windows[k][0] <= best[1]:
            k += 1
    return out


def _scan(templates: Templates, plan):

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("n_words", "n_base", "first", "last", "base", "labels", "score", "matches")}
            for _, buf, offsets in text_slices(batch.column(1)):
                words = Words(buf, offsets, ALNUM, True)
                places, numbers = templates.numbered(words)
                bounds = np.searchsorted(places, words.first)
                hits: dict[int, list[tuple[int, str]]] = {}
                for ids, label in templates.phrase_ids:
                    n = len(ids)
                    if len(places) < n:
                        continue
                    ok = np.ones(len(places) - n + 1, bool)
                    for j in range(n):
                        ok &= (numbers[j : len(ok) + j] == ids[j]) & (places[j : len(ok) + j] == places[: len(ok)] + j)
                    for i in np.flatnonzero(ok).tolist():
                        doc = int(np.searchsorted(words.first, places[i], "right")) - 1
                        if places[i] + n <= words.first[doc + 1]:
                            hits.setdefault(doc, []).append((int(places[i] - words.first[doc]), label))
                for doc in range(words.docs):
                    a, b = bounds[doc], bounds[doc + 1]
                    found, score = [], 0.0
                    if b > a:
                        own, who = places[a:b] - words.first[doc], numbers[a:b]
                        for rule in plan:
                            for first, last, n in blocks_of(own, who, rule):
                                found.append({"template": rule.label, "first_word": first, "last_word": last, "containment": n / rule.size})
                                score = max(score, n / rule.size)
                    base = hits.get(doc, [])
                    rows["n_words"].append(int(words.count[doc]))
                    rows["n_base"].append(len(base))
                    rows["first"].append(min((p for p, _ in base), default=None))
                    rows["last"].append(max((p for p, _ in base), default=None))
                    rows["base"].append(",".join(sorted({x for _, x in base})))
                    rows["labels"].append(",".join(sorted({x for _, x in base} | {m["template"] for m in found})))
                    rows["score"].append(1.0 if base else score)
                    rows["matches"].append(found)
            kind = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(rows[k], pa.int64()) for k in ("n_words", "n_base", "first", "last")], pa.array(rows["base"], pa.string()), pa.array(rows["labels"], pa.string()), pa.array(rows["score"], pa.float64()), pa.array(rows["matches"], kind)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    return run


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: word count, base phrases and ``matches``, every
    block (first and last word, best containment of a window in it) of every
    template.  A null or empty
    text has no words, no labels and score 0; with base phrases the score is
    1, else the best containment.  Null ids
    stay null, repeated rows are scanned each; only the two named columns are
    read."""
    known = Templates(templates, phrases)
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # one number for each of the templates' words, whatever the corpus
    counted = picked.select("text").mapInArrow(_count(known), "number int, n bigint").groupBy("number").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(known.vocabulary), np.int64)
    for r in counted:
        counts[r["number"]] = r["n"]
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<template:string,first_word:bigint,last_word:bigint,containment:double>>"
    return picked.mapInArrow(_scan(known, known.plan(counts, threshold)), schema)
