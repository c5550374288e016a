"""Operator 9: license scans by template-markup matching.

Templates are license wordings with markup: ``<<beginOptional>> ... <<endOptional>>`` may be
absent, ``<<var;words=n>>`` stands for up to n words. Each is compiled into an automaton over
word hashes; it is run from the places where its first word stands, and accepts where all
mandatory words follow exactly. Base phrases are looked up in the same hashes.
"""

from __future__ import annotations

import pkgutil
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import mapped, slices
from .words import NON_ALNUM, Words, hash_words

#: Phrases that give a base label wherever their words stand consecutively (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Labels of the files in ``license_texts``: whole license texts, from the first to the last binding words, and standard notices.
WHOLE = ["apache-2.0-full", "bsd-2-clause-full", "bsd-3-clause-full", "gpl-2.0-full", "gpl-3.0-full", "isc-full", "lgpl-2.1-full", "lgpl-3.0-full", "mit-full", "mpl-2.0-full"]
NOTICES = ["agpl-3.0-notice", "apache-2.0-notice", "gpl-2.0-notice", "gpl-3.0-notice", "lgpl-2.1-notice", "lgpl-3.0-notice", "mpl-2.0-notice"]

#: Templates by label, every one beginning with a mandatory word. The six written here are first sentences only, so
#: their labels say that a license is named or begun, not that its text follows.
TEMPLATES = {
    "apache-2.0": "Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>Version<<endOptional>> 2.0",
    "cc-by-nc-4.0": "Licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0 <<beginOptional>>International License<<endOptional>>",
    "gpl-3.0": "Licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "mit-notice": "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit-text": "Permission is hereby granted free of charge to any person obtaining a copy of <<var;words=8>> and associated documentation files <<beginOptional>>the Software<<endOptional>> to deal in the Software without restriction",
    "bsd-text": "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
} | {label: pkgutil.get_data(__package__, f"license_texts/{label}.txt").decode() for label in WHOLE + NOTICES}

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))))


def parse(template: str) -> list[tuple]:
    """Nodes ("word", w), ("optional", nodes), ("var", n) of a template."""
    out: list[list] = [[]]
    for piece in re.split(r"(<<[^>]*>>)", template):
        if piece == "<<beginOptional>>":
            out.append([])
        elif piece == "<<endOptional>>":
            inner = out.pop()
            out[-1].append(("optional", inner))
        elif m := re.fullmatch(r"<<var;words=(\d+)>>", piece):
            out[-1].append(("var", int(m[1])))
        elif piece.startswith("<<"):
            raise ValueError(f"unknown markup {piece}")
        else:
            out[-1] += [("word", w) for w in words_of(piece)]
    if len(out) != 1 or not out[0] or out[0][0][0] != "word":
        raise ValueError("a template begins with a mandatory word and closes its optional regions")
    return out[0]


def pattern(nodes: list[tuple]) -> str:
    """The template as a regular expression over words each followed by one space."""
    kinds = {"word": lambda w: w.decode() + " ", "optional": lambda inner: f"(?:{pattern(inner)})?", "var": lambda n: f"(?:[^ ]+ ){{0,{n}}}"}
    return "".join(kinds[kind](value) for kind, value in nodes)


class Automaton:
    """States 0 .. final; ``steps[s]`` maps a word hash to the next state, ``free[s]`` takes any word, ``empty[s]`` none."""

    def __init__(self, template: str):
        self.steps: list[dict[int, int]] = [{}]
        self.free: list[int | None] = [None]
        self.empty: list[list[int]] = [[]]
        nodes = parse(template)
        words = words_of(re.sub(r"<<[^>]*>>", " ", template))
        self.hash_of = dict(zip(words, hash_words(words).tolist(), strict=True))
        self.first = np.uint64(self.hash_of[nodes[0][1]])
        self.final = self._add(nodes, 0)

    def _new(self) -> int:
        self.steps.append({})
        self.free.append(None)
        self.empty.append([])
        return len(self.steps) - 1

    def _add(self, nodes: list[tuple], at: int) -> int:
        for kind, value in nodes:
            if kind == "word":
                to = self._new()
                self.steps[at][self.hash_of[value]] = to
                at = to
            elif kind == "optional":
                begin, end = self._new(), None
                self.empty[at].append(begin)
                end = self._add(value, begin)
                to = self._new()
                self.empty[end].append(to)
                self.empty[at].append(to)
                at = to
            else:
                chain = [at]
                for _ in range(value):
                    to = self._new()
                    self.free[chain[-1]] = to
                    chain.append(to)
                to = self._new()
                for s in chain:
                    self.empty[s].append(to)
                at = to
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, h: np.ndarray) -> bool:
        """Whether a prefix of the words is the template."""
        states = self._closed({0})
        for lo in range(0, len(h), 64):
            for word in h[lo : lo + 64].tolist():
                if self.final in states:
                    return True
                moved = {self.steps[s][word] for s in states if word in self.steps[s]} | {self.free[s] for s in states if self.free[s] is not None}
                if not moved:
                    return False
                states = self._closed(moved)
        return self.final in states


@cache
def _automaton(template: str) -> Automaton:
    return Automaton(template)


def _scan(phrases: dict[str, str], templates: dict[str, str]):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches):
        wanted = [(hash_words(words_of(p)), label) for p, label in phrases.items()]
        automata = [(_automaton(t), label) for label, t in templates.items()]
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                own = Words(data, offs, NON_ALNUM)
                h, first, n = own.h, own.first, hi - lo
                row = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
                count, low, high = np.zeros(n, np.int64), np.full(n, len(h)), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                for words, label in wanted:
                    k = len(words)
                    at = np.flatnonzero(h[: max(0, len(h) - k + 1)] == words[0])
                    for i in range(1, k):
                        at = at[h[at + i] == words[i]]
                    at = at[row[at] == row[at + k - 1]] if len(at) else at
                    own = row[at]
                    np.add.at(count, own, 1)
                    np.minimum.at(low, own, at - first[own])
                    np.maximum.at(high, own, at - first[own])
                    for i in np.unique(own):
                        base[i].add(label)
                found = [set(b) for b in base]
                matched = np.zeros(n, bool)
                for automaton, label in automata:
                    for at in np.flatnonzero(h == automaton.first):
                        i = row[at]
                        if label not in found[i] and automaton.accepts(h[at : first[i + 1]]):
                            found[i].add(label)
                            matched[i] = True
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n), pa.array(np.diff(first).astype(np.int64)), pa.array(count), pa.array(low.astype(np.int64), mask=none), pa.array(high.astype(np.int64), mask=none),
                        pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(f)) for f in found]), pa.array(np.where(matched, 1.0, np.where(none, 0.0, 0.5))),
                    ],
                    schema=schema,
                )

    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Return one row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case; null and empty texts
    have none. n_base counts all places of all phrases, first_word and last_word are the
    smallest and largest of their starts (null without one). labels adds to the base ones
    those of accepted templates; score is 1 with an accepted template, 0.5 with base
    phrases only, else 0. Repeated rows repeat; an empty table gives none; extra columns are ignored. Of a
    long text only the hashes of its words are held.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return mapped(docs, _scan(phrases or PHRASES, templates or TEMPLATES), fields)
