"""License scans with a generalised suffix automaton of licence words.

The word sequences of all templates form one automaton.  Texts stream through it
word by word, which gives the matching statistics: at each word the longest piece
of any template that ends there.  Pieces that cannot grow further and have
``LEAST`` words or more are chained, in template order and with gaps of at most
``GAP`` words, into spans; a template is found when a span covers ``SHARE`` of its
words, or ``ENOUGH`` of them in long ones.  Base phrases are counted wherever their
words stand consecutively.

Defined results.  Null text counts as empty: no words, no labels, score 0.  Rows
repeat as given, ids may be null, extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, GAP, SHARE, ENOUGH = 3, 4, 0.8, 16

# Base phrases and their labels, then notices of public licences.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
               "You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Words of the UTF-8 form: bytes from 0x80 on are word bytes, so code points are never cut."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Suffix automaton of several word sequences; ``spot`` is one (template, end) of a state's words."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.spot = [-1], [0], [(0, 0)]
        for t, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, (t, at + 1))

    def _state(self, size: int, follow: dict, link: int, spot: tuple[int, int]) -> int:
        for column, value in ((self.size, size), (self.next, follow), (self.link, link), (self.spot, spot)):
            column.append(value)
        return len(self.size) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A copy of ``target`` as long as what ``state`` reaches by ``word``."""
        copy = self._state(self.size[state] + 1, dict(self.next[target]), self.link[target], self.spot[target])
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        self.link[target] = copy
        return copy

    def _extend(self, last: int, word: bytes, spot: tuple[int, int]) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, word, known)
        new = self._state(self.size[last] + 1, {}, 0, spot)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            self.link[new] = target if self.size[target] == self.size[last] + 1 else self._split(last, word, target)
        return new

    def matches(self, sequence: list[bytes], runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """``end, length, state`` of the matching statistics inside the ``runs`` of known words."""
        for lo, hi in runs:
            state = length = 0
            for i in range(lo, hi):
                word = sequence[i]
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.size[state]
                state = self.next[state].get(word, 0)
                length = length + 1 if state else 0
                yield i + 1, length, state


class Scanner:
    def __init__(self):
        self.templates = [(label, words(text)) for label, text in TEMPLATES]
        self.automaton = Automaton([w for _, w in self.templates])
        self.known = {w for _, t in self.templates for w in t}
        self.phrases = {tuple(words(p)): label for p, label in PHRASES.items()}
        self.last = {p[-1]: p for p in self.phrases}
        # All places of a state's words: which templates, ending where.
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.automaton.size]
        for t, (_, sequence) in enumerate(self.templates):
            state = 0
            for at, word in enumerate(sequence):
                state = self.automaton.next[state][word]
                up = state
                while up > 0:
                    self.places[up].append((t, at + 1))
                    up = self.automaton.link[up]

    def base(self, sequence: list[bytes], hot: list[int]) -> list[tuple[int, str]]:
        """Start and label of every base phrase; ``hot`` are the places of known words."""
        found = []
        for phrase, label in self.phrases.items():
            n, first = len(phrase), phrase[0]
            found += [(i, label) for i in hot if sequence[i] == first and tuple(sequence[i : i + n]) == phrase]
        return sorted(found)

    def spans(self, sequence: list[bytes], hot: list[int]) -> list[tuple[int, int, str, float]]:
        """``start, end, label, covered share`` of every chained template."""
        runs: list[tuple[int, int]] = []
        for i in hot:
            if runs and runs[-1][1] == i:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((i, i + 1))
        pieces, held = [], None
        for end, length, state in self.automaton.matches(sequence, [r for r in runs if r[1] - r[0] >= LEAST]):
            if held and (end != held[0] + 1 or length <= held[1]):
                pieces.append(held)
            held = (end, length, state)
        if held:
            pieces.append(held)
        open_chains: dict[int, list] = {}  # template: start, end, template end, covered
        out = []

        def close(t: int) -> None:
            start, end, _, covered = open_chains.pop(t)
            label, template = self.templates[t]
            if covered >= min(math.ceil(SHARE * len(template)), ENOUGH):
                out.append((start, end, label, min(1.0, covered / len(template))))

        for end, length, state in pieces:
            if length < LEAST:
                continue
            for t, at in self.places[state]:
                chain = open_chains.get(t)
                start = end - length
                if chain and start <= chain[1] + GAP and at - length >= chain[2] - GAP and at > chain[2]:
                    # Words that overlap the piece before are not counted again.
                    new = min(length, at - chain[2], end - chain[1])
                    if new > 0:
                        open_chains[t] = [chain[0], end, at, chain[3] + new]
                        continue
                if chain:
                    if start < chain[1] and length <= chain[3]:
                        continue
                    close(t)
                open_chains[t] = [start, end, at, length]
        for t in list(open_chains):
            close(t)
        return sorted(out)

    def scan(self, text: str | None) -> dict:
        sequence = words(text)
        known = self.known
        hot = [i for i, w in enumerate(sequence) if w in known]
        base, spans = self.base(sequence, hot), self.spans(sequence, hot)
        base_labels = {label for _, label in base}
        return {
            "n_words": len(sequence), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {s[2] for s in spans})),
            "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
            "spans": [{"start": a, "end": b, "label": c, "share": d} for a, b, c, d in spans],
        }


def scan(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` (word positions)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
              ("labels", pa.string()), ("score", pa.float64()), ("spans", span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[n] for r in rows], k) for n, k in fields]], ["doc_id", *[n for n, _ in fields]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
             "spans array<struct<start:bigint,end:bigint,label:string,share:double>>")
