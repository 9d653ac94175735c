"""License texts by template markup compiled into token automata.

A template is a sequence of words; ``[[ ... ]]`` marks an optional region (they nest), ``{{a-b}}``
a replaceable one of a to b words.  Everything else is mandatory and has to match exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filecensus.llm import kernel


class Template(NamedTuple):
    label: str
    markup: str
    base: bool = False


#: Fixed phrases and labels of the base, then templates of our own.
TEMPLATES = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "released under [[the]] mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under [[the terms of]] the apache license [[version]] 2 [[0]] [[the license]]"),
    Template("apache-2", "you may not use this file except in compliance with the license [[{{0-12}}]] you may obtain a copy of the license at"),
    Template("gpl-3", "licensed under the [[terms of the]] gnu [[general public license]] [[gpl]] version 3 [[or [[any]] later [[version]]]]"),
    Template("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd-3", "neither the name of {{1-20}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("cc-by-nc", "licensed under [[a]] cc by nc [[{{1-2}} 4 0]] [[4 0]]"),
    Template("cc-by-nc", "creative commons attribution noncommercial [[4 0]] [[international]] license"),
    Template("cc-by", "licensed under [[a]] cc by 4 0"),
]


class Automaton:
    """States with word edges, free moves and any-word moves; state 0 starts, ``final`` accepts."""

    def __init__(self, markup: str):
        self.words: list[dict[int, int]] = [{}]
        self.free: list[list[int]] = [[]]
        self.any: list[list[int]] = [[]]
        parts = re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", markup)
        self.final = self._sequence(parts, 0)
        if parts:
            raise ValueError(f"unbalanced markup: {markup}")

    def _state(self) -> int:
        self.words.append({})
        self.free.append([])
        self.any.append([])
        return len(self.words) - 1

    def _sequence(self, parts: list[str], state: int) -> int:
        while parts:
            part = parts.pop(0)
            if part == "]]":
                parts.insert(0, part)
                return state
            after = self._state()
            if part == "[[":
                inner = self._sequence(parts, state)
                if not parts or parts.pop(0) != "]]":
                    raise ValueError("an optional region does not end")
                self.free[inner].append(after)
                self.free[state].append(after)
            elif part.startswith("{{"):
                least, most = map(int, part.strip("{}").split("-"))
                at = state
                for k in range(most):
                    if k >= least:
                        self.free[at].append(after)
                    self.any[at].append(step := self._state())
                    at = step
                self.free[at].append(after)
            else:
                self.words[state][word_key(part)] = after
            state = after
        return state

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def openings(self) -> set[int]:
        """Words a match can start with; a template must not start with a replaceable region."""
        start = self.closure({0})
        if any(self.any[s] for s in start) or self.final in start:
            raise ValueError("a template has to start with a word")
        return {w for s in start for w in self.words[s]}

    def match(self, tokens: list[int], at: int, end: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        states, best = self.closure({0}), -1
        for i in range(at, end):
            token, reached = tokens[i], set()
            for s in states:
                if token in self.words[s]:
                    reached.add(self.words[s][token])
                reached.update(self.any[s])
            if not reached:
                break
            states = self.closure(reached)
            if self.final in states:
                best = i + 1
        return best


def word_key(word: str) -> int:
    data = np.frombuffer(word.lower().encode(), np.uint8)
    return int(kernel.slice_hash(kernel.prefix_sums(data), np.array([0]), np.array([len(data)]))[0])


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, found) of every row of ``docs`` (doc_id, text).

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered.  found has a row
    (label, base, start, end) in words for the longest match of each template at each place.  A null
    or empty text has no words and nothing found.  The templates are a fixed list, so their automata
    travel with the function.
    """
    machines = [(t, Automaton(t.markup)) for t in templates]
    starters: dict[int, list[int]] = {}
    for k, (_, machine) in enumerate(machines):
        for w in machine.openings():
            starters.setdefault(w, []).append(k)
    openings = np.sort(np.array(list(starters), dtype=np.uint64))
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found_by_row = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for block in kernel.blocks(batch.column(1)):
                found = kernel.words(block, kernel.ALNUM)
                hashes = kernel.word_hashes(block, found)
                counts[block.first : block.first + block.rows] = np.diff(found.bounds)
                nearest = openings[np.minimum(np.searchsorted(openings, hashes), len(openings) - 1)]
                places = np.flatnonzero(nearest == hashes)
                rows = np.searchsorted(found.bounds, places, side="right") - 1
                tokens = hashes.tolist() if len(places) else []
                for at, row in zip(places.tolist(), rows.tolist(), strict=True):
                    low, high = int(found.bounds[row]), int(found.bounds[row + 1])
                    for k in starters[tokens[at]]:
                        template, machine = machines[k]
                        end = machine.match(tokens, at, high)
                        if end > 0:
                            found_by_row[block.first + row].append(
                                {"label": template.label, "base": template.base, "start": at - low, "end": end - low}
                            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(found_by_row, kind)], names=["doc_id", "n_words", "found"]
            )

    own = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        matches, f"doc_id {own}, n_words long, found array<struct<label:string,base:boolean,start:long,end:long>>"
    )
