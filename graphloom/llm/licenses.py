"""License scans: units of a text against licence templates by the Dice coefficient of word bigrams.

Units are every line, every block between blank lines, and the whole text.  Notices among
other words are found as passages: windows of the whole text's words that begin and end with a
word pair of the template and span at most as many pairs as its sizes allow; windows of one
template that share a word are one passage, of which the best is reported.  Text is
normalised to lower-case runs of letters and digits.  A unit of n distinct bigrams
can reach the threshold t only with templates of n * t / (2 - t) to
n * (2 - t) / t bigrams, so others aren't compared; units without any word
pair of a template aren't either.

Defined cases: null and empty texts match nothing; a unit with one word has no bigram
and matches nothing; ties go to the template's name in order; equal units count as
often as they occur; rows with a null doc_id take no part; repeated rows are scanned
alike; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches

# Short notices and the opening paragraphs of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")
BLANK_LINES = re.compile(r"\n[^\S\n]*\n\s*")


def bigrams(text: str) -> set[tuple[str, str]]:
    words = WORD.findall(text.lower())
    return set(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.templates = sorted(((len(b), name, b) for name, text in templates.items() if (b := bigrams(text))), key=lambda t: t[:2])
        self.sizes = [t[0] for t in self.templates]
        self.words = {w for _, _, b in self.templates for pair in b for w in pair}
        most = max(self.sizes, default=0)
        self.most = most * (2 - threshold) / threshold
        self.pairs = defaultdict(list)
        for number, (_, _, b) in enumerate(self.templates):
            for pair in b:
                self.pairs[pair].append(number)

    def match(self, unit: str) -> tuple[str, float] | None:
        """The best template of one unit, if it reaches the threshold."""
        own = bigrams(unit)
        if not own or len(own) > self.most or self.pairs.keys().isdisjoint(own):
            return None
        t, best = self.threshold, None
        low = bisect.bisect_left(self.sizes, len(own) * t / (2 - t) - 1e-9)
        for size, name, other in self.templates[low:]:
            if size > len(own) * (2 - t) / t + 1e-9:
                break
            dice = 2 * len(own & other) / (len(own) + size)
            if dice >= t and (best is None or (-dice, name) < (-best[1], best[0])):
                best = (name, dice)
        return best

    def units(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of lines, blocks of several lines, and the whole text."""
        found, start = set(), 0
        for line in text.split("\n"):
            found.add((start, start + len(line)))
            start += len(line) + 1
        start = 0
        for gap in BLANK_LINES.finditer(text):
            found.add((start, gap.start()))
            start = gap.end()
        return sorted(found | {(start, len(text)), (0, len(text))})

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, dice, start, end) of the units that match."""
        # a unit that reaches the threshold shares pairs, so words, with a template
        out = []
        for start, end in self.units(text):
            unit = text[start:end]
            if self.words.isdisjoint(WORD.findall(unit.lower())):
                continue
            best = self.match(unit)
            if best:
                out.append((*best, start, end))
        return out


    def windows(self, pairs: list[tuple[str, str]]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Per template its windows (first pair, last pair, dice) that reach the threshold, by first pair."""
        places = defaultdict(list)
        for i, pair in enumerate(pairs):
            if pair in self.pairs:
                for number in self.pairs[pair]:
                    places[number].append(i)
        t = self.threshold
        for number, at in places.items():
            size, _, own = self.templates[number]
            # a window needs so many pairs of the template, and has at most so many in all
            need, most = math.ceil(size * t / (2 - t) - 1e-9), math.floor(size * (2 - t) / t + 1e-9)
            found = []
            for low in range(len(at) - need + 1):
                if at[low + need - 1] - at[low] >= most:
                    continue
                seen, both, upto = set(), 0, at[low]
                for last in at[low : low + most]:
                    if last - at[low] >= most:
                        break
                    for pair in pairs[upto : last + 1]:
                        if pair not in seen:
                            seen.add(pair)
                            both += pair in own
                    upto = last + 1
                    dice = 2 * both / (len(seen) + size)
                    if dice >= t:
                        found.append((at[low], last, dice))
            if found:
                yield number, found

    def passages(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, dice, start, end) of the best window of each passage: the highest dice, then the first, then the shortest."""
        lowered = text.lower()
        if len(lowered) != len(text):
            lowered = "".join(low if len(low := c.lower()) == 1 else c for c in text)
        words = WORD.findall(lowered)
        best = []
        for number, found in self.windows(list(zip(words, words[1:], strict=False))):
            upto = None
            for first, last, dice in found:
                if upto is None or first > upto + 1:
                    best.append((number, first, last, dice))
                elif dice > best[-1][3]:
                    best[-1] = (number, first, last, dice)
                upto = last if upto is None else max(upto, last)
        if not best:
            return []
        spans = [m.span() for m in WORD.finditer(lowered)]
        return sorted((self.templates[number][1], dice, spans[first][0], spans[last + 1][1]) for number, first, last, dice in best)


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, matches and passages (license, dice, start, end in code points) of every document."""
    bounded_batches(docs)
    templates = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        scanner = Scanner(templates, threshold)
        for batch in batches:
            named = lambda found: [dict(zip(("license", "dice", "start", "end"), m, strict=True)) for m in found]
            rows, inside = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                rows.append(named(scanner.scan(text)))
                inside.append(named(scanner.passages(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array(inside, kind)], ["doc_id", "matches", "passages"])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text").filter("doc_id is not null")
    span = "array<struct<license:string,dice:double,start:int,end:int>>"
    return docs.mapInArrow(run, f"doc_id long, matches {span}, passages {span}")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches (units), n_passages, licenses (distinct, sorted), best_license and best_dice of every document."""
    found = license_spans(docs, templates, threshold)
    found = found.withColumn("all", F.concat("matches", "passages"))
    best = F.try_element_at(F.array_sort(F.transform("all", lambda m: F.struct((-m["dice"]).alias("less"), m["license"].alias("license")))), F.lit(1))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.size("passages").cast("long").alias("n_passages"),
        F.array_join(F.array_sort(F.array_distinct(F.col("all.license"))), ",").alias("licenses"),
        best["license"].alias("best_license"),
        (-best["less"]).alias("best_dice"),
    )
