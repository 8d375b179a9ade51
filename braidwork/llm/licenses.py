"""License scans by conditional compression.

Candidate blocks are runs of lines that speak of licensing. Each is compressed alone and with each
template as zstandard raw dictionary; the share of bytes that a template saves ranks the templates.
The best few are then compared word by word: the block is aligned with the best span of the whole
template and grows over neighbouring lines as long as they go on with its wording, so wrapped notices
stay together and parts count. The first template whose wording differs little is confirmed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from importlib.resources import files

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches

# Public licence notices and the short forms in which texts name the licences.
TEMPLATES = {
    "Artistic-1.0": "Released under the Artistic License.\nThis library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.\nThis work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.\nThis work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.\nThis work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "Released under CC0 1.0 Universal.\nTo the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.\nThis program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Released under the ISC License.\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.\nThis library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MPL-1.1": "Licensed under the Mozilla Public License, version 1.1.\nThe contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.\nThis Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
# The whole texts, but those of Creative Commons, which have their notices alone.
TEXTS = {x.name.removesuffix(".txt"): x.read_text() for x in files(__package__).joinpath("license_texts").iterdir() if x.name.endswith(".txt")}
SPEAKS = r"(?i)licen[sc]e|copyright|spdx-|creative commons|public domain|permission is hereby|redistribut|warrant(y|ies)"
_SPEAKS = re.compile(SPEAKS)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-z])")
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
FIELDS = "block int, first_line int, last_line int, license string, saved double, words_added int, words_missing int, confirmed boolean, text string"


def sentences(text: str) -> list[tuple[int, str]]:
    """Line and text of each sentence, or part of one in a line."""
    return [(k, part) for k, line in enumerate(text.split("\n")) for part in _SENTENCE.split(line)]


def blocks(parts: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    """Runs of sentences that speak of licensing: the first, and the one after the last."""
    first = None
    for k, (_, part) in enumerate([*parts, (0, "")]):
        if _SPEAKS.search(part):
            first = k if first is None else first
        elif first is not None:
            yield first, k
            first = None


def fitted(words: np.ndarray, text: np.ndarray, anchored: bool = False) -> tuple[int, int, int, int]:
    """The span of text (its beginning, if anchored) nearest to words: words added, words missing, first, end."""
    n, m = len(text), len(words)
    step = n + 1  # a value is differences * step + n - first
    ramp = np.arange(n + 1) * step
    row = ramp + n if anchored else n - np.arange(n + 1)
    for w in words:
        turn = row + step
        turn[1:] = np.where(text == w, np.minimum(turn[1:], row[:-1]), turn[1:])
        row = np.minimum.accumulate(turn - ramp) + ramp
    end = int(row.argmin())
    apart, first = int(row[end] // step), n - int(row[end] % step)
    return (apart + m - end + first) // 2, (apart - m + end - first) // 2, first, end


class Scanner:
    """Compressors for each template, made once a task."""

    def __init__(self, templates: dict[str, str], texts: dict[str, str], level: int = 9):
        self.names, self.alone = sorted(templates), zstandard.ZstdCompressor(level=level)
        self.lines = {k: [_WORD.findall(x.lower()) for x in templates[k].split("\n")] for k in self.names}
        whole = {k: f"{templates[k]}\n{texts.get(k, '')}" for k in self.names}
        made = lambda text: zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = {k: zstandard.ZstdCompressor(level=level, dict_data=made(whole[k])) for k in self.names}
        self.number: dict[str, int] = {}
        for text in whole.values():
            for x in _WORD.findall(text.lower()):
                self.number.setdefault(x, len(self.number))
        self.words = {k: self.numbers(whole[k]) for k in self.names}
        self.known: dict[str, list] = {}

    def numbers(self, text: str) -> np.ndarray:
        return np.array([self.number.get(x, -1) for x in _WORD.findall(text.lower())], np.int64)

    def ranked(self, block: str, tries: int) -> list[tuple]:
        """The templates that save most: name, share, differences to the nearest line, nearest span."""
        if block not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            raw, words, mine = block.encode(), _WORD.findall(block.lower()), self.numbers(block)
            plain = len(self.alone.compress(raw))
            saved = sorted(((1 - len(self.given[k].compress(raw)) / plain, k) for k in self.names), key=lambda x: (-x[0], x[1]))
            self.known[block] = [(k, share, min((_differences(words, line) for line in self.lines[k]), key=sum), fitted(mine, self.words[k])) for share, k in saved[:tries]]
        return self.known[block]

    def grown(self, parts: list[tuple[int, str]], first: int, end: int, least: int, name: str, span: tuple[int, int]) -> tuple[int, int]:
        """The run of parts around [first, end), from least on, that goes on with the template before and after span."""
        text, (low, high), k = self.words[name], span, end
        while k < len(parts):
            mine = self.numbers(parts[k][1])
            added, missing, _, used = fitted(mine, text[high : high + 2 * len(mine) + 8], anchored=True)
            if 2 * (added + missing) > len(mine):
                break
            k, high, end = k + 1, high + used, k + 1 if len(mine) else end
        k = first
        while k > least:
            mine = self.numbers(parts[k - 1][1])
            added, missing, _, used = fitted(mine[::-1], text[max(0, low - 2 * len(mine) - 8) : low][::-1], anchored=True)
            if 2 * (added + missing) > len(mine):
                break
            k, low, first = k - 1, low - used, k - 1 if len(mine) else first
        return first, end

    def scan(self, text: str, tries: int, differ: float, least_words: int) -> Iterator[tuple]:
        """Each block: first line, last line, the confirmed template or else the one that saves most, share saved,
        words added and missing, confirmed, text."""
        parts, done, sure, out = sentences(text), 0, 0, []
        told = lambda a, b: "\n".join(x for _, x in parts[a:b])
        for a, b in blocks(parts):
            a = max(a, done)
            if a >= b:
                continue
            block, best = told(a, b), None
            size = len(_WORD.findall(block))
            for name, share, (added, missing), (more, less, *span) in self.ranked(block, tries):
                first, end = self.grown(parts, a, b, sure, name, span)
                whole, n = told(first, end), size
                if (first, end) != (a, b):
                    mine = self.numbers(whole)
                    n, (more, less, *_) = len(mine), fitted(mine, self.words[name])
                if n >= least_words and more + less <= differ * n:
                    found = (first, end, name, share, more, less, True, whole)
                else:
                    found = (a, b, name, share, added, missing, added + missing <= differ * max(1, size), block)
                best = best or found
                if found[-2]:
                    best = found
                    break
            done = best[1]
            if best[-2]:
                sure = done
                while out and out[-1][1] > best[0]:  # blocks before it that weren't confirmed alone
                    out.pop()
            out.append(best)
        for first, end, *found in out:
            yield (parts[first][0], parts[end - 1][0], *found)


def _differences(words: list[str], line: list[str]) -> tuple[int, int]:
    same = sum(m.size for m in SequenceMatcher(None, words, line, autojunk=False).get_matching_blocks())
    return len(words) - same, len(line) - same


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, texts: dict[str, str] | None = None, tries: int = 3, differ: float = 0.1, least_words: int = 8) -> DataFrame:
    """A row for each candidate block of docs (doc_id, text): doc_id and FIELDS.

    templates: notices and short forms of each licence, one a line; texts: whole texts. confirmed: words
    added to and missing from a line of templates, or for blocks of ``least_words`` and more from a span
    of templates and texts, are at most ``differ`` of the block's words. Null and blank texts, and texts that don't
    speak of licensing, have no rows; rows that repeat a doc_id, or have none, are scanned each, whole. Of templates
    that save as much, the first by name counts. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    known, whole = dict(templates or TEMPLATES), dict(texts if texts is not None else {} if templates else TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, whole)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, k, *found) for k, found in enumerate(scanner.scan(text, tries, differ, least_words))]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", *(x.split()[0] for x in FIELDS.split(", "))])

    speaking = docs.where(F.col("text").rlike(SPEAKS)).select(F.col("doc_id").cast("long"), "text")
    return speaking.mapInArrow(run, f"doc_id long, {FIELDS}")
