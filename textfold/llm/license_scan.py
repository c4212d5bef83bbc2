"""License scans by conditional compression.

A window of words around each licence cue, over line ends, is compared with every template that has enough of its
words in it: the run of words around the cue that differs least from the notice, words missing and words too many
counted, is a match if these are at most ``MOST_DIFFERENT`` of the notice's words. A matched run is compressed alone and
with its template as a zstandard raw dictionary, which gives the share of bytes the template saves. Of overlapping matches
the one with the fewest differing words stays; ties go to the one that saves more bytes, then to the template's name.

Defined results: null and empty texts have no windows; a notice without a cue word is no candidate; equal windows of a
task are compared once (a bounded memory); repeated rows give repeated results; further columns are ignored;
an empty table gives no rows. A line is never cut, and a notice may be wrapped over lines and comment marks.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import small_batches

# Notices of public licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met.", "Licensed under the BSD 3-Clause License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.",
                "Released under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Proprietary": ["All rights reserved."],
}
CUES = (r"(?i)licen[sc]|copyright|\bCC(?:0|\W+BY)|public\W+domain|redistribut|hereby\W+granted|rights\W+reserved"
        r"|free\W+software")
MOST_DIFFERENT = 0.25
MEMO_ENTRIES = 100_000
WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][0-9A-Za-z]+)*")


def nearest(notice: list[str], words: list[str], first: int, last: int):
    """(differing words, size, start) of the run of words, over some of ``first`` to ``last``, that differs least from the notice; ties
    go to the shorter run, then to the earlier one."""
    # row by row of the notice: the least difference of its words so far to a run that ends here, and where that begins
    least, begin = [0] * (len(words) + 1), list(range(len(words) + 1))
    for i, x in enumerate(notice, 1):
        now, since = [i], [0]
        for j, w in enumerate(words):
            best = (now[j] + 1, -since[j])  # a word too many
            if least[j + 1] + 1 < best[0] or least[j + 1] + 1 == best[0] and -begin[j + 1] < best[1]:  # one missing
                best = (least[j + 1] + 1, -begin[j + 1])
            if x == w and (least[j], -begin[j]) <= best:
                best = (least[j], -begin[j])
            now.append(best[0])
            since.append(-best[1])
        least, begin = now, since
    return min(((d, e - a, a) for e, (d, a) in enumerate(zip(least, begin)) if a <= last and first < e), default=None)


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        self.notices = [(name, WORD.findall(t.lower())) for name in sorted(templates) for t in templates[name]]
        self.counts = [Counter(w) for _, w in self.notices]
        longest = max(len(w) for _, w in self.notices)
        self.reach = longest + int(MOST_DIFFERENT * longest)  # words of a match before or after its cue, at most
        level = {"level": 9, "write_content_size": False}
        self.plain = zstandard.ZstdCompressor(**level)
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(
            " ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **level) for _, w in self.notices]
        self.cue = re.compile(CUES)
        self.memo: dict[bytes, list[tuple]] = {}

    def windows(self, text: str):
        """(words, first, last) of each cue: the words around it as matches, and the first and last of its own."""
        for hit in self.cue.finditer(text):
            far = 16 * self.reach
            while True:  # words before the cue, whole ones only
                at = max(0, hit.start() - far)
                words, after = [], 0
                for w in WORD.finditer(text, at):
                    words.append(w)
                    after += w.start() >= hit.end()
                    if after == self.reach:
                        break
                if at:
                    del words[:1]
                first = sum(w.end() <= hit.start() for w in words)
                if first >= self.reach or not at:
                    break
                far *= 2
            words = words[max(0, first - self.reach):]
            first = min(first, self.reach)
            last = max(i for i, w in enumerate(words) if w.start() < hit.end())
            yield words, first, last

    def matches(self, words: tuple[str, ...], first: int, last: int) -> list[tuple]:
        """(differing words, bytes saved, notice, start, end, saved share) of the notices around the cue."""
        key = hashlib.blake2b(" ".join((*words, str(first), str(last))).encode(), digest_size=16).digest()
        if key in self.memo:
            return self.memo[key]
        have, found = Counter(words), []
        for i, (_, notice) in enumerate(self.notices):
            most = int(MOST_DIFFERENT * len(notice))
            if sum(w not in have for w in notice) > most or (self.counts[i] - have).total() > most:
                continue
            near = nearest(notice, words, first, last)
            if near and near[0] <= most:
                different, size, a = near
                raw = " ".join(words[a:a + size]).encode()
                alone = len(self.plain.compress(raw))
                saved = alone - len(self.given[i].compress(raw))
                found.append((different, saved, i, a, a + size, saved / alone))
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo = {}
        self.memo[key] = found
        return found

    def licences(self, text: str) -> list[tuple]:
        """The notices in a text: (offset, licence, saved, different, words)."""
        found = {}
        for words, first, last in self.windows(text):
            for different, saved, i, a, b, share in self.matches(tuple(w[0].lower() for w in words), first, last):
                name, notice = self.notices[i]
                found[words[a].start(), words[b - 1].end(), i] = (different, -saved, name, share, len(notice))
        kept: list[tuple] = []  # without overlaps, in order
        for (a, b, _), (different, _, name, share, size) in sorted(found.items(), key=lambda x: (x[1][:3], x[0])):
            at = bisect.bisect(kept, (a,))
            if (at == len(kept) or kept[at][0] >= b) and (at == 0 or kept[at - 1][1] <= a):
                kept.insert(at, (a, b, name, share, different, size))
        return [(a, *rest) for a, _, *rest in kept]


def _scan(templates: dict[str, list[str]]):
    names = ["doc_id", "at", "license", "saved", "n_different", "n_words"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"]) for hit in scanner.licences(t.as_py())]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, at, license, saved, n_different, n_words): each licence notice found, at its first word's offset in code points."""
    d = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").rlike(CUES))
    return d.mapInArrow(_scan(templates or TEMPLATES),
                        "doc_id bigint, at bigint, license string, saved double, n_different bigint, n_words bigint")
