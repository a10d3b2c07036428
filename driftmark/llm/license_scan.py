"""License scan by conditional compression.

In a block that speaks of licensing, windows of a few template lengths are compressed by themselves and with every template
as a raw Zstandard dictionary. A template is a candidate of a window where the bytes it saves come near those it saves
on its own text, so that short notices count in long lines. Candidates are ranked by bytes saved; going down the ranks,
a winner is confirmed by its exact differences in wording, so that one license is not taken for another that differs
in a version or a clause, and what it covers is closed to the candidates behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FREE = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by "
    "the Free Software Foundation{} of the License"
)
#: Notices as they are published by their authors (fixed values).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-Rights-Reserved": "All rights reserved.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at"
    ),
    "GPL-2.0-header": _FREE.format("program", "", "; either version 2"),
    "GPL-3.0-header": _FREE.format("program", "", ", either version 3"),
    "LGPL-2.1-header": _FREE.format("library", "Lesser ", "; either version 2.1"),
    "LGPL-3.0-header": _FREE.format("library", "Lesser ", ", either version 3"),
    "AGPL-3.0-header": _FREE.format("program", "Affero ", ", either version 3"),
    **{
        f"CC-{code}-4.0-header": f"This work is licensed under a Creative Commons {name} 4.0 International License."
        for code, name in {
            "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
        }.items()
    },
}
#: Words whose presence in a line makes it a candidate (fixed values).
CUES = re.compile(
    r"licen[cs]|copyright|\(c\)|©|rights reserved|public domain|creative commons|\bcc[ -]?(?:by|0)|\b[al]?gpl|mozilla public|"
    r"apache|permission is hereby|redistribut|warrant|sublicense|\bas[- ]is\b|obtaining a copy|the software|unencumbered|liabilit",
    re.IGNORECASE,
)
#: Words that tell licenses apart; they must agree exactly (fixed values).
TELLING = frozenset("nc nd sa lesser affero mit apache gnu mozilla cc0 cc by attribution sharealike noncommercial noderivatives".split())
#: What may follow a notice and make it another one: a clause or a version that hangs on it, no year and no new sentence.
BEHIND = re.compile(
    r"(?:[ \t]*[-/][ \t]*|[ \t]+)(?:nc|nd|sa|sharealike|noncommercial|noderivatives)\b|[ \t,]*\(?v(?:er(?:sion)?)?\.?[ \t]*\d|[ \t-]+\d+\.\d",
    re.IGNORECASE,
)
_YEAR = re.compile(r"(?:19|20)\d\d")
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _telling(found: list[str]) -> set[str]:
    return {w for w in found if w in TELLING or any(c.isdigit() for c in w) and not _YEAR.fullmatch(w)}


def blocks(text: str | None, reach: int = 400) -> Iterator[tuple[int, str]]:
    """(code point offset, block): runs of lines with a cue; lines over 2 * reach long give the parts near cues."""
    at, start, end = 0, None, 0
    for line in (text or "").split("\n"):
        stop = at + len(line)
        if CUES.search(line):
            if stop - at > 2 * reach:
                if start is not None:
                    yield start, text[start:end]
                    start = None
                low = high = None
                for m in CUES.finditer(line):
                    a, b = max(0, m.start() - reach), min(len(line), m.end() + reach)
                    if high is not None and a <= high:
                        high = b
                    else:
                        if high is not None:
                            yield at + low, line[low:high]
                        low, high = a, b
                yield at + low, line[low:high]
            else:
                start = at if start is None else start
                end = stop
        elif start is not None:
            yield start, text[start:end]
            start = None
        at = stop + 1
    if start is not None:
        yield start, text[start:end]


class Scanner:
    def __init__(self, templates: dict[str, str], level: int = 3):
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        parameters = zstandard.ZstdCompressionParameters.from_level(level, **options)
        self.plain = zstandard.ZstdCompressor(compression_params=parameters)
        self.words = {k: words(t) for k, t in templates.items()}
        # Texts are compressed as their words, so that case, marks and line ends don't matter.
        raw = {k: " ".join(w).encode() for k, w in self.words.items()}
        dictionary = lambda v: zstandard.ZstdCompressionDict(v + b" " * max(0, 8 - len(v)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = {k: zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary(v)) for k, v in raw.items()}
        #: Bytes that a template saves on its own text.
        self.own = {k: max(1, len(self.plain.compress(v)) - len(self.given[k].compress(v))) for k, v in raw.items()}
        self._short = lru_cache(maxsize=50_000)(self._find)
        #: Around a cue, more than any template is long.
        self.reach = max(400, max(map(len, templates.values()), default=0) + 100)

    def find(self, block: str, least: float, share: float) -> tuple[tuple[str, float, int, int, bool], ...]:
        """_find, remembered for short blocks."""
        return self._short(block, least, share) if len(block) <= 2000 else self._find(block, least, share)

    def candidates(self, mine: list[str], least: float) -> list[tuple[int, float, str, int, int]]:
        """(bytes saved, size reduction, license, first word, end word) of the windows of a block's words in which a template
        saves `least` of its own saving or more. Windows are two templates long and begin every half template, so that one
        holds a notice with little beside it; the block as a whole is a window, too."""
        edges = np.cumsum([0] + [len(w.encode()) + 1 for w in mine])
        raw, alone, out = " ".join(mine).encode(), {}, []
        for name, want in self.words.items():
            n = max(1, len(want))
            step = -(-n // 2)
            for low, high in {(low, min(len(mine), low + 2 * n)) for low in range(0, max(1, len(mine) - n + step), step)} | {(0, len(mine))}:
                part = raw[edges[low] : edges[high] - 1]
                if (low, high) not in alone:
                    alone[low, high] = len(self.plain.compress(part))
                given = len(self.given[name].compress(part))
                if alone[low, high] - given >= least * self.own[name]:
                    out.append((alone[low, high] - given, 1 - given / alone[low, high], name, low, high))
        return out

    def confirmed(self, name: str, block: str, spans: list[tuple[int, int]], mine: list[str], low: int, high: int, share: float) -> tuple | None:
        """(first word, end word, missing, added) of a template's wording in the words low to high of a block."""
        want = self.words[name]
        same = [m for m in SequenceMatcher(None, want, mine[low:high], autojunk=False).get_matching_blocks() if m.size]
        matched = sum(m.size for m in same)
        if not same or matched < share * len(want):
            return None
        low, high = low + same[0].b, low + same[-1].b + same[-1].size
        # Words inside the match, and what hangs on its end, tell the license as well.
        if _telling(mine[low:high]) != _telling(want) or BEHIND.match(block, spans[high - 1][1]):
            return None
        return low, high, len(want) - matched, high - low - matched

    def _find(self, block: str, least: float, share: float) -> tuple[tuple[str, float, int, int, bool], ...]:
        """(license, size reduction, missing words, changed or added words, exact) of the winners, by bytes saved; of equal
        savings the longer template first, then the shorter window."""
        spans = [m.span() for m in _WORD.finditer(block)]
        mine = [block[a:b].lower() for a, b in spans]
        if not mine:
            return ()
        ranks = sorted(self.candidates(mine, least), key=lambda c: (-c[0], -len(self.words[c[2]]), c[4] - c[3], c[2:]))
        found, taken = [], set()
        for _, gain, name, low, high in ranks:
            hit = self.confirmed(name, block, spans, mine, low, high, share)
            if hit and taken.isdisjoint(range(hit[0], hit[1])):
                taken |= set(range(hit[0], hit[1]))
                found.append((name, gain, hit[2], hit[3], not hit[2] and not hit[3]))
        return tuple(found)


_SCANNERS: dict[tuple, Scanner] = {}


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.35, share: float = 0.9
) -> DataFrame:
    """One row per finding: doc_id, start (code point offset of the block), license, reduction, n_missing, n_added, exact, block.

    reduction: of the window in which the template won. least: smallest part of what a template saves on its own text that
    it must save in a window; share: part of its words that must then stand there in order. A notice that stands in a block twice gives two rows. Null and empty texts have no findings; repeated rows repeat theirs; a null id stays null; other
    columns are not read; an empty table gives no rows.
    """
    templates = dict(TEMPLATES if templates is None else templates)
    key = tuple(sorted(templates.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _SCANNERS.setdefault(key, Scanner(templates)) if key not in _SCANNERS else _SCANNERS[key]
        for batch in batches:
            out = []
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text and CUES.search(text):
                    for start, block in blocks(text, scanner.reach):
                        out += [(i, start, *x, block) for x in scanner.find(block, least, share)]
            names = ["doc_id", "start", "license", "reduction", "n_missing", "n_added", "exact", "block"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    schema = "doc_id long, start long, license string, reduction double, n_missing long, n_added long, exact boolean, block string"
    return picked.mapInArrow(run, schema)
