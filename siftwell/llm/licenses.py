"""License scans by patience alignment.

A text is cut into overlapping windows of WIDE template lengths, one every half length, so that a
license with as many words inserted as it has lies whole in one of them. In a window, words that
occur once in both are anchors; the longest increasing run of their places is kept, and the gaps
between them are aligned in the same way, with equal words at their ends matched first. Of the
matched words the densest stretch counts; its share of the template is the coverage. Texts that lack
too many of a template's words for the wanted coverage are not aligned.

Null and empty texts match nothing. Of equal coverages the longer template wins, then the name.
Rows are independent: repeated rows give equal results. Other columns are dropped; an empty table
gives an empty result. Very long texts are scanned whole, window by window; memory is bounded by one
text and its words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches

#: Share of a template's words that must match, and what an unmatched word in between costs.
COVERAGE, GAP_COST = 0.8, 0.5
#: Half lengths of a template in a window.
WIDE = 5
WORDS = re.compile(r"[^\W_]+")

#: Names of licenses and their usual statements or texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT (text)": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC (text)": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0 (notice)": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-2-Clause (text)": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause (text)": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "MPL-2.0 (notice)": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "LGPL-2.1 (notice)": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "CC0-1.0 (notice)": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
        "This software is distributed without any warranty."
    ),
    "Unlicense (text)": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib (text)": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
    ),
    "CC-BY-4.0 (notice)": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "GPL-3.0 (notice)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}


def tokens(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def rising(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            piles.append(i)
        else:
            tops[k], piles[k] = p, i
        below.append(piles[k - 1] if k else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of matched words, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b[w] == 1}
        both = [(where[w], j) for j, w in enumerate(b[b0:b1], b0) if w in where]
        chain = [both[i] for i in rising([x for x, _ in both])]
        out += chain
        if chain:
            ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:])]
    return sorted(out)


def densest(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretch of matches with the most matched words less the cost of words skipped in between."""
    best, best_at, score, start = 0.0, (0, 0), 0.0, 0
    for i, (x, _) in enumerate(matches):
        gap = x - matches[i - 1][0] - 1 if i else 0
        if score - GAP_COST * gap <= 0:
            score, start = 0.0, i
        else:
            score -= GAP_COST * gap
        score += 1
        if score > best:
            best, best_at = score, (start, i + 1)
    return matches[slice(*best_at)]


class Template:
    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, tokens(text)
        self.distinct = frozenset(self.words)
        self.least = -(-int(coverage * len(self.words) * 1000) // 1000)
        self.missing = len(self.words) - self.least

    def find(self, words: list[str]) -> tuple[int, int, int] | None:
        """(matched words, first and last place in the text) of the best window, the first of equals."""
        n, best = len(self.words), None
        step = max(n // 2, 1)
        hits = [i for i, w in enumerate(words) if w in self.distinct]
        if not hits:
            return None
        for k in sorted({s for i in hits for s in range(max(i // step - WIDE, 0), i // step + 1)}):
            window = words[k * step : k * step + WIDE * step + 1]
            if len(self.distinct.difference(window)) > self.missing:
                continue
            found = densest(align(window, self.words))
            if len(found) >= self.least and (best is None or len(found) > best[0]):
                best = (len(found), k * step + found[0][0], k * step + found[-1][0])
        return best


def templates_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from a folder of license texts, named by their files; a folder that people keep, so it fits the driver."""
    rows = spark.read.text(folder, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "value")
    return {r.name.removesuffix(".txt"): r.value for r in rows.orderBy("name").collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, licenses): the matches of each text, best first."""
    known = [Template(name, text, coverage) for name, text in (templates or TEMPLATES).items()]
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int64()), ("words", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    def one(text: str | None) -> list[dict]:
        words = tokens(text or "")
        there, out = set(words), []
        for t in known:
            if len(t.distinct - there) <= t.missing and (hit := t.find(words)):
                out.append({"license": t.name, "matched": hit[0], "words": len(t.words), "first": hit[1], "last": hit[2]})
        return sorted(out, key=lambda m: (-m["matched"] / m["words"], -m["words"], m["license"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(one, batch.column("text").to_pylist()), kind)], ["doc_id", "licenses"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, licenses array<struct<license: string, matched: long, words: long, first: long, last: long>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.get("licenses", F.lit(0))
    return rows.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), best["license"].alias("license"), best["matched"].alias("matched"), best["words"].alias("template_words"), best["first"].alias("first_word"), best["last"].alias("last_word"))
