"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Every run of whole lines of a text is a candidate for every template whose size allows the wanted coefficient: two bigram
sets reach a Dice coefficient t only if neither is larger than (2 - t) / t times the other. A run can only be the best one if its first and
last line each have at least t / 2 of their bigrams in the template, so most texts are done after one look-up of their
bigrams. Texts are read in place; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from carefold.llm.decontaminate import words_of

DICE = 0.8

#: (licence, text): fixed values, the statements and short texts by which licences are granted.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
            "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
            "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
            "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
                "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
                "License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
                "obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
            "notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
                 "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
                 "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
                 "Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
                 "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
                 "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
                 "Affero General Public License for more details."),
)


class Templates:
    """Bigram sets of the templates over one vocabulary."""

    def __init__(self, templates, dice: float):
        self.dice, self.vocabulary, self.rows = dice, {}, []
        for name, text in templates:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode())]
            pairs = {a << 32 | b for a, b in zip(ids, ids[1:])}
            if pairs:
                self.rows.append((name, pairs, len(pairs) * dice / (2 - dice), len(pairs) * (2 - dice) / dice))
        self.known = np.unique(np.array(sorted(set().union(*(r[1] for r in self.rows))) if self.rows else [], np.int64))


def _line_pairs(lines: list[list[bytes]], get) -> list[list[int]]:
    """Per line its bigrams, the first of them with the last word before the line; other words than the templates' are told
    apart by their negative hash."""
    out, last = [], None
    for words in lines:
        ids = [get(w) or -(hash(w) & 0x7FFFFFFF) - 1 for w in words]
        chain = ids if last is None else [last, *ids]
        out.append([a << 32 | (b & 0xFFFFFFFF) if a > 0 and b > 0 else hash((a, b)) | -2**63 for a, b in zip(chain, chain[1:])])
        last = ids[-1] if ids else last
    return out


class _Fresh:
    """Where a run of lines meets pairs that it does not hold yet. ``seen[j]``: the smallest line, among the last lines before ``j``
    that hold the pairs of line ``j``; a run from line ``i`` learns nothing from a line with ``seen[j] > i``."""

    def __init__(self, chains: list[list[int]]):
        last: dict[int, int] = {}
        self.seen = np.full(len(chains), len(chains), np.int64)
        for j, chain in enumerate(chains):
            distinct = set(chain)
            if distinct:
                self.seen[j] = min(last.get(p, -1) for p in distinct)
            last.update(dict.fromkeys(distinct, j))
        self.step = max(16, math.isqrt(len(chains)))
        self.low = np.array([self.seen[k:k + self.step].min() for k in range(0, len(chains), self.step)], np.int64)

    def after(self, j: int, i: int) -> int:
        """The next line after ``j`` that may add to a run from line ``i``; the number of lines if there is none."""
        j += 1
        block = j // self.step
        own = np.flatnonzero(self.seen[j:(block + 1) * self.step] <= i)
        if len(own):
            return j + int(own[0])
        later = np.flatnonzero(self.low[block + 1:] <= i)
        if not len(later):
            return len(self.seen)
        start = (block + 1 + int(later[0])) * self.step
        return start + int(np.flatnonzero(self.seen[start:start + self.step] <= i)[0])


def best_runs(text: bytes | None, templates: Templates) -> list[tuple[str, float, int, int]]:
    """(licence, Dice, first line, line after the last) of the best run of lines for every licence that reaches the
    coefficient, unless another licence matches some of these lines better."""
    lines = [words_of(x) for x in (text or b"").split(b"\n")]
    get, half = templates.vocabulary.get, templates.dice / 2
    flat = np.fromiter((get(w, 0) for line in lines for w in line), np.int64)
    if len(flat) < 2:
        return []
    pairs = flat[:-1] << 32 | flat[1:]
    hit = np.isin(pairs, templates.known) & (flat[:-1] > 0) & (flat[1:] > 0)
    if not hit.any():
        return []
    sizes = np.array([len(line) for line in lines])
    begin = np.cumsum(sizes) - sizes
    upto = np.r_[0, np.cumsum(hit)]
    own = [upto[max(b, b + n - 1)] - upto[b] if n > 1 else 0 for b, n in zip(begin, sizes)]
    starts = [i for i, (m, n) in enumerate(zip(own, sizes)) if n == 1 or n > 1 and m >= half * (n - 1)]
    chains, found = _line_pairs(lines, get), {}
    fresh_lines = None  # made for the few texts that get as far as growing a run
    for name, wanted, low, high in templates.rows:
        for i in starts:
            inner = chains[i][1:] if len(chains[i]) >= len(lines[i]) else chains[i]
            if len(inner) > 0 and len(wanted.intersection(inner)) < half * len(set(inner)):
                continue
            run, same, j = set(), 0, i
            while j < len(lines):
                fresh = set(inner if j == i else chains[j]) - run
                run |= fresh
                same += len(fresh & wanted)
                if len(run) > high:
                    break
                dice = 2 * same / (len(run) + len(wanted))
                if len(run) >= low and dice >= templates.dice and dice > found.get(name, (0,))[0]:
                    found[name] = (dice, i, j + 1)
                fresh_lines = fresh_lines or _Fresh(chains)
                j = fresh_lines.after(j, i)
    rows = [(name, *rest) for name, rest in found.items()]
    return sorted(r for r in rows if not any(o[1] > r[1] and o[2] < r[3] and r[2] < o[3] for o in rows))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """(id_col, licences): for every row the licences whose template some run of whole lines matches with at least ``dice``,
    as (licence, dice, first_line, end_line) sorted by name, with the best run each; equal coefficients go to the earlier run,
    and a licence whose run overlaps a better match of another one is left out.

    Words are compared in lower case without punctuation. Null, empty and one-word texts have no licences. Repeated
    rows come out as often as they came in; ids may be null; other columns are not looked at."""
    known = docs.sparkSession.sparkContext.broadcast(Templates(templates, dice))  # a fixed list
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("first_line", pa.int64()), ("end_line", pa.int64())]))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("licence", "dice", "first_line", "end_line"), r)) for r in best_runs(t.as_py(), known.value)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, item)], names=[id_col, "licences"])

    return docs.select(id_col, F.col(text_col).cast("binary").alias("_text")).mapInArrow(
        stage, f"`{id_col}` {kind}, licences array<struct<licence: string, dice: double, first_line: bigint, end_line: bigint>>")
