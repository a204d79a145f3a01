"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

The terms are words and pairs of neighbouring words, so the same words in another order are another text.

1. One pass over the whole text of every file notes which template terms it has. Where a pair of words with a trigger
   (license, permission, copyright ...) also stands in a template, the template is laid over the text at that place: the
   words under it, as many as the template has, are a passage. Line ends and comment marks are no words, so wrapping does
   not matter.
2. Document frequencies of the template terms, over all files, give the IDF weights. There are as many as the templates
   have terms, whatever the corpus. A term outside the templates weighs like one that only one file has.
3. A passage's TF-IDF vector, with all its terms, is compared with its template; the best cosine of at least
   `threshold` decides. A template is a statement, which names a licence, or a text of the licence itself.
   A file is a licence file if it has a licence and is named like one (LICENSE, COPYING), or if four fifths of its words
   lie in passages of licence texts, whatever its size.
4. Files without a licence of their own take that of the licence file in the nearest ancestor directory, by joining
   the ancestors of their paths with the directories that have one.

Rules: null or empty text has no licence of its own but can inherit. Ties go to the higher cosine, then the first
licence id in order; of several licence files in a directory likewise. A null path has no directory. Repeated paths and
repeated rows are separate files. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.shared import BROADCAST_ROWS, Scratch, slices, tidy

THRESHOLD = 0.6
#: Share of a file's words in passages of licence texts that makes it a licence file.
FILE_SHARE = 0.8
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name}"
_GNU_LATER = _GNU + " as published by the Free Software Foundation{comma} either version {n} of the License, or (at your option) any later version."
_GNU_HOPE = " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}."


def _gnu(name: str, n: str, what: str, old: bool = False) -> list[str]:
    part = {"what": what, "mark": ";" if old else ":", "name": name, "n": n, "comma": ";" if old else ","}
    return [_GNU.format(**part) + f", version {n}.", _GNU_LATER.format(**part), (_GNU_LATER + _GNU_HOPE).format(**part)]


#: Texts of licences, whole or as they head a file.
TEMPLATES = {
    "AGPL-3.0": _gnu("Affero General Public License", "3", "program"),
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [" ".join([_BSD, "1.", _BSD_SOURCE, "2.", _BSD_BINARY, _BSD_AS_IS])],
    "BSD-3-Clause": [_BSD, " ".join([_BSD, "1.", _BSD_SOURCE, "2.", _BSD_BINARY, "3.", _BSD_NAME, _BSD_AS_IS]), "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": _gnu("General Public License", "2", "program", old=True),
    "GPL-3.0": _gnu("General Public License", "3", "program"),
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "library", old=True),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "library"),
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
}
#: Names of licences in statements.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
#: What a statement says of a name.
SAYINGS = ["Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under the {}", "This work is licensed under a {}", "is available under the {}", "is published under the {}"]
TRIGGERS = frozenset("license licence licensed licenced licenses sublicense copyright spdx permission permitted waived unencumbered released distributed available published".split())
_MARKS = (b"licen", b"copyright", b"spdx", b"permi", b"waived", b"unencumbered", b"released", b"distributed", b"available", b"published")
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([-.][^/]*)?$"
_WORD = re.compile(rb"[a-z0-9]+")


def _words(data: bytes) -> list[bytes]:
    return _WORD.findall(data.lower())


def _spdx() -> list[tuple[str, str]]:
    ids = {*TEMPLATES, *NAMES}
    return [(l, f"SPDX-License-Identifier: {l}{end}") for l in ids for end in ("", *(("-only", "-or-later") if "GPL" in l else ()))]


def _statements() -> list[tuple[str, str]]:
    return [(l, say.format(name)) for l, names in NAMES.items() for name in names for say in SAYINGS] + _spdx()


#: (licence, its words, whether it is a text of the licence), in order of the licences.
LIST = sorted([(l, _words(t.encode()), True) for l, ts in TEMPLATES.items() for t in ts] + [(l, _words(t.encode()), False) for l, t in _statements()], key=lambda x: x[0])
VOCABULARY = {w: i for i, w in enumerate(sorted({w for _, ws, _ in LIST for w in ws}))}
_V = len(VOCABULARY)
_TRIGGER_IDS = np.array(sorted(VOCABULARY[w.encode()] for w in TRIGGERS if w.encode() in VOCABULARY))


def _ids(words: list[bytes]) -> np.ndarray:
    """Numbers of the words in the vocabulary; -1 for others."""
    return np.fromiter((VOCABULARY.get(w, -1) for w in words), np.int64, len(words))


def _codes(ids: np.ndarray) -> np.ndarray:
    """One number a pair of neighbours; -1 if a word of it is not in the vocabulary."""
    return np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * _V + ids[1:], -1)


_TEMPLATE_IDS = [_ids(ws) for _, ws, _ in LIST]
PAIRS = np.unique(np.concatenate([_codes(x) for x in _TEMPLATE_IDS]))
TERMS = _V + len(PAIRS)


def _pairs(ids: np.ndarray) -> np.ndarray:
    """Numbers of the terms that pairs of neighbours are, from _V on; -1 for others."""
    codes = _codes(ids)
    at = np.minimum(np.searchsorted(PAIRS, codes), len(PAIRS) - 1)
    return np.where(PAIRS[at] == codes, at + _V, -1)


def _anchors() -> dict[int, list[tuple[int, int]]]:
    """By pair with a trigger: (template, place in it)."""
    out: dict[int, list[tuple[int, int]]] = {}
    for k, ids in enumerate(_TEMPLATE_IDS):
        near = np.isin(ids, _TRIGGER_IDS)
        for i, pair in enumerate(_pairs(ids).tolist()):
            if near[i] or near[i + 1]:
                out.setdefault(pair, []).append((k, i))
    return out


ANCHORS = _anchors()


def passages(pairs: np.ndarray) -> list[tuple[int, int]]:
    """(template, first word) wherever one of its pairs with a trigger meets the text's; the first may lie before the text."""
    found: dict[tuple[int, int], None] = {}
    for i in np.flatnonzero(np.isin(pairs, _ANCHOR_PAIRS)).tolist():
        for k, o in ANCHORS[int(pairs[i])]:
            found[(k, i - o)] = None
    return list(found)


_ANCHOR_PAIRS = np.array(sorted(ANCHORS))


def _read(text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(word ids, template terms in the text, passages)."""
    data = (text or b"").lower()
    ids = _ids(_WORD.findall(data))
    pairs = _pairs(ids)
    own = np.unique(np.concatenate([ids, pairs]))
    return ids, own[own >= 0], passages(pairs) if any(m in data for m in _MARKS) else []


def cosine(ids: np.ndarray, template: np.ndarray, idf: np.ndarray) -> float:
    """Of the words `ids` to a template's vector (counts times idf, of length 1); idf's last place is for other terms."""
    terms, counts = np.unique(np.concatenate([ids, _pairs(ids)]), return_counts=True)
    if len(terms) and terms[0] < 0:  # each other term is one of its own
        other, terms, counts = counts[0], terms[1:], counts[1:]
    else:
        other = 0
    weights = counts * idf[terms]
    norm = np.sqrt(np.square(weights).sum() + other * idf[-1] ** 2)
    return float(template[terms] @ weights / norm) if norm else 0.0


def template_vectors(idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(LIST), TERMS))
    for k, ids in enumerate(_TEMPLATE_IDS):
        np.add.at(out[k], np.concatenate([ids, _pairs(ids)]), 1)
    out *= idf[:-1]
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def idf_of(total: int, df: dict[int, int]) -> np.ndarray:
    """Weights of the template terms, and last that of a term outside them, as if one file had it."""
    counts = np.array([*(df.get(t, 0) for t in range(TERMS)), min(1, total)])
    return np.log((1 + total) / (1 + counts)) + 1


def decide(ids: np.ndarray, found: list[tuple[int, int]], vectors: np.ndarray, idf: np.ndarray, threshold: float) -> tuple[str | None, float, bool]:
    """(licence, cosine, whether the text is mostly licence text) by a text's passages."""
    best: tuple[str | None, float] = (None, 0.0)
    inside = np.zeros(len(ids) + 1, np.int64)
    known: dict[tuple[int, bytes], float] = {}
    for k, first in sorted(found):
        a, b = max(0, first), min(len(ids), first + len(_TEMPLATE_IDS[k]))
        part = ids[a:b]
        key = (k, part.tobytes())
        if key not in known:
            known[key] = round(cosine(part, vectors[k], idf), 9)
        cos = known[key]
        if cos >= threshold:
            if cos > best[1]:
                best = (LIST[k][0], cos)
            if LIST[k][2]:
                inside[a] += 1
                inside[b] -= 1
    mostly = len(ids) > 0 and (np.cumsum(inside)[:-1] > 0).sum() >= FILE_SHARE * len(ids)
    return (*best, bool(mostly))


def scan(files: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, license, basis header / file / inherited, score): one row a file; license null if none is found."""
    spark = files.sparkSession
    scratch = Scratch(spark, "license")

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 2):
                rows = [_read(x.as_py()) for x in part.column(2).cast(pa.binary())]
                n = len(rows)
                held = [ids.tolist() if found else None for ids, _, found in rows]
                spots = [[{"k": k, "first": f} for k, f in found] if found else None for _, _, found in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(uid, uid + n), pa.int64()), part.column(0), part.column(1), pa.array([own.tolist() for _, own, _ in rows], pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int32())), pa.array(spots, pa.list_(pa.struct([("k", pa.int32()), ("first", pa.int64())])))],
                    ["uid", "key", "path", "present", "ids", "found"],
                )
                uid += n

    chosen = files.select(F.col(key).cast("long").alias("key"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    seen = scratch.table(chosen.mapInArrow(read, "uid long, key long, path string, present array<int>, ids array<int>, found array<struct<k:int,first:long>>"), "seen")
    counted = seen.select(F.explode("present").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()
    idf = idf_of(seen.count(), {r.t: r.df for r in counted})
    weights = spark.sparkContext.broadcast((template_vectors(idf), idf))

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weight = weights.value
        for batch in batches:
            best = []
            for ids, found in zip(batch.column(3), batch.column(4).to_pylist(), strict=True):
                best.append(decide(ids.values.to_numpy().astype(np.int64), [(f["k"], f["first"]) for f in found], vectors, weight, threshold) if found else (None, 0.0, False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([m for _, _, m in best], pa.bool_()), pa.array([l for l, _, _ in best], pa.string()), pa.array([s for _, s, _ in best], pa.float64())], ["uid", "key", "path", "mostly", "own", "score"])

    # little is read for much work, so tasks are set by number and not by size
    dealt = seen.select("uid", "key", "path", "ids", "found").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid")
    scored = scratch.table(dealt.mapInArrow(score, "uid long, key long, path string, mostly boolean, own string, score double"), "scored")
    scratch.drop(seen)
    is_file = F.col("own").isNotNull() & (F.col("mostly") | F.coalesce(F.col("path").rlike(_NAMED), F.lit(False)))
    cut = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    held = scored.where(is_file & F.col("path").isNotNull()).groupBy(cut.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("license"))).alias("b")).select("dir", F.col("b.license").alias("license"), (-F.col("b.s")).alias("from_score"))
    held = scratch.table(held, "directories")
    few = held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parts = F.split("path", "/")
    above = scored.where("own is null and path is not null").select("uid", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")))).alias("a")).select("uid", "a.*")
    nearest = above.join(F.broadcast(held) if few else held, "dir").groupBy("uid").agg(F.max(F.struct("depth", "license", "from_score")).alias("n")).select("uid", F.col("n.license").alias("inherited"), "n.from_score")
    out = scored.join(nearest, "uid", "left")
    basis = F.when(is_file, "file").when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited")
    return out.select(F.col("key").alias(key), F.coalesce("own", "inherited").alias("license"), basis.alias("basis"), F.round(F.coalesce(F.when(F.col("own").isNotNull(), F.col("score")), F.col("from_score")), 6).alias("score"))
