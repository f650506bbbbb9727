"""License scans (operator 2), native: DataFrame functions only on the main path.

A text's lines lose their comment marks, wrapped lines are folded, and what is left between blank lines and after
ended lines is a paragraph. It becomes word 1- to 3-grams (each once); a multinomial logistic regression, trained
here on licence notices, weighs them. Its probabilities are calibrated by a temperature; a paragraph that no family
explains well (a class of its own, trained on notices of made-up names), or whose best family shares too few 2-grams with the family's templates, is ``unknown`` if it has a
cue (a word that licences use), and else of no licence.

Every paragraph of every text is cut, searched for cues and compared with the templates of all families together. One
without a cue that shares fewer n-grams with all of them than a family must share alone is of no licence, whatever its
scores. All others are scored: their n-grams are exploded, joined to the weights (a broadcast of fixed size: the model's
vocabulary) and summed by paragraph. Rows with these paragraphs are written to a table first, so that the numbers which
tell rows apart stay.

Defined results: null and empty texts have no paragraphs; repeated rows keep a row each; a very long line is one
paragraph; an empty table gives no rows; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.session import materialize

# Notices as their licences word them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "You may obtain a copy of the License at",
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004",
        "Licensed under Apache-2.0.",
        "Distributed under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "MIT License",
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "This project is licensed under the terms of the MIT license.",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Licensed under MIT.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You may use this file under the terms of the GPL.",
        "https://www.gnu.org/licenses/",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Released under the GPL v3.",
        "Licensed under GPLv3.",
        "Licensed under GPL-3.0.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GPL v2.",
        "Licensed under GPLv2.",
        "Licensed under GPL-2.0.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Licensed under the GNU Lesser General Public License.",
        "Released under the LGPL v2.1.",
        "Licensed under the LGPL, version 3.",
        "Licensed under LGPL-3.0.",
        "Licensed under LGPL-2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL-3.0 license.",
        "Licensed under AGPL-3.0.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Licensed under the BSD 3-Clause License.",
        "BSD 2-Clause License",
        "Released under the 2-clause BSD license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under BSD-3-Clause.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Licensed under MPL-2.0.",
        "https://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC-SA 4.0, the Creative Commons Attribution-NonCommercial-ShareAlike license.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, a public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        "For more information, please refer to https://unlicense.org",
        "SPDX-License-Identifier: Unlicense",
    ],
    "isc": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
}

#: Paragraphs of no licence, with and without words that licences use.
ORDINARY = [
    "The driver lost his license after the accident and had to take the bus to work for a year.",
    "She asked for permission to leave early and walked home along the river.",
    "The museum keeps a copy of the letter in the public reading room.",
    "He was licensed to practise medicine in three countries.",
    "The general spoke in public about the version of events that the papers printed.",
    "The company sells software and associated services to schools without restriction of size.",
    "Under the terms of the agreement the workers return on Monday.",
    "A fishing license costs ten dollars at any shop near the lake.",
    "The foundation gave free books to every person in the village.",
    "The warranty of the fridge runs for two years from the purchase.",
    "Apache helicopters flew over the valley during the exercise.",
    "The lecture at MIT was about the history of general relativity.",
    "Poetic license lets the author change the order of the facts.",
    "The commons behind the church were open to creative gardeners.",
    "The source of the river lies in the hills, and its form is binary at the fork.",
    "Copyright law is taught in the second year of the course.",
    "The license plate of the red car ended in seven.",
    "Distribution of food began at noon and the conditions were met with patience.",
    "The liquor licence of the pub was renewed by the council.",
    "Nobody was permitted to enter the hall without a ticket.",
    "Copyright (c) 2020 the authors.",
    "Copyright 2019 Jane Doe. All rights reserved.",
    "Copyright (C) 1998, 2004 by the project's contributors",
    "All rights reserved.",
    "This file is part of the tools that the group has built.",
    "The names of the authors are in the second file, and the use of the tools is shown in the third.",
    "If the weather is kind, the group will sell copies of the book at the market, or give them to the library.",
    "This is a short note on how to use the tools for the garden and any other work that you may have to do.",
    "",
]

#: Sentences of licences that no family here stands for; {} is any name.
OTHERS = [
    "Licensed under the {} License.", "Licensed under the {} License, version 9.", "Released under the terms of the {} license.", "This work is licensed under the {} Public License.", "Licensed under {}.",
    "SPDX-License-Identifier: {}", "Permission to copy these pages for classroom use is given by {}.", "Available under the {} license agreement.", "Distributed under {} terms; see the license for details.",
    "Redistribution of this file is permitted by {} only with written permission.", "This program is distributed by {} without warranty.", "You may obtain a copy of the {} license from the authors.",
]

# Stems of which oracle() wants one in a text (lower case). scan() reads all texts.
STEMS = (
    "licen", "copyright", "warrant", "redistribut", "permission", "permitted", "public domain", "creative commons", "gnu general", "gnu lesser", "gnu affero", "gpl", "unencumbered", "waive", "spdx", "cc0", "cc by", "cc-by",
    "the mpl", "mpl-2", "mozilla", "free to copy", "apache", "bsd", "gnu.org",
)
# The cues, by which a paragraph that no family explains is unknown.
CUE = r"(?i)licen[cs]|copyright|warrant|redistribut|permission|permitted|public domain|creative commons|\bgnu\b|\b[al]?gpl|unencumbered|waived|spdx|\bcc0|\bcc[ -]by|\bmpl\b|mozilla public|free to copy|apache|\bbsd\b"

# Marks that begin and end a line of a comment.
OPENING = r"^[ \t\r]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--)?[ \t\r]*"
CLOSING = r"[ \t\r]*(?:\*+/|-->)?[ \t\r]*"
#: A line of so many characters that no stop ends is wrapped; a shorter one if the next goes on in lower case.
WRAPPED = 40
STOP = r"[.!?:]"
GOES_ON = r"^[a-z(]"

NONE = "none"
UNKNOWN = "unknown"
NGRAM = 3
#: Texts with paragraphs to score in a task, about.
PART_ROWS = 250
#: A family needs this calibrated probability, and this share of its paragraph's COMPARED-grams in its templates.
LEAST_PROBABILITY = 0.6
LEAST_TEMPLATE = 0.4
COMPARED = 2


def paragraphs(text: str) -> list[str]:
    """The plain form of how scan() cuts a text."""
    lines = [re.sub(CLOSING + r"\Z", "", re.sub(OPENING, "", x)) for x in text.split("\n")]
    out = ""
    for x, y in zip(lines, [*lines[1:], ""]):
        soft = x and y and not re.search(STOP + r"\Z", x) and (len(x) >= WRAPPED or re.search(GOES_ON, y))
        out += x + ("\n" if not soft else "" if x.endswith("-") else " ")
    return [x for x in out.split("\n") if x]


def normalized(text: str) -> str:
    """Lower case, words of letters, digits, inner dots and hyphens, single spaces."""
    return re.sub(r"[.-]+(?= |$)|(?<= )[.-]+|^[.-]+", "", re.sub(r"[^a-z0-9.-]+", " ", text.lower())).strip()


def ngrams(text: str, most: int = NGRAM) -> list[str]:
    """Each n-gram once."""
    words = [w for w in normalized(text).split(" ") if w]
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)))


def longest(text: str) -> list[str]:
    """The COMPARED-grams; of fewer words the whole, so that short notices can be compared too."""
    grams = ngrams(text, COMPARED)
    most = max((g.count(" ") for g in grams), default=0)
    return [g for g in grams if g.count(" ") == most]


def _examples(seed: int = 3) -> tuple[list[str], list[str]]:
    """Training paragraphs: notices whole, cut, and with words left out; ordinary prose whole, cut, and mixed."""
    r = random.Random(seed)
    texts, names = [], []
    for name, notices in [*TEMPLATES.items(), (NONE, ORDINARY)]:
        for notice in notices:
            words = notice.split()
            texts += [notice] * 4
            names += [name] * 4
            for _ in range(12):
                a = r.randint(0, len(words) // 2) if len(words) > 12 else 0
                b = r.randint(min(len(words), a + 10), len(words)) if len(words) > 12 else len(words)
                some = [w for w in words[a:b] if r.random() > 0.08]
                if name == NONE:
                    some = r.choice(ORDINARY).split()[: r.randint(0, 8)] + some
                elif r.random() < 0.3:
                    some = r.choice(["Copyright 2019 the authors.", "All rights reserved.", "See LICENSE for details.", "This file is part of the tools."]).split() + some
                texts.append(" ".join(some))
                names.append(name)
    for sentence in OTHERS:
        for _ in range(12):
            texts.append(sentence.replace("{}", " ".join("".join(r.choices("abcdefghiklmnoprstu", k=r.randint(3, 9))) for _ in range(r.randint(1, 3)))))
            names.append(UNKNOWN)
    return texts, names


class Model:
    """Weights by n-gram for every class, the temperature, and each template family's COMPARED-grams."""

    def __init__(self, classes: list[str], vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.classes, self.vocabulary, self.weights, self.bias, self.temperature = classes, vocabulary, weights, bias, temperature
        self.at = {g: i for i, g in enumerate(vocabulary)}
        self.template = {UNKNOWN: set()} | {c: {g for t in TEMPLATES[c] for g in (*longest(t), *(ngrams(t, 1)[:1] if len(ngrams(t, 1)) == 1 else ()))} for c in classes if c in TEMPLATES}

    def classify(self, paragraph: str) -> str:
        """The plain form of what scan() does with a paragraph."""
        cued = bool(re.search(CUE, paragraph))
        z = (self.bias + sum((self.weights[self.at[g]] for g in ngrams(paragraph) if g in self.at), np.zeros(len(self.bias)))) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(np.argmax(p))
        long = longest(paragraph)
        name = self.classes[best]
        if name == NONE:
            return NONE
        shared = sum(g in self.template[name] for g in long) / max(len(long), 1)
        return name if p[best] >= LEAST_PROBABILITY and shared >= LEAST_TEMPLATE else UNKNOWN if cued else NONE


@lru_cache(maxsize=1)
def trained(rounds: int = 300, rate: float = 2.0, l2: float = 2e-4) -> Model:
    """Fit the regression by gradient descent on sparse rows, the temperature on examples left out. Deterministic."""
    texts, names = _examples()
    classes = [*TEMPLATES, UNKNOWN, NONE]
    vocabulary = sorted({g for t in [x for v in TEMPLATES.values() for x in v] + ORDINARY + [g for x in OTHERS for g in x.split("{}")] for g in ngrams(t)})
    at = {g: i for i, g in enumerate(vocabulary)}
    v, k = len(vocabulary), len(classes)
    # column v stands for the bias, so that no row is empty
    rows = [[at[g] for g in ngrams(t) if g in at] + [v] for t in texts]
    y = np.eye(k)[[classes.index(n) for n in names]]
    out = np.arange(len(texts)) % 5 == 0

    def sparse(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = [rows[i] for i in np.flatnonzero(chosen)]
        size = np.array([len(x) for x in mine])
        return np.concatenate(mine), np.cumsum(size) - size, size

    column, first, size = sparse(~out)
    row = np.repeat(np.arange(len(size)), size)
    by_column = np.argsort(column, kind="stable")
    used, start = np.unique(column[by_column], return_index=True)
    w = np.zeros((v + 1, k))
    for _ in range(rounds):
        z = np.add.reduceat(w[column], first)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - y[~out]) / np.sqrt(size)[:, None]  # long paragraphs count no more than short ones
        step = l2 * w
        step[used] += np.add.reduceat(g[row[by_column]], start) / len(size)
        w -= rate * step

    column, first, _ = sparse(out)
    z = np.add.reduceat(w[column], first)

    def loss(t: float) -> float:
        s = z / t
        s -= s.max(1, keepdims=True)
        return float(-(s - np.log(np.exp(s).sum(1, keepdims=True)))[y[out] == 1].mean())

    temperature = min((0.25 * 1.1**i for i in range(40)), key=loss)
    return Model(classes, vocabulary, np.round(w[:v], 6), np.round(w[v], 6), round(temperature, 6))


def weights_table(spark: SparkSession, model: Model) -> DataFrame:
    """(gram, w array<double>, t array<int>): a row per n-gram of the vocabulary, from a literal."""
    body = json.dumps([{"gram": g, "w": model.weights[i].tolist(), "t": [int(g in model.template.get(c, ())) for c in model.classes]} for i, g in enumerate(model.vocabulary)])
    return spark.range(1).select(F.inline(F.from_json(F.lit(body), "array<struct<gram:string,w:array<double>,t:array<int>>>")))


def _paragraphs(lines: Column) -> Column:
    """Folded paragraphs of an array of lines without comment marks."""

    def folded(x: Column, i: Column) -> Column:
        following = F.coalesce(F.get(lines, i + 1), F.lit(""))
        soft = (x != "") & (following != "") & ~x.rlike(STOP + r"\z") & ((F.length(x) >= WRAPPED) | following.rlike(GOES_ON))
        return F.concat(x, F.when(~soft, "\n").when(F.endswith(x, F.lit("-")), "").otherwise(" "))

    return F.filter(F.split(F.array_join(F.transform(lines, folded), ""), "\n"), lambda x: x != "")


def _words(low: Column) -> Column:
    """The words of a lower-case paragraph, as normalized() leaves them."""
    clean = F.regexp_replace(low, "[^a-z0-9.-]+", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(clean, r"[.-]+(?= |$)|(?<= )[.-]+|^[.-]+", "")), " "), lambda w: w != "")


def _to_score(paragraphs: Column, model: Model) -> Column:
    """(cued, words) of the paragraphs that may get a name: those with a cue, and those that share LEAST_TEMPLATE of their COMPARED-grams with all templates together, which no family exceeds alone."""
    known = sorted(set().union(*model.template.values()))

    def compared(words: Column) -> Column:
        k = F.greatest(F.least(F.size(words), F.lit(COMPARED)), F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " ")))

    # a step's result is used several times in the next, so each is a struct of its own
    cut = F.transform(paragraphs, lambda p: F.struct(p.rlike(CUE).alias("cued"), _words(F.lower(p)).alias("words")))
    cut = F.transform(cut, lambda p: F.struct(p["cued"].alias("cued"), p["words"].alias("words"), F.when(~p["cued"], compared(p["words"])).alias("grams")))
    cut = F.filter(cut, lambda p: p["cued"] | (F.size(F.filter(p["grams"], lambda g: g.isin(known))) >= LEAST_TEMPLATE * F.size(p["grams"])))
    return F.transform(cut, lambda p: F.struct(p["cued"].alias("cued"), p["words"].alias("words")))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, families (sorted, '' for none), n_cues, n_licensed, n_unknown paragraphs."""
    model = model or trained()
    n = len(model.classes)
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, OPENING, ""), CLOSING + r"\z", ""))
    cut = whole.select("doc_id", lines.alias("lines")).select("doc_id", _to_score(_paragraphs(F.col("lines")), model).alias("paragraphs"))
    every = materialize(cut.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "paragraphs"), "paragraphs")
    zero = F.lit(0).cast("long")
    without = every.filter(F.size("paragraphs") == 0).select("doc_id", F.lit("").alias("families"), zero.alias("n_cues"), zero.alias("n_licensed"), zero.alias("n_unknown"))
    some = every.filter(F.size("paragraphs") > 0)
    # few texts have paragraphs to score, but each gives many n-grams: spread them again, by their number
    base = some.repartition(max(8, some.count() // PART_ROWS), "rid")
    each = base.select("rid", "doc_id", F.posexplode("paragraphs").alias("at", "p")).select("rid", "doc_id", "at", "p.cued", "p.words")

    def of_length(k: int) -> Column:
        """Each k-gram once, and whether it is compared with templates. None for fewer words."""
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, k), " "))
        some = F.when(F.size("words") >= k, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
        return F.transform(some, lambda g: F.struct(g.alias("gram"), (F.least(F.size("words"), F.lit(COMPARED)) == k).alias("full")))

    made = [of_length(k) for k in range(1, NGRAM + 1)]
    # a null n-gram stands for a paragraph without words
    grams = each.select("rid", "doc_id", "at", "cued", F.explode_outer(F.concat(*made)).alias("g")).select("rid", "doc_id", "at", "cued", "g.gram", "g.full")
    joined = grams.join(F.broadcast(weights_table(docs.sparkSession, model)), "gram", "left")
    sums = [F.sum(F.coalesce(F.get("w", F.lit(c)), F.lit(0.0))).alias(f"w{c}") for c in range(n)]
    shared = [F.sum(F.when(F.col("full"), F.coalesce(F.get("t", F.lit(c)), F.lit(0)))).alias(f"t{c}") for c in range(n)]
    summed = joined.groupBy("rid", "doc_id", "at", "cued").agg(*sums, *shared, F.count(F.when(F.col("full"), 1)).alias("long"))
    z = [(F.col(f"w{c}") + float(model.bias[c])) / model.temperature for c in range(n)]
    # equal scores: the earlier class, as argmax takes it
    best = F.array_max(F.array(*[F.struct(z[c].alias("z"), F.lit(-c).alias("c"), F.lit(model.classes[c]).alias("name"), F.coalesce(F.col(f"t{c}"), F.lit(0)).alias("t")) for c in range(n)]))
    total = F.aggregate(F.array(*z), F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("best.z")))
    judged = summed.withColumn("best", best).withColumn("p", 1 / total)
    sure = (F.col("p") >= LEAST_PROBABILITY) & (F.col("best.t") >= LEAST_TEMPLATE * F.greatest(F.col("long"), F.lit(1)))
    name = F.when(F.col("best.name") == NONE, NONE).when(sure, F.col("best.name")).when(F.col("cued"), UNKNOWN).otherwise(NONE)
    named = judged.select("rid", "doc_id", "at", "cued", name.alias("name"))
    out = named.groupBy("rid", "doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("name").isin(NONE, UNKNOWN), F.col("name")))), ",").alias("families"),
        F.count(F.when(F.col("cued"), 1)).alias("n_cues"),
        F.count(F.when(~F.col("name").isin(NONE, UNKNOWN), 1)).alias("n_licensed"),
        F.count(F.when(F.col("name") == UNKNOWN, 1)).alias("n_unknown"),
    )
    return without.unionByName(out.drop("rid"))


def oracle(model: Model | None = None) -> str:
    """DuckDB SQL with the model's weights inlined, for scan() over ``documents`` (ids are unique there)."""
    model = model or trained()
    n = len(model.classes)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({quoted(g)}, {model.weights[i].tolist()}::DOUBLE[], {[int(g in model.template.get(c, ())) for c in model.classes]}::INT[])" for i, g in enumerate(model.vocabulary))
    stems = " OR ".join(f"contains(lower(text), {quoted(x)})" for x in STEMS)
    sums = ", ".join(f"sum(coalesce(m.w[{c + 1}], 0)) AS w{c}, sum(CASE WHEN k = n THEN coalesce(m.t[{c + 1}], 0) ELSE 0 END) AS t{c}" for c in range(n))
    z = ", ".join(f"(w{c} + {float(model.bias[c])!r}) / {model.temperature!r} AS z{c}" for c in range(n))
    top = "greatest(" + ", ".join(f"z{c}" for c in range(n)) + ")"
    total = " + ".join(f"exp(z{c} - top)" for c in range(n))
    pick = " ".join(f"WHEN z{c} = top THEN {quoted(model.classes[c])}" for c in range(n))
    shared = " ".join(f"WHEN z{c} = top THEN t{c}" for c in range(n))
    return f"""
WITH m(gram, w, t) AS (VALUES {rows}),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE {stems}),
bare AS (SELECT doc_id, pos, regexp_replace(regexp_replace(x, {quoted(OPENING)}, ''), {quoted(CLOSING + chr(92) + 'z')}, '') AS x FROM raw),
follow AS (SELECT *, lag(x, 1, '') OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM bare),
cut AS (SELECT *, CASE WHEN x <> '' AND y <> '' AND NOT regexp_matches(y, {quoted(STOP + chr(92) + 'z')}) AND (length(y) >= {WRAPPED} OR regexp_matches(x, {quoted(GOES_ON)})) THEN 0 ELSE 1 END AS new FROM follow),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM cut),
p AS (SELECT doc_id, para AS pos, string_agg(CASE WHEN ends_with(x, '-') THEN x ELSE x || ' ' END, '' ORDER BY pos) AS x FROM numbered WHERE x <> '' GROUP BY doc_id, para),
w AS (SELECT doc_id, pos, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(x), '[^a-z0-9.-]+', ' ', 'g'), '[.-]+( |$)', '\\1', 'g'), '( )[.-]+', '\\1', 'g'), '^[.-]+', '', 'g')), ' '), lambda v: v <> '') AS words FROM p),
g AS (SELECT DISTINCT doc_id, pos, k, least(len(words), {COMPARED}) AS n, array_to_string(words[i : i + k - 1], ' ') AS gram FROM w, range(1, {NGRAM + 1}) ks(k), LATERAL (SELECT unnest(range(1, len(words) - k + 2)) AS i)),
s AS (SELECT doc_id, pos, {sums}, count(*) FILTER (k = n) AS long FROM g LEFT JOIN m ON g.gram = m.gram GROUP BY ALL),
z AS (SELECT *, {z} FROM s),
b AS (SELECT *, {top} AS top FROM z),
v AS (SELECT doc_id, pos, long, CASE {pick} END AS name, CASE {shared} END AS t, 1 / ({total}) AS p FROM b),
d AS (SELECT doc_id, pos, regexp_matches(x, {quoted(CUE)}) AS cued, CASE WHEN name IS NULL OR name = '{NONE}' THEN '{NONE}' WHEN v.p >= {LEAST_PROBABILITY} AND t >= {LEAST_TEMPLATE} * greatest(long, 1) THEN name WHEN cued THEN '{UNKNOWN}' ELSE '{NONE}' END AS name FROM p LEFT JOIN v USING (doc_id, pos)),
o AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT name) FILTER (name NOT IN ('{NONE}', '{UNKNOWN}'))), ',') AS families, count(*) FILTER (cued) AS n_cues,
      count(*) FILTER (name NOT IN ('{NONE}', '{UNKNOWN}')) AS n_licensed, count(*) FILTER (name = '{UNKNOWN}') AS n_unknown FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(families, '') AS families, coalesce(n_cues, 0) AS n_cues, coalesce(n_licensed, 0) AS n_licensed, coalesce(n_unknown, 0) AS n_unknown
FROM documents LEFT JOIN o USING (doc_id)"""
