"""Licence scan by a trained paragraph classifier, in DataFrame expressions only.

Paragraphs (lines, and windows of the words of blocks of lines) that hold a licence word or could be confirmed get n-gram
features: words and word pairs of a vocabulary. A sparse logistic regression over families and an unknown class, fitted on the
driver on NOTICES, CLAUSES and ORDINARY below, gives probabilities; the unknown class is calibrated on ordinary sentences held
back. A template (a notice, a clause or a licence's NAME) whose n-grams a paragraph holds by a given share confirms the family.

Notices that are wrapped over several lines are found in windows of the words of a block of lines (blocks are parted by blank
lines), whatever the width of the lines.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices by family: fixed values.
NOTICES = {
    "MIT": ["This project is distributed under the terms of the MIT License", "Licensed under MIT", "SPDX-License-Identifier: MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file", "The code is available under the MIT licence", "Published under an MIT license"],
    "Apache": ["Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0", "This module is Apache 2.0 licensed", "Distributed under the Apache Software License", "Code is made available under the Apache 2 license"],
    "GPL": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 2", "Released under GPLv3", "Distributed under the terms of the GNU GPL", "The program is covered by the GNU General Public License version 2 or later", "This file is licensed under the GNU General Public License"],
    "LGPL": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1", "SPDX-License-Identifier: LGPL-2.1-only", "Licensed under the LGPL version 3", "Released under the GNU LGPL", "The library may be used under the GNU Lesser General Public License", "Distributed under LGPLv2"],
    "AGPL": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the AGPL version 3", "Released under the GNU Affero General Public License", "The server is AGPLv3 licensed"],
    "BSD": ["BSD 3-Clause License", "Licensed under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license", "Released under the 2-clause BSD licence", "Distributed under the new BSD license"],
    "MPL": ["Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0", "Licensed under the MPL 2.0", "Released under the Mozilla Public License", "The contents of this file are subject to the Mozilla Public License Version 1.1", "Code is covered by the MPL"],
    "EPL": ["SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the EPL version 1.0", "Released under the Eclipse Public License"],
    "EUPL": ["SPDX-License-Identifier: EUPL-1.2", "Licensed under the EUPL", "Licensed under the European Union Public Licence version 1.1", "Released under the EUPL version 1.2"],
    "CDDL": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE Version 1.0", "SPDX-License-Identifier: CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License", "Licensed under the CDDL"],
    "Artistic": ["The Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0", "This package may be redistributed under the same terms as Perl itself, the Artistic License", "Released under the Perl Artistic License"],
    "Boost": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0", "Licensed under the Boost license"],
    "Zlib": ["SPDX-License-Identifier: Zlib", "Released under the zlib license", "This source is under the zlib/libpng license", "Licensed under the zlib licence"],
    "OFL": ["This Font Software is licensed under the SIL Open Font License, Version 1.1", "SPDX-License-Identifier: OFL-1.1", "The fonts are released under the SIL OFL", "Licensed under the Open Font License"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons BY-NC-SA 4.0", "Released under CC BY-NC", "SPDX-License-Identifier: CC-BY-NC-4.0", "Shared under a Creative Commons Attribution NonCommercial ShareAlike licence", "Content is available under CC BY-NC-ND 3.0"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "Text is available under CC BY-SA 4.0", "Released under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0", "Shared under a Creative Commons Attribution licence"],
    "CC0": ["CC0 1.0 Universal Public Domain Dedication", "Released under CC0", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights", "The data set is dedicated to the public domain under CC0"],
    "Unlicense": ["SPDX-License-Identifier: Unlicense", "Released under the Unlicense", "For more information, please refer to unlicense.org", "This is free and unencumbered software released into the public domain"],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC", "Released under the ISC licence", "Distributed under the Internet Systems Consortium license"],
    "Proprietary": ["Copyright (c) 2020 Example Corporation. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited", "No part of this publication may be reproduced without prior written permission", "This document contains confidential and proprietary information of the company", "Copyright 2019, all rights reserved by the publisher", "All rights are reserved. Redistribution is prohibited"],
}
#: Paragraphs of the licences' own texts by family: fixed values.
CLAUSES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/", "The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "You should have received a copy of the GNU Affero General Public License along with this program", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Covered Software means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form"],
    "EPL": ["THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE. ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."],
    "EUPL": ["You may not use this work except in compliance with the European Union Public Licence. Approved by the European Commission"],
    "Artistic": ["This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package"],
    "Boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "CC-BY-NC": ["You may not use the material for commercial purposes. You must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "CC-BY": ["You are free to share and adapt the material for any purpose, even commercially. You must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "CC0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "Unlicense": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
}
#: What licences are called, for the comparison with templates only: fixed values.
NAMES = {
    "MIT": ["MIT License"], "Apache": ["Apache License Version 2.0", "Apache License 2.0"], "GPL": ["GNU General Public License", "GNU General Public License version 3", "GPL version 3"], "LGPL": ["GNU Lesser General Public License"], "AGPL": ["GNU Affero General Public License"], "BSD": ["BSD License"],
    "MPL": ["Mozilla Public License"], "EPL": ["Eclipse Public License"], "EUPL": ["European Union Public Licence"], "CDDL": ["Common Development and Distribution License"], "Artistic": ["Artistic License"], "Boost": ["Boost Software License"], "Zlib": ["zlib License"], "OFL": ["Open Font License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial"], "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0"], "CC0": ["CC0 1.0"], "Unlicense": ["the Unlicense"], "ISC": ["ISC License"], "Proprietary": ["all rights reserved"],
}
#: Sentences that are no notice, most with a licence word: fixed values.
ORDINARY = [
    "He lost his driving licence last year.", "A fishing license costs ten pounds.", "You need permission from the owner to park here.", "The apache helicopter landed near the village.", "She asked for permission to leave the room.",
    "The public domain is a concept in law.", "The mozilla team met in spring.", "The warranty of my car has ended.", "Copyright law is taught in the second year.", "The GNU is a large antelope.", "A BSD conference was held in May.",
    "The MIT campus lies by the river.", "Redistribution of wealth was debated.", "The bar got its liquor license back.", "Poetic licence is allowed in a novel.", "The pilot showed a licence to the officer.", "We grant permission to film on Monday.",
    "The licence plate was green.", "They applied for a building permission.", "A creative common room for all students.", "Marriage licenses are issued at the town hall.", "The software was slow and the license dialog popped up.",
    "Which license should I choose for my project?", "Terms of the agreement were not published.", "The general public was free to enter.", "An attribution error in psychology", "Universal design is a field of work.", "The dog license fee rose again.", "His permission was not needed.", "Copyright is a word.",
    "The rights of all citizens were discussed in parliament.", "Two seats at the front were reserved for the guests.", "The company said that all tickets were sold within an hour.", "A reserved man, he kept all his thoughts to himself.", "Reserved parking is behind the theatre.", "She reserved a table for six people.", "The museum reserved all judgement on the painting.",
    "The minister spoke about human rights and free speech.", "Our train was late and all the coffee was gone.", "The eclipse of the sun could be seen from the island.", "The European Union agreed on a new budget for public works.", "Members of the union met the public on Sunday.", "The boost to the economy was small.", "An artistic director was named for the festival.", "The font on the sign was hard to read.",
    "A court in the common interest of trade and development", "The software company hired forty engineers.", "The source of the river lies in the hills.", "Free copies of the book were given to the first readers.", "The law firm made a copy of every document.", "The distribution of rain over the year is even.", "The council may not permit any use of the field without notice.", "A written notice was sent to each person.",
    "The foundation gave money to the public library.", "General terms are explained in the first chapter.", "The version shown on stage was shorter.", "The author of the work died in the war.", "The contract was void under the law of the land.", "The club is open to any person of good will.", "The conditions of the race were hard.", "Commercial flights were cancelled for two days.",
]
#: Licence words: a paragraph with one of them is listed, of whatever family.
LISTED = ("licen[cs][a-z]*", "sublicen[cs][a-z]*", "copyright[a-z]*", "permission[a-z]*", "public domain", "redistribut[a-z]*", "spdx", "creative commons", "cc0", "cc.by", "all rights reserved", "mozilla public", "[al]?gpl(?:v[0-9])?", "free software", "proprietary", "unlicense", "eupl", "cddl")
#: Words that ordinary text often holds: confirmable() takes them only where no others are enough.
COMMON = frozenset("0 1 2 3 4 a all any and are as at available be by except file following for from general have if in is it its kind later may mit more must no not note of on or other possible project public shall should such that the this to under use used version was which with without work you".split())
#: Words of the windows that slide over a block of lines by a quarter of their size; longer ones are added for longer templates.
WINDOW_WORDS = (8, 16, 32)
UNKNOWN = "unknown"
#: Words of a lower-cased text, as Python and as SQL says it.
WORDS, SQL_WORDS = r"[^\W_]+", r"[\p{L}\p{N}]+"
#: Parts of the table of n-grams, so that one is found among few.
PARTS = 512


def grams(text: str) -> set[str]:
    words = re.findall(WORDS, text.lower())
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


class LicenceModel:
    """vocabulary, families and weights (by n-gram, families in order, then unknown), bias, least probability, templates.

    texts: notices and clauses by family; names: further templates, not trained on.
    """

    def __init__(self, texts: dict[str, list[str]] | None = None, ordinary: list[str] | None = None, names: dict[str, list[str]] | None = None, features: int = 1500, epochs: int = 300):
        if texts is None:
            texts, names = {f: NOTICES[f] + CLAUSES.get(f, []) for f in NOTICES}, NAMES if names is None else names
        ordinary, names = ordinary or ORDINARY, names or {}
        self.families = [*sorted(texts), UNKNOWN]
        rows: list[tuple[set[str], int]] = []
        for family, own in sorted(texts.items()):
            for text in own:
                words = text.split()
                part = max(3, len(words) * 3 // 4)
                cuts = [text, f"note {text} see file", " ".join(words[:part]), " ".join(words[-part:])]
                cuts += [" ".join(words[k : k + 16]) for k in range(8, len(words) - 8, 12)]
                rows += [(grams(c), self.families.index(family)) for c in cuts]
        held = ordinary[::4]
        rows += [(grams(t), len(texts)) for t in ordinary if t not in held for _ in range(3)] + [(set(), len(texts))]
        found: dict[str, int] = {}
        for g, _ in rows:
            for x in g:
                found[x] = found.get(x, 0) + 1
        self.vocabulary = sorted(sorted(found, key=lambda x: (-found[x], x))[:features])
        place = {x: k for k, x in enumerate(self.vocabulary)}
        x = np.zeros((len(rows), len(place)))
        for k, (g, _) in enumerate(rows):
            own = [place[t] for t in g if t in place]
            x[k, own] = 1 / np.sqrt(max(1, len(own)))
        y = np.eye(len(self.families))[[c for _, c in rows]]
        weight = np.ones(len(self.families))
        weight[-1] = 3.0  # most paragraphs are of no family
        share = (weight / weight.sum() / y.sum(0))[y.argmax(1)][:, None]
        w, b, mw, mb = np.zeros((len(place), y.shape[1])), np.zeros(y.shape[1]), 0, 0
        for _ in range(epochs):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - y) * share
            mw, mb = 0.9 * mw - 10 * (x.T @ g + 2e-5 * w), 0.9 * mb - 10 * g.sum(0)
            w, b = w + mw, b + mb
        w[np.abs(w) < 0.05] = 0  # sparse
        self.weights, self.bias = w, b
        self.least = 0.5
        calibrate = [self.probabilities(t)[:-1].max() for t in held]  # a family must be likelier than it is for any of these
        self.least = float(min(0.8, max(0.5, max(calibrate, default=0.5) + 0.02)))
        self.templates = [(f, t) for f, own in sorted(texts.items()) for t in [*own, *names.get(f, [])]]

    def probabilities(self, text: str) -> np.ndarray:
        place = {x: k for k, x in enumerate(self.vocabulary)}
        own = [place[g] for g in grams(text) if g in place]
        z = self.weights[own].sum(0) / np.sqrt(max(1, len(own))) + self.bias
        p = np.exp(z - z.max())
        return p / p.sum()


def _alternatives(words: list[str]) -> str:
    """A pattern of plain words with common beginnings put first, so that a place is tried once a letter and not once a word."""
    ends, by = "" in words, {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    parts = [c + _alternatives(rest) for c, rest in sorted(by.items())]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)}){'?' if ends else ''}" if len(parts) > 1 or ends else parts[0]


def confirmable(model: LicenceModel, confirm: float = 0.6) -> list[str]:
    """Words of which every text holds one that holds at least the share `confirm` of some template's n-grams.

    Without these words, each template has too few n-grams left.
    """
    need: set[str] = set()
    listed = re.compile("|".join(LISTED))
    for found in sorted((grams(t) for _, t in model.templates), key=lambda g: (len(g), sorted(g))):
        open_ = {g for g in found if not any(listed.fullmatch(x) for x in g.split())}
        left = lambda: sum(not need.intersection(x.split()) for x in open_)
        for word in sorted((x for x in open_ if " " not in x and x not in need), key=lambda x: (x in COMMON, -len(x), x)):
            if left() == 0 or left() / len(found) < confirm:
                break
            need.add(word)
    return sorted(need)


def pattern(words: list[str]) -> str:
    """That a lower-cased text holds one of the words, or a licence word."""
    return f"(?<![\\p{{L}}\\p{{N}}])(?:{_alternatives(words)}|{'|'.join(LISTED)})(?![\\p{{L}}\\p{{N}}])"


LISTED_PATTERN = f"(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(LISTED)})(?![\\p{{L}}\\p{{N}}])"


def _literal(values: list) -> Column:
    return F.array(*[_literal(v) if isinstance(v, list) else F.lit(v) for v in values])


def paragraph_grams(paragraph: Column) -> Column:
    """Distinct words and word pairs, in SQL."""
    words = F.regexp_extract_all(F.lower(paragraph), F.lit(f"({SQL_WORDS})"), 1)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))))


def classify(paragraph: Column, model: LicenceModel, confirm: float = 0.6, joined: bool = False) -> Column:
    """struct(paragraph, family, probability, confirmed) of one paragraph.

    family is 'unknown' if that class is likeliest or no family reaches the calibrated probability. confirmed: a template of
    that family has at least the share `confirm` of its n-grams in the paragraph; if it is joined of
    lines, also one of the template's word pairs, as single words of a short template may lie scattered in it, and
    the struct has the share.
    """
    n = len(model.families)
    parts: list[dict] = [{} for _ in range(PARTS)]
    for x, row in zip(model.vocabulary, model.weights):
        parts[zlib.crc32(x.encode()) % PARTS][x] = [round(float(v), 6) for v in row]
    table = F.from_json(F.lit(json.dumps(parts)), "array<map<string,array<double>>>")
    weights = lambda x: F.element_at(F.get(table, (F.crc32(x.cast("binary")) % PARTS).cast("int")), x)
    known = lambda g: F.filter(F.transform(g, weights), lambda v: v.isNotNull())
    zero = _literal([0.0] * n)
    logits = lambda rows: F.zip_with(F.aggregate(rows, zero, lambda a, v: F.zip_with(a, v, lambda p, q: p + q)), _literal([float(b) for b in model.bias]), lambda s, b: s / F.sqrt(F.greatest(F.size(rows), F.lit(1))) + b)
    of: dict[str, list[list[str]]] = {f: [] for f in model.families}
    for f, t in model.templates:
        of[f].append(sorted(grams(t)))
    templates = F.from_json(F.lit(json.dumps(of)), "map<string,array<array<string>>>")
    share = lambda both, size: F.when(F.exists(both, lambda x: x.contains(" ")), F.size(both) / size).otherwise(0.0) if joined else F.size(both) / size
    most = lambda g, family: F.coalesce(F.array_max(F.transform(F.element_at(templates, family), lambda t: share(F.array_intersect(t, g), F.size(t)))), F.lit(0.0))

    def named(p: Column, g: Column) -> Column:
        best = F.element_at(_literal(model.families), F.array_position(p, F.array_max(p)).cast("int"))
        family = F.when((best != UNKNOWN) & (F.array_max(p) >= F.lit(model.least)), best).otherwise(UNKNOWN)
        told = paragraph.alias("paragraph"), family.alias("family"), F.array_max(p).alias("probability")
        return let(most(g, family), lambda v: F.struct(*told, (v >= F.lit(confirm)).alias("confirmed"), *([v.alias("share")] if joined else [])))

    def soft(z: Column) -> Column:
        e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    return let(paragraph_grams(paragraph), lambda g: let(known(g), lambda rows: let(logits(rows), lambda z: let(soft(z), lambda p: named(p, g)))))


def joined_windows(text: Column, model: LicenceModel) -> Column:
    """Windows of the words of each block of two lines or more, words parted by one space.

    A stretch of up to three quarters of a window lies whole in one. The marks with which lines of a comment begin are left out, so that
    they don't lengthen a notice.
    """
    longest = max(len(re.findall(WORDS, t.lower())) for _, t in model.templates)
    sizes = list(WINDOW_WORDS)
    while sizes[-1] * 3 / 4 < 1.5 * longest:  # a word between blanks may hold several of a template's, or the text have words of its own
        sizes.append(2 * sizes[-1])

    def slid(words: Column, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(words) - n) * 4 / n).cast("int"), F.lit(0)))
        return F.transform(starts, lambda k: F.array_join(F.slice(words, k * (n // 4) + 1, n), " "))

    def windows(block: Column) -> Column:
        words = F.regexp_extract_all(block, F.lit(r"(\S*[A-Za-z0-9]\S*)"), 1)
        return let(words, lambda w: F.flatten(F.array(*[slid(w, n) for n in sizes])))

    blocks = F.filter(F.split(text, r"\r?\n[ \t]*\r?\n"), lambda b: F.trim(b).contains("\n"))
    return F.array_distinct(F.flatten(F.transform(blocks, windows)))


def let(value: Column, body) -> Column:
    """body of the value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan_licences(docs: DataFrame, model: LicenceModel | None = None, text: str = "text", into: str = "licences", confirm: float = 0.6) -> DataFrame:
    """docs plus an array of structs (paragraph, family, probability, confirmed), one for each line with a licence word
    and for each other line that is confirmed. A family that no line confirms, but joined lines of a block do, has one more: its
    most probable window.

    Null and empty texts and texts without such a line get an empty array. A column called `into` is replaced; repeated rows
    get equal arrays. One scan, no shuffle, no Python on the executors.
    """
    model = model or LicenceModel()
    could = pattern(confirmable(model, confirm))
    lines = F.filter(F.split(F.col(text), "\n"), lambda p: F.lower(p).rlike(could))
    found = F.filter(F.transform(lines, lambda p: classify(p, model, confirm)), lambda x: x["confirmed"] & (x["family"] != UNKNOWN) | F.lower(x["paragraph"]).rlike(LISTED_PATTERN))
    windows = F.filter(joined_windows(F.col(text), model), lambda p: F.lower(p).rlike(could))
    sure = F.filter(F.transform(windows, lambda p: classify(p, model, confirm, joined=True)), lambda x: x["confirmed"] & (x["family"] != UNKNOWN))
    # a window that cuts a notice short gives way to one that holds it and more
    cut = lambda x, xs: F.exists(xs, lambda y: (y["family"] != x["family"]) & (y["share"] > x["share"]) & y["paragraph"].contains(x["paragraph"]))
    sure = let(sure, lambda xs: F.transform(F.filter(xs, lambda x: ~cut(x, xs)), lambda x: x.dropFields("share")))
    best = lambda xs, f: F.reduce(F.filter(xs, lambda x: x["family"] == f), F.element_at(F.filter(xs, lambda x: x["family"] == f), 1), lambda a, x: F.when(x["probability"] > a["probability"], x).otherwise(a))
    more = lambda lines, xs: F.transform(F.array_except(F.array_distinct(xs["family"]), F.filter(lines, lambda x: x["confirmed"])["family"]), lambda f: best(xs, f))
    found = let(found, lambda lines: let(sure, lambda xs: F.concat(lines, more(lines, xs))))
    nothing = F.array().cast("array<struct<paragraph:string,family:string,probability:double,confirmed:boolean>>")
    return docs.withColumn(into, F.when(F.lower(F.col(text)).rlike(could), found).otherwise(nothing))


def family(licences: Column) -> Column:
    """A document's licence: the most probable confirmed family, else 'unknown' if a line has a licence word, else 'none'."""
    sure = F.filter(licences, lambda x: x["confirmed"] & (x["family"] != UNKNOWN))
    best = F.aggregate(sure, F.struct(F.lit(-1.0).alias("p"), F.lit("").alias("f")), lambda a, x: F.when(x["probability"] > a["p"], F.struct(x["probability"].alias("p"), x["family"].alias("f"))).otherwise(a))
    return F.when(F.size(sure) > 0, best["f"]).when(F.size(licences) > 0, F.lit(UNKNOWN)).otherwise(F.lit("none"))
