"""Op 5, licence scans by a trained paragraph classifier.

A paragraph is a line of a text, or consecutive lines that a statement can be wrapped over: the
lines between its first and its last one have at most as many words as the longest statement,
and none of them is blank or without words. Of a long line windows are taken that hold every
statement in it whole. Word uni-, bi- and trigrams that occur in the templates
below are the sparse features of a softmax regression over licence families and an unknown
class. It is trained on the templates' statements, whole, cut and with words changed, and
on at most NEGATIVES lines of the corpus, an eighth as many that resemble statements but hold
none, statements with their words shuffled and denied ones as unknown; the least probability for a family is calibrated on held-out variants. A prediction
is confirmed by comparison with the family's templates: a statement's words must mostly
stand in the paragraph, in order; where another family's statement is held as well and longer, it
is that family's; where the words take the grant back ("not licensed under"), it is none. SPDX
identifiers are read as expressions: each family that one names is found. Only paragraphs that hold so many words of a statement that
this comparison can succeed are classified, so nothing is lost by leaving out the others.

Results: one row per document; n_paragraphs counts the lines that aren't blank, n_license the
lines that hold a statement alone, each once for a family, and the wrapped statements, each once for its family; null and empty texts have no paragraphs and no licence; rows
that repeat a doc_id get a result each; other columns are ignored; an empty table gives an
empty result. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common

#: Paragraphs of the corpus, chosen by a hash, that are shown as unknown.
NEGATIVES = 4000
#: Characters of such a line that the training sees.
SHOWN = 1000
#: Least share of a template statement's words that a paragraph must have, in order.
CONFIRMED = 0.7
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_ATOM = re.compile(r"[a-z0-9]+")

# Statements by which licences are granted, by family (fixed texts).
TEMPLATES = {
    "mit": (
        "Released under the MIT License", "Licensed under the MIT license", "This project is licensed under the terms of the MIT license", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "Released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License version 2", "Released under the GPL", "Licensed under GPLv3", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "GNU General Public License Version 3, 29 June 2007", "GNU General Public License Version 2, June 1991",
    ),
    "lgpl": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "GNU Lesser General Public License Version 3, 29 June 2007", "Licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU Affero General Public License Version 3, 19 November 2007",
        "Licensed under the GNU AGPL", "Licensed under AGPLv3",
        "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": (
        "Licensed under the BSD 3-Clause License", "Released under the BSD license", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "isc": (
        "Licensed under the ISC License", "Released under the ISC license", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "zlib": ("Licensed under the zlib License", "Released under the zlib/libpng license", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    "boost": ("Distributed under the Boost Software License, Version 1.0", "Licensed under the Boost Software License", "Boost Software License Version 1.0, August 17th, 2003"),
    "cddl": ("The contents of this file are subject to the terms of the Common Development and Distribution License", "Licensed under the Common Development and Distribution License"),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1", "Licensed under the SIL Open Font License"),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Released under the Creative Commons Attribution license"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC-SA 4.0"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "public-domain": ("This work is in the public domain", "Released into the public domain", "CC0 1.0 Universal Public Domain Dedication", "This is free and unencumbered software released into the public domain"),
    "proprietary": ("All rights reserved", "Copyright, all rights reserved", "No part of this publication may be reproduced without the prior written permission of the publisher"),
}
FAMILIES = tuple(TEMPLATES)
# Beginnings of SPDX identifiers and their families; the first that fits decides (fixed values).
SPDX = (
    ("AGPL-", "agpl"), ("LGPL-", "lgpl"), ("GPL-", "gpl"), ("MIT", "mit"), ("Apache-2", "apache-2.0"), ("BSD-", "bsd"), ("MPL-", "mpl"), ("EPL-", "epl"), ("ISC", "isc"), ("Zlib", "zlib"), ("BSL-", "boost"),
    ("CDDL-", "cddl"), ("OFL-", "ofl"), ("CC-BY-SA-", "cc-by-sa"), ("CC-BY-NC-", "cc-by-nc"), ("CC-BY-ND-", "cc-by-nd"), ("CC-BY-", "cc-by"), ("CC0-", "public-domain"), ("Unlicense", "public-domain"),
)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\- \t]+)", re.IGNORECASE)
#: What takes a grant back, if such a word follows as one of the next three.
_NEGATIONS = frozenset({"not", "never", "cannot", "isn", "aren", "wasn", "longer"})
_GRANTS = frozenset({"licensed", "licenced", "released", "distributed", "covered", "available", "under"})


def spdx_families(expression: str) -> list[str]:
    """The families that an SPDX expression names, whatever joins them; exceptions after WITH are none."""
    out, words = [], re.findall(r"[A-Za-z0-9.+-]+", expression)
    for n, word in enumerate(words):
        if word.upper() in ("AND", "OR", "WITH") or n and words[n - 1].upper() == "WITH":
            continue
        family = next((f for start, f in SPDX if word.lower().startswith(start.lower())), None)
        if family is None:
            if n and words[n - 1].upper() not in ("AND", "OR", "WITH"):
                break  # the expression has ended
        elif family not in out:
            out.append(family)
    return out


def spdx(text: str) -> list[tuple[int, str]]:
    """(line, family) of the identifiers in a text."""
    out, line, passed = [], 0, 0
    for m in _SPDX.finditer(text):
        line += text.count("\n", passed, m.start())
        passed = m.start()
        out += ((line, f) for f in spdx_families(m[1]))
    return out


def negated(words: list[str]) -> bool:
    """Whether the words say that a licence isn't granted."""
    return any(w in _NEGATIONS and not _GRANTS.isdisjoint(words[n + 1 : n + 4]) for n, w in enumerate(words))


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


STATEMENTS = [(i, word_list(t)) for i, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
#: Statements that take a grant back.
DENIALS = [before + w for _, w in STATEMENTS if w[0] in _GRANTS for before in (["not"], ["no", "longer"], ["is", "not"], ["isn", "t"])]
FEATURES = {g: n for n, g in enumerate(sorted(set().union(*(ngrams(w) for _, w in STATEMENTS), *(ngrams(w[:4]) for w in DENIALS))))}
LONGEST = max(len(w) for _, w in STATEMENTS)
#: For each run of letters and digits: the statements that have it, and how often.
ATOMS: dict[str, list[tuple[int, int]]] = defaultdict(list)
for _n, (_, _words) in enumerate(STATEMENTS):
    for _a, _c in Counter(a for w in _words for a in _ATOM.findall(w)).items():
        ATOMS[_a].append((_n, _c))
VOCABULARY = {w: n for n, w in enumerate(sorted({w for _, words in STATEMENTS for w in words}))}
COUNTS = [Counter(w) for _, w in STATEMENTS]
#: Words of a statement that no other family's statements have: a paragraph must hold one of them, if there are any.
OWN = [frozenset(w) - {x for f, words in STATEMENTS if f != g for x in words} for g, w in STATEMENTS]
#: How many of its words a paragraph must hold for a statement to be confirmed.
NEEDED = [next(n for n in range(len(w) + 1) if n / len(w) >= CONFIRMED) for _, w in STATEMENTS]
#: Lines with such words are shown to the training more densely; the scan doesn't use this.
_LIKELY = re.compile(r"licen[cs]e|spdx|rights reserved|public domain|permission|redistribut|compliance|copyright|gpl|cc0|mozilla|creative commons", re.IGNORECASE)


def vector(words: list[str]) -> tuple[np.ndarray, float]:
    """Indices of the paragraph's features, and the share of its words that are none."""
    grams = (" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return np.array(sorted({FEATURES[g] for g in grams if g in FEATURES}), int), float(np.mean([w not in FEATURES for w in words])) if words else 1.0


def _inputs(samples: list[list[str]]) -> np.ndarray:
    """A constant, the share of strange words, and the features, scaled by the paragraph's size."""
    x = np.zeros((len(samples), len(FEATURES) + 2))
    for row, words in zip(x, samples, strict=True):
        at, strange = vector(words)
        row[0], row[1] = 1, strange
        if len(at):
            row[2 + at] = 1 / np.sqrt(len(at))
    return x


def variants(seed: int, each: int) -> list[tuple[int, list[str]]]:
    """Statements with words around, cut at an end, or with a word changed."""
    rng = np.random.default_rng(seed)
    out = []
    for family, words in STATEMENTS:
        out.append((family, words))
        for _ in range(each):
            new = list(words)
            if len(new) > 5 and rng.random() < 0.3:
                new = new[: -int(rng.integers(1, 3))]
            if len(new) > 5 and rng.random() < 0.3:
                new[int(rng.integers(len(new)))] = f"w{rng.integers(1000)}"
            around = [f"w{rng.integers(1000)}" for _ in range(int(rng.integers(0, 5)))]
            cut = int(rng.integers(len(around) + 1))
            out.append((family, around[:cut] + new + around[cut:]))
    return out


def marks(frequency: Counter) -> dict[str, list[int]]:
    """For each statement letters and digits of which a paragraph that confirms it holds one at least, and its statements.

    A paragraph may lack len(statement) - NEEDED of the words, so it holds one of any len(statement) - NEEDED + 1; the
    rarest are taken. Of a word with a hyphen or dot the rarest part is taken, as it can be wrapped over lines.
    """
    out = defaultdict(list)
    for n, (_, words) in enumerate(STATEMENTS):
        parts = [min(_ATOM.findall(w), key=lambda a: (frequency[a], -len(a), a)) for w in words]
        parts.sort(key=lambda a: (frequency[a], -len(a), a))
        for part in set(parts[: len(words) - NEEDED[n] + 1]):
            out[part].append(n)
    return dict(out)


def possible(words: list[str], statements: set[int]) -> bool:
    """Whether the words can confirm one of the statements: they hold enough of its words, in any order."""
    have = Counter(w for w in words if w in VOCABULARY)
    return any(sum(min(c, have[w]) for w, c in COUNTS[n].items() if w in have) >= NEEDED[n] for n in statements)


class Model:
    def __init__(self, weights: np.ndarray, least: float, frequency: Counter):
        self.weights, self.least, self.marks = weights, least, marks(frequency)

    def probabilities(self, samples: list[list[str]]) -> np.ndarray:
        z = _inputs(samples) @ self.weights
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def families(self, paragraphs: list[str]) -> list[tuple[str, float, float] | None]:
        """The confirmed family of each paragraph, its probability and its confirmation."""
        if len(paragraphs) > 2000:
            return [x for i in range(0, len(paragraphs), 2000) for x in self.families(paragraphs[i : i + 2000])]
        samples = [word_list(p) for p in paragraphs]
        out = []
        for words, p in zip(samples, self.probabilities(samples), strict=True):
            best = int(np.argmax(p))
            held, many = compared(words, best) if best < len(FAMILIES) and p[best] >= self.least else (0.0, 0)
            if held < CONFIRMED or negated(words):
                out.append(None)
                continue
            for other in range(len(FAMILIES)):  # one statement within another: the paragraph's is the longer one
                share, more = compared(words, other) if other != best else (0.0, 0)
                if share >= held and more > many:
                    best, held, many = other, share, more
            out.append((FAMILIES[best], float(p[best]), float(held)))
        return out


def compared(words: list[str], family: int) -> tuple[float, int]:
    """Of the family's statement that the words hold most of, in order: the share, and the number of words."""
    best, there = (0.0, 0), np.array([VOCABULARY.get(w, -1) for w in words], int)
    have = Counter(words)
    for n, (f, statement) in enumerate(STATEMENTS):
        if f != family or OWN[n] and OWN[n].isdisjoint(have) or sum(min(c, have[w]) for w, c in COUNTS[n].items()) < max(1, best[0] * len(statement)):
            continue
        row = np.zeros(len(words) + 1, int)
        for w in statement:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(there == VOCABULARY[w], row[:-1] + 1, 0)))
        best = max(best, (float(row[-1] / len(statement)), int(row[-1])))
    return best


def confirmation(words: list[str], family: int) -> float:
    """The largest share of a statement of the family that the words hold in order (longest common subsequence)."""
    return compared(words, family)[0]


def train(negatives: list[str], seed: int = 7, steps: int = 400) -> Model:
    """Softmax regression by gradient steps; the threshold keeps unknown variants out and known ones in."""
    rng = np.random.default_rng(seed)
    known, held = variants(seed, 12), variants(seed + 1, 6)
    unknown = [word_list(p) for p in negatives] + [[str(x) for x in rng.permutation(words)] for _, words in STATEMENTS if len(words) > 3]
    unknown += DENIALS
    unknown += [[str(rng.choice(words)), *(f"w{rng.integers(1000)}" for _ in range(8))] for _, words in STATEMENTS for _ in range(4)]
    other = rng.random(len(unknown)) < 0.25  # held out for the threshold
    samples = [w for _, w in known] + [w for w, o in zip(unknown, other) if not o]
    y = np.array([f for f, _ in known] + [len(FAMILIES)] * (len(samples) - len(known)))
    x, target = _inputs(samples), np.eye(len(FAMILIES) + 1)[y]
    weight = 1 / np.bincount(y, minlength=len(FAMILIES) + 1)[y]
    weight = weight[:, None] / weight.mean()
    model = Model(np.zeros((x.shape[1], len(FAMILIES) + 1)), 0.5, Counter(a for p in negatives for a in set(_ATOM.findall(p.lower()))))
    speed = np.zeros_like(model.weights)
    for _ in range(steps):
        z = x @ model.weights
        e = np.exp(z - z.max(1, keepdims=True))
        step = x.T @ ((e / e.sum(1, keepdims=True) - target) * weight) / len(x) + 1e-5 * model.weights
        speed = 0.9 * speed + step
        model.weights -= 4.0 * speed
    right = model.probabilities([w for _, w in held])[np.arange(len(held)), [f for f, _ in held]]
    wrong = model.probabilities([w for w, o in zip(unknown, other) if o])[:, :-1].max(1) if other.any() else np.zeros(1)
    model.least = float(min(max(0.3, np.quantile(wrong, 0.995)), max(0.3, np.quantile(right, 0.02))))
    return model


def joined(lines: list[str]) -> str:
    return " ".join(lines).replace("- ", "-")


def statements(found: list[tuple[int, int, str, float, float]]) -> list[tuple[int, int, str, float, float]]:
    """Of (first line, last line, family, probability, confirmation), shorter ones first: every line found alone, and
    wrapped statements that share no line with a found one of their family. A statement that is held in part gives way
    to a wrapped one around it that holds more of another family's."""
    out, lines = [], set()
    for x in found:
        i, j, family, _, held = x
        if i == j and (family, i) in lines:
            continue  # another window of the line
        if i < j:
            if any((family, n) in lines for n in range(i, j + 1)):
                continue
            out = [y for y in out if not (i <= y[0] and y[1] <= j and y[4] < min(1, held))]
        out.append(x)
        lines.update((family, n) for n in range(i, j + 1))
    return out


class Finder:
    """Paragraphs of texts that can confirm a statement."""

    def __init__(self, marks: dict[str, list[int]]):
        self.marks = marks
        self.automaton = ahocorasick.Automaton()
        for mark in marks:
            self.automaton.add_word(mark, mark)
        self.automaton.make_automaton()

    def marked(self, text: str) -> dict[int, set[int]]:
        """By line of the text in lower case: the statements that a mark in it belongs to."""
        out, line, passed = {}, 0, 0
        for end, mark in self.automaton.iter(text):
            start = end + 1 - len(mark)
            if not (_alphanumeric(text[start - 1 : start]) or _alphanumeric(text[end + 1 : end + 2])):
                line += text.count("\n", passed, start)
                passed = start
                out.setdefault(line, set()).update(self.marks[mark])
        return out

    def paragraphs(self, text: str) -> list[tuple[int, int, str]]:
        """(first line, last line, words), fewer lines first: single lines and lines that a statement can be wrapped over."""
        lower = text.lower()
        marked = self.marked(lower)
        if not marked:
            return []
        lines, cut, known = lower.split("\n"), {}, {}

        def words(n: int) -> list[str]:
            if n not in cut:
                cut[n] = word_list(lines[n])
            return cut[n]

        def familiar(n: int) -> list[str]:
            if n not in known:
                known[n] = [a for a in _ATOM.findall(lines[n]) if a in ATOMS]
            return known[n]

        out = []
        for n, found in marked.items():
            for at in range(0, max(1, len(words(n)) - LONGEST), LONGEST):
                window = words(n)[at : at + 2 * LONGEST]
                if possible(window, found):
                    out.append((n, n, " ".join(window)))
        # a line between two others has a word at least, so a mark stands within so many lines of the first
        for i in sorted({i for n in marked for i in range(max(0, n - LONGEST - 1), n + 1)}):
            # a hyphen at a line's end ties its last word to the next line's first
            if not familiar(i):
                continue  # the lines without this one hold as much of a statement
            parts, found, inner, j = [], set(), 0, i
            have, held, enough = Counter(), Counter(), set()  # of runs, of a statement's runs, statements that may be there
            while j < len(lines) and words(j) and inner <= LONGEST:
                found |= marked.get(j, set())
                for a in familiar(j):
                    have[a] += 1
                    for n, most in ATOMS[a]:
                        if have[a] <= most:
                            held[n] += 1
                            if held[n] >= NEEDED[n]:
                                enough.add(n)
                tied = "-" if lines[j].rstrip().endswith("-") else ""
                if j > i and familiar(j) and not enough.isdisjoint(found):
                    group = joined([*parts, " ".join(words(j)[:LONGEST]) + tied])
                    if possible(_WORD.findall(group), found):
                        out.append((i, j, group))
                parts.append(" ".join(words(j)[-LONGEST:] if j == i else words(j)) + tied)
                inner += len(words(j)) if j > i else 0
                j += 1
        return sorted(out, key=lambda x: x[1] - x[0])


def _alphanumeric(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _scan(model: Model):
    schema = pa.schema([("k", pa.int64()), ("n_paragraphs", pa.int64()), ("n_license", pa.int64()), ("families", pa.string()), ("confidence", pa.float64())])

    def run(batches):
        finder = Finder(model.marks)
        seen: dict[str, tuple[str, float, float] | None] = {}
        for batch in batches:
            rows = []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                likely = finder.paragraphs(text)
                names = list(dict.fromkeys(p for _, _, p in likely))
                new = [p for p in names if p not in seen]
                if len(seen) > 50_000:
                    seen, new = {}, names
                seen.update(zip(new, model.families(new), strict=True) if new else ())
                named = [(n, n, f, 1.0, 1.0) for n, f in spdx(text)]
                found = statements(named + [(i, j, *seen[p]) for i, j, p in likely if seen[p] and not (named and i == j and any(i == x[0] for x in named))])
                rows.append((k, sum(bool(p.strip()) for p in text.split("\n")), len(found), ",".join(sorted({x[2] for x in found})), max((x[3] for x in found), default=None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def license_scan(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """Per row: doc_id, n_paragraphs, n_license, families (comma-joined, sorted) and the largest confidence."""
    base = common.keyed(docs)
    # samples of lines that resemble no statement and of lines that do but hold none: one line for each bucket of a hash, so that as many rows
    # as there are buckets come here from any corpus, of a long line its first SHOWN characters
    lines = base.select(F.explode(F.split("text", "\n")).alias("line")).withColumn("likely", F.col("line").rlike(f"(?i){_LIKELY.pattern}")).where("line <> ''")
    mine = F.xxhash64("line")
    bucket = F.when(F.col("likely"), F.pmod(mine, F.lit(max(1, negatives // 8)))).otherwise(F.pmod(F.shiftrightunsigned(mine, 8), F.lit(max(1, negatives))))
    sample = lines.where(F.col("likely") | (F.pmod(mine, F.lit(16)) == 0)).groupBy("likely", bucket.alias("bucket")).agg(F.min(F.substring("line", 1, SHOWN)).alias("line")).collect()
    shown = sorted(r["line"] for r in sample if not r["likely"])
    shown += sorted(r["line"] for r in sample if r["likely"] and max(confirmation(word_list(r["line"]), f) for f in range(len(FAMILIES))) < 0.5)
    out = base.select("k", "text").mapInArrow(_scan(train(shown)), "k long, n_paragraphs long, n_license long, families string, confidence double")
    return out.select(common.doc_id(), *out.columns[1:])


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))
