"""License scans by a positional index of rare template words, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text in which A-Z are lower case: digits, a-z and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place counts, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices by which well-known licenses are given, with the phrases that must stand in each; * marks their ends.
TEMPLATES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the * GNU Affero General Public License * as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); * you may not use this file except in compliance with the License * You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 * Unless required by applicable law or agreed to in writing * software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Licensed under the * Apache License, Version 2.0"),
    ("bsd", "* Redistribution and use in source and binary forms * with or without modification, are permitted provided that the following conditions are met: * Redistributions of source code must retain the above copyright notice * this list of conditions and the following disclaimer. * Redistributions in binary form must reproduce the above copyright notice * this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "* Redistributions in binary form must reproduce the above copyright notice * this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. * Neither the name of * the copyright holder nor the names of its contributors may be used to * endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization * obtaining a copy of the software and accompanying documentation covered by this license * (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("cc-by", "This work is licensed under a * Creative Commons Attribution 4.0 * International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-nc", "Licensed under * CC BY-NC"),
    ("cc-by-nc", "This work is licensed under a * Creative Commons Attribution-NonCommercial * 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    ("cc-by-sa", "Licensed under * CC BY-SA"),
    ("cc-by-sa", "This work is licensed under a * Creative Commons Attribution-ShareAlike * 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    ("cc0", "The person who associated a work with this deed has * dedicated the work to the public domain * by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("epl-2.0", "This program and the accompanying materials are * made available under the terms of the Eclipse Public License * 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it * under the terms of the GNU General Public License * as published by the Free Software Foundation * either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-2.0", "This work is licensed under the * GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the * GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or * distribute this software for any purpose with or without fee is hereby granted * provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the * GNU Lesser General Public License * as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "* Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files * (the Software), * to deal in the Software without restriction * including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice * shall be included in all copies or substantial portions of the Software"),
    ("mpl-2.0", "This Source Code Form is * subject to the terms of the Mozilla Public License * v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is * free and unencumbered software released into the public domain * Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: * The origin of this software must not be misrepresented * you must not claim that you wrote the original software."),
)

#: Rarest words of a template that are looked up in a file, and how many words a place may be off its position in the template.
ROOTS, DRIFT = 6, 12


@dataclass
class Template:
    """A notice as words; needs: mandatory phrases with the position of their first word."""

    label: str
    words: list[str]
    needs: list[tuple[str, int]]

    @classmethod
    def parsed(cls, label: str, text: str) -> Template:
        """Words of text; of the parts between *, those at odd places are the mandatory phrases."""
        found: list[str] = []
        needs = []
        for i, part in enumerate(text.split("*")):
            own = re.findall("[0-9a-z]+", part.lower())
            if i % 2:
                needs.append((" ".join(own), len(found)))
            found += own
        return cls(label, found, needs)

    def places(self, word: str) -> list[int]:
        return [i for i, w in enumerate(self.words) if w == word]

    def must(self) -> list[str]:
        return sorted({w for phrase, _ in self.needs for w in phrase.split()})


def templates() -> list[Template]:
    return [Template.parsed(label, text) for label, text in TEMPLATES]


def vocabulary(known: list[Template]) -> list[str]:
    """Words of the templates and of the phrases: some hundreds."""
    return sorted({w for t in known for w in t.words} | {w for p, _ in PHRASES for w in p.split()})


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _once(x: Column, use) -> Column:
    """use(x) with x computed once: what a lambda reads from outside is computed again for each element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def with_words(df: DataFrame, vocab: list[str], text: str = "text") -> DataFrame:
    """Adds qm_w, the text's words (null: none), and qm_own, those of the vocabulary among them, each once.

    lower() is exact here: only words of ASCII letters are looked at, and the one other character that it turns into one of these
    (the Kelvin sign) is put out of the way. It changes nothing else about which characters are ASCII.
    """
    low = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("é")))
    parts = F.array_remove(F.split(low, GAP, -1), "")  # several times faster than to extract the words
    return df.withColumn("qm_w", parts).withColumn("qm_own", F.array_intersect("qm_w", _strings(vocab)))


def document_frequency(worded: DataFrame) -> dict[str, int]:
    """Number of texts that hold each word of the vocabulary. A row per such word goes to the driver, however many texts there are."""
    rows = worded.select(F.explode("qm_own").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def _window(first: Column, words: int) -> Column:
    """So many words of the text from `first` on, with DRIFT more on both sides."""
    return F.slice(F.col("qm_w"), F.greatest(first - DRIFT, F.lit(0)) + 1, F.lit(words + 2 * DRIFT))


def aligned(t: Template, frequency: dict[str, int]) -> Column:
    """The greatest share of the template's words that a proven place of it holds, null without one.

    The rarest mandatory word is looked up first: each of its places, less each of its positions in the template, is
    where the template may begin. Of the ROOTS rarest words of the template that the text has, half must stand at their
    position from there, give or take DRIFT words, and every mandatory phrase too. Nothing is looked up unless the text has all
    words of these phrases. The cost grows with the number of words and of the first word's places.
    """
    rare = lambda ws: sorted(set(ws), key=lambda w: (frequency.get(w, 0), w))
    ordered, must = rare(t.words), rare(t.must())
    own = F.col("qm_own")
    gate = (F.size(own) >= len(must)) & (F.size(F.array_intersect(_strings(must), own)) == len(must))
    postings = F.array(*[F.struct(F.lit(w).alias("w"), F.array(*[F.lit(q) for q in t.places(w)]).alias("at")) for w in ordered])
    roots = F.slice(F.filter(postings, lambda s: F.array_contains(own, s["w"])), 1, ROOTS)
    seen = F.filter(F.transform("qm_w", lambda x, i: F.when(x == must[0], i)), lambda i: i.isNotNull())
    begins = F.flatten(F.transform(seen, lambda p: F.array(*[p - q for q in t.places(must[0])])))

    def proven(begin: Column, chosen: Column) -> Column:
        stands = lambda s: F.exists(s["at"], lambda q: F.array_contains(_window(begin + q, 1), s["w"]))
        ok = F.size(F.filter(chosen, stands)) * 2 >= F.size(chosen)
        for phrase, q in t.needs:
            near = F.concat(F.lit(" "), F.array_join(_window(begin + q, len(phrase.split())), " "), F.lit(" "))
            ok = ok & near.contains(f" {phrase} ")
        return ok

    share = lambda begin: F.size(F.array_intersect(_strings(ordered), _window(begin, len(t.words)))) / F.lit(float(len(ordered)))
    best = _once(roots, lambda chosen: F.array_max(F.transform(F.filter(begins, lambda b: proven(b, chosen)), share)))
    return F.when(gate, best)


def licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base places, the first and last of them as word numbers from 0 (null: none) and base_labels come from PHRASES. labels
    adds those of TEMPLATES with a proven place. score is 1 with a base place, else the greatest share of a template's
    words at such a place, else 0. Null and empty texts have no word, no label and score 0; repeated rows fare alike,
    null doc_ids stay; other columns are ignored. An empty table gives no row. The whole text is read, and a text is one row
    throughout: nothing is exchanged but the counts of the templates' words.
    """
    known = templates()
    worded = with_words(docs.select("doc_id", "text"), vocabulary(known))
    frequency = document_frequency(worded)
    either = "|".join(p for p, _ in PHRASES)
    pattern = f"(?<= )(?:{either})(?= )"
    may = F.arrays_overlap("qm_own", _strings([p.split()[0] for p, _ in PHRASES]))
    worded = worded.withColumn("qm_line", F.when(may, F.concat(F.lit(" "), F.array_join("qm_w", " "), F.lit(" "))).otherwise(""))
    worded = worded.withColumn("qm_hits", F.regexp_extract_all("qm_line", F.lit(pattern), F.lit(0)))
    worded = worded.withColumn("qm_gaps", F.when(F.size("qm_hits") > 0, F.split("qm_line", pattern, -1)))
    # k words stand between k + 1 blanks.
    between = lambda gap: (F.char_length(gap) - F.char_length(F.replace(gap, F.lit(" "), F.lit(""))) - 1).cast("long")
    n, size = F.size("qm_w").cast("long"), F.size("qm_hits")
    last = F.size(F.split(F.element_at("qm_hits", -1), " ")).cast("long")
    found = [F.struct(F.lit(t.label).alias("label"), aligned(t, frequency).alias("share")) for t in known]
    base = reduce(lambda x, p: F.when(F.array_contains("qm_hits", p[0]), F.concat(x, F.array(F.lit(p[1])))).otherwise(x), PHRASES, F.array().cast("array<string>"))
    worded = worded.withColumn("qm_found", F.filter(F.array(*found), lambda s: s["share"].isNotNull())).withColumn("qm_base", base)
    return worded.select(
        "doc_id",
        n.alias("n_words"),
        size.cast("long").alias("n_base"),
        F.when(size > 0, between(F.get("qm_gaps", F.lit(0)))).alias("first_word"),
        F.when(size > 0, n - between(F.element_at("qm_gaps", -1)) - last).alias("last_word"),
        F.array_join(F.array_sort("qm_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("qm_base", F.transform("qm_found", lambda s: s["label"]))), ",").alias("labels"),
        F.when(size > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("qm_found", lambda s: s["share"])), F.lit(0.0))).alias("score"),
    )


def _values(rows: list[tuple]) -> str:
    text = lambda v: "[" + ", ".join(map(text, v)) + "]" if isinstance(v, list) else "'" + v + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def oracle() -> str:
    """The same in DuckDB's SQL: words as rows, postings and phrases as tables."""
    known = templates()
    words = [(i, w, q) for i, t in enumerate(known) for q, w in enumerate(t.words)]
    needs = [(i, p, q, len(p.split())) for i, t in enumerate(known) for p, q in t.needs]
    musts = [(i, w) for i, t in enumerate(known) for w in t.must()]
    about = [(i, t.label, len(t.words), len(set(t.words)), len(t.must())) for i, t in enumerate(known)]
    window = f"list_slice(w, greatest(b + q - {DRIFT}, 0) + 1, greatest(b + q - {DRIFT}, 0) + {2 * DRIFT} + {{}})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
phrases(phrase, label, len) AS (VALUES {_values([(p, label, len(p.split())) for p, label in PHRASES])}),
about(t, label, len, kinds, musts) AS (VALUES {_values(about)}),
posting(t, word, q) AS (VALUES {_values(words)}),
must(t, word) AS (VALUES {_values(musts)}),
need(t, phrase, q, len) AS (VALUES {_values(needs)}),
spot AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
base AS (SELECT r, p, label FROM (SELECT r, w, p, word FROM spot JOIN d USING (r) WHERE word IN (SELECT split_part(phrase, ' ', 1) FROM phrases)) a
         JOIN phrases ON array_to_string(list_slice(w, p + 1, p + len), ' ') = phrase),
own AS (SELECT DISTINCT r, word FROM spot WHERE word IN (SELECT word FROM posting)),
df AS (SELECT word, count(*) AS df FROM own GROUP BY word),
gated AS (SELECT r, t FROM own JOIN must USING (word) JOIN about USING (t) GROUP BY r, t, musts HAVING count(*) = musts),
rarest AS (SELECT t, arg_min(word, (coalesce(df, 0), word)) AS word FROM must LEFT JOIN df USING (word) GROUP BY t),
roots AS (SELECT r, t, word FROM (SELECT DISTINCT r, t, word, df FROM gated JOIN posting USING (t) JOIN own USING (r, word) JOIN df USING (word))
          QUALIFY row_number() OVER (PARTITION BY r, t ORDER BY df, word) <= {ROOTS}),
begins AS (SELECT DISTINCT r, t, a.p - o.q AS b FROM gated JOIN rarest USING (t) JOIN spot a USING (r, word) JOIN posting o USING (t, word)),
half AS (SELECT r, t, b FROM (SELECT r, t, b, word, bool_or(list_contains({window.format(1)}, word)) AS ok FROM begins JOIN roots USING (r, t) JOIN posting USING (t, word) JOIN d USING (r) GROUP BY r, t, b, word)
         GROUP BY r, t, b HAVING 2 * count(*) FILTER (WHERE ok) >= count(*)),
proven AS (SELECT r, t, b FROM half JOIN need USING (t) JOIN d USING (r) GROUP BY r, t, b
           HAVING bool_and(contains(' ' || array_to_string({window.format("len")}, ' ') || ' ', ' ' || phrase || ' '))),
share AS (SELECT r, label, len(list_intersect(list_distinct({window.replace(" + q", "").format("len")}), (SELECT list(DISTINCT word) FROM posting o WHERE o.t = x.t))) / CAST(kinds AS DOUBLE) AS share
          FROM proven x JOIN about USING (t) JOIN d USING (r)),
labels AS (SELECT r, label, share FROM share UNION ALL SELECT r, label, 1e0 FROM base)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first AS first_word, b.last AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(l.score, 0e0) AS score
FROM d LEFT JOIN (SELECT r, count(*) AS n, min(p) AS first, max(p) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r) b USING (r)
LEFT JOIN (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM labels GROUP BY r) l USING (r)"""
