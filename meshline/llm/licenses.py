"""Licence scans by sentence rules (operator 8), with DataFrame functions only.

Texts are normalised to lower-case words of a-z and 0-9. A known licence sentence is a run of words, so it is found however
its text is wrapped, numbered, indented or commented, and inside longer sentences; ``{}`` in it stands for a name of up to
``NAME_WORDS`` words. Each document's sequence of known sentences is matched against ordered licence rules: a rule matches
where its identifiers follow one another in the sequence (words that aren't part of known sentences don't count). Of rules
that start at the same place the longest one wins; matches inside a longer match are left out.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshline.llm.shared import table

#: Known licence sentences (normalised as ``normalised`` does, ``{}``: a name) and their identifiers.
SENTENCES: dict[str, str] = {
    # short notices
    "licensed under the apache license version 2 0": "ApacheNotice",
    "released under the mit license": "MITNotice",
    "licensed under the mit license": "MITNotice",
    "or the mit license": "MITNotice",
    "distributed under the mit license": "MITNotice",
    "released under the apache license version 2 0": "ApacheNotice",
    "distributed under the apache license version 2 0": "ApacheNotice",
    "this project is licensed under the mit license": "MITNotice",
    "licensed under cc by nc 4 0": "CCBYNC4Notice",
    "licensed under cc by 4 0": "CCBY4Notice",
    "licensed under cc by sa 4 0": "CCBYSA4Notice",
    "this work is licensed under the gnu general public license version 3": "GPL3Notice",
    "this work is licensed under the gnu general public license version 2": "GPL2Notice",
    # Apache header
    "licensed under the apache license version 2 0 the license": "ApacheHead",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheBasis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "licensed to the apache software foundation asf under one or more contributor license agreements": "ASFHead",
    "the asf licenses this file to you under the apache license version 2 0 the license": "ASFGrant",
    # MIT
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNoticeKept",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITAsIs",
    # BSD
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDHead",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDNames",
    "the name of {} may not be used to endorse or promote products derived from this software without specific prior written permission": "BSDNames",
    "this software is provided by {} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDAsIs",
    # GPL, LGPL and AGPL headers
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3Head",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2Head",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLHope",
    "see the gnu general public license for more details": "GPLSee",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21Head",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "LGPLHope",
    "see the gnu lesser general public license for more details": "LGPLSee",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3Head",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3Head",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3Head",
    "see the gnu affero general public license for more details": "AGPLSee",
    # others
    "to the extent possible under law {} has waived all copyright and related or neighboring rights to": "CC0Waiver",
    "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law": "CC0Deed",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2Head",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCAsIs",
    "this is free and unencumbered software released into the public domain": "UnlicenseHead",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseGrant",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "distributed under the boost software license version 1 0": "BoostNotice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2Notice",
}

#: Ordered rules; the identifiers of a rule follow one another.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("apache-2.0-header", "Apache-2.0", ("ApacheHead", "ApacheComply", "ApacheCopy", "ApacheBasis", "ApacheSee")),
    ("apache-2.0-short-header", "Apache-2.0", ("ApacheHead", "ApacheComply", "ApacheCopy")),
    ("apache-2.0-asf-header", "Apache-2.0", ("ASFHead", "ASFGrant", "ApacheComply", "ApacheCopy", "ApacheBasis", "ApacheSee")),
    ("apache-2.0-notice", "Apache-2.0", ("ApacheNotice",)),
    ("mit-text", "MIT", ("MITGrant", "MITNoticeKept", "MITAsIs")),
    ("mit-notice", "MIT", ("MITNotice",)),
    ("bsd-3-clause", "BSD-3-Clause", ("BSDHead", "BSDSource", "BSDBinary", "BSDNames")),
    ("bsd-3-clause-text", "BSD-3-Clause", ("BSDHead", "BSDSource", "BSDBinary", "BSDNames", "BSDAsIs")),
    ("bsd-2-clause-text", "BSD-2-Clause", ("BSDHead", "BSDSource", "BSDBinary", "BSDAsIs")),
    ("bsd-2-clause", "BSD-2-Clause", ("BSDHead", "BSDSource", "BSDBinary")),
    ("gpl-3.0-header", "GPL-3.0-or-later", ("GPL3Head", "GPLHope", "GPLSee")),
    ("gpl-2.0-header", "GPL-2.0-or-later", ("GPL2Head", "GPLHope", "GPLSee")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ("LGPL21Head", "LGPLHope", "LGPLSee")),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", ("LGPL3Head", "LGPLHope", "LGPLSee")),
    ("lgpl-3.0-program-header", "LGPL-3.0-or-later", ("LGPL3Head", "GPLHope", "LGPLSee")),
    ("cc0-1.0-waiver", "CC0-1.0", ("CC0Waiver",)),
    ("cc0-1.0-deed", "CC0-1.0", ("CC0Deed",)),
    ("agpl-3.0-header", "AGPL-3.0-or-later", ("AGPL3Head", "GPLHope", "AGPLSee")),
    ("isc-text", "ISC", ("ISCGrant", "ISCAsIs")),
    ("unlicense-text", "Unlicense", ("UnlicenseHead", "UnlicenseGrant")),
    ("zlib-text", "Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("bsl-1.0-notice", "BSL-1.0", ("BoostNotice",)),
    ("epl-2.0-notice", "EPL-2.0", ("EPL2Notice",)),
    ("gpl-3.0-notice", "GPL-3.0", ("GPL3Notice",)),
    ("gpl-2.0-notice", "GPL-2.0", ("GPL2Notice",)),
    ("mpl-2.0-header", "MPL-2.0", ("MPL2Head",)),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", ("CCBYNC4Notice",)),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", ("CCBYSA4Notice",)),
    ("cc-by-4.0-notice", "CC-BY-4.0", ("CCBY4Notice",)),
]

#: SPDX identifiers; each is known as a sentence and a rule of its own.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower()): f"Spdx {x}" for x in SPDX}
RULES += [(f"spdx-{x.lower()}", x, (f"Spdx {x}",)) for x in SPDX]

#: Words that a name in a sentence may have, at most.
NAME_WORDS = 16

#: Every known sentence of ``SENTENCES`` holds one of these; a text without them is not looked at further.
HINT = "licens|permission|redistribut|copyright|warrant|free software|unencumbered|sublicense|anyone is free|law"

#: Sentences before a match are counted in blocks of so many, so that counting stays linear.
BLOCK = 512


def normalised(text: Column) -> Column:
    """Lower-case words of a-z and 0-9, each with a blank of its own on either side, so that neighbours share none."""
    words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))


def sentence_pattern(sentence: str) -> str:
    """What a sentence looks like in a normalised text."""
    return "".join(f"(?: [a-z0-9]+ ){{1,{NAME_WORDS}}}?" if w == "{}" else f" {w} " for w in sentence.split())


def pattern(known: dict[str, str]) -> str:
    """All sentences as alternatives, by first words; of those that begin alike the longest one first."""
    by_first: dict[str, list[str]] = {}
    for s in sorted(known, key=lambda s: (-len(s.split()), s)):
        by_first.setdefault(s.split()[0], []).append(s)
    return "(?:" + "|".join(f" {first} (?:{'|'.join(sentence_pattern(s).removeprefix(f' {first} ') for s in group)})" for first, group in sorted(by_first.items())) + ")"


def _once(x: Column, use) -> Column:
    """``use(x)``, with ``x`` worked out once a row however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), 0)


def _words(part: Column) -> Column:
    """Words of a normalised part: each has two blanks."""
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan(df: DataFrame, known: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """One row per rule matched in a document: ``doc_id``, ``rule``, ``license``, ``first_word``, ``n_words``, ``n_sentences``.

    ``first_word`` counts the text's normalised words from 0; the span of ``n_words`` ends with the rule's last sentence,
    ``n_sentences`` is the rule's length. Sentences are taken from left to right without overlaps, at a word the longest
    one. Null, empty and blank texts match nothing, an empty table gives an empty one. Very long texts are scanned whole.
    Repeated rows are scanned each, and repeat their matches; null ids are kept; further columns, whatever their names, are
    ignored. The tables of sentences and rules are fixed and small, so they are literals of the plan.
    """
    known, rules = known or SENTENCES, rules or RULES
    wanted = df.select("doc_id", "text")
    if known is SENTENCES:
        wanted = wanted.filter(F.lower("text").rlike(HINT))
    look = pattern(known)
    plain = F.create_map(*[F.lit(x) for s, i in sorted(known.items()) if "{}" not in s for x in (sentence_pattern(s), i)])
    named = [(f"^{sentence_pattern(s)}$", i) for s, i in sorted(known.items(), key=lambda x: (-len(x[0].split()), x[0])) if "{}" in s]
    id_of = lambda m: F.coalesce(F.try_element_at(plain, m), *[F.when(m.rlike(p), F.lit(i)) for p, i in named])

    norm = wanted.withColumn("norm", normalised(F.col("text"))).filter(F.col("norm").rlike(look))
    cut = norm.select("doc_id", F.regexp_extract_all("norm", F.lit(look), F.lit(0)).alias("hits"), F.split("norm", look, -1).alias("gaps"))
    told = cut.select(
        "doc_id", F.transform("hits", lambda m, i: F.struct(id_of(m).alias("id"), _words(F.get("gaps", i)).alias("gap"), _words(m).alias("n"))).alias("seq"),
    )
    reach = max(len(want) for _, _, want in rules)

    def of(rule: tuple[str, str, tuple[str, ...]], seq: Column, i: Column) -> Column:
        name, licence, want = rule
        hit = reduce(and_, [F.get(seq, i + k)["id"] == w for k, w in enumerate(want)])
        return F.when(hit, F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("license"), F.lit(len(want)).alias("n"), i.alias("at")))

    def matched(seq: Column) -> Column:
        return F.transform(seq, lambda _, i: F.filter(F.array(*[of(r, seq, i) for r in rules]), lambda x: x.isNotNull()))

    def best(hits: Column) -> Column:
        longer = lambda y, x, j, i: (y["n"] > x["n"]) & (j + y["n"] >= i + x["n"])
        near = lambda i: F.sequence(F.greatest(F.lit(0), i - reach + 1), i)
        held = lambda x, i: F.exists(near(i), lambda j: F.exists(F.get(hits, j), lambda y: longer(y, x, j, i)))
        return F.flatten(F.transform(hits, lambda here, i: F.filter(here, lambda x: ~held(x, i))))

    def summed(seq: Column, first: Column, stop: Column) -> Column:
        """Words from the gap before sentence ``first`` to the end of the one before ``stop``."""
        some = F.when(first < stop, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(some, F.lit(0).cast("long"), lambda acc, j: acc + F.get(seq, j)["gap"] + F.get(seq, j)["n"])

    blocks = F.transform(F.sequence(F.lit(0), (F.size("seq") / BLOCK).cast("int")), lambda b: summed(F.col("seq"), b * BLOCK, F.least(F.size("seq"), (b + 1) * BLOCK)))
    found = told.withColumn("blocks", blocks).select("doc_id", "seq", "blocks", _once(_once(F.col("seq"), matched), best).alias("found"))

    def before(i: Column) -> Column:
        """Words up to the end of the sentences before ``i``."""
        b = (i / BLOCK).cast("int")
        whole = F.aggregate(F.when(b > 0, F.sequence(F.lit(0), b - 1)).otherwise(F.array().cast("array<int>")), F.lit(0).cast("long"), lambda acc, k: acc + F.get("blocks", k))
        return whole + summed(F.col("seq"), b * BLOCK, i)

    placed = F.transform("found", lambda x: F.struct(x.alias("x"), (before(x["at"]) + F.get("seq", x["at"])["gap"]).alias("first"), summed(F.col("seq"), x["at"], x["at"] + x["n"]).alias("words")))
    return found.select("doc_id", F.col("seq"), F.explode(placed).alias("h")).select(
        "doc_id", F.col("h.x.rule").alias("rule"), F.col("h.x.license").alias("license"), F.col("h.first").alias("first_word"),
        (F.col("h.words") - F.get("seq", F.col("h.x.at"))["gap"]).alias("n_words"), F.col("h.x.n").cast("long").alias("n_sentences"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in DuckDB: known sentences cut out of normalised texts, numbered per document, joined to the rules place by place."""
    esc = lambda s: "'" + s.replace("'", "''") + "'"
    ids = " ".join(f"WHEN regexp_full_match(m, {esc(sentence_pattern(s))}) THEN {esc(i)}" for s, i in sorted(SENTENCES.items(), key=lambda x: (-len(x[0].split()), x[0])))
    rules = ", ".join(f"({esc(n)}, {esc(lic)}, {k}, {esc(w)}, {len(want)})" for n, lic, want in RULES for k, w in enumerate(want))
    look = esc(pattern(SENTENCES))
    return rf"""
WITH rule_part(rule, license, k, id, n) AS (VALUES {rules}),
norm AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || replace(w, ' ', '  ') || ' ' END AS t
 FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS w FROM documents WHERE text IS NOT NULL)),
cut AS (SELECT r, doc_id, unnest(range(len(hits))) AS place, unnest(hits) AS m, unnest(gaps[1:len(hits)]) AS g FROM (SELECT r, doc_id, regexp_extract_all(t, {look}) AS hits, regexp_split_to_array(t, {look}) AS gaps FROM norm)),
one AS (SELECT r, doc_id, place, CASE {ids} END AS id, len(list_filter(string_split(m, ' '), lambda x: x <> '')) AS n, len(list_filter(string_split(g, ' '), lambda x: x <> '')) AS gap FROM cut),
ids AS (SELECT *, sum(gap + n) OVER (PARTITION BY r ORDER BY place) AS until FROM one),
hits AS (SELECT i.r, i.doc_id, p.rule, p.license, i.place - p.k AS place, any_value(p.n) AS n FROM ids i
  JOIN rule_part p ON i.id = p.id GROUP BY ALL HAVING count(*) = any_value(p.n))
SELECT h.doc_id, h.rule, h.license, (i.until - i.n)::BIGINT AS first_word, (e.until - i.until + i.n)::BIGINT AS n_words, h.n::BIGINT AS n_sentences FROM hits h
JOIN ids i ON i.r = h.r AND i.place = h.place JOIN ids e ON e.r = h.r AND e.place = h.place + h.n - 1
WHERE NOT EXISTS (SELECT 1 FROM hits g WHERE g.r = h.r AND g.n > h.n AND g.place <= h.place
  AND g.place + g.n >= h.place + h.n)"""
