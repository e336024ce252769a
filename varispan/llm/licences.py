"""Licence scan: sparse TF-IDF cosine of headers, notices and licence texts to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import reduce
from math import log, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Licence and the statement that names it; like all templates here a fixed value, so their tables are of known size.
STATEMENTS = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""
_GNU_NAMES = [("GPL-3.0", "GNU General Public License", 3, "29 June 2007"), ("GPL-2.0", "GNU General Public License", 2, "June 1991"), ("LGPL-3.0", "GNU Lesser General Public License", 3, "29 June 2007"), ("AGPL-3.0", "GNU Affero General Public License", 3, "19 November 2007")]
#: Notices, titles and texts of licences as they are published.
NOTICES = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", f"{_BSD}\n{_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_AS_IS}"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    *[(licence, _GNU.format(name=name, version=version)) for licence, name, version, _ in _GNU_NAMES],
    *[(licence, f"{name} Version {version}, {date}") for licence, name, version, date in _GNU_NAMES],
]
#: Tags of one line: the identifier itself.
_IDS = sorted({name for name, _ in STATEMENTS + NOTICES})
TAGS = [(name, f"SPDX-License-Identifier: {name}") for name in _IDS]
#: A template's place in this list is its number; the statements come first.
TEMPLATES = STATEMENTS + NOTICES + TAGS
CUES = ("licens", "copyright", "spdx", "released under", "public domain", "creative commons")
#: One word of each cue, for whole texts: a passage may be wrapped inside a cue of two words.
TEXT_CUES = ("licens", "copyright", "spdx", "released", "domain", "commons")
LEAST = 0.7
#: Words beside its licence lines up to which a file counts as its directory's licence file.
MOST_OTHER_WORDS = 120
#: Words at a template's begin that a passage must have to be compared to it.
ANCHOR = 3
_TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
PATH = "concat_ws('/', coalesce(source, '_'), case when doc_id % 7 <> 0 then coalesce(lang, '_') end, case when doc_id % 7 <> 0 and doc_id % 3 <> 0 then cast(doc_id div 500 as string) end, concat(coalesce(cast(doc_id as string), '_'), '.txt'))"


def _words(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower().replace("licenc", "licens"))


def template_weights() -> tuple[list[tuple[int, str, float]], list[tuple[str, float]], float]:
    """(template, token, weight / norm), (token, idf) and the idf of other tokens, over the templates.

    Counts are of the templates, not of the corpus: there a tag's own words are rarer than any name, and the tag of a
    licence that has no template would pass for one that has.
    """
    bags = [Counter(_words(text)) for _, text in TEMPLATES]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, bag in enumerate(bags):
        norm = sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(i, t, n * idf[t] / norm) for t, n in sorted(bag.items())]
    return rows, sorted(idf.items()), log(1 + len(bags)) + 1


def anchors() -> list[tuple[int, str, int]]:
    """(template, its first words, its number of words)."""
    return [(i, " ".join(_words(text)[:ANCHOR]), len(_words(text))) for i, (_, text) in enumerate(TEMPLATES)]


def _table(spark, rows, schema: str) -> DataFrame:
    """A small fixed table out of one literal."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ':') for c in schema.split(', '))}>>")))


def unit_scores(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, licence, score, line, span, words): cosine of each passage to its templates, where LEAST or more. ``files``: file, text.

    Passages are lines with a cue, held against every statement, and the words from each place where a template's first
    words stand, as many as the template has: those go on over line ends and comment signs. ``line`` tells the first kind, ``span`` is
    the passage's number of words and ``words`` that of the whole text.
    """
    spark = files.sparkSession
    rows, idf, rest = template_weights()
    weights, idfs = _table(spark, rows, "template int, token string, tw double"), _table(spark, idf, "token string, idf double")
    names = _table(spark, [(i, name) for i, (name, _) in enumerate(TEMPLATES)], "template int, licence string")
    has = lambda c, cues=CUES: reduce(lambda a, b: a | b, [c.contains(x) for x in cues])
    tokens_of = lambda c: F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))
    low = F.replace(F.lower("text"), F.lit("licenc"), F.lit("licens"))
    words = F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("words")
    texts = files.where(has(low, TEXT_CUES)).select("file", F.xxhash64("text").alias("body"), words, low.alias("low"), tokens_of(low).alias("t"))
    starts: dict[str, list[tuple[int, int]]] = {}
    for i, anchor, n in anchors():
        starts.setdefault(anchor, []).append((i, n))
    at = F.from_json(F.lit(json.dumps({a: [{"template": i, "n": n} for i, n in v] for a, v in starts.items()})), "map<string, array<struct<template:int, n:int>>>")
    lines = F.filter(F.transform(F.split("low", "\n"), lambda x, i: F.struct(F.lit(-1).alias("unit"), i.alias("at"), x.alias("x"))), lambda s: has(s["x"]))
    lines = F.transform(lines, lambda s: F.struct(s["unit"].alias("unit"), s["at"].alias("at"), tokens_of(s["x"]).alias("bag")))
    last = F.size("t") - ANCHOR
    begin = lambda i: F.array_join(F.slice("t", i + 1, ANCHOR), " ")
    places = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.map_contains_key("starts", begin(i))))
    passages = lambda i: F.transform(F.element_at("starts", begin(i)), lambda s: F.struct(s["template"].alias("unit"), i.alias("at"), F.slice("t", i + 1, s["n"]).alias("bag")))
    both = F.concat(lines, F.coalesce(F.flatten(F.transform(places, passages)), F.array().cast("array<struct<unit:int, at:int, bag:array<string>>>")))
    units = texts.withColumn("starts", at).select("file", "body", "words", F.inline(both))
    key = ["file", "body", "unit", "at"]
    tokens = units.select(*key, "words", F.size("bag").alias("span"), F.explode("bag").alias("token"))
    tokens = scratch.save(tokens.groupBy(*key, "token").agg(F.count("*").alias("n"), F.max("words").alias("words"), F.max("span").alias("span")), "tokens")
    # the tables are TEMPLATES' own, of known size
    tokens = tokens.join(F.broadcast(idfs), "token", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(rest)))
    norms = tokens.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.max("words").alias("words"), F.max("span").alias("span"))
    w = F.broadcast(weights.withColumnRenamed("token", "token_"))
    meets = (F.col("token") == F.col("token_")) & ((F.col("unit") == F.col("template")) | ((F.col("unit") < 0) & (F.col("template") < len(STATEMENTS))))
    dots = tokens.join(w, meets).groupBy(*key, "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, key).withColumn("score", F.round(F.col("dot") / F.col("norm"), 4)).where(F.col("score") >= LEAST)
    return scored.join(F.broadcast(names), "template").select("file", "body", "at", "licence", "score", (F.col("unit") < 0).alias("line"), "span", "words")


def scan(docs: DataFrame, path: str = PATH, file_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, path, licence, score, origin ('header', 'inherited' or null), from_dir.

    Passages of a text (``unit_scores``) are compared to templates: a file's header licence is that of its best passage of
    cosine LEAST or more, ties to the later name. A file named LICENSE, LICENCE or COPYING, or with no more than
    MOST_OTHER_WORDS words beside such passages, is its directory's licence file; of several the best score
    counts, then the later licence name. Files without a header inherit from the nearest directory above them, their own first.
    Null texts have no header; null ids keep a path of their own kind ('_'). Rows that share an id share a file, whose best
    passage may be in any of them. Rows come out as often as they came in; other columns are ignored; an empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "licences")
    base = docs.withColumn("_path", F.expr(path)).select(F.col(file_id).cast("long").alias("doc_id"), F.col("_path").alias("path"), F.col("text").cast("string").alias("text"))
    scores = unit_scores(base.select(F.col("path").alias("file"), "text"), scratch)
    lines = F.count_distinct(F.when(F.col("line"), F.struct("body", "at")))
    best = scores.groupBy("file").agg(F.max(F.struct("score", "licence")).alias("b"), lines.alias("lines"), F.max("span").alias("span"), F.max("words").alias("words"))
    best = scratch.save(best.select("file", "b.licence", "b.score", (F.col("words") - F.greatest(F.lit(12) * F.col("lines"), "span")).alias("others")), "headers")
    rows = base.select("doc_id", "path").join(best, F.col("path") == F.col("file"), "left").drop("file")
    folder = F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    name = F.upper(F.regexp_extract("path", r"(?s)([^/]*)$", 1))
    is_file = name.rlike(r"^(LICEN[CS]E|COPYING)(\..*)?$") | (F.col("others") <= MOST_OTHER_WORDS)
    known = rows.where(F.col("licence").isNotNull() & is_file).groupBy(folder.alias("dir")).agg(F.max(F.struct("score", "licence")).alias("b")).select("dir", F.col("b.licence").alias("dir_licence"), F.col("b.score").alias("dir_score"))
    # ancestors of each distinct directory, itself included, joined by path
    dirs = rows.where("licence is null").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))).alias("a")).select("dir", "a.depth", "a.up")
    near = above.join(known.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_licence", "dir_score")).alias("n"))
    near = near.select(F.col("dir").alias("own"), "n.up", "n.dir_licence", "n.dir_score")
    out = rows.withColumn("dir", folder).join(near, F.col("dir") == F.col("own"), "left")
    header = F.col("licence").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("licence", "dir_licence").alias("licence"), F.when(header, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        F.when(header, "header").when(F.col("dir_licence").isNotNull(), "inherited").alias("origin"), F.when(~header, F.col("up")).alias("from_dir"),
    )


def op6_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}" if isinstance(v, int) else f"{v!r}::double" for v in r) + ")" for r in rows)


def _sql() -> str:
    rows, idf, rest = template_weights()
    has = lambda c, cues=CUES: "(" + " or ".join(f"contains({c}, '{x}')" for x in cues) + ")"
    low = "replace(lower(text), 'licenc', 'licens')"
    toks = lambda c: rf"regexp_extract_all({c}, '[a-z0-9]+(?:\.[a-z0-9]+)*')"
    begins = ", ".join(sorted({f"'{a}'" for _, a, _ in anchors()}))
    starts = " || ' ' || ".join(f"t[i + {j}]" for j in range(ANCHOR))
    return rf"""
with weights(template, token, tw) as (values {_values(rows)}),
idfs(token, idf) as (values {_values(idf)}),
names(template, licence) as (values {_values([(i, n) for i, (n, _) in enumerate(TEMPLATES)])}),
anchors(template, anchor, n) as (values {_values(anchors())}),
base as (select doc_id, text, concat_ws('/', coalesce(source, '_'), case when doc_id % 7 <> 0 then coalesce(lang, '_') end, case when doc_id % 7 <> 0 and doc_id % 3 <> 0 then (doc_id // 500)::varchar end, coalesce(doc_id::varchar, '_') || '.txt') as path from documents),
texts as (select path, low, {toks('low')} as t, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) as words from (select path, text, {low} as low from base) where {has('low', TEXT_CUES)}),
lines as (select path, low as body, words, unnest(range(len(l))) as place, unnest(l) as x from (select path, low, words, string_split(low, chr(10)) as l from texts)),
places as (select path, low, words, t, unnest(list_filter(range(1, len(t) - {ANCHOR - 2}), lambda i: {starts} in ({begins}))) as i from texts),
units as (
  select path, body, words, -1 as unit, place, {toks('x')} as bag from lines where {has('x')}
  union all select path, low, words, template, i, t[i : i + n - 1] from places join anchors on anchor = {starts}),
toks as (select path, body, unit, place, token, words, span, count(*) as n from (select path, body, unit, place, words, len(bag) as span, unnest(bag) as token from units) group by all),
w as (select toks.*, n * coalesce(idf, {rest!r}) as w from toks left join idfs using (token)),
norms as (select path, body, unit, place, words, span, sqrt(sum(w * w)) as norm from w group by all),
dots as (select path, body, unit, place, template, sum(w * tw) as dot from w join weights on w.token = weights.token and (unit = template or unit < 0 and template < {len(STATEMENTS)}) group by all),
scored as (select path, body, unit, place, licence, words, span, round(dot / norm, 4) as score from dots join norms using (path, body, unit, place) join names using (template)),
headers as (select path, max({{'score': score, 'licence': licence}}) as b, max(words) - greatest(12 * count(distinct case when unit < 0 then {{'body': body, 'place': place}} end), max(span)) as others from scored where score >= {LEAST} group by 1),
r as (
  select doc_id, path, regexp_replace(path, '/[^/]*$', '') as dir, b.licence as licence, b.score as score,
    regexp_matches(upper(regexp_extract(path, '[^/]*$')), '^(LICEN[CS]E|COPYING)(\..*)?$') or others <= {MOST_OTHER_WORDS} as is_file
  from base left join headers using (path)),
known as (select dir, max({{'score': score, 'licence': licence}}) as b from r where licence is not null and is_file group by 1),
near as (
  select d.dir, max({{'depth': length(k.dir), 'up': k.dir, 'licence': k.b.licence, 'score': k.b.score}}) as n
  from (select distinct dir from r) d join known k on d.dir = k.dir or starts_with(d.dir, k.dir || '/') group by 1)
select doc_id, path, coalesce(licence, n.licence) as licence, case when licence is not null then score else n.score end as score,
  case when licence is not null then 'header' when n.licence is not null then 'inherited' end as origin, case when licence is null then n.up end as from_dir
from r left join near using (dir)
"""


SQL = _sql()
