"""License scans: units of a text against licence templates by the Dice coefficient of their word bigrams, in DataFrame operations only.

Units are the lines of a text, its sentences, its paragraphs (between blank lines), the whole of it, and runs: a template's run is a row of neighbouring sentences (lines end sentences, too), in each of which at least
LIKE of the bigrams are the template's; sentences of fewer than three words neither make nor break a run. So a licence of several paragraphs within a longer text is found, however its lines are broken.
A unit is normalised: lower case, all but letters and digits of ASCII as one space. Two sets of a and b bigrams can reach a Dice coefficient t only if min(a, b) >= t / (2 - t) * max(a, b): units
outside the bounds of all templates go before their bigrams are made, and a template is a candidate only for units within its own bounds. Within these bounds more than a known part of the template's
bigrams must be in the unit, so any unit that matches has one of some key words, chosen so that bigrams with such a word are more than the rest: texts without a key word go first.
The templates' bigrams are a table of fixed size, which each task has; a unit meets the templates it shares bigrams with.

A unit of one word has that word for its only bigram. Null and empty texts match nothing. Repeated rows each get the same result. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from importlib.resources import files

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import written

#: Notices as their licences word them. The whole licences are files in `licence_texts`.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-notice": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC0-1.0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}


def _whole_texts() -> dict[str, str]:
    found = files("provenant.llm").joinpath("licence_texts").iterdir()
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(found, key=lambda f: f.name)}


TEMPLATES = NOTICES | _whole_texts()
THRESHOLD = 0.8
#: Part of a sentence's bigrams that a template has, for the sentence to be in a run of it.
LIKE = 0.6


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(words: str) -> Column:
    return F.expr(f"array_distinct(if(size({words}) < 2, {words}, transform(sequence(0, size({words}) - 2), i -> concat({words}[i], ' ', {words}[i + 1]))))")


def _template_table(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """licence, size, grams: worked out once here, a row a template, as the key words are."""
    rows = [(name, len(grams := plain_bigrams(text)), sorted(grams)) for name, text in sorted(templates.items())]
    return docs.sparkSession.createDataFrame(rows, "licence string, size int, grams array<string>")


def bounds(size: int, threshold: float) -> tuple[float, float]:
    ratio = threshold / (2 - threshold)
    return size * ratio, size / ratio


def plain_bigrams(text: str) -> set[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return set(words[:1]) if len(words) < 2 else {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def key_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words one of which any unit has that reaches the threshold with a template.

    Of a template's m bigrams such a unit has at least t/2 (1 + t/(2-t)) m, so words are taken, those that stand in most bigrams first, until fewer than that many bigrams are without one. Words
    of six letters and more come before shorter ones, which are common in any text.
    """
    least = threshold / 2 * (1 + threshold / (2 - threshold))
    found: set[str] = set()
    for text in templates.values():
        grams = plain_bigrams(text)
        bare = {g for g in grams if not found & set(g.split())}
        while len(bare) >= least * len(grams):
            counts = Counter(w for g in bare for w in g.split())
            word = max(counts, key=lambda w: (len(w) >= 6, counts[w], w))
            found.add(word)
            bare = {g for g in bare if word not in g.split()}
    return sorted(found)


def any_of(words: list[str]) -> str:
    """A pattern of all words that tries each letter once: a plain list of some hundred words is tried word by word at each place of a text."""
    tails: dict[str, list[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    inner = "|".join(head + any_of(rest) for head, rest in sorted(tails.items()))
    if not inner or len(tails) == 1 and "" not in words:
        return inner
    return f"(?:{inner})" + ("?" if "" in words else "")


def _sentences(text: str) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r\f]+", "$1\n"), "\n")


def _once(docs: DataFrame, templates: dict[str, str], threshold: float, key: str, text: str) -> DataFrame:
    """doc_id, text_hash, text of each different row that has a key word."""
    word = f"(?<![a-z0-9])(?:{any_of(key_words(templates, threshold))})(?![a-z0-9])"
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return written(rows.filter(F.lower("text").rlike(word)).dropDuplicates(["doc_id", "text_hash"]), "licence-texts")  # read three times below


def _runs(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_hash, unit, licence, dice: the runs of two and more sentences of each template."""
    index = F.broadcast(known.select("licence", F.explode("grams").alias("gram")))
    pieces = docs.select("doc_id", "text_hash", F.explode(F.array(F.transform(_sentences("text"), normalised))).alias("pieces"))
    told = F.filter(F.transform("pieces", lambda p, i: F.struct(i.alias("pos"), F.split(p, " ").alias("words"))), lambda x: F.size(x["words"]) >= 3)
    rows = pieces.select("doc_id", "text_hash", F.posexplode(told).alias("i", "x")).select("doc_id", "text_hash", "i", "x.pos", F.explode(F.array(F.col("x.words"))).alias("words"))
    rows = rows.select("doc_id", "text_hash", "i", "pos", F.explode(F.array(bigrams("words"))).alias("grams"))
    like = (
        rows.select("doc_id", "text_hash", "i", "pos", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(index, "gram")
        .groupBy("doc_id", "text_hash", "i", "pos", "n", "licence").agg(F.count("*").alias("both")).filter(F.col("both") >= LIKE * F.col("n"))
    )
    place = F.row_number().over(Window.partitionBy("doc_id", "text_hash", "licence").orderBy("i"))
    runs = like.withColumn("run", F.col("i") - place).groupBy("doc_id", "text_hash", "licence", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).filter("first < last")
    same = F.expr("r.doc_id <=> p.doc_id and r.text_hash = p.text_hash")
    units = runs.alias("r").join(pieces.alias("p"), same).select("r.*", F.trim(F.regexp_replace(F.array_join(F.slice("pieces", F.col("first") + 1, F.col("last") - F.col("first") + 1), " "), " +", " ")).alias("unit"))
    units = units.select("doc_id", "text_hash", "licence", "unit", F.explode(F.array(F.split("unit", " "))).alias("words")).select("doc_id", "text_hash", "licence", "unit", F.explode(F.array(bigrams("words"))).alias("own"))
    met = units.join(F.broadcast(known), "licence")
    return met.select("doc_id", "text_hash", "unit", "licence", (F.lit(2.0) * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.col("size"))).alias("dice"))


def matches(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, unit (normalised), licence, dice: units that reach the threshold."""
    known = _template_table(docs, templates)
    sizes = [len(plain_bigrams(t)) for t in templates.values()]
    low, high = min(bounds(n, threshold)[0] for n in sizes), max(bounds(n, threshold)[1] for n in sizes)
    some = _once(docs, templates, threshold, key, text)
    parts = F.concat(F.split("text", "\n"), F.split("text", r"\n\s*\n"), _sentences("text"), F.array("text"))
    # bigrams repeat, words don't bound them from above: a unit of w words has w - 1 bigrams at most and needs `low` of them
    units = (
        some.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform(parts, normalised))).alias("unit"))
        .filter("unit <> ''")
        # exploded, not projected: a filter would otherwise be moved below and split each unit anew for every word
        .select("doc_id", "text_hash", "unit", F.explode(F.array(F.split("unit", " "))).alias("words"))
        .filter(F.greatest(F.lit(1), F.size("words") - 1) >= low)
        .select("doc_id", "text_hash", "unit", F.explode(F.array(bigrams("words"))).alias("grams"))
        .withColumn("n", F.size("grams"))
        .filter((F.col("n") >= low) & (F.col("n") <= high))
        .select("doc_id", "text_hash", "unit", "n", F.xxhash64("unit").alias("unit_hash"), F.explode("grams").alias("gram"))
    )
    index = known.select("licence", "size", F.explode("grams").alias("gram"))
    ratio = threshold / (2 - threshold)
    shared = (
        units.join(F.broadcast(index), "gram")
        .filter((F.least("n", "size") >= F.greatest("n", "size") * ratio))
        .groupBy("doc_id", "text_hash", "unit_hash", "n", "licence", "size")
        .agg(F.count("*").alias("both"), F.first("unit").alias("unit"))
    )
    found = shared.select("doc_id", "text_hash", "unit", "licence", (F.lit(2.0) * F.col("both") / (F.col("n") + F.col("size"))).alias("dice"))
    return found.filter(F.col("dice") >= threshold).unionByName(_runs(some, known).filter(F.col("dice") >= threshold)).distinct()


def scan(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licence (best, ties by name), dice, licences (comma-joined names of each unit's best match, sorted), n_matches (units and templates): one row for each row of `docs`."""
    found = matches(docs, templates=templates, threshold=threshold, key=key, text=text)
    each = found.groupBy("doc_id", "text_hash", "unit").agg(F.max_by("licence", F.struct("dice", "licence")).alias("licence"), F.max("dice").alias("dice"), F.count("*").alias("n"))
    best = each.groupBy("doc_id", "text_hash").agg(
        F.min_by("licence", F.struct(-F.col("dice"), "licence")).alias("licence"), F.max("dice").alias("dice"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"), F.sum("n").alias("n_matches"),
    )
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_hash") == F.col("b.text_hash"))
    return rows.join(best.alias("b"), same, "left").select("d.doc_id", "licence", "dice", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))


def oracle_sql() -> str:
    quoted = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in sorted(TEMPLATES.items()))
    norm = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
    grams = "list_distinct(case when len({0}) < 2 then {0} else list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]) end)"
    ratio = THRESHOLD / (2 - THRESHOLD)
    sentences = "string_split(regexp_replace({0}, '([.!?])[ \\t\\n\\r\\f]+', '\\1\n', 'g'), chr(10))"
    return f"""
with t as (select licence, {grams.format("w")} as g from (select licence, string_split({norm.format("body")}, ' ') as w from (values {quoted}) v(licence, body))),
tg as (select licence, unnest(g) as gram from t),
lim as (select min(len(g)) * {ratio} as low, max(len(g)) / {ratio} as high from t),
o as (select distinct doc_id, hash(text) as h, text from documents where text is not null),
u as (select distinct doc_id, h, {norm.format("unit")} as unit from (
  select doc_id, h, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n\\s*\\n'), {sentences.format("text")}, [text])) as unit from o)),
g as (select doc_id, h, unit, {grams.format("w")} as g from (select *, string_split(unit, ' ') as w from u where unit <> '')
      where greatest(1, len(w) - 1) >= (select low from lim)),
m1 as (select doc_id, h, unit, licence, 2.0 * cast(len(list_intersect(g.g, t.g)) as double) / (len(g.g) + len(t.g)) as dice
      from g, t where len(g.g) between (select low from lim) and (select high from lim)
      and least(len(g.g), len(t.g)) >= greatest(len(g.g), len(t.g)) * {ratio}),
pp as (select doc_id, h, list_transform({sentences.format("text")}, lambda x: {norm.format("x")}) as pieces from o),
pw as (select doc_id, h, pos, string_split(p, ' ') as w from (select doc_id, h, unnest(pieces) as p, unnest(range(len(pieces))) as pos from pp)),
pg as (select doc_id, h, pos, row_number() over (partition by doc_id, h order by pos) as i, {grams.format("w")} as g from pw where len(w) >= 3),
pl as (select doc_id, h, i, pos, n, licence, count(*) as both from (select doc_id, h, i, pos, len(g) as n, unnest(g) as gram from pg) join tg using (gram) group by all having count(*) >= {LIKE} * n),
r as (select doc_id, h, licence, min(pos) as first, max(pos) as last from (select *, i - row_number() over (partition by doc_id, h, licence order by i) as run from pl) group by doc_id, h, licence, run having min(pos) < max(pos)),
ru as (select r.doc_id, r.h, r.licence, trim(regexp_replace(array_to_string(pieces[first + 1:last + 1], ' '), ' +', ' ', 'g')) as unit from r join pp on r.doc_id is not distinct from pp.doc_id and r.h = pp.h),
rg as (select doc_id, h, licence, unit, {grams.format("w")} as g from (select *, string_split(unit, ' ') as w from ru)),
m as (select * from m1 where dice >= {THRESHOLD} union select doc_id, h, unit, licence, 2.0 * cast(len(list_intersect(rg.g, t.g)) as double) / (len(rg.g) + len(t.g)) as dice from rg join t using (licence) where 2.0 * cast(len(list_intersect(rg.g, t.g)) as double) / (len(rg.g) + len(t.g)) >= {THRESHOLD}),
e as (select doc_id, h, unit, arg_max(licence, (dice, licence)) as licence, max(dice) as dice, count(*) as n from m group by all),
b as (select doc_id, h, arg_min(licence, (-dice, licence)) as licence, max(dice) as dice, string_agg(distinct licence, ',' order by licence) as licences, sum(n) as n from e group by all)
select d.doc_id, b.licence, b.dice, coalesce(b.licences, '') as licences, cast(coalesce(b.n, 0) as bigint) as n_matches
from documents d left join b on d.doc_id is not distinct from b.doc_id and hash(d.text) = b.h
"""
