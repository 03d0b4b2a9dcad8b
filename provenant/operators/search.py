"""Ranked full-text search over titles and contents, on a table of postings.

Terms are runs of letters and digits, lower-cased, with the signs of letters that decompose left out (`ó` is `o`; `ł` stays). A query is built of phrases (of terms, the last of which may
be a prefix, in any or one column, anywhere or at its start) and of phrases near one another. Ranked search works on the tokens of each row: texts are taken apart once, and only what a query
found in a row, with the row's length, is kept and counted. Rank is negative, best first, ties by id. Boolean parts work on a table of tokens (term, doc, column, pos).

This module reads all texts for each query, for tables that are searched once; `index` has the same queries over a stored index that reads their terms alone.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_TERMS = 128
TERM = r"[\p{L}\p{N}\p{Co}]+"
K1, B = 1.2, 0.75


def _decomposing() -> tuple[str, str]:
    """Letters up to U+024F that Unicode takes apart into a letter and signs, and the letters left."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _decomposing()


def fold(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), _FROM, _TO)


def search_docs(artifacts: DataFrame, events: DataFrame, derived: DataFrame) -> DataFrame:
    """What can be found, as object_kind, object_id, title, content."""
    one = lambda df, kind, title, content: df.select(F.lit(kind).alias("object_kind"), F.col("id").alias("object_id"), title.alias("title"), content.alias("content"))
    return (
        one(artifacts, "artifact", F.col("original_name"), F.coalesce(F.col("mime_type"), F.lit("")))
        .unionByName(one(events, "event", F.col("event_type"), F.coalesce(F.col("body"), F.lit(""))))
        .unionByName(one(derived, "derived_text", F.col("kind"), F.coalesce(F.col("text"), F.lit(""))))
    )


def build_index(docs: DataFrame, key: str = "object_id", columns: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """term, doc, column, pos: one row for each token."""
    parts = [_tokens(docs, key, c) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def _tokens(docs: DataFrame, key: str, column: str) -> DataFrame:
    terms = F.regexp_extract_all(fold(F.coalesce(F.col(column), F.lit(""))), F.lit(TERM), F.lit(0))
    return docs.select(F.col(key).alias("doc"), F.lit(column).alias("column"), F.posexplode(terms).alias("pos", "term"))


def match_all(index: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with every term: one pass, one sum a document."""
    wanted = sorted({*terms})
    return index.filter(F.col("term").isin(*wanted)).groupBy("doc").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(wanted)).select("doc")


def match_any(index: DataFrame, terms: list[str]) -> DataFrame:
    return index.filter(F.col("term").isin(*terms)).select("doc").distinct()


def match(index: DataFrame, *, all: list[str] = (), any: list[str] = (), none: list[str] = ()) -> DataFrame:  # noqa: A002
    if len(all) + len(any) + len(none) > MOST_TERMS or not (all or any):
        raise ValueError(f"1 to {MOST_TERMS} terms, one of them to be found")
    found = match_all(index, list(all)) if all else match_any(index, list(any))
    if all and any:
        found = found.join(match_any(index, list(any)), "doc", "left_semi")
    return found.join(match_any(index, list(none)), "doc", "left_anti") if none else found


def match_phrase(index: DataFrame, terms: list[str]) -> DataFrame:
    """Start positions of terms that follow one another in a column: each position votes for where its phrase would start."""
    wanted = F.array(*map(F.lit, terms))
    starts = index.filter(F.col("term").isin(*{*terms})).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(terms) - 1)))).filter(F.element_at(wanted, F.col("i") + 1) == F.col("term"))
    return starts.groupBy("doc", "column", (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("n")).filter(F.col("n") == len(terms)).select("doc", "column", "start")


def match_prefix(index: DataFrame, prefix: str) -> DataFrame:
    return index.filter(F.col("term").startswith(prefix)).select("doc").distinct()


def match_near(index: DataFrame, first: str, second: str, between: int) -> DataFrame:
    """Documents where both terms stand in a column with at most `between` tokens between them. Positions meet by buckets of that width, not all by all."""
    width = between + 1
    bucket = F.floor(F.col("pos") / width)
    a = index.filter(F.col("term") == first).select("doc", "column", "pos", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("near"))
    b = index.filter(F.col("term") == second).select("doc", "column", F.col("pos").alias("pos2"), bucket.alias("near"))
    return a.join(b, ["doc", "column", "near"]).filter((F.abs(F.col("pos2") - F.col("pos")) - 1 <= between) & (F.col("pos2") != F.col("pos"))).select("doc").distinct()


def column_filter(index: DataFrame, column: str) -> DataFrame:
    return index.filter(F.col("column") == column)


def initial_token(index: DataFrame, term: str) -> DataFrame:
    return index.filter((F.col("term") == term) & (F.col("pos") == 0)).select("doc", "column").distinct()


class Phrase(NamedTuple):
    """Terms in a row; the last one may stand for all terms that start with it."""

    terms: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    initial: bool = False


class Near(NamedTuple):
    """Phrases in one column, each with at most `between` tokens between it and the first."""

    phrases: tuple[Phrase, ...]
    between: int = 10


COLUMNS = ("title", "content")


def _tokens_of(docs: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """doc, and the tokens of each column as an array."""
    terms = [F.regexp_extract_all(fold(F.coalesce(F.col(c), F.lit(""))), F.lit(TERM), F.lit(0)).alias(f"in_{c}") for c in columns]
    # exploded, not projected: each use of the tokens below would otherwise take the text apart anew
    return docs.select(F.col(key).alias("doc"), F.explode(F.array(F.struct(*terms))).alias("t")).select("doc", "t.*")


def _starts(phrase: Phrase, column: str) -> Column:
    """Where the phrase stands in a column: an array of positions."""
    tokens = F.col(f"in_{column}")
    places = F.array(F.lit(0)) if phrase.initial else F.sequence(F.lit(0), F.size(tokens) - 1)

    def here(i: Column) -> Column:
        fits = F.lit(True)
        for j, term in enumerate(phrase.terms):
            token = F.get(tokens, i + j)
            fits = fits & F.coalesce(token.startswith(term) if phrase.prefix and j == len(phrase.terms) - 1 else token == term, F.lit(False))
        return fits

    return F.when(F.size(tokens) > 0, F.filter(places, here)).otherwise(F.array().cast("array<int>"))


def _count(phrase: Phrase, columns: tuple[str, ...]) -> Column:
    return sum((F.size(_starts(phrase, c)) for c in columns if phrase.column in (None, c)), F.lit(0))


def _near(near: Near, columns: tuple[str, ...]) -> Column:
    first, *others = near.phrases
    found = F.lit(False)
    for c in columns:
        if any(p.column not in (None, c) for p in near.phrases):
            continue

        def close(i: Column, p: Phrase, c: str = c) -> Column:
            gap = lambda j: F.when(j > i, j - i - len(first.terms)).otherwise(i - j - len(p.terms))
            return F.exists(_starts(p, c), lambda j: (j != i) & (gap(j) >= 0) & (gap(j) <= near.between))

        found = found | F.exists(_starts(first, c), lambda i: reduce(lambda a, b: a & b, (close(i, p) for p in others), F.lit(True)))
    return found


def matched(docs: DataFrame, *, all: tuple = (), any: tuple = (), none: tuple = (), key: str = "object_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:  # noqa: A002
    """doc, len (tokens), counts (of each phrase that is to be found), hit: one row for each document. Parts are phrases and near groups: all of `all`, one of `any` if given, none of `none`."""
    phrases = phrases_of((*all, *any))
    if not phrases or len(phrases) + len(none) > MOST_TERMS:
        raise ValueError(f"1 to {MOST_TERMS} parts, one of them to be found")
    place = {p: i for i, p in enumerate(phrases)}
    rows = _tokens_of(docs, key, columns).withColumn("len", sum((F.size(f"in_{c}") for c in columns), F.lit(0)).cast("long"))
    rows = rows.withColumn("counts", F.explode(F.array(F.array(*(_count(p, columns) for p in phrases)))))
    said = lambda part: _near(part, columns) if isinstance(part, Near) else F.col("counts")[place[part]] > 0 if part in place else _count(part, columns) > 0
    hit = reduce(lambda a, b: a & b, map(said, all), F.lit(True))
    hit = hit & reduce(lambda a, b: a | b, map(said, any)) if any else hit
    hit = hit & ~reduce(lambda a, b: a | b, map(said, none)) if none else hit
    return rows.select("doc", "len", "counts", hit.alias("hit"))


def phrases_of(parts: tuple) -> list[Phrase]:
    return list(dict.fromkeys(p for part in parts for p in (part.phrases if isinstance(part, Near) else (part,))))


def bm25_part(n: Column, tf: Column, length: Column, n_docs: Column, mean: Column) -> Column:
    """What a phrase in `n` of `n_docs` documents, `tf` times in this one, adds to the rank."""
    idf = F.greatest(F.log((n_docs - n + 0.5) / (n + 0.5)), F.lit(1e-6))
    return -idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _part(n: Column, tf: Column) -> Column:
    return bm25_part(n, tf, F.col("len"), F.col("n_docs"), F.col("mean"))


def ranked(found: DataFrame) -> DataFrame:
    """doc, rank of the rows of matched() that are hits."""
    n = len(head[0]["counts"]) if (head := found.select("counts").head(1)) else 0
    if not n:
        return found.select("doc", F.lit(0.0).alias("rank")).limit(0)
    total = found.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean"), F.array(*(F.count_if(F.col("counts")[i] > 0) for i in range(n))).alias("ns"))
    scored = found.filter("hit").crossJoin(F.broadcast(total))  # total: one row
    return scored.select("doc", sum((_part(F.col("ns")[i], F.col("counts")[i]) for i in range(n)), F.lit(0.0)).alias("rank"))


def bm25(docs: DataFrame, terms: list[str], key: str = "object_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """doc, rank of all documents with any of the terms."""
    return ranked(matched(docs, any=tuple(Phrase((t,)) for t in sorted({*terms})), key=key, columns=columns))


def snippet(docs: DataFrame, terms: list[str], n: int = 24, key: str = "object_id", content: str = "content") -> DataFrame:
    """`key`, snippet: the `n` tokens of the content with most matches (the earliest such), an ellipsis where something is left out."""
    words = F.split(F.trim(F.regexp_replace(F.col(content), r"\s+", " ")), " ")
    base = docs.select(key, F.explode(F.array(words)).alias("words"))
    hit = F.transform("words", lambda w: F.exists(F.regexp_extract_all(fold(w), F.lit(TERM), F.lit(0)), lambda t: t.isin(*terms)).cast("int"))
    marked = base.select(key, "words", F.explode(F.array(hit)).alias("hits"))
    last = F.greatest(F.lit(0), F.size("words") - n)
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("hits", i) == 1) | (i == 0) | (i == last))
    best = F.array_max(F.transform(starts, lambda i: F.struct(F.aggregate(F.slice("hits", i + 1, n), F.lit(0), lambda s, h: s + h).alias("hits"), (-i).alias("at"))))
    found = marked.select(key, "words", F.explode(F.array(best)).alias("best")).select(key, "words", (-F.col("best.at")).alias("at"))
    text = F.array_join(F.slice("words", F.col("at") + 1, n), " ")
    return found.select(key, F.concat(F.when(F.col("at") > 0, "…").otherwise(""), text, F.when(F.col("at") + n < F.size("words"), "…").otherwise("")).alias("snippet"))


def search_page(docs: DataFrame, limit: int, *, all: tuple = (), any: tuple = (), none: tuple = (), key: str = "object_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:  # noqa: A002
    """The best documents that a query of phrases and near groups finds, with rank, place and has_more; a query without parts gives an empty page."""
    if not 1 <= limit <= 200:
        raise ValueError("a page has 1 to 200 rows")
    if not (all or any):
        found = docs.select(F.col(key).alias("doc"), F.lit(0.0).alias("rank")).limit(0)
    else:
        found = ranked(matched(docs, all=all, any=any, none=none, key=key, columns=columns))
    found = found.orderBy("rank", "doc").limit(limit + 1)
    order = Window.orderBy("rank", "doc")  # over limit + 1 rows
    return found.withColumn("place", F.row_number().over(order)).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit).filter(F.col("place") <= limit)
