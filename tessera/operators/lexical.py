"""Keyword retrieval with BM25."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

#: The usual constants of BM25.
K1, B = 1.2, 0.75
AGGREGATORS = ("sum", "avg", "max")


@dataclass(frozen=True)
class KeywordQuery:
    """Phrases that must all occur, and terms of which one must."""

    required: tuple[str, ...]
    optional: tuple[str, ...]

    @classmethod
    def of(cls, text: str) -> KeywordQuery:
        """A phrase stands between quotes that white space or the ends surround; other quotes are white space, escaped ones letters."""
        if not isinstance(text, str):
            raise TypeError("a keyword query is a string")
        parts = re.split(r'(?<!\\)"', text)
        required, rest, k = [], [parts[0]], 1
        while k < len(parts):
            opens = not parts[k - 1] or parts[k - 1][-1:].isspace()
            closes = k + 1 < len(parts) and (parts[k + 1][:1].isspace() or not parts[k + 1])
            if opens and closes and parts[k].strip():
                required.append(parts[k].replace('\\"', '"'))
                rest.append(parts[k + 1])
                k += 2
            elif opens and k + 1 < len(parts):  # both quotes of a faulty pair go
                rest += [parts[k], parts[k + 1]]
                k += 2
            else:
                rest.append(parts[k])
                k += 1
        return cls(tuple(required), tuple(" ".join(rest).replace('\\"', '"').split()))

    @property
    def everything(self) -> bool:
        return not self.required and self.optional == ("*",)


def words_of(text: str) -> list[str]:
    """As functions.text.tokens, for a query."""
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def _tokens(field: str) -> Column:
    return F.col(f"tokens_{field}")


def with_tokens(docs: DataFrame, fields: Sequence[str], words: Sequence[Sequence[str]] = ()) -> DataFrame:
    """`docs` with the tokens of each field.  With `words`, only rows of which a field has all words of one of them as substrings, which is
    far faster to see than tokens are to make.
    """
    missing = [x for x in fields if x not in docs.columns]
    if missing:
        raise ValueError(f"no such text fields: {', '.join(missing)}")
    if not fields:
        return docs
    # A generated row is no expression that filters or projections above could take in: each text is cut once.
    def made(text, prefix: str) -> Column:
        return F.inline(F.array(F.struct(*(text(x).alias(f"{prefix}_{x}") for x in fields))))

    if not words:
        return docs.select("*", made(lambda x: X.tokens(F.col(f"`{x}`")), "tokens"))
    lowered = docs.select("*", made(lambda x: F.lower(F.coalesce(F.col(f"`{x}`"), F.lit(""))), "lower"))
    may = _any([reduce(lambda a, b: a & b, [F.col(f"`lower_{x}`").contains(w) for w in group]) for x in fields for group in words if group])
    return lowered.where(may).select(*docs.columns, made(lambda x: X.tokens(F.col(f"`lower_{x}`")), "tokens"))


def _times(field: str, term: str) -> Column:
    return F.size(F.filter(_tokens(field), lambda x: x == term))


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains(fields: Sequence[str], phrase: str) -> Column:
    """Whether a field has the words of `phrase` one after the other."""
    words = words_of(phrase)
    if not words:
        return F.lit(False)
    if len(words) == 1:
        return _any([F.array_contains(_tokens(x), words[0]) for x in fields])
    return _any([F.concat(F.lit(" "), F.array_join(_tokens(x), " "), F.lit(" ")).contains(f" {' '.join(words)} ") for x in fields])


def matches(query: KeywordQuery, fields: Sequence[str]) -> Column:
    """All required phrases, and one of the optional terms if there are any; `*` alone matches all, nothing matches none."""
    if query.everything:
        return F.lit(True)
    if not query.required and not query.optional:
        return F.lit(False)
    tests = [contains(fields, x) for x in query.required]
    if query.optional:
        tests.append(_any([contains(fields, x) for x in query.optional]))
    return reduce(lambda a, b: a & b, tests)


def statistics(tokened: DataFrame, fields: Sequence[str], terms: Sequence[str], *, df_scope: str = "fields") -> dict:
    """Rows, mean lengths by field over rows that have it, and documents by term: one row of sums reaches the driver.

    `df_scope` fields counts a document for a term if any of the fields has it, `field` for each field.
    """
    sums = [F.count("*").alias("n")]
    sums += [F.avg(F.when(F.col(f"`{x}`").isNotNull(), F.size(_tokens(x)))).alias(f"len_{k}") for k, x in enumerate(fields)]
    for j, term in enumerate(terms):
        has = [F.array_contains(_tokens(x), term) for x in fields]
        sums += [F.count_if(_any(has)).alias(f"df_{j}_any")] if df_scope == "fields" else [F.count_if(h).alias(f"df_{j}_{k}") for k, h in enumerate(has)]
    return tokened.agg(*sums).first().asDict()


def field_score(stats: dict, fields: Sequence[str], k: int, terms: Sequence[str]) -> Column:
    """BM25 of one field; the idf is that of all searched fields together or of the field, as the statistics are."""
    field, mean = fields[k], stats[f"len_{k}"] or 1.0
    score = F.lit(0.0)
    for j, term in enumerate(terms):
        n = stats[f"df_{j}_any"] if f"df_{j}_any" in stats else stats[f"df_{j}_{k}"]
        idf = F.log(F.lit(1 + (stats["n"] - n + 0.5) / (n + 0.5)))
        tf = _times(field, term).cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(_tokens(field)) / F.lit(float(mean))))
    return score


def bm25(docs: DataFrame, query: KeywordQuery, fields: Sequence[str], *, aggregator: str = "sum", df_scope: str = "fields", candidates: Column | None = None, within: DataFrame | None = None) -> DataFrame:
    """`docs` that match, with _score: BM25 over `fields`, summed, averaged over all searched fields, or the largest.

    Statistics are those of all of `docs`; `candidates` filters what is returned, and `within`, some of the rows of `docs`, is what
    is scored if it is given.  Two scans that cut each text once, and no shuffle.
    """
    if aggregator not in AGGREGATORS:
        raise ValueError(f"unknown aggregator {aggregator!r}; one of {', '.join(AGGREGATORS)}")
    fields = list(dict.fromkeys(fields))
    terms = [] if query.everything else [w for x in (*query.optional, *query.required) for w in words_of(x)]
    rows = docs if within is None else within
    rows = rows if candidates is None else rows.where(candidates)
    if query.everything or not terms:
        return (rows if query.everything else rows.where(F.lit(False))).withColumn("_score", F.lit(0.0)).select(*docs.columns, "_score")
    stats = statistics(with_tokens(docs.select(*(F.col(f"`{x}`") for x in fields if x in docs.columns)), fields), fields, terms, df_scope=df_scope)
    found = with_tokens(rows, fields, [words_of(x) for x in (*query.optional, *query.required)]).where(matches(query, fields))
    scores = [field_score(stats, fields, k, terms) for k in range(len(fields))]
    score = F.greatest(*scores) if aggregator == "max" and len(scores) > 1 else reduce(lambda a, b: a + b, scores)
    return found.withColumn("_score", score / len(fields) if aggregator == "avg" else score).select(*docs.columns, "_score")


def postings(docs: DataFrame, fields: Sequence[str], *, key: str = "_id") -> DataFrame:
    """The inverted index as a table: (field, term, key, tf, dl).  Written partitioned by field and bucketed by term it is read by term."""
    tokened = with_tokens(docs, fields)
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("field"), _tokens(x).alias("tokens")) for x in fields)))
    rows = tokened.select(key, each.alias("e")).select(key, "e.field", F.size("e.tokens").alias("dl"), F.explode("e.tokens").alias("term"))
    return rows.groupBy("field", "term", key).agg(F.count("*").alias("tf"), F.first("dl").cast("long").alias("dl"))
