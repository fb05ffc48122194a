"""Full-text search over tables: tokenizer, match expressions and an inverted index.

Tokens are runs of letters and digits, case-folded and without diacritics; everything else
separates. The match language: ``a b`` (all of them), ``"a b"`` or ``a_b`` (phrase),
``a*`` (prefix), ``col:a`` or ``col:"a b"``, ``OR``, ``NOT``, ``AND``, parentheses,
``NEAR(a b, k)`` and ``^a`` (first token). An unquoted word with other characters in it is
an error, as in the usual text engines.

Scale: a search is one scan with JVM expressions only. Where many searches meet the same
table, ``inverted_index`` gives the (token, id) table to semi-join with.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

LIMIT = 100


def unmarked(text: str) -> str:
    """Lower case, decomposed, without marks: what data and queries are compared by."""
    return text.lower() if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c)[0] != "M")


@arrow_udf(StringType())
def _unmarked(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unmarked(t) for t in text.to_pylist()], pa.string())


def fold(text: Column) -> Column:
    """``unmarked`` as a column; only texts beyond ASCII leave the JVM."""
    wide = text.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_unmarked(F.when(wide, text)), F.lower(text))


def token_list(text: Column) -> Column:
    """All tokens in order."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_string(text: Column) -> Column:
    """Tokens joined and padded by blanks, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(token_list(text), " "), F.lit(" "))


class MatchSyntaxError(ValueError):
    """The match expression can't be read."""


@dataclass(frozen=True)
class _Token:
    kind: str
    text: str


_LEX = re.compile(r'\s*(?:(?P<near>NEAR)\s*\(|(?P<open>\()|(?P<close>\))|(?P<comma>,)|(?P<op>AND|OR|NOT)(?=[\s()]|$)|(?P<col>[A-Za-z_][A-Za-z0-9_]*)\s*:|(?P<phrase>"(?:[^"]|"")*")|(?P<caret>\^)|(?P<word>[\w]+)|(?P<star>\*))', re.UNICODE)


def _lex(query: str) -> list[_Token]:
    at, out = 0, []
    while query[at:].strip():
        m = _LEX.match(query, at)
        if not m:
            raise MatchSyntaxError(f"can't read the match expression at {query[at:at + 20]!r}")
        out.append(_Token(m.lastgroup or "", m.group(m.lastgroup)))
        at = m.end()
    return out


def _words(text: str) -> list[str]:
    """Tokens of a query, cut as ``token_list`` cuts the data."""
    letters = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in unmarked(text))
    return letters.split()


class _Parser:
    """Recursive descent over or > and > not > term, giving a Column."""

    def __init__(self, query: str, columns: list[str]) -> None:
        self.tokens, self.at, self.columns = _lex(query), 0, columns

    def peek(self) -> _Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> _Token:
        token = self.peek()
        if token is None:
            raise MatchSyntaxError("the match expression ends too early")
        self.at += 1
        return token

    def parse(self) -> Column:
        if not self.tokens:
            raise MatchSyntaxError("empty match expression")
        found = self.either()
        if self.peek():
            raise MatchSyntaxError(f"unexpected {self.peek().text!r}")
        return found

    def either(self) -> Column:
        left = self.all()
        while (t := self.peek()) and t.kind == "op" and t.text == "OR":
            self.take()
            left = left | self.all()
        return left

    def all(self) -> Column:
        left = self.term(self.columns)
        while (t := self.peek()) and t.kind not in ("close", "comma") and not (t.kind == "op" and t.text == "OR"):
            if t.kind == "op":
                self.take()
                right = self.term(self.columns)
                left = left & ~right if t.text == "NOT" else left & right
            else:
                left = left & self.term(self.columns)
        return left

    def term(self, columns: list[str]) -> Column:
        t = self.take()
        if t.kind == "open":
            inner = self.either()
            if self.take().kind != "close":
                raise MatchSyntaxError("a parenthesis is missing")
            return inner
        if t.kind == "col":
            if t.text not in self.columns:
                raise MatchSyntaxError(f"no such column: {t.text}")
            return self.term([t.text])
        if t.kind == "near":
            return self.near(columns)
        first = t.kind == "caret"
        if first:
            t = self.take()
        if t.kind not in ("phrase", "word"):
            raise MatchSyntaxError(f"unexpected {t.text!r}")
        words = _words(t.text)
        prefix = bool((n := self.peek()) and n.kind == "star")
        if prefix:
            self.take()
        if not words:
            return F.lit(False)
        needle = " " + " ".join(words) + ("" if prefix else " ")
        tests = [F.startswith(token_string(F.col(c)), F.lit(needle)) if first else F.contains(token_string(F.col(c)), F.lit(needle)) for c in columns]
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return out

    def near(self, columns: list[str]) -> Column:
        words, distance = [], 10
        while (t := self.take()).kind != "close":
            if t.kind == "comma":
                distance = int(self.take().text)
            elif t.kind in ("word", "phrase"):
                words.append(_words(t.text))
            else:
                raise MatchSyntaxError(f"unexpected {t.text!r}")
        if len(words) < 2 or any(len(w) != 1 for w in words):
            raise MatchSyntaxError("NEAR takes two or more single words")
        gap = r"(?: [^ ]+){0," + str(distance) + "} "
        either_way = "|".join(gap.join(re.escape(w[0]) for w in order) for order in (words, words[::-1]))
        tests = [F.rlike(token_string(F.col(c)), F.lit(f" (?:{either_way}) ")) for c in columns]
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return out


def matches(query: str, columns: list[str]) -> Column:
    """Whether a row matches; without column filter any of the columns may hold each term."""
    return _Parser(query, columns).parse()


def search(df: DataFrame, query: str, columns: list[str], row_id: str = "id", limit: int | None = LIMIT) -> DataFrame:
    """Matching rows, the first ``limit`` by id (ties by nothing: ids are unique)."""
    found = df.where(matches(query, columns))
    return found.orderBy(row_id).limit(limit) if limit is not None else found


def inverted_index(df: DataFrame, columns: list[str], row_id: str = "id") -> DataFrame:
    """(token, id), distinct, over all columns."""
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    return df.select(F.explode(F.array_distinct(token_list(text))).alias("token"), F.col(row_id).alias("id"))


def search_index(index: DataFrame, terms: list[str]) -> DataFrame:
    """Ids that hold all terms, by the index alone."""
    wanted = sorted({w for t in terms for w in _words(t)})
    hits = index.where(F.col("token").isin(*wanted)).groupBy("id").agg(F.count_distinct("token").alias("n"))
    return hits.where(F.col("n") == len(wanted)).select("id")
