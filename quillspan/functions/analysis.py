"""Analyzers: how a text becomes terms, once as column expressions for the
corpus and once as plain Python for the few words of a query.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"
NON_SPACE = r"\S+"


def _folds() -> tuple[str, str]:
    """Letters with marks, and the ASCII letters without."""
    pairs = []
    for i in range(0x80, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            pairs.append((chr(i), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@dataclass(frozen=True)
class Analyzer:
    """Character filters, a tokenizer (a pattern of tokens; None: the whole value is one) and token filters, in this order.

    Patterns are such that Java and Python read them alike. A stop word leaves a
    hole at its position. Synonyms stand at the position of their term.
    position_gap and offset_gap lie between the values of a field with many.
    """

    pattern: str | None = WORDS
    lowercase: bool = True
    fold: bool = False
    char_filters: tuple[tuple[str, str], ...] = ()
    replacements: tuple[tuple[str, str], ...] = ()
    stops: frozenset[str] = frozenset()
    synonyms: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    position_gap: int = 0
    offset_gap: int = 1

    # As columns

    def filtered(self, text: Column) -> Column:
        for pattern, into in self.char_filters:
            text = F.regexp_replace(text, pattern, into)
        return text

    def raw_tokens(self, text: Column) -> Column:
        """The tokens of a (filtered) text as they stand in it."""
        if self.pattern is None:
            return F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def between(self, text: Column) -> Column:
        """What stands before, between and after the tokens of a (filtered) text."""
        if self.pattern is None:
            return F.when(F.length(text) > 0, F.array(F.lit(""), F.lit(""))).otherwise(F.array(text))
        return F.split(text, self.pattern, -1)

    def term(self, token: Column) -> Column:
        """The term of a token; null for a stop word and for what the filters leave empty."""
        if self.lowercase:
            token = F.lower(token)
        if self.fold:
            token = F.translate(token, *_folds())
        for pattern, into in self.replacements:
            token = F.regexp_replace(token, pattern, into)
        if not (self.replacements or self.stops):
            return token
        return F.when(~token.isin("", *self.stops), token)

    # For queries

    def _term(self, token: str) -> str:
        token = self.normalize(token)
        for pattern, into in self.replacements:
            token = regex.sub(pattern, regex.sub(r"\$(\d)", r"\\\1", into), token)
        return token

    def normalize(self, text: str) -> str:
        """The text of a prefix, wildcard, range, regular expression or fuzzy term: letters change, nothing is cut."""
        if self.lowercase:
            text = text.lower()
        return text.translate(str.maketrans(*_folds())) if self.fold else text

    def analyze(self, text: str) -> list[tuple[int, tuple[str, ...]]]:
        """(position, terms) of the tokens of a text."""
        for pattern, into in self.char_filters:
            text = regex.sub(pattern, regex.sub(r"\$(\d)", r"\\\1", into), text)
        tokens = [text] * bool(text) if self.pattern is None else [m[0] for m in regex.finditer(self.pattern, text)]
        terms = [self._term(t) for t in tokens]
        return [(k, (t, *self.synonyms.get(t, ()))) for k, t in enumerate(terms) if t and t not in self.stops]


ENGLISH_STOPS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
