"""Segmentation and tokenising as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import LEXICAL_STOP_WORDS, TERM_STOP_WORDS

_NOT_WORD = r"[^\p{L}\p{N}_]+"
#: Unicode's white space, which is what (?U)\s matches.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end (trim takes spaces only). A regular expression would try every character of the text."""
    return F.btrim(c, F.lit(_SPACE))


def tokenize(c: Column) -> Column:
    """Lower-case ASCII words that begin with a letter; a word that touches any other letter, digit or _ is none."""
    return F.filter(F.split(F.lower(c), _NOT_WORD), lambda x: x.rlike("^[a-z][a-z0-9]*$"))


def normalize_tokens(c: Column, stop_words: Iterable[str] = LEXICAL_STOP_WORDS) -> Column:
    """Lower-case words without punctuation, stop words and single characters."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.filter(words, lambda x: (F.length(x) > 1) & ~x.isin(sorted(stop_words)))


def line_sentences(c: Column) -> Column:
    """Stripped, lower-case lines of more than 10 characters: what contexts are taken from."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.lower(strip(x))), lambda x: F.length(x) > 10)


def sentence_units(c: Column) -> Column:
    """Stripped lines; for texts of fewer than 5, sentences of more than 10 characters if those are more."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    sentences = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda x: F.length(x) > 10)
    return F.when((F.size(lines) < 5) & (F.size(sentences) > F.size(lines)), sentences).otherwise(lines)


def is_stop_word(c: Column, stop_words: Iterable[str] = TERM_STOP_WORDS) -> Column:
    return c.isin(sorted(stop_words))


def clean(c: Column) -> Column:
    """Line breaks as spaces, stripped; of a text of white space nothing is left."""
    return strip(F.translate(c, "\n", " "))


def clean_for_embedding(c: Column) -> Column:
    """The cleaned text; an empty one is an error."""
    return F.when(clean(c) == "", F.raise_error(F.lit("empty text can't be embedded"))).otherwise(clean(c))


def title_case(c: Column) -> Column:
    return F.initcap(c)


def term_type(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("unigram", "bigram", "trigram"))), F.size(F.split(c, " ")))
