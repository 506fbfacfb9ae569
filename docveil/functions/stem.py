"""Endings of words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inflections of Danish and English nouns and verbs that a stem does not have, longest first (own choice).
ENDINGS = "erernes ernes erens enes eres erne eren ene ens ers ets ede ing en er es et ed e s".split()
#: Letters that a stem keeps.
LEAST_STEM = 3
_PATTERN = rf"^(.{{{LEAST_STEM},}}?)(?:{'|'.join(ENDINGS)})$"


def stem(word: Column) -> Column:
    """A lower-case word without its inflections: twice the shortest stem of LEAST_STEM letters or more that an ending follows, so that words that look inflected meet those that are."""
    return F.regexp_replace(F.regexp_replace(word, _PATTERN, "$1"), _PATTERN, "$1")


def plain_stem(word: str) -> str:
    """stem() of a word that is known when a query is built."""
    return re.sub(_PATTERN, r"\1", re.sub(_PATTERN, r"\1", word))
