"""Words of texts as the full-text index sees them, and ranks of matches."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their base letters, from the Unicode tables.
_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if chr(c).islower() and len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii()]
MARKED, BASE = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)
WORD = r"[\p{L}\p{N}\p{Co}]+"
#: Constants of the ranking and of the fusion of rankings.
K1, B, FUSE = 1.2, 0.75, 60


def words(text: Column) -> Column:
    """Words in order: lower case, without marks, cut at everything that is neither letter nor digit. Null gives null."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, BASE), F.lit(WORD), 0)


def query_phrases(query: str) -> list[list[str]]:
    """The phrases a query asks for, all of which must occur; words joined by underscores are one phrase."""
    out = []
    for raw in re.split(r"[^\w]+", query):
        plain = "".join(BASE[MARKED.index(c)] if c in MARKED else c for c in raw.lower())
        phrase = [w for w in re.findall(r"[^\W_]+", plain)]
        if phrase:
            out.append(phrase)
    return out


def occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in an array of words."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda x: x == phrase[0]))
    n, want = len(phrase), F.array(*[F.lit(w) for w in phrase])
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(at, lambda i: F.slice(tokens, i, n) == want))


def bm25(tf: Column, df: Column, n: Column, length: Column, mean_length: Column) -> Column:
    """Part of a match's score that one phrase gives."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def fused(rank: Column) -> Column:
    return F.lit(1.0) / (F.lit(FUSE) + rank)
