"""Lexicon sentiment of a text, in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rule: what a strengthening word adds, what a negation multiplies with, normalisation, thresholds, words looked back.
BOOST, NEGATE, ALPHA, EDGE, REACH = 0.293, -0.74, 15.0, 0.05, 3
# Valences; words that are not listed are neutral.
VALENCE = {
    "love": 3.2, "great": 3.1, "awesome": 3.4, "perfect": 3.0, "excellent": 3.1, "happy": 2.7, "glad": 2.4, "nice": 1.8, "thanks": 2.4, "thank": 2.2, "fixed": 1.6, "improved": 1.5, "helpful": 1.7, "clean": 1.2,
    "terrible": -2.1, "awful": -2.5, "hate": -2.7, "broken": -1.6, "broke": -1.5, "worst": -3.1, "annoying": -1.9, "fails": -1.5, "failing": -1.5, "failed": -1.5, "failure": -1.7,
    "crash": -1.4, "crashes": -1.4, "crashed": -1.4, "regression": -1.5, "regressions": -1.5, "stuck": -1.2, "wrong": -1.3, "bad": -1.5,
}
# Words that turn a valence round, and words that strengthen one.
TURNING = ["not", "no", "never", "cannot", "cant", "can't", "won't", "wont", "dont", "don't", "isnt", "isn't", "wasnt", "wasn't", "arent", "aren't"]
STRONGER = ["very", "really", "extremely", "highly", "absolutely"]


def compound(text: Column) -> Column:
    """Score from -1 to 1; 0 for null and for texts without a listed word."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9']+"), lambda x: x != "")
    words = F.transform(words, F.lower)
    table = F.create_map(*[x for k, v in VALENCE.items() for x in (F.lit(k), F.lit(float(v)))])

    def one(w, i):
        v = F.coalesce(F.try_element_at(table, w), F.lit(0.0))
        back = F.reverse(F.slice(words, F.greatest(i - REACH + 1, F.lit(1)), F.least(i, F.lit(REACH))))
        return F.when(v == 0.0, 0.0).otherwise(
            F.aggregate(back, v, lambda acc, b: F.when(b.isin(STRONGER), acc + F.signum(acc) * BOOST).when(b.isin(TURNING), acc * NEGATE).otherwise(acc))
        )

    total = F.aggregate(F.transform(words, one), F.lit(0.0), lambda a, x: a + x)
    return F.when(total == 0.0, 0.0).otherwise(total / F.sqrt(total * total + ALPHA))


def sentiment(text: Column) -> Column:
    """positive, negative or neutral."""
    c = compound(text)
    return F.when(c >= EDGE, "positive").when(c <= -EDGE, "negative").otherwise("neutral")
