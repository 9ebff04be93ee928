"""Greedy subsequence score of a pattern in a name, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the score.
BASE, AT_START, ADJACENT, AFTER_BREAK, LENGTH_STEP = 100, 200, 15, 10, 8
BREAKS = "_-./ \t"
MOST = 2147483647


def fuzzy_score(pattern: Column, name: Column) -> Column:
    """The score, or null without a match.

    Case does not count. Equal text scores MOST. Else the pattern's characters are matched as early as possible from left to
    right: BASE, AT_START if the first is at 0, less its position, ADJACENT for each that follows its predecessor, AFTER_BREAK
    for each at 0 or after a break, less an eighth of the name's length; 1 at least. Only ASCII text is scored.
    """
    p, h = F.lower(pattern), F.lower(name)
    state = F.struct(F.lit(0).alias("k"), F.lit(-2).alias("last"), F.lit(-1).alias("first"), F.lit(0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        wanted = F.substring(p, s["k"] + 1, F.lit(1))
        hit = (s["k"] < F.length(p)) & (F.substring(h, i + 1, F.lit(1)) == wanted)
        after = (i == 0) | F.contains(F.lit(BREAKS), F.substring(name, i, F.lit(1)))
        gain = F.when(i == s["last"] + 1, ADJACENT).otherwise(0) + F.when(after, AFTER_BREAK).otherwise(0)
        return F.struct(
            F.when(hit, s["k"] + 1).otherwise(s["k"]).alias("k"),
            F.when(hit, i).otherwise(s["last"]).alias("last"),
            F.when(hit & (s["first"] < 0), i).otherwise(s["first"]).alias("first"),
            F.when(hit, s["sum"] + gain).otherwise(s["sum"]).alias("sum"),
        )

    def total(s: Column) -> Column:
        raw = BASE + F.when(s["first"] == 0, AT_START).otherwise(0) - s["first"] + s["sum"] - F.floor(F.length(name) / LENGTH_STEP).cast("int")
        return F.when(s["k"] == F.length(p), F.greatest(raw, F.lit(1)))

    walked = F.aggregate(F.sequence(F.lit(0), F.length(name) - 1), state, step, total)
    ascii_ = ~F.concat(pattern, name).rlike(r"[^\x00-\x7F]")
    fits = ascii_ & (F.length(p) > 0) & (F.length(p) <= F.length(h))
    return F.when(fits, F.when(p == h, F.lit(MOST)).otherwise(walked))


#: The characters that sets of characters tell.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789" + BREAKS
N_CHARACTERS = len(CHARACTERS)


def characters(name: Column) -> Column:
    """Which lower-case letters, digits and breaks a text has, a bit each."""
    bits = [F.when(F.contains(name, F.lit(c)), F.lit(1 << k).cast("long")).otherwise(F.lit(0)) for k, c in enumerate(CHARACTERS)]
    out = bits[0].cast("long")
    for b in bits[1:]:
        out = out.bitwiseOR(b.cast("long"))
    return out


def tier(query: Column, id_: Column, display: Column) -> Column:
    """0 for an equal name, 1 for one that starts so, 2 for the rest; case does not count."""
    q, a, b = F.lower(query), F.lower(id_), F.lower(display)
    return F.when((a == q) | (b == q), 0).when(F.startswith(a, q) | F.startswith(b, q), 1).otherwise(2)


def best_score(query: Column, id_: Column, display: Column) -> Column:
    return F.greatest(fuzzy_score(query, id_), F.when(display != id_, fuzzy_score(query, display)))
