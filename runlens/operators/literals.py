"""Texts that a regular expression cannot match without.

They are read off the expression by built-in functions, so patterns may come as a table of any size.
The reading errs on the safe side: what it does not understand, it does not require.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Private characters: a cut between required texts, and stand-ins for escaped signs.
CUT = "\ue000"
STAND_INS = {sign: chr(0xE001 + i) for i, sign in enumerate("\\.[]{}()*+?^$|")}
# Quoting, free spacing and case rules beyond A-Z change what plain characters mean.
OPAQUE = r"\\Q|\(\?[a-zA-Z]*[xuU]|[\ue000-\ue00f]"
CLASS_ESCAPE = r"\\(?:[pP]\{[^}]*\}|x\{[^}]*\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|c.|0[0-7]{1,3}|[kN][<{][^>}]*[>}]|[1-9][0-9]*|[A-Za-z0-9])"
# Innermost groups whose content need not stand in a match as it is, and those it does.
OTHER_GROUP = r"\((?:\?(?!:)[^()]*|[^()]*\|[^()]*|(?:\?:)?)\)|\([^()]*\)(?=[*+?{])"
PLAIN_GROUP = r"\((?:\?:)?([^()|?][^()|]*)\)(?![*+?{])"
NESTING = 6


def folded(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def required_texts(pattern: Column) -> Column:
    """Per alternative of a regular expression the texts, folded, that each of its matches holds.

    An array of arrays; an empty inner array requires nothing.  A matching line, folded, holds
    all texts of one alternative at least.
    """
    text = F.replace(pattern, F.lit("\\\\"), F.lit(STAND_INS["\\"]))
    text = F.regexp_replace(text, CLASS_ESCAPE, CUT)
    for sign, stand_in in STAND_INS.items():
        text = F.replace(text, F.lit("\\" + sign), F.lit(stand_in))
    text = F.regexp_replace(text, r"\\([^A-Za-z0-9])", "$1")
    for _ in range(3):
        text = F.regexp_replace(text, r"\[[^\[\]]*\]", CUT)
    for _ in range(NESTING):
        text = F.regexp_replace(text, OTHER_GROUP, CUT)
        text = F.regexp_replace(text, PLAIN_GROUP, "$1")
    text = F.regexp_replace(text, r"\+[+?]?", CUT)
    text = F.regexp_replace(text, r"(?s).(?:[*?]|\{[^}]*\})[+?]?", CUT)
    text = F.regexp_replace(text, r"[.^$]", CUT)

    def pieces(alternative: Column) -> Column:
        plain = F.translate(alternative, "".join(STAND_INS.values()), "".join(STAND_INS))
        return F.filter(F.split(folded(plain), CUT), lambda piece: piece != "")

    known = F.transform(F.split(text, r"\|"), pieces)
    understood = ~pattern.rlike(OPAQUE) & ~text.rlike(r"[\[\](){}\\]")
    return F.when(understood, known).otherwise(F.array(F.array().cast("array<string>")))
