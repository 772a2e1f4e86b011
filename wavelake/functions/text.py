"""Identifier patterns in free text, and lists of broken rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name and pattern of each kind of identifier, readable by Java and RE2 alike.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -]?[0-9]{0,4}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "url": r"https?://[A-Za-z0-9./_-]+",
    "long_number": r"\b[0-9]{9,}\b",
}

PHI_SQL = ("WITH f AS (SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in PATTERNS.items())
           + ") AS findings FROM documents) SELECT doc_id, findings, findings = '' AS clean FROM f")


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition is false (not those where it is unknown)."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def scan(df: DataFrame, text: str) -> DataFrame:
    """Add ``findings`` (names of the patterns found) and ``clean``."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in PATTERNS.items()]))
    return df.withColumn("findings", found).withColumn("clean", F.size("findings") == 0)


_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: What a submission's text is searched for, and the longest text allowed. Readable by Java and RE2 alike;
#: the edges of words are written out, as engines differ on them beside letters beyond ASCII.
SUBMISSION_PATTERNS = {
    "iso_date": _EDGE + r"\d{4}-\d{2}-\d{2}" + _END,
    "numeric_date": _EDGE + r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}" + _END,
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "long_number": _EDGE + r"\d{7,}" + _END,
    "phone": r"(?:\+\d{1,3}[\s.-]?\d{2,4}[\s.-]?\d{3,4}[\s.-]?\d{3,4}|\(\d{2,4}\)[\s.-]?\d{3,4}[\s.-]?\d{3,4}|" + _EDGE + r"\d{2,4}\s\d{3,4}\s\d{3,4}" + _END + r")",
    "path": r"(?:[A-Za-z]:[\\/]|/)[\w./\\-]{4,}",
    "name_like": _EDGE + r"[A-Z][a-z]{1,}\s+[A-Z][a-z]{1,}" + _END,
    "narrative": r"(?i)" + _EDGE + r"(?:my (?:son|daughter|child)|patient|named|called)" + _END,
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    "insurance_number": _EDGE + r"[A-Z]\d{9}" + _END,
    "iban": _EDGE + r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}" + _END,
}
LONGEST = 80

#: Patterns that need a digit; and what a text must hold for a pattern to be sought at all, quicker to find than its edges and repetitions.
DIGITS = {"iso_date", "numeric_date", "long_number", "phone", "ssn", "insurance_number", "iban"}
_NEEDED = {"iso_date": r"\d{4}-", "numeric_date": r"\d[./-]\d", "long_number": r"\d{7}", "phone": r"\d{2}", "ssn": r"\d-\d", "insurance_number": r"[A-Z]\d", "iban": r"[A-Z]\d",
           "name_like": r"[A-Z][a-z]+\s+[A-Z]", "narrative": r"(?i)[mpnc](?:y (?:son|daughter|child)|atient|amed|alled)"}


def _needs(where: Column, name: str) -> Column:
    if name == "email":
        return where.contains("@")
    if name == "path":
        return where.contains("/") | where.contains(":\\")
    return where.rlike(_NEEDED[name])


SUBMISSION_SQL = ("concat_ws(',', CASE WHEN length({t}) > 80 THEN 'too_long' END, "
                  + ", ".join(f"CASE WHEN regexp_matches({{t}}, '{p}') THEN '{n}' END" for n, p in ((n, p.replace("{", "{{").replace("}", "}}")) for n, p in SUBMISSION_PATTERNS.items()))
                  + r", CASE WHEN regexp_matches(regexp_replace({t}, '[A-Za-z]', '', 'g'), '\p{{L}}') THEN 'foreign_letter' END)")


def nfkc(text: str):
    """Compatibility forms of characters folded together; Spark has no function for it, so this is an Arrow-batched one."""
    @F.pandas_udf("string")
    def fold(col: pd.Series) -> pd.Series:
        return col.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return fold(text)


def submission_findings(text: Column, folded: Column | None = None) -> Column:
    """Names of all that a submitted text must not hold: a length over LONGEST, identifiers (sought in ``folded``, the
    text after NFKC, where given), letters beyond ASCII. A null text has none."""
    where = text if folded is None else folded

    def found(digits: bool) -> Column:
        out = [F.when(F.length(text) > LONGEST, F.lit("too_long"))]
        out += [F.when(_needs(where, n) & where.rlike(p), F.lit(n)) for n, p in SUBMISSION_PATTERNS.items() if digits or n not in DIGITS]
        return F.array_compact(F.array(*out, F.when(text.rlike(r"[\p{L}&&[^A-Za-z]]"), F.lit("foreign_letter"))))

    # most texts hold no digit, so seven patterns are not sought there
    return F.when(where.rlike("[0-9]"), found(True)).otherwise(found(False))
