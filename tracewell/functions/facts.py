"""What verbs read from a line's text, as columns that can be stored with it.

Verbs ask here for a line's time, level and so on.  Lines that :func:`with_facts` has seen (see
``sources.readers.parsed``) carry these as columns, so that no verb parses text again; for other
lines the same value is computed on the spot.  Whoever changes ``text`` calls :func:`forget`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parse

FACTS = {
    "_ts": lambda: parse.parse_ts("text"),
    "_level": lambda: parse.detect_level("text"),
    "_analysed": lambda: parse.detect_level("text", "analyzer"),
    "_severity": lambda: parse.severity_rank("text"),
    "_component": lambda: parse.component("text"),
    "_crash": lambda: parse.crash_keyword("text"),
}


def with_facts(lines: DataFrame) -> DataFrame:
    return lines.withColumns({name: make() for name, make in FACTS.items() if name not in lines.columns})


def forget(lines: DataFrame) -> DataFrame:
    return lines.drop(*FACTS)


def _fact(lines: DataFrame, name: str) -> Column:
    return F.col(name) if name in lines.columns else FACTS[name]()


def ts(lines: DataFrame) -> Column:
    return _fact(lines, "_ts")


def level(lines: DataFrame) -> Column:
    return _fact(lines, "_level")


def analysed_level(lines: DataFrame) -> Column:
    return _fact(lines, "_analysed")


def severity(lines: DataFrame) -> Column:
    return _fact(lines, "_severity")


def component(lines: DataFrame) -> Column:
    return _fact(lines, "_component")


def crash(lines: DataFrame) -> Column:
    return _fact(lines, "_crash")
