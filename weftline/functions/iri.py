"""IRI tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = "http://weftline.local/ont#"


def quoted(text: Column) -> Column:
    """Percent-encodes UTF-8 bytes other than letters, digits and `_.-~`."""
    form = F.url_encode(text)  # form encoding: differs in the space, the asterisk and the tilde
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def token(text: Column, first_token: bool = False) -> Column:
    """The text as an IRI part; with first_token only up to the first white space. Null for blank texts."""
    trimmed = F.regexp_replace(text.cast("string"), r"(?U)^\s+|\s+$", "")
    wanted = F.split(trimmed, r"(?U)\s+", 2)[0] if first_token else trimmed
    return F.when(wanted != "", quoted(wanted))


def iri(text: Column, base: str = BASE, first_token: bool = False) -> Column:
    return F.concat(F.lit(base), token(text, first_token))


def python_token(text: str, first_token: bool = False) -> str:
    """The same for a configured name, on the driver."""
    from urllib.parse import quote

    parts = text.split()
    return quote(parts[0] if first_token and parts else text.strip(), safe="")
