"""Names, keys and identities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Entity kinds, each its own hash domain.
KINDS = (
    "device", "interface", "ip", "endpoint", "application", "appservice",
    "businessservice", "customer", "segment", "connection", "path",
)

# Leading interface-name tokens and their long form.
IF_NAME_TOKENS = {
    "te": "tengige",
    "gi": "gigabitethernet",
    "eth": "ethernet",
    "et": "ethernet",
    "fa": "fastethernet",
    "hu": "hundredgige",
}

# The Unicode White_Space characters.
SPACES = (
    "\t\n\x0b\x0c\r \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

ASCII_SPACES = "\t\n\x0b\x0c\r "

UNIT_SEPARATOR = "\x1f"

INTEGER = "^[+-]?[0-9]+$"


def is_ascii(text: Column) -> Column:
    """As many bytes as characters: cheaper than a pattern."""
    return F.octet_length(text) == F.char_length(text)


def plain_lower(text: Column) -> Column:
    """Lower case code point by code point: the JVM alone would expand U+0130 and pick a final sigma."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3")))


def trim_spaces(text: Column) -> Column:
    """Trim all Unicode white space, not only the ASCII blank."""
    return F.when(is_ascii(text), F.trim(text, F.lit(ASCII_SPACES))).otherwise(F.trim(text, F.lit(SPACES)))


def folded(text: Column) -> Column:
    """Trimmed and lowered, in one test of the text."""
    beyond = F.lower(F.translate(F.trim(text, F.lit(SPACES)), "\u0130\u03a3", "i\u03c3"))
    return F.when(is_ascii(text), F.lower(F.trim(text, F.lit(ASCII_SPACES)))).otherwise(beyond)


def entity_hash(kind: str, *parts: Column) -> Column:
    """``kind:`` and 16 hex digits over the kind and its trimmed, lowered parts."""
    if kind not in KINDS:
        raise ValueError(f"unknown entity kind {kind!r}")
    pieces = [F.coalesce(folded(p.cast("string")), F.lit("")) for p in parts]
    digest = F.sha2(F.concat_ws(UNIT_SEPARATOR, F.lit(kind), *pieces), 256)
    return F.concat(F.lit(kind + ":"), F.substring(digest, 1, 16))


@pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    present = text.notna()
    if not present.any():
        return text
    out = text.copy()
    out[present] = [unicodedata.normalize("NFKC", value) for value in text[present]]
    return out


# Called deterministic, the function would be run again for every filter pushed below it.
_nfkc = _nfkc.asNondeterministic()


def normalize_token(text: Column) -> Column:
    """compatibility form, no white space, lower case.

    Spark has no compatibility normaliser, so text beyond ASCII goes through one Arrow function;
    ASCII text is passed to it as null and stays in the JVM.
    """
    plain = F.lower(F.regexp_replace(text, "[\\t-\\r ]+", ""))
    composed = F.translate(_nfkc(F.when(~is_ascii(text), text)), SPACES, "")
    return F.when(is_ascii(text), plain).otherwise(plain_lower(composed))


def expand_if_name(token: Column) -> Column:
    """F6 on an already normalised token: spell out the whole leading letter run."""
    head = F.regexp_extract(token, "^([a-z]+)", 1)
    table = F.create_map(*[F.lit(x) for pair in IF_NAME_TOKENS.items() for x in pair])
    long_form = F.coalesce(F.try_element_at(table, head), head)
    tail = F.regexp_replace(token, "^[a-z]+", "")
    return F.when(token.contains("-"), token).otherwise(F.concat(long_form, tail))


def canonical_if_name(raw: Column) -> Column:
    """one spelling per interface; names with a dash keep theirs."""
    return expand_if_name(normalize_token(raw))


def key_safe(text: Column) -> Column:
    """no colon and no control character."""
    return ~text.rlike("[:\\p{Cc}]")


def interface_hash(device: Column, canonical: Column) -> Column:
    """F7."""
    return entity_hash("interface", device, canonical)


def host_part(address: Column) -> Column:
    """F8: ``host`` of ``host:port`` or ``[host]:port``; anything else unchanged."""
    bracketed = "^\\[([^\\]]*)\\]:[^:]*$"
    simple = "^([^:\\[\\]]*):[^:]*$"
    return (
        F.when(address.rlike(bracketed), F.regexp_extract(address, bracketed, 1))
        .when(address.rlike(simple), F.regexp_extract(address, simple, 1))
        .otherwise(address)
    )


def strict_int(text: Column) -> Column:
    """an optional sign and digits only; null otherwise, and null when out of range."""
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def iface_label(instance: Column, if_index: Column) -> Column:
    """P0."""
    return F.concat(instance, F.lit(":"), if_index.cast("string"))
