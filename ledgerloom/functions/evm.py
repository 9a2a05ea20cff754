"""Column helpers for addresses, hashes, hex words and JSON payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import u256

# Formats and constants of the chain data.
ZERO_ADDRESS = "0x" + "0" * 40
ADDRESS_PATTERN = "^0[xX][0-9a-fA-F]{40}$"
HASH_PATTERN = "^0[xX][0-9a-fA-F]{64}$"
EXPLORER_DEFAULT = "https://etherscan.io/tx/%s"
EXPLORER_BY_CHAIN = {11155111: "https://sepolia.etherscan.io/tx/%s"}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def address_of(number) -> Column:
    """Address whose low bits are an integer column."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(_c(number))), 40, "0"))


def hash_of(number) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(_c(number))), 64, "0"))


def word_of(number) -> Column:
    """32-byte word, without prefix, of a non-negative integer column."""
    return F.lpad(F.lower(F.hex(_c(number))), 64, "0")


def topic_address(topic) -> Column:
    """Low 20 bytes of a topic, lower-case."""
    return F.concat(F.lit("0x"), F.right(F.lower(_c(topic)), F.lit(40)))


def data_word(data, index: int) -> Column:
    """The i-th 32-byte word of hex ``data``; NULL where it is short or not hex."""
    d = _c(data)
    start = 3 + 64 * index
    word = F.substring(d, start, 64)
    return F.when((F.length(d) >= start + 63) & F.unhex(word).isNotNull(), word)


def topic_word(topic) -> Column:
    """The hex digits of a 32-byte topic, NULL if it is none."""
    word = F.substring(_c(topic), 3, 64)
    return F.when((F.length(_c(topic)) == 66) & F.unhex(word).isNotNull(), word)


def parse_u256(text) -> Column:
    """User input, ``0x`` hex or decimal digits, to an exact number; bad input is NULL."""
    t = F.lower(F.trim(_c(text)))
    digits = F.substring(t, 3, 64)
    return F.when(
        t.rlike("^0x[0-9a-f]{1,64}$"), u256.from_hex(F.lpad(digits, 64, "0"))
    ).otherwise(u256.from_string(t))


def parse_block_number(text, fallback=None) -> Column:
    """Hex or decimal block number; empty takes the fallback, malformed gives 0."""
    own = F.trim(_c(text))
    if fallback is not None:
        own = F.when(F.coalesce(own, F.lit("")) == "", F.trim(_c(fallback))).otherwise(own)
    hexed = F.when(
        own.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(own, 3, 16), 16, 10)
    )
    return F.coalesce(F.coalesce(hexed, own).try_cast("long"), F.lit(0).cast("long"))


def lower_hex(col) -> Column:
    return F.lower(F.trim(_c(col)))


def eq_ci(col, value) -> Column:
    """Equality on a column normalised at ingest; only the constant is lowered,
    so the predicate reaches the scan."""
    if isinstance(value, str):
        return _c(col) == value.strip().lower()
    return _c(col) == F.lower(value)


def nonzero(col) -> Column:
    return _c(col) != ZERO_ADDRESS


def is_zero_address(text: str | None) -> bool:
    return re.fullmatch(r"(0[xX])?0*", (text or "").strip()) is not None


def valid_address(col) -> Column:
    return F.coalesce(F.trim(_c(col)).rlike(ADDRESS_PATTERN), F.lit(False))


def valid_hash(col) -> Column:
    return F.coalesce(F.trim(_c(col)).rlike(HASH_PATTERN), F.lit(False))


def parse_date(text) -> Column:
    """RFC 3339, ``YYYY-MM-DDThh:mm:ss`` or ``YYYY-MM-DD``, read as UTC; else NULL."""
    t = _c(text)
    shape = (
        r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}"
        r"((\.\d{1,9})?(Z|[+-]\d{2}:\d{2})|))?$"
    )
    return F.when(t.rlike(shape), t.try_cast("timestamp"))


def explorer_url(tx_hash, chain_id, template: str | None = None) -> Column:
    tx = _c(tx_hash)
    if template:
        return F.format_string(template, tx)
    url = F.format_string(EXPLORER_DEFAULT, tx)
    for chain, pattern in EXPLORER_BY_CHAIN.items():
        url = F.when(_c(chain_id) == chain, F.format_string(pattern, tx)).otherwise(url)
    return url


def json_object(**fields) -> Column:
    """JSON text with sorted keys; NULL members are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
