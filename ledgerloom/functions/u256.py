"""Exact 256-bit integers as three decimal limbs, in native expressions only.

``DECIMAL`` stops at 38 digits, a uint256 has up to 78. A value is therefore a
struct ``hi, mid, lo`` of decimals with base 10^26, where ``hi`` has room for sums
beyond 256 bits. Sums of limbs stay inside 38 digits, so they run as ordinary
hash aggregates with map-side partials. They are exact for any group of up to
10^10 rows; a larger overflow raises, it never wraps.

After :func:`normalise` the limbs ``mid`` and ``lo`` lie in [0, 10^26) and only
``hi`` carries the sign; struct comparison is then numeric comparison.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 26
BASE = 10**DIGITS
LIMB = T.DecimalType(DIGITS, 0)
WIDE = T.DecimalType(38, 0)
U256 = T.StructType(
    [T.StructField("hi", WIDE), T.StructField("mid", LIMB), T.StructField("lo", LIMB)]
)


def _const(value: int) -> Column:
    return F.lit(Decimal(value)).cast(T.DecimalType(max(1, len(str(abs(value)))), 0))


def _wide(value: int) -> Column:
    return F.lit(Decimal(value)).cast(WIDE)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def pack(hi: Column, mid: Column, lo: Column) -> Column:
    return F.named_struct(
        F.lit("hi"), hi.cast(WIDE), F.lit("mid"), mid.cast(LIMB), F.lit("lo"), lo.cast(LIMB)
    )


def zero() -> Column:
    z = F.lit(0)
    return pack(z, z, z)


def from_small(value: Column) -> Column:
    """From an integral column of at most 26 digits (long, int, DECIMAL(26,0))."""
    v = value.cast(WIDE)
    z = F.lit(0)
    return normalise_parts(z.cast(WIDE), z.cast(WIDE), v)


def from_string(text: Column) -> Column:
    """From a decimal digit string of 1 to 78 digits; anything else gives NULL.

    ``text`` is mentioned several times: let it be a column of an earlier projection where it costs much.
    """
    t = F.trim(text)
    # counted from the end, so a short text has empty upper limbs
    limb = lambda i: F.concat(F.lit("0"), F.substring(t, -(i + 1) * DIGITS, DIGITS)).cast(LIMB)
    return F.when(t.rlike("^[0-9]{1,78}$"), pack(limb(2), limb(1), limb(0)))


def from_hex(word: Column) -> Column:
    """From a 32-byte word given as 64 hex digits without prefix.

    One expression by Horner's rule, meant for constants and small tables; use
    :func:`with_words` for whole columns of a log table.
    """
    base, shift = _wide(BASE), _const(2**32)

    def step(acc: Column, i: Column) -> Column:
        chunk = F.conv(F.substr(word, i * 8 + 1, F.lit(8)), 16, 10).cast(WIDE)
        lo = (acc["lo"] * shift + chunk).cast(WIDE)
        mid = (acc["mid"] * shift + _div(lo, base).cast(WIDE)).cast(WIDE)
        hi = (acc["hi"] * shift + _div(mid, base).cast(WIDE)).cast(WIDE)
        return pack(hi, mid % base, lo % base)

    return F.when(word.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(7)), zero(), step))


def with_words(df: DataFrame, words: dict[str, Column]) -> DataFrame:
    """Add one U256 column per 64-digit hex word column; NULL words stay NULL.

    The work is laid out in short projections (32-bit chunks, weighted limb
    sums, carries) instead of one expression: all of it stays in whole-stage
    generated code, with methods short enough for the JIT. Words below 2^96
    (almost all real amounts) skip their upper chunks, values below 10^26
    skip the decimal division of the carry, which costs more than all the rest, and
    words below 2^60 are one number from the start.
    """
    plain = [c for c in df.columns if c not in words]

    def part(out: str, label: str) -> str:
        return f"_{label}_{out}"

    df = df.withColumns({part(out, "word"): word for out, word in words.items()})
    chunks = {}
    for out in words:
        word = F.col(part(out, "word"))
        tiny, small = (F.substring(word, 1, n) == "0" * n for n in (49, 40))
        chunks[part(out, "small")] = small
        chunks[part(out, "tiny")] = F.when(tiny, F.conv(F.substring(word, 50, 15), 16, 10).cast("long"))
        for i in range(8):
            chunk = F.conv(F.substring(word, 57 - 8 * i, 8), 16, 10).cast("long")
            chunks[part(out, f"c{i}")] = F.when(~tiny if i < 3 else ~small, chunk)
    df = df.withColumns(chunks)

    sums = {}
    for out in words:
        pieces = [F.col(part(out, f"c{i}")).cast(T.DecimalType(10, 0)) for i in range(8)]
        for limb, label in enumerate(("lo", "mid", "hi")):
            terms = [
                (pieces[i] * _const(weight)).cast(WIDE)
                for i in range(8)
                if (weight := (2 ** (32 * i) // BASE**limb) % BASE)
            ]
            short = _add(terms[:3]) if limb == 0 else _wide(0)
            tiny = F.col(part(out, "tiny"))
            whole = F.when(tiny.isNotNull(), tiny.cast(WIDE)) if limb == 0 else F
            sums[part(out, label)] = whole.when(F.col(part(out, "small")), short).otherwise(_add(terms))
    df = df.withColumns(sums)
    for lower, upper in (("lo", "mid"), ("mid", "hi")):
        df = df.withColumns(
            {part(out, f"{lower}_carry"): _carry(F.col(part(out, lower))) for out in words}
        ).withColumns(
            {
                part(out, upper): (F.col(part(out, upper)) + F.col(part(out, f"{lower}_carry"))).cast(WIDE)
                for out in words
            }
        )
    done = []
    for out in words:
        hi, mid, lo = (F.col(part(out, k)) for k in ("hi", "mid", "lo"))
        value = pack(
            hi, _less(mid, F.col(part(out, "mid_carry"))), _less(lo, F.col(part(out, "lo_carry")))
        )
        done.append(F.when(F.col(part(out, "word")).isNotNull(), value).alias(out))
    return df.select(*plain, *done)


def _add(terms: list[Column]) -> Column:
    out = terms[0]
    for term in terms[1:]:
        out = (out + term).cast(WIDE)
    return out


def _carry(limb: Column) -> Column:
    """What a non-negative raw limb hands to the next one."""
    carry = _div(limb, _wide(BASE)).cast(T.DecimalType(12, 0))
    return F.when(limb < _const(BASE), _const(0).cast(T.DecimalType(12, 0))).otherwise(carry)


def _less(limb: Column, carry: Column) -> Column:
    return F.when(carry == 0, limb).otherwise((limb - (carry * _const(BASE)).cast(WIDE)).cast(WIDE))


def normalise_parts(hi: Column, mid: Column, lo: Column) -> Column:
    """Floor-normalise signed raw limbs: ``mid`` and ``lo`` end in [0, 10^26).

    Limbs already in range skip the decimal division. The conditional around
    the struct also keeps the optimizer from inlining it into every later
    mention of a limb, which would multiply the whole expression.
    """
    hi, mid, lo = hi.cast(WIDE), mid.cast(WIDE), lo.cast(WIDE)
    lo_n, lo_carry = _floor_split(lo)
    mid_t = (mid + lo_carry).cast(WIDE)
    mid_n, mid_carry = _floor_split(mid_t)
    return F.when(lo.isNotNull(), pack((hi + mid_carry).cast(WIDE), mid_n, lo_n))


def _floor_split(limb: Column) -> tuple[Column, Column]:
    base = _wide(BASE)
    in_range = (limb >= 0) & (limb < _const(BASE))
    rest = F.pmod(limb, base).cast(WIDE)
    carry = _div((limb - rest).cast(WIDE), base).cast(WIDE)
    return F.when(in_range, limb).otherwise(rest), F.when(in_range, _wide(0)).otherwise(carry)


def add(a: Column, b: Column) -> Column:
    return normalise_parts(
        *[a[k].cast(WIDE) + b[k].cast(WIDE) for k in ("hi", "mid", "lo")]
    )


def sub(a: Column, b: Column) -> Column:
    return normalise_parts(
        *[a[k].cast(WIDE) - b[k].cast(WIDE) for k in ("hi", "mid", "lo")]
    )


def _magnitude(a: Column) -> tuple[Column, Column, Column]:
    """Limbs of ``-a`` for a normalised ``a``: borrows instead of divisions."""
    base, none, one = _wide(BASE), _wide(0), _wide(1)
    lo, mid, hi = (a[k].cast(WIDE) for k in ("lo", "mid", "hi"))
    mid_t = (mid + F.when(lo == 0, none).otherwise(one)).cast(WIDE)
    return (
        (-hi - F.when(mid_t == 0, none).otherwise(one)).cast(WIDE),
        F.when(mid_t == 0, none).otherwise((base - mid_t).cast(WIDE)).cast(LIMB),
        F.when(lo == 0, none).otherwise((base - lo).cast(WIDE)).cast(LIMB),
    )


def negate(a: Column) -> Column:
    """``-a`` of a normalised value, normalised."""
    return normalise_parts(*[-a[k].cast(WIDE) for k in ("hi", "mid", "lo")])


def signed(a: Column, negative: Column) -> Column:
    """Raw (not normalised) limbs of ``a`` or ``-a``: cheap input for a sum."""
    return pack(*[F.when(negative, -a[k]).otherwise(a[k]) for k in ("hi", "mid", "lo")])


def total(a: Column) -> Column:
    """Aggregate: exact signed sum of a limb column; NULL over no non-null rows.

    A limb that is NULL over rows that are not (an overflow outside ANSI mode) fails.
    """
    full = F.count(a["lo"]) > 0
    sums = [F.sum(a[k]) for k in ("hi", "mid", "lo")]
    lost = F.raise_error(F.lit("a sum of amounts is out of range"))
    return normalise_parts(*[F.when(full & s.isNull(), lost.cast("decimal(38,0)")).otherwise(s) for s in sums])


def with_running(df: DataFrame, a: str, window, prefix: str) -> DataFrame:
    """Raw running limb sums as ``prefix_hi``, ``prefix_mid``, ``prefix_lo``.

    They are columns of their own: inside :func:`normalise_parts` every mention
    of a window expression would be computed again.
    """
    return df.withColumns({f"{prefix}_{k}": F.sum(F.col(a)[k]).over(window) for k in ("hi", "mid", "lo")})


def _digits(hi: Column, mid: Column, lo: Column) -> Column:
    parts = [hi.cast("string"), *[F.lpad(k.cast("string"), DIGITS, "0") for k in (mid, lo)]]
    # digits without leading zeros sort after "0", an empty rest before it
    return F.greatest(F.ltrim(F.concat(*parts), F.lit("0")), F.lit("0"))


def to_string(a: Column) -> Column:
    """Canonical decimal text of a non-negative value."""
    return F.when(a.isNotNull(), _digits(a["hi"], a["mid"], a["lo"]))


def to_signed_string(a: Column) -> Column:
    """Canonical decimal text of a normalised signed value."""
    return F.when(a["hi"] < 0, F.concat(F.lit("-"), _digits(*_magnitude(a)))).when(
        a.isNotNull(), _digits(a["hi"], a["mid"], a["lo"])
    )


def is_zero(a: Column) -> Column:
    return (a["hi"] == 0) & (a["mid"] == 0) & (a["lo"] == 0)
