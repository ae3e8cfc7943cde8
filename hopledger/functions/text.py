"""Rendering and small vocabularies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopledger.functions.identity import plain_lower, trim_spaces

# Criticality vocabularies, a higher rank is worse, anything else ranks 0.
CRITICALITY_RANKS = {
    "critical": 4, "high": 3, "medium": 2, "low": 1,
    "tier-1": 4, "tier-2": 3, "tier-3": 2, "tier-4": 1,
    "p1": 4, "p2": 3, "p3": 2, "p4": 1,
    "sev1": 4, "sev2": 3, "sev3": 2, "sev4": 1,
}


def escape_label_value(text: Column) -> Column:
    """backslash first, then quote, then newline."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def criticality_rank(criticality: Column) -> Column:
    """F11."""
    table = F.create_map(*[F.lit(x) for pair in CRITICALITY_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain_lower(criticality)), F.lit(0))


def plural(count: Column, noun: str) -> Column:
    """F12."""
    return F.concat(count.cast("string"), F.lit(" " + noun), F.when(count == 1, "").otherwise("s"))


def overlay(base: Column, top: Column) -> Column:
    """both maps, the top one winning on a shared key."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k))
    return F.map_concat(kept, top)


def number_text(value: Column) -> Column:
    """F16: a number in its shortest form: no trailing ``.0``, an exponent of two digits at least below 1e-4 and from 1e6 on."""
    value = value.cast("double")
    shortest = F.abs(value).cast("string")
    mantissa = F.regexp_extract(shortest, "^[0-9.]+", 0)
    digits = F.regexp_replace(F.regexp_replace(F.replace(mantissa, F.lit(".")), "^0+", ""), "0+$", "")
    # The place of the first digit: from the exponent as printed, or from the digits before the point.
    printed = F.regexp_extract(shortest, "E(-?[0-9]+)$", 1).try_cast("int")
    whole = F.length(F.substring_index(mantissa, ".", 1)) - 1
    leading = F.length(F.regexp_extract(mantissa, "^0\\.(0*)", 1)) + 1
    place = F.coalesce(printed, F.when(F.abs(value) < 1, -leading).otherwise(whole))
    tail = F.substring(digits, F.lit(2), F.length(digits))
    power = F.concat(F.when(place < 0, "e-").otherwise("e+"), F.lpad(F.abs(place).cast("string"), F.greatest(F.lit(2), F.length(F.abs(place).cast("string"))), F.lit("0")))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), power)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -place - 1), digits)
    text = (
        F.when(value == 0, "0").when((place < -4) | (place >= 6), scientific)
        .when(place < 0, small).otherwise(F.regexp_replace(mantissa, "\\.0$", ""))
    )
    return (
        F.when(F.isnan(value), "NaN").when(F.abs(value) == float("inf"), F.when(value > 0, "+Inf").otherwise("-Inf"))
        .otherwise(F.concat(F.when(value < 0, "-").otherwise(""), text))
    )


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of named values, each computed once: nested column expressions would repeat them in every use."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _halves(x: Column) -> Column:
    """A double as the sum of two of half its length, so that products of such halves are exact."""
    wide = x * F.lit(float(2**27 + 1))
    return _let(lambda v: F.struct(v["high"].alias("high"), (v["x"] - v["high"]).alias("low")), x=x, high=wide - (wide - x))


def _four_digits(x: Column) -> Column:
    """(digits, place): the four leading digits of a number from 1e-18 to 1e18, rounded from its binary value with halves to even.

    The product with a power of ten is known exactly as a double and its error, so what decides the rounding is no rounded figure.
    """
    place = F.when(x >= 1, F.length(F.floor(x).cast("string")) - 1)
    for k in range(1, 18):
        place = place.when(x >= float(f"1e-{k}"), -k)
    ten = lambda power: F.rint(F.pow(F.lit(10.0), F.greatest(power, F.lit(0))))

    def products(v: Column) -> Column:
        return _let(numbers, x=v["x"], place=v["place"], up=v["up"], down=v["down"], product=v["x"] * v["up"], a=_halves(v["x"]), b=_halves(v["up"]))

    def numbers(v: Column) -> Column:
        a, b = v["a"], v["b"]
        error = ((a["high"] * b["high"] - v["product"]) + a["high"] * b["low"] + a["low"] * b["high"]) + a["low"] * b["low"]
        number = F.floor(F.when(v["x"] < 10000, v["product"]).otherwise(v["x"] / v["down"]))
        return _let(chosen, x=v["x"], place=v["place"], down=v["down"], product=v["product"], error=error, number=number)

    def chosen(v: Column) -> Column:
        number = v["number"]
        over = F.when(v["x"] < 10000, (v["product"] - number - 0.5) + v["error"]).otherwise(v["x"] - (number + 0.5) * v["down"])
        up = lambda w: (w["over"] > 0) | ((w["over"] == 0) & (w["number"] % 2 == 1))
        return _let(lambda w: carried(w["number"] + F.when(up(w), 1).otherwise(0), w["place"]), number=number, place=v["place"], over=over)

    def carried(digits: Column, place: Column) -> Column:
        return _let(lambda w: F.struct(F.when(w["d"] == 10000, 1000).otherwise(w["d"]).alias("digits"),
                                       (w["p"] + F.when(w["d"] == 10000, 1).otherwise(0)).alias("place")), d=digits, p=place)

    return _let(lambda v: _let(products, x=v["x"], place=v["place"], up=ten(3 - v["place"]), down=ten(v["place"] - 3)), x=x, place=place.otherwise(-18))


def humanize_percentage(ratio: Column) -> Column:
    """F16: the ratio times one hundred to four significant digits, without padding zeros, and a percent sign."""

    def written(v: Column) -> Column:
        digits, place = F.rtrim(v["digits"].cast("string"), F.lit("0")), v["place"]
        before, after = F.rpad(F.substring(digits, F.lit(1), place + 1), place + 1, F.lit("0")), F.substring(digits, place + 2, F.lit(4))
        tail = F.substring(digits, 2, 3)
        point = lambda text: F.when(text != "", F.concat(F.lit("."), text)).otherwise("")
        return (
            F.when(place.between(-4, -1), F.concat(F.lit("0."), F.repeat(F.lit("0"), -place - 1), digits)).when(place.between(0, 3), F.concat(before, point(after)))
            .otherwise(F.concat(F.substring(digits, 1, 1), point(tail), F.when(place < 0, "e-").otherwise("e+"), F.lpad(F.abs(place).cast("string"), 2, "0")))
        )

    def signed(v: Column) -> Column:
        size = F.abs(v["value"])
        beyond = F.regexp_replace(F.format_string("%.3e", size), "\\.?0*e", "e")
        inside = (size >= 1e-18) & (size < 1e18)
        text = F.when(v["value"] == 0, "0").when(inside, _let(lambda w: written(w["four"]), four=_four_digits(size))).otherwise(beyond)
        return F.when(F.isnan(v["value"]), "NaN").when(size == float("inf"), F.when(v["value"] > 0, "+Inf").otherwise("-Inf")).otherwise(
            F.concat(F.when(v["value"] < 0, "-").otherwise(""), text))

    return F.when(ratio.isNotNull(), F.concat(_let(signed, value=ratio.cast("double") * 100), F.lit("%")))


def candidate_paths(path: Column, paths: Column) -> Column:
    """the single ``path`` first, then ``paths``."""
    empty = F.slice(F.array(path), 1, 0)
    return F.concat(F.when(path.isNull(), empty).otherwise(F.array(path)), F.coalesce(paths, empty))


def curated_list(text: Column) -> Column:
    """comma list, trimmed, no blanks, each name once."""
    names = F.transform(F.split(text, ","), trim_spaces)
    return F.array_distinct(F.filter(names, lambda name: name != ""))
