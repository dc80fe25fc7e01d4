"""Text, distance and signature expressions: native columns only, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EARTH_KM = 6371.0088


def _or_null(x: Column) -> Column:
    return F.when(x != "", x)


def normalize(x: Column) -> Column:
    """ASCII lower case; runs of other ASCII than letters and digits become one space; trimmed."""
    return _or_null(F.trim(F.regexp_replace(F.translate(x, UPPER, LOWER), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")))


def sorted_tokens(x: Column) -> Column:
    """White-space tokens in byte order, one space between."""
    return _or_null(F.array_join(F.array_sort(F.filter(F.split(x, r"[ \t\n\r\f\x0B]+"), lambda t: t != "")), " "))


def soundex(x: Column) -> Column:
    """American Soundex of the letters; none: null."""
    letters = F.regexp_replace(x, "[^A-Za-z]", "")
    return F.when(letters != "", F.soundex(letters))


def year(d: Column) -> Column:
    return F.year(d).cast("string")


def month(d: Column) -> Column:
    return F.lpad(F.month(d).cast("string"), 2, "0")


def day(d: Column) -> Column:
    return F.lpad(F.dayofmonth(d).cast("string"), 2, "0")


def year_month(d: Column) -> Column:
    return F.concat(year(d), F.lit("-"), month(d))


def email_username(x: Column) -> Column:
    """What stands before the first @, else the whole."""
    return _or_null(F.substring_index(x, "@", 1))


def email_domain(x: Column) -> Column:
    """What stands after the last @, else null."""
    return F.when(F.instr(x, "@") > 0, _or_null(F.substring_index(x, "@", -1)))


TRANSFORMS = {f.__name__: f for f in (normalize, sorted_tokens, soundex, year, month, day, year_month, email_username, email_domain)}


def transformed(x: Column, chain: tuple[str, ...]) -> Column:
    """The transforms from left to right."""
    for name in chain:
        x = TRANSFORMS[name](x)
    return x


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity: each character takes the first free equal one within the reach; half the matched characters out of order are transpositions."""
    n, m = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
    empty = F.expr("cast(array() as array<int>)")

    def step(acc: Column, i: Column) -> Column:
        first, last = F.greatest(i - reach, F.lit(1)), F.least(i + reach, m)
        around = F.when(first <= last, F.sequence(first, last)).otherwise(empty)
        free = F.filter(around, lambda j: (F.substring(b, j, F.lit(1)) == F.substring(a, i, F.lit(1))) & ~F.array_contains(acc["jb"], j))
        return F.when(F.size(free) > 0, F.struct(F.array_append(acc["ia"], i).alias("ia"), F.array_append(acc["jb"], free[0]).alias("jb"))).otherwise(acc)

    start = F.struct(empty.alias("ia"), empty.alias("jb"))
    matched = F.aggregate(F.when((n > 0) & (m > 0), F.sequence(F.lit(1), n)).otherwise(empty), start, step)

    def similarity(s: Column) -> Column:
        k = F.size(s["ia"])
        apart = F.aggregate(F.zip_with(s["ia"], F.array_sort(s["jb"]), lambda i, j: (F.substring(a, i, F.lit(1)) != F.substring(b, j, F.lit(1))).cast("int")), F.lit(0), lambda x, y: x + y)
        half = F.floor(apart / 2).cast("double")
        return F.when((n == 0) & (m == 0), F.lit(1.0)).when(k == 0, F.lit(0.0)).otherwise((k / F.greatest(n, F.lit(1)) + k / F.greatest(m, F.lit(1)) + (k - half) / F.greatest(k, F.lit(1))) / 3)

    return F.element_at(F.transform(F.array(matched), similarity), 1)  # bound once, so the fold runs once


def common_prefix(a: Column, b: Column) -> Column:
    """Equal leading characters, four at most."""
    out = None
    for k in range(4, 0, -1):
        same = (F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
        out = F.when(same, k) if out is None else out.when(same, k)
    return out.otherwise(0)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro, raised by a tenth of the rest for each of up to four equal leading characters if it is 0.7 or more."""
    prefix = common_prefix(a, b)
    raised = F.element_at(F.transform(F.array(jaro(a, b)), lambda j: F.when(j >= 0.7, j + prefix * 0.1 * (1 - j)).otherwise(j)), 1)
    return F.when(a == b, F.lit(1.0)).otherwise(raised)


def char_mask(x: Column) -> Column:
    """64 bits, one for the characters that share their code's low six bits."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).bitwiseAND(63))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))


def levenshtein_lower_bound(mask_a: Column, mask_b: Column, la: Column, lb: Column) -> Column:
    """No distance is below this: each side needs an edit for every kind of character that the other lacks."""
    only_a, only_b = F.bit_count(mask_a.bitwiseAND(F.bitwise_not(mask_b))), F.bit_count(mask_b.bitwiseAND(F.bitwise_not(mask_a)))
    return F.greatest(F.abs(la - lb), only_a, only_b)


def jaro_winkler_length_bound(la: Column, lb: Column, prefix: Column | int = 4) -> Column:
    """No similarity of texts of these lengths is above this: at best all of the shorter one matches, in order."""
    shorter, longer = F.least(la, lb), F.greatest(la, lb)
    j = F.when(longer == 0, F.lit(1.0)).when(shorter == 0, F.lit(0.0)).otherwise((shorter / F.greatest(longer, F.lit(1)) + 2) / 3)
    return F.when(j >= 0.7, j + prefix * F.lit(0.1) * (1 - j)).otherwise(j)


def jaro_winkler_upper_bound(mask_a: Column, mask_b: Column, la: Column, lb: Column, prefix: Column | int = 4) -> Column:
    """No similarity is above this: characters of kinds that the other side lacks cannot match. The prefix, if known, makes it tighter."""
    m = F.least(la - F.bit_count(mask_a.bitwiseAND(F.bitwise_not(mask_b))), lb - F.bit_count(mask_b.bitwiseAND(F.bitwise_not(mask_a))))
    j = F.when((la == 0) & (lb == 0), F.lit(1.0)).when(m <= 0, F.lit(0.0)).otherwise((m / F.greatest(la, F.lit(1)) + m / F.greatest(lb, F.lit(1)) + 1) / 3)
    return F.when(j >= 0.7, j + prefix * F.lit(0.1) * (1 - j)).otherwise(j)


def meridian_km(lat_a: Column, lat_b: Column) -> Column:
    """The distance of two parallels; no two points on them are nearer."""
    return F.radians(F.abs(lat_a - lat_b)) * EARTH_KM


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def minhash_bands(x: Column, bands: int, rows: int, ngram: int, seed: int) -> Column:
    """An array of band keys of the text's character n-grams (the whole text if shorter)."""
    count = F.greatest(F.length(x) - ngram + 1, F.lit(1))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(x, i, F.lit(ngram))))
    signature = F.transform(F.sequence(F.lit(0), F.lit(bands * rows - 1)), lambda k: F.array_min(F.transform(grams, lambda g: F.xxhash64(g, k + F.lit(seed * 1_000_003)))))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.array_join(F.transform(F.slice(signature, b * rows + 1, F.lit(rows)), lambda v: v.cast("string")), ",")))
    return F.when(x.isNotNull() & (x != ""), keys)


def weight_of(probability: Column | float):
    """Bits of a probability."""
    if isinstance(probability, Column):
        return F.log2(probability / (1 - probability))
    import math

    return math.log2(probability / (1 - probability))


def probability_of(weight: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(2.0), -weight))
