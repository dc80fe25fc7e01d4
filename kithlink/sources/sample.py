"""Synthetic people with planted duplicates and their truth, from row numbers and hashes: the same rows under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = ("example.com", "mail.example.com", "post.example.net", "web.example.org", "inbox.example.net", "box.example.org")
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnprstvwz"


def draw(row: Column, what: str, seed: int) -> Column:
    """A number in [0, 1) for a row and a purpose."""
    return F.pmod(F.xxhash64(row, F.lit(what), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def word(number: Column, syllables: int = 3) -> Column:
    """A pronounceable word for a vocabulary number; different numbers give different words."""
    out, rest = F.lit(""), number.cast("long")
    for _ in range(syllables):
        out = F.concat(out, F.substring(F.lit(CONSONANTS), F.pmod(rest, F.lit(18)).cast("int") + 1, F.lit(1)), F.substring(F.lit(VOWELS), F.pmod(F.floor(rest / 18), F.lit(5)).cast("int") + 1, F.lit(1)))
        rest = F.floor(rest / 90)
    return out


def skewed(u: Column, size: int) -> Column:
    """A vocabulary number with a power-law frequency."""
    return F.floor(F.pow(u, F.lit(3.0)) * size).cast("long")


def typo(x: Column, u: Column, kind: Column) -> Column:
    """One character dropped, doubled or changed at a drawn place."""
    at = (F.floor(u * F.length(x)) + 1).cast("int")
    before, after = F.substring(x, F.lit(1), at - 1), F.substring(x, at + 1, F.length(x))
    same = F.substring(x, at, F.lit(1))
    changed = F.when(kind < 1 / 3, F.concat(before, after)).when(kind < 2 / 3, F.concat(before, same, same, after)).otherwise(F.concat(before, F.lit("x"), after))
    return F.when(F.length(x) > 2, changed).otherwise(x)


def people(spark: SparkSession, rows: int = 1_000_000, duplicate_rate: float = 0.08, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(records, truth): ten columns and an id; truth is (id_a, id_b), the original first."""
    copies = int(rows * duplicate_rate)
    originals = rows - copies
    base = spark.range(rows).withColumn("copy", F.col("id") >= originals)
    base = base.withColumn("of", F.when(F.col("copy"), F.floor(draw(F.col("id"), "of", seed) * originals)).otherwise(F.col("id")).cast("long"))
    r, mine = F.col("of"), F.col("id")
    d = lambda what: draw(r, what, seed)
    own = lambda what: draw(mine, what, seed)
    hit = lambda what, share: F.col("copy") & (own(what) < share)
    first, last = word(skewed(d("first"), 2_500)), word(skewed(d("last"), 60_000), 4)
    domain = lambda u: F.element_at(F.array(*map(F.lit, DOMAINS)), (F.floor(F.pow(u, F.lit(2.0)) * len(DOMAINS)) + 1).cast("int"))
    email = F.concat(last, F.lit("_"), F.substring(first, 1, 1), F.hex(F.floor(d("mail number") * 4_096).cast("long")), F.lit("@"), F.when(hit("domain", 0.2), domain(own("new domain"))).otherwise(domain(d("domain"))))
    gender = F.when(d("gender null") >= 0.05, F.when((d("gender") < 0.5) != hit("flip", 0.01), "F").otherwise("M"))
    birth = F.date_add(F.lit("1950-01-01").cast("date"), F.floor(d("birth") * 20_819).cast("int") + F.when(hit("birth moved", 0.15), F.floor(own("birth by") * 7).cast("int") - 3).otherwise(0))
    jitter = lambda what: F.when(F.col("copy"), (own(what) + own(what + "2") + own(what + "3") - 1.5) * 0.004).otherwise(0.0)
    tokens = F.transform(F.sequence(F.lit(1), (F.floor(d("token count") * 4) + 3).cast("int")), lambda i: word(F.pmod(F.xxhash64(r, i, F.lit(seed)), F.lit(20_000))))
    out = base.select(
        F.concat(F.lit("r"), mine).alias("id"),
        F.when(hit("first typo", 0.25), typo(first, own("first at"), own("first kind"))).otherwise(first).alias("first_name"),
        F.when(hit("last typo", 0.35), typo(last, own("last at"), own("last kind"))).otherwise(last).alias("last_name"),
        F.when(~hit("no gender", 0.1), gender).alias("gender"), birth.alias("dob"),
        F.when(~hit("no email", 0.3), email).alias("email"),
        F.when(~hit("no phone", 0.2), F.concat(F.lit("0"), F.lpad(F.floor(d("phone") * 1_000_000_000).cast("string"), 9, "0"))).alias("phone"),
        F.when(~hit("no postcode", 0.1), (F.floor(d("postcode") * 9_000) + 1_000).cast("string")).alias("postcode"),
        (d("latitude") * 10 + 40 + jitter("lat")).alias("latitude"), (d("longitude") * 20 - 5 + jitter("lon")).alias("longitude"),
        F.when(hit("token", 0.33), F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens).alias("address_tokens"),
    )
    truth = base.where("copy").select(F.concat(F.lit("r"), "of").alias("id_a"), F.concat(F.lit("r"), "id").alias("id_b"))
    return out, truth


def two_inputs(spark: SparkSession, rows: int = 1_000_000, duplicate_rate: float = 0.08, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first, second, truth): the same people over two inputs. Copies stand in the second, their originals in the first; the others are dealt by a hash. Copies of one person beyond
    the first copy stay in the second input and have no truth among themselves."""
    records, truth = people(spark, rows, duplicate_rate, seed)
    number = F.substring("id", 2, 20).cast("long")
    copied = truth.select(F.col("id_a").alias("id")).distinct().withColumn("copied", F.lit(True))
    marked = records.withColumn("copy", number >= rows - int(rows * duplicate_rate)).join(copied, "id", "left")
    second = F.col("copy") | (F.col("copied").isNull() & (draw(number, "input", seed) < 0.5))
    return marked.where(~second).drop("copy", "copied"), marked.where(second).drop("copy", "copied"), truth
