"""Deterministic pseudonyms from salted SHA-256 digests, in 32-bit limbs."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.fixed import PRIORITY, TAX_CODE_ODD


def digest(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit(":"), F.upper(value)), 256)


def limbs(digest_hex: Column) -> Column:
    """Eight numbers below 2**32, the highest first."""
    return F.array(*(F.conv(F.substring(digest_hex, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(8)))


def _divided(number: Column, by: int, then) -> Column:
    """``then(quotient limbs, remainder)`` of a division of limbs."""
    start = F.struct(F.array().cast("array<bigint>").alias("q"), F.lit(0).cast("bigint").alias("r"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["r"] * F.lit(1 << 32) + x
        return F.struct(F.array_append(acc["q"], F.call_function("div", now, F.lit(by).cast("bigint"))).alias("q"), (now % F.lit(by)).alias("r"))

    return F.aggregate(number, start, step, lambda acc: then(acc["q"], acc["r"]))


def digits(value: Column, salt: str, n: int) -> Column:
    """The first ``n`` decimal digits of the digest as a number, repeated if it is shorter."""
    start = F.struct(limbs(digest(value, salt)).alias("rest"), F.lit("").alias("out"))
    step = lambda acc, _: _divided(acc["rest"], 10**9, lambda q, r: F.struct(q.alias("rest"), F.concat(F.lpad(r.cast("string"), 9, "0"), acc["out"]).alias("out")))
    raw = F.aggregate(F.sequence(F.lit(1), F.lit(9)), start, step, lambda acc: F.regexp_replace(acc["out"], "^0+(?=.)", ""))
    return F.substring(F.repeat(raw, F.lit(n)), 1, n)


def letters(value: Column, salt: str, n: int | Column) -> Column:
    """``n`` base-26 digits of the digest as A to Z, the lowest first."""
    count = F.lit(n) if isinstance(n, int) else n
    start = F.struct(limbs(digest(value, salt)).alias("rest"), F.lit("").alias("out"))
    step = lambda acc, _: _divided(acc["rest"], 26, lambda q, r: F.struct(q.alias("rest"), F.concat(acc["out"], F.char(r + 65)).alias("out")))
    return F.when(count <= 0, F.lit("")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), start, step, lambda acc: acc["out"]))


def remainder(value: Column, salt: str, by: int) -> Column:
    return _divided(limbs(digest(value, salt)), by, lambda q, r: r)


def mod97(value: Column) -> Column:
    """The check number of a bank account: letters stand for 10 to 35, other characters for nothing."""
    chars = F.filter(F.split(value, ""), lambda c: c.rlike("^[0-9A-Z]$"))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97).cast("int")

    return F.aggregate(chars, F.lit(0), step)


def iban(value: Column, salt: str) -> Column:
    compact = F.regexp_replace(F.upper(value), "(?U)\\s", "")
    country, size = F.substring(compact, 1, 2), F.length(compact) - 4
    italian = F.concat(letters(compact, salt + ":iban-cin", 1), digits(compact, salt + ":iban-bank", 10), digits(compact, salt + ":iban-account", 12))
    body = F.when((country == "IT") & (size == 23), italian).otherwise(letters(compact, salt + ":iban", size))
    check = F.lpad((98 - mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(size < 1, F.lit("IBAN_ANON")).otherwise(F.concat(country, check, body))


def tax_code_check(first: Column) -> Column:
    """The last letter of a tax code, from the 15 before it."""
    odd = F.array(*map(F.lit, TAX_CODE_ODD))

    def weight(c: Column, k: Column) -> Column:
        place = F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 65)
        return F.when(k % 2 == 0, F.get(odd, place)).otherwise(place).cast("int")

    total = F.aggregate(F.transform(F.filter(F.split(first, ""), lambda c: c != ""), weight), F.lit(0), lambda a, x: a + x)
    return F.char(total % 26 + 65)


def tax_code(value: Column, salt: str) -> Column:
    own = F.upper(value)
    plan = ((letters, 6), (digits, 2), (letters, 1), (digits, 2), (letters, 1), (digits, 3))
    first = F.concat(*(make(own, f"{salt}:cf{k}", n) for k, (make, n) in enumerate(plan, 1)))
    return F.concat(first, tax_code_check(first))


def suggestion(entity: Column, original: Column, key: Column, index: Column, salt: str, kinds: Collection[str] = tuple(PRIORITY)) -> Column:
    """What a group's value is replaced with unless someone chooses otherwise. ``kinds``: the entities that can occur."""
    number = F.when(index < 1000, F.lpad(index.cast("string"), 3, "0")).otherwise(index.cast("string"))
    only = F.regexp_replace(original, "(?U)\\D", "")

    def name() -> Column:
        first = F.concat(F.lit("Nome"), number)
        return F.when(F.size(F.split(original, "(?U)\\s+")) > 1, F.concat(first, F.lit(" Cognome"), number)).otherwise(first)

    def staff() -> Column:
        seed = F.concat(original, F.lit(":"), key)
        six = digits(seed, salt + ":matricola", 6)
        prefix = F.substring(F.lit("567"), remainder(seed, salt + ":matricola-prefix", 3).cast("int") + 1, F.lit(1))
        return F.when(F.length(only) == 7, F.concat(prefix, six)).otherwise(six)

    made = {
        ("NAME",): name,
        ("IBAN",): lambda: iban(original, salt),
        ("CODICE_FISCALE",): lambda: tax_code(original, salt),
        ("EMAIL",): lambda: F.concat(F.lit("user"), number, F.lit("@example.invalid")),
        ("PHONE",): lambda: F.repeat(F.lit("0"), F.greatest(F.length(only), F.lit(8))),
        ("MATRICOLA", "SUSPECTED_MATRICOLA"): staff,
    }
    out = F.concat(F.lit("ANON_"), number)
    for names, make in made.items():
        if any(x in kinds for x in names):
            out = F.when(entity.isin(*names), make()).otherwise(out)
    return out
