import hashlib
import string

from pyspark.sql import functions as F

from veilwright.functions import pseudonyms as P

SALT = "salt"
VALUES = ["a", "Rossi", "IT60X0542811101000000123456", "straße", "è" * 40, *(f"v{k}" for k in range(60))]


def number(value, salt):
    return int(hashlib.sha256(f"{salt}:{value.upper()}".encode()).hexdigest(), 16)


def in_letters(value, salt, n):
    x, out = number(value, salt), ""
    for _ in range(n):
        x, r = divmod(x, 26)
        out += string.ascii_uppercase[r]
    return out


def frame(spark, values=VALUES):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_digits_and_letters(spark):
    v = F.col("v")
    for r in frame(spark).select("v", P.digits(v, SALT, 6).alias("six"), P.digits(v, SALT, 90).alias("many"), P.letters(v, SALT, 7).alias("seven"), P.letters(v, SALT, 0).alias("none"), P.remainder(v, SALT, 3).alias("rest")).collect():
        whole = str(number(r.v, SALT))
        assert r.six == whole[:6] and r.many == (whole * 2)[:90]
        assert r.seven == in_letters(r.v, SALT, 7) and r.none == ""
        assert r.rest == number(r.v, SALT) % 3


def check_number(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_accounts(spark):
    values = ["IT60X0542811101000000123456", "it60 x054 2811 1010 0000 0123 456", "DE89370400440532013000", "FR1420041010050500013M02606", "XX12"]
    got = {r.v: r.p for r in frame(spark, values).select("v", P.iban(F.col("v"), SALT).alias("p")).collect()}
    assert got["XX12"] == "IBAN_ANON"
    assert got[values[0]] == got[values[1]]
    for v in values[:4]:
        plain = "".join(v.upper().split())
        assert got[v][:2] == plain[:2] and len(got[v]) == len(plain) and check_number(got[v]) == 1
    own = values[0]
    digits = lambda part, n: str(number(own, f"{SALT}:iban-{part}"))[:n]
    assert got[own][4:] == in_letters(own, f"{SALT}:iban-cin", 1) + digits("bank", 10) + digits("account", 12)
    assert got[values[2]][4:] == in_letters(values[2], f"{SALT}:iban", 18)


def test_tax_codes(spark):
    (r,) = frame(spark, ["rssmra80a01h501u"]).select(P.tax_code(F.col("v"), SALT).alias("p"), P.tax_code_check(F.upper(F.substring("v", 1, 15))).alias("c")).collect()
    assert r.c == "U"
    own = "RSSMRA80A01H501U"
    want = "".join(in_letters(own, f"{SALT}:cf{k}", n) if k % 2 else str(number(own, f"{SALT}:cf{k}"))[:n] for k, n in ((1, 6), (2, 2), (3, 1), (4, 2), (5, 1), (6, 3)))
    assert r.p[:15] == want


def test_suggestions(spark):
    rows = [("NAME", "Mario Rossi", 7), ("NAME", "Rossi", 1234), ("EMAIL", "a@b.it", 12), ("PHONE", "02 123", 1), ("PHONE", "+39 0212345678", 1), ("MATRICOLA", "5123456", 1), ("SUSPECTED_MATRICOLA", "998877", 1), ("OTHER", "x", 3)]
    df = spark.createDataFrame([(e, o, "K" + o, k) for e, o, k in rows], "e string, o string, key string, k int")
    got = [r.s for r in df.select(P.suggestion(F.col("e"), F.col("o"), F.col("key"), F.col("k"), SALT).alias("s")).collect()]
    assert got[:5] == ["Nome007 Cognome007", "Nome1234", "user012@example.invalid", "00000000", "000000000000"]
    seed = "5123456:K5123456"
    assert got[5] == "567"[number(seed, f"{SALT}:matricola-prefix") % 3] + str(number(seed, f"{SALT}:matricola"))[:6]
    assert got[6] == str(number("998877:K998877", f"{SALT}:matricola"))[:6]
    assert got[7] == "ANON_003"
