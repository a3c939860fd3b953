"""PII: numbers, dates, addresses of the net and of mail get pseudonyms of the same format from a keyed Feistel network.

DataFrame functions only: a text is cut at its findings, each is replaced, and the text is put together again. The key
comes from a table of one row by a scalar subquery, so it stands in no plan, explain output or event log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import fresh, table

ROUNDS = 8
#: The setting that holds the key, and what is used where it is unset: a real run sets its own.
KEY_CONF, DEMO_KEY = "spark.quern.pii.key", "demo key"
# Lengths of account numbers (IBAN) by country, and country codes of one and two digits.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
COUNTRY_CODES = "7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IBAN = "|".join(rf"(?:{names.replace(' ', '|')})\d\d(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in IBAN_LENGTHS.items())
#: kind -> pattern; the order is that of the alternation. A finding must also be valid, see KINDS below.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:(?:\+1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])|\(\d{3}\)[ .-]?)\d{3}|[2-9]\d\d[ .-][2-9]\d\d)[ .-]\d{4}(?!\d|-\d)",
    "abroad": r"(?<![\d+])\+[2-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,12})){1,6}(?!\d)",
    "iban": rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])",
    "card": r"(?<![\d.+-])[2-6]\d{3}(?:(?:[ -]?\d{4}){2}[ -]?\d{1,7}|[ -]\d{6}[ -]\d{5})(?!\d|-\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "date": r"(?<![\d/.-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d\.\d\d\.(?:19|20)\d\d|\d\d/\d\d/(?:19|20)\d\d)(?!\d|[/-]\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _long(c: Column) -> Column:
    return c.cast("long")


def _whole(x: Column, b: int) -> Column:
    """x div b in whole numbers, x not negative."""
    return F.floor(x.cast("decimal(20,0)") / F.lit(b).cast("decimal(20,0)")).cast("long")


def feistel(x: Column, a: int, b: int, tweak: Column, back: bool) -> Column:
    """A keyed permutation of 0 .. a*b-1: two halves mod ``a`` and mod ``b``; in turn each adds a hash of the other."""

    def step(s: Column, k: Column) -> Column:
        other = F.when(k % 2 == 0, s["r"]).otherwise(s["l"])
        f = F.conv(F.substring(F.sha2(F.concat_ws("|", tweak, k.cast("string"), other.cast("string")), 256), 1, 14), 16, 10).cast("long")
        f = -f if back else f
        return F.struct(F.when(k % 2 == 0, F.pmod(s["l"] + f, F.lit(a))).otherwise(s["l"]).cast("long").alias("l"), F.when(k % 2 == 1, F.pmod(s["r"] + f, F.lit(b))).otherwise(s["r"]).cast("long").alias("r"))

    rounds = F.array(*[F.lit(k) for k in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    start = F.struct(_whole(x, b).alias("l"), _long(F.pmod(x, F.lit(b))).alias("r"))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def feistel_text(x: Column, tweak: Column, back: bool) -> Column:
    """A keyed permutation of strings of the same shape: ASCII digits stay digits, capital letters capital ones."""

    def shift(half: Column, other: Column, k: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", tweak, k.cast("string"), other), 256)

        def one(i: Column) -> Column:
            c = F.substr(half, i, F.lit(1))
            n = F.ascii(c)
            f = F.conv(F.substr(digest, (i * 4) % 60 + 1, F.lit(4)), 16, 10).cast("int")
            f = -f if back else f
            turn = lambda low, size: F.char(F.pmod(n - low + f, F.lit(size)) + low)
            return F.when(n.between(48, 57), turn(48, 10)).when(n.between(97, 122), turn(97, 26)).when(n.between(65, 90), turn(65, 26)).otherwise(c)

        return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), one), "")).otherwise("")

    def step(s: Column, k: Column) -> Column:
        return F.struct(F.when(k % 2 == 0, shift(s["l"], s["r"], k)).otherwise(s["l"]).alias("l"), F.when(k % 2 == 1, shift(s["r"], s["l"], k)).otherwise(s["r"]).alias("r"))

    rounds = F.array(*[F.lit(k) for k in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    half = F.ceil(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), half).alias("l"), F.substr(x, half + 1).alias("r"))
    return F.aggregate(rounds, start, step, lambda s: F.concat(s["l"], s["r"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _fill(shape: Column, digits: Column, place: str = r"\d") -> Column:
    """``digits`` in the places of the digits of ``shape``, or of other characters."""
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        d = c.rlike(f"^{place}$")
        return F.struct(F.concat(s["out"], F.when(d, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(d, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.split(shape, ""), zero, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum: from the right, each second digit is doubled and its digits added."""

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(m: Column, tweak: Column, back: bool) -> Column:
    """The scheme's digit stays, the digits up to the last are permuted, the check digit is computed."""
    d = _digits(m)

    def of(n: int) -> Column:
        mid = n - 2
        new = F.lpad(feistel(F.substring(d, 2, mid).cast("long"), 10 ** (mid - mid // 2), 10 ** (mid // 2), tweak, back).cast("string"), mid, "0")
        body = F.concat(F.substring(d, 1, 1), new)
        return F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    return _fill(m, reduce(lambda c, n: c.when(F.length(d) == n, of(n)), range(14, 20), F.when(F.length(d) == 13, of(13))))


def _phone(m: Column, tweak: Column, back: bool) -> Column:
    """Ten digits; a leading +1 stays. Area and exchange codes below 200, which no subscriber has, stay below 200."""
    d = F.substring(_digits(m), -10, 10)
    n = lambda at, size: F.substring(d, at, size).cast("long")

    def within(area: tuple[int, int], exchange: tuple[int, int]) -> Column:
        (a0, a), (e0, e) = area, exchange
        y = feistel(((n(1, 3) - a0) * e + n(4, 3) - e0) * 10_000 + n(7, 4), a * 100, e * 100, F.concat(tweak, F.lit(f"{a0}{e0}")), back)
        return F.concat(F.lpad((_whole(y, e * 10_000) + a0).cast("string"), 3, "0"), F.lpad((F.pmod(_whole(y, 10_000), F.lit(e)) + e0).cast("string"), 3, "0"), F.lpad(F.pmod(y, F.lit(10_000)).cast("string"), 4, "0"))

    low, high = (0, 200), (200, 800)
    ten = F.when((n(1, 3) >= 200) & (n(4, 3) >= 200), within(high, high)).when(n(1, 3) >= 200, within(high, low)).when(n(4, 3) >= 200, within(low, high)).otherwise(within(low, low))
    lead = F.length(_digits(m)) - 10
    return _fill(m, F.concat(F.substr(_digits(m), F.lit(1), lead), ten))


def _ip(m: Column, tweak: Column, back: bool) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    y = feistel(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65_536, 65_536, tweak, back)
    return F.concat_ws(".", *[F.shiftright(y, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def _ssn(m: Column, tweak: Column, back: bool) -> Column:
    n = lambda at, size: F.substring(m, at, size).cast("long")
    area = n(1, 3) - F.when(n(1, 3) > 666, 2).otherwise(1)
    y = feistel((area * 99 + n(5, 2) - 1) * 9999 + n(8, 4) - 1, 898 * 99, 9999, tweak, back)
    a = _whole(y, 99 * 9999) + 1
    a = a + F.when(a >= 666, 1).otherwise(0)
    return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.pmod(_whole(y, 9999), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(y, F.lit(9999)) + 1).cast("string"), 4, "0"))


def _iso(m: Column) -> Column:
    """The date in ISO format: 1999-12-31 as it is, 31.12.1999 and 31/12/1999 turned round."""
    turned = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))
    return F.when(F.substring(m, 5, 1) == "-", m).otherwise(turned)


def _date(m: Column, tweak: Column, back: bool) -> Column:
    """One of the 73,049 days from 1900 to 2099, in the same format."""
    first = F.lit("1900-01-01").cast("date")
    day = F.date_diff(F.try_to_date(_iso(m), "yyyy-MM-dd"), first).cast("long")
    new = F.date_add(first, feistel(day, 319, 229, tweak, back).cast("int"))
    return F.when(F.substring(m, 5, 1) == "-", F.date_format(new, "yyyy-MM-dd")).when(F.substring(m, 3, 1) == ".", F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))


def _email(m: Column, tweak: Column, back: bool) -> Column:
    """The part before the @ is permuted by its shape; the domain stays, and enters the hash. Capital and small letters are one to both."""
    name, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    new = feistel_text(F.lower(name), F.concat(tweak, F.lower(domain)), back)
    cased = F.zip_with(F.split(new, ""), F.split(name, ""), lambda n, old: F.when(old.rlike("^[A-Z]$"), F.upper(n)).otherwise(n))
    return F.concat(F.array_join(cased, ""), F.lit("@"), domain)


def mod97(account: Column) -> Column:
    """The number that an account's characters spell, letters as 10 to 35, modulo 97."""

    def add(s: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.pmod(F.when(n >= 65, s * 100 + n - 55).otherwise(s * 10 + n - 48), F.lit(97)).cast("int")

    return F.aggregate(F.split(account, ""), F.lit(0), add)


def _plain_iban(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _iban(m: Column, tweak: Column, back: bool) -> Column:
    """The country stays, the account is permuted by its shape, the check digits are computed."""
    plain = _plain_iban(m)
    country = F.substring(plain, 1, 2)
    account = feistel_text(F.substr(plain, F.lit(5)), F.concat(tweak, country), back)
    check = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return _fill(m, F.concat(country, check, account), "[^ ]")


def _abroad(m: Column, tweak: Column, back: bool) -> Column:
    """The country code stays, the other digits are permuted."""
    d = _digits(m)
    code = F.regexp_extract(d, rf"^(?:{COUNTRY_CODES.replace(' ', '|')}|\d\d\d)", 0)
    return _fill(m, F.concat(code, feistel_text(F.substr(d, F.length(code) + 1), F.concat(tweak, code), back)))


#: kind -> (test of a finding that matches the pattern, pseudonym)
KINDS = {
    "email": (lambda m: F.lit(True), _email),
    "ip": (lambda m: F.lit(True), _ip),
    "phone": (lambda m: F.lit(True), _phone),
    "abroad": (lambda m: F.length(_digits(m)).between(8, 15), _abroad),
    "iban": (lambda m: (mod97(F.concat(F.substr(_plain_iban(m), F.lit(5)), F.substring(_plain_iban(m), 1, 4))) == 1) & F.substring(_plain_iban(m), 3, 2).between("02", "98"), _iban),
    "card": (lambda m: F.length(_digits(m)).between(13, 19) & (luhn_sum(_digits(m)) % 10 == 0), _card),
    "ssn": (lambda m: ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), _ssn),
    "date": (lambda m: F.try_to_date(_iso(m), "yyyy-MM-dd").isNotNull(), _date),
}


def pseudonym(m: Column, key: Column, back: bool = False) -> Column:
    """struct(kind, value) of what one finding becomes; kind is null and value the finding itself if it isn't valid."""
    kinds = [F.when(m.rlike(f"^(?:{PATTERNS[k]})$") & ok(m), F.struct(F.lit(k).alias("kind"), new(m, F.concat(key, F.lit(f"|{k}")), back).alias("value"))) for k, (ok, new) in KINDS.items()]
    return F.coalesce(*kinds, F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))


def pseudonymize(docs: DataFrame, key: str | None = None, text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with its text replaced, and ``found``: array of struct(kind, value), the pseudonyms in their order.

    E-mail addresses (capital and small letters are one), IPv4 addresses, phone numbers of the North American form or
    with a + and a country code (abroad), account numbers (IBAN, check digits), card numbers (Luhn), social security
    numbers and dates (ISO, and day first with dots or slashes) that are valid become others that are, of the same
    format: equal values have equal pseudonyms in all documents, different ones different. Where findings could overlap
    the first to begin counts, and of those that begin together the one that comes first in PATTERNS.

    ``key`` is what the spark.quern.pii.key setting says, by default. ``back`` undoes it. Each row is changed where it
    is: no shuffle, and only rows with a digit or an @ are searched. A very long text is searched whole, in a row's
    memory. A null text stays null with nothing found, repeated rows are changed alike, other columns stay (a column
    named found is replaced); no rows give no rows.
    """
    spark = docs.sparkSession
    secret = spark.createDataFrame([(key if key is not None else spark.conf.get(KEY_CONF, DEMO_KEY),)], "secret string")
    t = F.col(text_col)
    maybe = t.rlike(r"\d|@")
    found, new, k = fresh(), fresh(), fresh()
    out = docs.withColumn(k, secret.scalar()).withColumn(found, F.when(maybe, F.regexp_extract_all(t, F.lit(ANY), 0)))
    out = out.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, F.col(k), back))))
    parts = F.zip_with(F.split(t, ANY, -1), F.col(new), lambda a, b: F.concat(a, F.coalesce(b["value"], F.lit(""))))
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    return out.withColumn(text_col, F.when(F.col(new).isNotNull(), F.array_join(parts, "")).otherwise(t)).withColumn("found", F.coalesce(F.filter(new, lambda x: x["kind"].isNotNull()), empty)).drop(found, new, k)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.transform("found", lambda x: x["kind"]).alias("kinds"), F.transform("found", lambda x: x["value"]).alias("pseudonyms"))
