"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Every kind of value is found by a pattern and, where its format has a rule, validated (check digits,
calendar, octets, reserved areas).  A valid value is replaced by another valid value of the same format,
by a keyed Feistel permutation of its characters: digits stay digits, letters stay letters of their
case, separators stay where they are.  The permutation depends on the key and the kind of value alone, so
equal values have equal pseudonyms in all documents, and different ones different pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: A column of ours, dropped again.
FOUND = "__logweir_found"
#: Steps of cycle walking: while a permuted value is invalid it is permuted again.
WALK = 128
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"

# Patterns of the kinds, in order of precedence.
SECRET = r"""(?<![A-Za-z])(?i:token|secret|passw(?:or)?d|api[_-]?key)["']?\s?[=:]\s?["']?(?=[A-Za-z_+/-]*[0-9])[0-9A-Za-z_+/-]{16,128}(?![0-9A-Za-z_+/-])"""
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
#: Countries by the characters of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """IBANs of the registered countries by their length, in groups of four or in one; others as far as they go."""
    forms = []
    for n, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}(?![A-Za-z0-9])")
    forms.append("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
    return f"(?<![A-Za-z0-9])(?:{'|'.join(forms)})"


IBAN = iban_pattern()
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z/-])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9](?:[ .-]?\(?[0-9]\)?){8,14}|\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?|(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f]{1,4}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
KINDS = {"secret": SECRET, "email": EMAIL, "iban": IBAN, "date": DATE, "ssn": SSN, "phone": PHONE, "ip": IP, "ipv6": IPV6, "card": CARD}
LATER = "|".join(p for k, p in KINDS.items() if k not in ("secret", "email", "iban"))
ANY = "|".join(KINDS.values())


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def code(c: Column) -> Column:
    return F.ascii(c)


def shifted(c: Column, by: Column, hexadecimal: bool) -> Column:
    """A character moved on within its class; others stay."""
    if hexadecimal:
        return F.substring(F.lit("0123456789abcdef"), ((F.instr(F.lit("0123456789abcdef"), c) - 1 + by) % 16 + 1).cast("int"), F.lit(1))
    turn = lambda first, n: F.char((code(c) - F.ascii(F.lit(first)) + by) % n + F.ascii(F.lit(first)))
    return F.when(c.between("0", "9"), turn("0", 10)).when(c.between("a", "z"), turn("a", 26)).when(c.between("A", "Z"), turn("A", 26)).otherwise(c)


def round_sum(half: Column, seed: Column, hexadecimal: bool) -> Column:
    """A half moved on by a keyed hash of the other; a block of the hash serves 16 characters."""
    block = lambda i: F.sha2(F.concat(seed, F.lit("|"), F.floor(i / 16).cast("string")), 256)

    def at(i: Column) -> Column:
        drawn = F.conv(F.substring(block(i), (F.pmod(i, F.lit(16)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
        return shifted(F.substring(half, (i + 1).cast("int"), F.lit(1)), drawn, hexadecimal)

    n = F.length(half)
    return F.when(n == 0, half).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at), ""))


def feistel(text: Column, kind: str, key: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of the texts of one format: an unbalanced Feistel network over the two halves.

    Each round adds a keyed hash of one half to the other, character by character within its class, so
    every round, and with it the whole, can be undone.  A single character has no other half; it is moved
    on by a keyed constant.
    """
    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))

    def turn(acc: Column, k: Column) -> Column:
        seed = lambda half: F.concat_ws("|", F.lit(f"{key}|{kind}"), k.cast("string"), F.length(text).cast("string"), half)
        return F.when(
            k % 2 == 0, F.struct(round_sum(acc["l"], seed(acc["r"]), hexadecimal).alias("l"), acc["r"].alias("r"))
        ).otherwise(F.struct(acc["l"].alias("l"), round_sum(acc["r"], seed(acc["l"]), hexadecimal).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda a: F.concat(a["l"], a["r"]))


def walked(start: Column, step, valid) -> Column:
    """``step`` again and again until ``valid``: a permutation of the valid values alone.

    More than half of all values are valid, so WALK steps are enough but for a chance of 2**-WALK, when
    an invalid value of the same format comes out.
    """
    state = F.struct(start.alias("v"), F.lit(False).alias("done"))

    def go(acc: Column, _: Column) -> Column:
        return F.when(acc["done"], acc).otherwise(let(step(acc["v"]), lambda v: F.struct(v.alias("v"), valid(v).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), state, go, lambda a: a["v"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def poured(value: Column, core: Column, letters: str = "[0-9]") -> Column:
    """``value`` with its characters of a class replaced, one after the other, by those of ``core``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        taken = F.struct(F.concat(acc["out"], F.substring(core, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))
        return F.when(c.rlike(letters), taken).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))

    return F.aggregate(F.split(value, ""), start, put, lambda a: a["out"])


def luhn_sum(number: Column) -> Column:
    """The Luhn sum of a digit string, the last digit counted once."""
    back = F.split(F.reverse(number), "")

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(back, one), F.lit(0), lambda a, x: a + x)


def card_valid(value: Column) -> Column:
    return let(digits(value), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike("^(.)\\1*$"))


def card(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last makes the Luhn sum right again."""

    def own(d: Column) -> Column:
        body = feistel(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
        return let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return let(digits(value), lambda d: poured(value, walked(d, own, lambda v: ~v.rlike("^(.)\\1*$"))))


def ssn_core_valid(d: Column) -> Column:
    area = F.substring(d, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def ssn(value: Column, key: str) -> Column:
    return poured(value, walked(digits(value), lambda v: feistel(v, "ssn", key), ssn_core_valid))


def phone_valid(value: Column) -> Column:
    return F.length(digits(value)).between(10, 15)


def phone(value: Column, key: str) -> Column:
    """The last ten digits are permuted, or as many as follow a country code of two digits; the code stays."""

    def own(d: Column) -> Column:
        n = F.when(value.startswith("+") & (F.length(d) < 12) & ~d.startswith("1"), F.length(d) - 2).otherwise(F.lit(10))
        return let(n, lambda m: F.concat(F.substring(d, F.lit(1), F.length(d) - m), feistel(F.substring(d, F.length(d) - m + 1, m), "phone", key)))

    return let(digits(value), lambda d: poured(value, own(d)))


def ip_valid(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))


def ip(value: Column, key: str) -> Column:
    """The 32 bits are permuted as eight hexadecimal digits."""
    as_hex = F.array_join(F.transform(F.split(value, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")
    out = feistel(as_hex, "ip", key, hexadecimal=True)
    return let(out, lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10)), "."))


def ipv6(value: Column, key: str) -> Column:
    """The hexadecimal digits are permuted in their places."""
    small = F.lower(value)
    core = F.regexp_replace(small, ":", "")
    moved = poured(small, feistel(core, "ipv6", key, hexadecimal=True), "[0-9a-f]")
    return F.when(value == small, moved).otherwise(F.upper(moved))


def date_parts(value: Column) -> dict[str, Column]:
    """Year, month and day of a value in one of the formats; day before month unless only the other way is a date."""
    d, year_first = digits(value), value.rlike("^[0-9]{4}[-/]")
    number = lambda at, n: F.substring(d, at, n).cast("int")
    american = ~year_first & (number(3, 2) > 12)
    return {
        "y": F.when(year_first, number(1, 4)).otherwise(number(5, 4)),
        "m": F.when(year_first, number(5, 2)).when(american, number(1, 2)).otherwise(number(3, 2)),
        "d": F.when(year_first, number(7, 2)).when(american, number(3, 2)).otherwise(number(1, 2)),
        "american": american,
        "year_first": year_first,
    }


def date_valid(value: Column) -> Column:
    p = date_parts(value)
    leap = (p["y"] % 4 == 0) & ((p["y"] % 100 != 0) | (p["y"] % 400 == 0))
    longest = F.when(p["m"].isin(4, 6, 9, 11), 30).when(p["m"] == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return p["y"].between(int(FIRST_DAY[:4]), int(LAST_DAY[:4])) & p["m"].between(1, 12) & (p["d"] >= 1) & (p["d"] <= longest)


def date(value: Column, key: str) -> Column:
    """The number of the day within two centuries is permuted, and written in the same order and separators."""
    p = date_parts(value)
    first, last = F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")
    number = F.lpad(F.datediff(F.make_date(p["y"], p["m"], p["d"]), first).cast("string"), 5, "0")
    moved = walked(number, lambda v: feistel(v, "date", key), lambda v: v.cast("int") <= F.datediff(last, first))
    day = F.date_add(first, moved.cast("int"))
    forms = let(day, lambda x: F.when(p["year_first"], F.date_format(x, "yyyyMMdd")).when(p["american"], F.date_format(x, "MMddyyyy")).otherwise(F.date_format(x, "ddMMyyyy")))
    return poured(value, forms)


def mod97(text: Column) -> Column:
    """A text of digits and capital letters (A = 10 ...), modulo 97."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + (code(c) - 55)) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def iban_valid(value: Column) -> Column:
    return let(F.replace(value, F.lit(" "), F.lit("")), lambda v: F.length(v).between(15, 34) & (mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1))


def iban(value: Column, key: str) -> Column:
    """The account is permuted and the check digits made right; the country stays."""

    def own(v: Column) -> Column:
        country = F.substring(v, 1, 2)
        return let(
            feistel(F.substring(v, F.lit(5), F.length(v)), "iban", key),
            lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b),
        )

    return let(F.replace(value, F.lit(" "), F.lit("")), lambda v: poured(value, own(v), "[A-Z0-9]"))


def email(value: Column, key: str) -> Column:
    """Letters and digits of the local part are permuted in their places; the domain's name gives way, its end stays."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)) - 1)
    return F.concat(feistel(local, "email", key), F.lit("@"), feistel(name, "domain", key), F.lit("."), F.substring_index(domain, ".", -1))


def secret(value: Column, key: str) -> Column:
    """The secret is permuted, as hexadecimal digits if it has no others, else each character in its class; what introduces it stays."""
    core = F.regexp_extract(value, "([0-9A-Za-z_+/-]{16,128})$", 1)
    upper = core == F.upper(core)
    as_hex = let(feistel(F.lower(core), "secret", key, hexadecimal=True), lambda h: F.when(upper, F.upper(h)).otherwise(h))
    new = F.when(core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), as_hex).otherwise(feistel(core, "secret", key))
    return F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(core)), new)


def always(value: Column) -> Column:
    return F.lit(True)


RULES = {
    "secret": (always, secret), "email": (always, email), "iban": (iban_valid, iban), "date": (date_valid, date), "ssn": (lambda v: ssn_core_valid(digits(v)), ssn),
    "phone": (phone_valid, phone), "ip": (ip_valid, ip), "ipv6": (always, ipv6), "card": (card_valid, card),
}


def kind_of(value: Column) -> Column:
    """The kind of a found value, or null if it breaks the rule of its format."""
    out = F
    for k, pattern in KINDS.items():
        out = out.when(value.rlike(whole(pattern)), F.when(RULES[k][0](value), F.lit(k)))
    return out


def pieces(value: Column) -> Column:
    """A found value as an array: itself, or, if it has the shape of an IBAN and isn't one, what later kinds find in it and what lies between."""
    inner = F.concat(F.regexp_extract_all(value, F.lit(LATER), F.lit(0)), F.array(F.lit("")))
    apart = F.flatten(F.zip_with(F.split(value, LATER, -1), inner, lambda gap, p: F.array(gap, p)))
    return F.when(value.rlike(whole(IBAN)) & ~iban_valid(value), apart).otherwise(F.array(value))


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of a struct (kind, value); the value itself where the kind is null."""
    out = F
    for k in KINDS:
        out = out.when(found["kind"] == k, RULES[k][1](found["value"], key))
    return out.otherwise(found["value"])


def pseudonymize(docs: DataFrame, key: str, column: str = "text", kinds: str | None = "pii") -> DataFrame:
    """``docs`` with every valid piece of personal data in ``column`` replaced by its pseudonym.

    The columns are those of ``docs`` and, unless ``kinds`` is None, one of that name with an array of the
    kinds replaced in order of their places, in place of any such column.  Values that break their format's rule, such as a number whose check digit is wrong, stay.
    Null texts stay null, with no kinds; texts of any length are searched to the end.  Rows are
    treated each for itself, so repeated rows, ties and other columns don't matter, and an empty table
    stays empty.
    """
    text = F.col(column)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    named = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda v: F.transform(pieces(v), lambda p: F.struct(kind_of(p).alias("kind"), p.alias("value"))))
    docs = docs.withColumn(FOUND, named)
    new = F.concat(F.transform(FOUND, lambda fs: F.array_join(F.transform(fs, lambda f: pseudonym(f, key)), "")), F.array(F.lit("")))
    rewritten = F.array_join(F.zip_with(F.split(text, ANY, -1), new, lambda gap, p: F.concat(gap, p)), "")
    touched = F.exists(FOUND, lambda fs: F.exists(fs, lambda f: f["kind"].isNotNull()))
    docs = docs.withColumn(column, F.when(touched, rewritten).otherwise(text))
    if kinds:
        docs = docs.withColumn(kinds, F.filter(F.transform(F.flatten(FOUND), lambda f: f["kind"]), lambda k: k.isNotNull()))
    return docs.drop(FOUND)
