"""Format-preserving pseudonyms for validated numbers and dates, by a keyed Feistel network.

A value is read as a list of digits in mixed radices: card and phone digits in 10,
letters in 26, octets in 256, a date as two parts of its day number in a 400-year
cycle.  Each Feistel round adds a keyed hash of one half to the other, digit by digit
modulo its radix, so the network is a permutation of exactly that format: a valid value
becomes a valid value of the same shape, different values stay different, and equal
values, however they are punctuated, get one pseudonym in every document.

What is replaced: card numbers that pass the Luhn check (the check digit is made anew),
IBANs that pass modulo 97 (country kept, check digits made anew), US social security
numbers, phone numbers (country code kept), IPv4 addresses, dates of 1800 to 2199 that
exist (ISO, also with a time after T, or day, month and year with slashes or dots), and the local parts of email
addresses.  Anything that fails its check is left as it is.  Built-in functions only.

Results: null texts stay null; empty texts stay empty; repeated rows get equal texts;
a null doc_id stays null; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

KEY = "public-demo-key"
ROUNDS = 10
FIRST_DAY, DAYS = "1800-01-01", (189, 773)  # 189 x 773 days are 400 years

ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "date": ISO_DATE + r"|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "card": r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}",
}
EDGE = (r"(?<![A-Za-z0-9@])(?<![0-9][.,-])", r"(?![A-Za-z0-9@])(?![.,-][0-9])")
#: A time may follow an ISO date without a space.
PATTERN = EDGE[0] + "(?:" + ISO_DATE + "(?=[Tt][0-9])|(?:" + "|".join(f"(?:{form})" for form in FORMS.values()) + ")" + EDGE[1] + ")"


def _is(text: Column, kind: str) -> Column:
    return text.rlike(f"^(?:{FORMS[kind]})$")


def digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def feistel(values: Column, radices: Column, tag: str, key: str = KEY, rounds: int = ROUNDS) -> Column:
    """Keyed permutation of ``values`` below ``radices``; the halves take turns."""
    steps = F.array(*[F.lit(k) for k in range(rounds)])

    def step(now: Column, k: Column) -> Column:
        half = F.floor(F.size(now) / 2).cast("int")
        first = k % 2 == 0
        other = F.when(first, F.slice(now, half + 1, F.size(now))).otherwise(F.slice(now, F.lit(1), half))
        seed = F.concat_ws("|", F.lit(key), F.lit(tag), k.cast("string"), F.size(now).cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))

        def add(x: Column, i: Column) -> Column:
            drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 14), 16, 10).cast("long")
            return F.when((i < half) == first, ((x + drawn) % F.get(radices, i)).cast("int")).otherwise(x)

        return F.transform(now, add)

    return F.aggregate(steps, F.transform(values, lambda x: x.cast("int")), step)


def _radix(n: Column, radix: int) -> Column:
    return F.array_repeat(F.lit(radix), n.cast("int"))


def refill(text: Column, symbols: Column) -> Column:
    """Put the symbols into the places of the letters and digits of ``text``, in their case."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))

    def put(now: Column, c: Column) -> Column:
        new = F.get(symbols, now["i"])
        own = c.rlike("[A-Za-z0-9]")
        cased = F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)
        return F.struct(F.concat(now["s"], F.when(own, cased).otherwise(c)).alias("s"), (now["i"] + own.cast("int")).alias("i"))

    return F.aggregate(F.split(text, ""), start, put, lambda now: now["s"])


def _strings(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("string"))


def luhn_sum(ds: Column, doubled: int) -> Column:
    """Sum from the right; positions of parity ``doubled`` count twice, less nine above nine."""

    def part(d: Column, i: Column) -> Column:
        return F.when(i % 2 == doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(ds), part), F.lit(0), lambda s, x: s + x)


def pseudo_card(m: Column, key: str) -> Column:
    ds = digits(m)
    body = feistel(F.slice(ds, F.lit(1), F.size(ds) - 1), _radix(F.size(ds), 10), "card", key)
    check = lambda b: F.concat(b, F.array(((10 - luhn_sum(b, 0) % 10) % 10).cast("int")))
    new = F.transform(F.array(body), check)[0]
    return F.when(luhn_sum(ds, 1) % 10 == 0, refill(m, _strings(new)))


def _mod97(chars: Column) -> Column:
    def step(now: Column, c: Column) -> Column:
        n = F.conv(c, 36, 10).cast("int")
        return (now * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(chars, F.lit(0), step)


def pseudo_iban(m: Column, key: str) -> Column:
    chars = F.split(F.regexp_replace(m, " ", ""), "")
    land, check, own = F.slice(chars, 1, 2), F.slice(chars, 3, 2), F.slice(chars, F.lit(5), F.size(chars))
    letter = lambda c: c.rlike("[A-Z]")
    values = F.transform(own, lambda c: F.when(letter(c), F.ascii(c) - 65).otherwise(c.try_cast("int")))
    radices = F.transform(own, lambda c: F.when(letter(c), F.lit(26)).otherwise(F.lit(10)))
    moved = feistel(values, radices, "iban", key)
    new = F.zip_with(own, moved, lambda c, v: F.when(letter(c), F.char(v + 65)).otherwise(v.cast("string")))
    rebuilt = F.transform(
        F.array(new), lambda b: F.concat(land, F.split(F.lpad((98 - _mod97(F.concat(b, land, F.array(F.lit("0"), F.lit("0"))))).cast("string"), 2, "0"), ""), b)
    )[0]
    return F.when(_mod97(F.concat(own, land, check)) == 1, refill(m, rebuilt))


def pseudo_date(m: Column, key: str) -> Column:
    n = F.regexp_replace(m, "[^0-9]", "")
    iso = m.rlike("^[0-9]{4}-")
    day = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")
    year = F.substring(n, 5, 4)
    european = day(year, F.substring(n, 3, 2), F.substring(n, 1, 2))
    american = day(year, F.substring(n, 1, 2), F.substring(n, 3, 2))
    value = F.when(iso, day(F.substring(n, 1, 4), F.substring(n, 5, 2), F.substring(n, 7, 2))).otherwise(F.coalesce(european, american))
    at = F.datediff(value, F.lit(FIRST_DAY).cast("date"))
    moved = feistel(F.array(F.floor(at / DAYS[1]), at % DAYS[1]), F.array(F.lit(DAYS[0]), F.lit(DAYS[1])), "date", key)
    new = F.transform(F.array(moved), lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), v[0] * DAYS[1] + v[1]))[0]
    written = F.when(iso, F.date_format(new, "yyyyMMdd")).when(european.isNotNull(), F.date_format(new, "ddMMyyyy")).otherwise(F.date_format(new, "MMddyyyy"))
    inside = at.between(0, DAYS[0] * DAYS[1] - 1)
    return F.when(inside, refill(m, F.split(written, "")))


def pseudo_ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    moved = feistel(octets, F.array_repeat(F.lit(256), 4), "ip", key)
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(_strings(moved), "."))


def pseudo_ssn(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, "-"), lambda x: x.cast("int"))
    area = parts[0]
    values = F.array(area - F.when(area > 666, 2).otherwise(1), parts[1] - 1, parts[2] - 1)
    moved = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key)
    write = lambda v: F.format_string("%03d-%02d-%04d", v[0] + F.when(v[0] >= 665, 2).otherwise(1), v[1] + 1, v[2] + 1)
    good = area.between(1, 899) & (area != 666) & (parts[1] > 0) & (parts[2] > 0)
    return F.when(good, F.transform(F.array(moved), write)[0])


def pseudo_phone(m: Column, key: str) -> Column:
    """A country code before a separator or bracket is kept."""
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}[ .-]?)(?=[(0-9])", 1)
    own = F.substring(m, F.length(code) + 1, F.length(m))
    ds = digits(own)
    marked = m.rlike(r"^\+|[()]|^[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}$")
    return F.when(marked & F.size(ds).between(7, 14), F.concat(code, refill(own, _strings(feistel(ds, _radix(F.size(ds), 10), "phone", key)))))


def pseudo_email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    chars = F.split(F.regexp_replace(F.lower(local), "[^a-z0-9]", ""), "")
    letter = lambda c: c.rlike("[a-z]")
    values = F.transform(chars, lambda c: F.when(letter(c), F.ascii(c) - 97).otherwise(c.try_cast("int")))
    radices = F.transform(chars, lambda c: F.when(letter(c), F.lit(26)).otherwise(F.lit(10)))
    moved = feistel(values, radices, "email", key)
    new = F.zip_with(chars, moved, lambda c, v: F.when(letter(c), F.char(v + 97)).otherwise(v.cast("string")))
    return F.when(local.rlike("[A-Za-z0-9]"), F.concat(refill(local, new), F.lit("@"), domain))


PSEUDONYMS: dict[str, Callable[[Column, str], Column]] = {
    "email": pseudo_email, "iban": pseudo_iban, "date": pseudo_date, "ip": pseudo_ip, "card": pseudo_card, "ssn": pseudo_ssn, "phone": pseudo_phone,
}


def pseudonym(m: Column, key: str = KEY) -> Column:
    """Pseudonym of a found value; null if it fails the check of its form."""
    out = None
    for kind, make in PSEUDONYMS.items():
        out = F.when(_is(m, kind), make(m, key)) if out is None else out.when(_is(m, kind), make(m, key))
    return out


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``(doc_id, text, n_replaced)`` with every validated value replaced."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    rows = rows.withColumn("_found", found)
    some = F.size("_found") > 0
    new = F.when(some, F.transform("_found", lambda m: pseudonym(m, key)))
    rows = rows.withColumn("_new", new)
    filled = F.zip_with("_new", "_found", lambda n, m: F.coalesce(n, m))
    pieces = F.zip_with(F.split(text, PATTERN, -1), F.array_append(filled, F.lit("")), lambda a, b: F.concat(a, b))
    n = F.when(some, F.size(F.filter("_new", lambda x: x.isNotNull()))).otherwise(0)
    return rows.select("doc_id", F.when(some, F.array_join(pieces, "")).otherwise(text).alias("text"), n.cast("long").alias("n_replaced"))
