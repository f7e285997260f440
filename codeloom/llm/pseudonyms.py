"""Format-preserving Feistel pseudonyms for personal numbers and dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import let, text_of

ROUNDS = 10

#: Dates from 1900-01-01 to 2099-12-31 are permuted: 73,049 days, the product of these two.
FIRST_DAY = "1900-01-01"
DAY_SIDES = (17, 4297)

EDGE, END = r"(?<![A-Za-z0-9_.+-])", r"(?![A-Za-z0-9_])"

#: Candidates in the order in which they are tried at one place; their checks follow below.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+",
    "ip": EDGE + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![A-Za-z0-9_]|\.\d)",
    "date": EDGE + r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})" + END,
    "ssn": EDGE + r"\d{3}-\d{2}-\d{4}(?![A-Za-z0-9_-])",
    "phone": r"(?<![A-Za-z0-9_])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}" + END,
    "card": EDGE + r"\d(?:[ -]?\d){12,18}(?![A-Za-z0-9_]|[-.]\d)",
}

ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def div(a: Column, b: Column) -> Column:
    """Whole quotient, exact for all bigints."""
    return F.call_function("div", a, b)


def keyed(key: str, *parts: Column) -> Column:
    """60 bits of SHA-256 over the key and the parts, as a number from 0."""
    text = F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(value: Column, left: Column, right: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A keyed permutation of the numbers below ``left * right``; rounds add to both halves in turn."""
    start = F.struct(div(value, right).alias("l"), F.pmod(value, right).cast("bigint").alias("r"))
    sign = -1 if inverse else 1

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        l_new = F.pmod(s["l"] + F.lit(sign) * F.pmod(keyed(key, F.lit(kind), i, s["r"]), left), left)
        r_new = F.pmod(s["r"] + F.lit(sign) * F.pmod(keyed(key, F.lit(kind), i, s["l"]), right), right)
        return F.struct(
            F.when(odd, l_new).otherwise(s["l"]).cast("bigint").alias("l"),
            F.when(odd, s["r"]).otherwise(r_new).cast("bigint").alias("r"),
        )

    order = range(ROUNDS, 0, -1) if inverse else range(1, ROUNDS + 1)
    rounds = F.array(*map(F.lit, order))
    return F.aggregate(rounds, start, turn, lambda s: s["l"] * right + s["r"])


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("bigint")


def permuted_digits(digits: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """Digits of the same count, at most 18, by a Feistel network over two halves."""
    n = F.length(digits)
    half = F.floor(n / 2)
    out = feistel(digits.cast("bigint"), _pow10(n - half), _pow10(half), key, kind, inverse)
    return F.lpad(out.cast("string"), n, "0")


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one is the check digit."""
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.pmod(F.length(digits) - i, F.lit(2)) == 0
        return F.when(doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), weigh), F.lit(0), lambda a, x: a + x)


def refill(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced in order; both have equally many."""
    def put(c: Column, i: Column) -> Column:
        at = F.length(only_digits(F.substring(layout, F.lit(1), i + 1)))
        return F.when(c.rlike("^[0-9]$"), F.substring(digits, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(layout, ""), put), "")


def _card(m: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        check = lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
        valid = (luhn_sum(d) % 10 == 0) & (F.translate(d, "0", "") != "")
        return F.when(valid, refill(m, let(body, check)))

    return let(only_digits(m), swap)


def _phone(m: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        n = F.least(F.lit(10), F.length(d) - 1)
        tail = permuted_digits(F.substring(d, F.length(d) - n + 1, n), key, "phone")
        return F.when(F.length(d).between(8, 15), refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - n), tail)))

    return let(only_digits(m), swap)


def _ip(m: Column, key: str) -> Column:
    def swap(p: Column) -> Column:
        octets = [p[i].cast("bigint") for i in range(4)]
        number = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
        valid = F.forall(p, lambda x: (x.cast("int") <= 255) & ~x.rlike("^0[0-9]"))
        new = feistel(number, F.lit(65536), F.lit(65536), key, "ip")
        dotted = let(new, lambda x: F.concat_ws(".", *(F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))
        return F.when(valid, dotted)

    return let(F.split(m, r"\."), swap)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999 are numbered without gaps."""
    area, group, serial = (F.substring(m, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area.between(1, 899)) & (area != 666) & (group >= 1) & (serial >= 1)
    index = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1

    def show(x: Column) -> Column:
        s, ag = F.pmod(x, F.lit(9999)) + 1, div(x, F.lit(9999))
        g, a = F.pmod(ag, F.lit(99)) + 1, div(ag, F.lit(99)) + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        return F.concat_ws("-", *(F.lpad(v.cast("string"), n, "0") for v, n in ((a, 3), (g, 2), (s, 4))))

    return F.when(valid, let(feistel(index, F.lit(898 * 99), F.lit(9999), key, "ssn"), show))


def _date(m: Column, key: str) -> Column:
    """ISO, day.month.year and month/day/year; the new date is written alike."""
    shapes = ((r"^\d{4}-", "yyyy-MM-dd", "yyyy-MM-dd"), (r"\.", "d.M.yyyy", "dd.MM.yyyy"), (r"/", "M/d/yyyy", "MM/dd/yyyy"))
    out = F.lit(None).cast("string")
    for mark, read, show in reversed(shapes):
        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(read))), F.lit(FIRST_DAY).cast("date"))
        new = feistel(day.cast("bigint"), F.lit(DAY_SIDES[0]), F.lit(DAY_SIDES[1]), key, "date")
        text = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), show)
        good = day.between(0, DAY_SIDES[0] * DAY_SIDES[1] - 1)
        out = F.when(m.rlike(mark), F.when(good, text)).otherwise(out)
    return out


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 12), F.lit("@example.org"))


SWAPS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(match: Column, key: str) -> Column:
    """Struct (kind, text) for a candidate; kind is null and text the candidate where its check fails."""
    kind = F.lit(None).cast("string")
    text = match
    for name in reversed(list(SWAPS)):
        is_kind = match.rlike("^(?:" + PATTERNS[name] + ")$")
        text = F.when(is_kind, F.coalesce(SWAPS[name](match, key), match)).otherwise(text)
        kind = F.when(is_kind, F.when(SWAPS[name](match, key).isNotNull(), F.lit(name))).otherwise(kind)
    return F.struct(kind.alias("kind"), text.alias("text"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(row, text, found): each row of ``docs`` with its text after replacement and the kinds replaced, in text order.

    Card numbers (Luhn), IPv4 addresses (octets), telephone numbers (8 to 15 digits after a plus), social security
    numbers (assigned ranges) and calendar dates of 1900 to 2099 are permuted by a keyed Feistel network within their
    format: equal values give equal pseudonyms in all documents, distinct ones distinct pseudonyms, and what is
    written is valid again. Candidates that fail their check stay. Mail addresses have no fixed format to permute;
    they take a keyed digest, so equal ones stay linked too. A text is cut at the candidates and put together
    again within its row: no shuffle, whatever its length. Null texts are empty texts; equal rows give equal rows;
    other columns ride along in ``row``.
    """
    text = text_of()
    candidates = F.regexp_extract_all(F.when(text.rlike("[0-9]{2}|@"), text).otherwise(""), F.lit(ANY), F.lit(0))
    packed = docs.select(
        F.struct("*").alias("row"), text.alias("_text"), F.transform(candidates, lambda m: pseudonym(m, key)).alias("_found")
    )

    def rebuilt(parts: Column) -> Column:
        new = F.concat(F.transform(F.col("_found"), lambda f: f["text"]), F.array(F.lit("")))
        return F.array_join(F.zip_with(parts, new, lambda a, b: F.concat(a, b)), "")

    whole = F.when(F.size("_found") > 0, let(F.split("_text", ANY, -1), rebuilt)).otherwise(F.col("_text"))
    kinds = F.filter(F.transform("_found", lambda f: f["kind"]), lambda k: k.isNotNull())
    return packed.select("row", whole.alias("text"), kinds.alias("found"))
