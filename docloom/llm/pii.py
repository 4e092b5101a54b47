"""Format-preserving pseudonyms for personal data.

Payment cards, telephone and social security numbers, IPv4 addresses and dates are validated, then mapped by a keyed
Feistel permutation of their own format: a card stays a card with a right check digit, a date stays a date. The map is
a bijection, so equal values stay equal across documents and different ones stay different. Mail addresses, which
aren't numbers, get a keyed token of their lower-case form.

A value is a number below a * b, held as (x, y) with x < a and y < b. Each round adds a keyed hash of one half to the
other, modulo that half's bound; every round can be undone, so ROUNDS of them permute the a * b values.

DataFrame expressions only. Texts without a digit and without an @ are not searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, table

ROUNDS = 10
#: The query's key. It is public, so its pseudonyms can be undone; pseudonymise() has no default one.
QUERY_KEY = "docloom-demo-key"

#: (kind, pattern); alternatives in this order at each place.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("date", r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[/.-][0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
)
ANY = "|".join(f"({p})" for k, p in PATTERNS if k != "card")
KINDS = [k for k, _ in PATTERNS]
#: Maximal runs of 13 digits or more over single blanks and hyphens; the blocks of a run; what starts at each block and
#: is long enough for a card.
RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+"
BLOCK = r"(?<=[ -])(?=[0-9])"
AT_BLOCK = r"(?<![0-9])(?=[0-9])(?:(?=([0-9](?:[ -]?[0-9]){12,18}(?![0-9])))|)"
#: 400 Gregorian years from FIRST_DAY on: 146097 = 189 * 773 days.
FIRST_DAY, LAST_DAY = "1800-01-01", "2199-12-31"
DAYS_A, DAYS_B = 189, 773


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """struct<x, y>: the image of (x, y), x < a, y < b. All longs below 2**62."""
    def noise(half: Column, r: Column, bound: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), half.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), bound)

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, (s["x"] + noise(s["y"], r, a)) % a).otherwise(s["x"]).alias("x"),
            F.when(even, s["y"]).otherwise((s["y"] + noise(s["x"], r, b)) % b).alias("y"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Of a digit string whose last digit is the check digit."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def _permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Digits of the same number, 2 to 36 of them, halves as numbers."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    power = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
    s = feistel(F.substr(digits, F.lit(1), left).cast("long"), F.substr(digits, left + 1, right).cast("long"), power(left), power(right), key, F.concat(tweak, n.cast("string")))
    return F.transform(F.array(s), lambda t: F.concat(F.lpad(t["x"].cast("string"), left, "0"), F.lpad(t["y"].cast("string"), right, "0")))[0]


def _refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced, in order, by the given ones."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    one = lambda s, c: F.when(c.rlike("[0-9]"), F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"))).otherwise(F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out")))
    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, one)["out"]


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def _card(v: Column, key: str) -> Column:
    def mapped(d: Column) -> Column:
        def closed(body: Column) -> Column:
            check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
            return _refill(v, F.concat(body, check.cast("string")))

        body = _permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
        return _let(body, closed)

    return _let(_digits(v), mapped)


def _cards(run: Column, key: str) -> Column:
    """struct<text, n>: a run of digit blocks with its n cards replaced.

    A card is one block or several neighbouring ones with 13 to 19 digits and a right check digit; from the left, at each
    block the longest."""
    def longest(window: Column) -> Column:
        """The longest card that the window starts with, or null. The window ends with a block."""
        sizes = F.array(*[F.regexp_extract(window, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in range(19, 12, -1)])
        valid = F.filter(sizes, lambda c: F.when(c != "", _luhn_sum(_digits(c)) % 10 == 0).otherwise(False))
        return F.when(window != "", F.get(valid, F.lit(0)))

    at = F.transform(F.regexp_extract_all(run, F.lit(AT_BLOCK), F.lit(1)), longest)
    blocks = F.arrays_zip(F.split(run, BLOCK, -1).alias("block"), at.alias("card"))  # a block with the mark after it
    # left: characters of a card that are still to come; below 0 a mark follows the card
    def step(s: Column, x: Column) -> Column:
        def after(left: Column, out: Column, n: Column) -> Column:
            rest = left - F.length(x["block"])
            return F.struct(rest.alias("left"), F.concat(out, F.when(rest < 0, F.right(x["block"], F.lit(1))).otherwise("")).alias("text"), n.alias("n"))

        begins = F.length(x["card"])
        return F.when(s["left"] > 0, after(s["left"], s["text"], s["n"])).when(
            x["card"].isNotNull(), after(begins, F.concat(s["text"], _card(x["card"], key)), s["n"] + 1)
        ).otherwise(F.struct(F.lit(0).alias("left"), F.concat(s["text"], x["block"]).alias("text"), s["n"].alias("n")))

    out = F.aggregate(blocks, F.struct(F.lit(0).alias("left"), F.lit("").alias("text"), F.lit(0).alias("n")), step)
    return F.transform(F.array(out), lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n")))[0]


def _with_cards(piece: Column, key: str) -> Column:
    """struct<text, n>: a piece of text with its n cards replaced."""
    def of(runs: Column) -> Column:
        both = F.zip_with(F.split(piece, RUN, -1), runs, lambda p, r: F.concat(p, F.coalesce(r["text"], F.lit(""))))
        return F.struct(F.array_join(both, "").alias("text"), F.aggregate(runs, F.lit(0), lambda n, r: n + r["n"]).alias("n"))

    runs = F.transform(F.regexp_extract_all(piece, F.lit(RUN), F.lit(0)), lambda r: _cards(r, key))
    return F.when(piece.rlike(RUN), _let(runs, of)).otherwise(F.struct(piece.alias("text"), F.lit(0).alias("n")))


def _phone(v: Column, key: str) -> Column:
    """The last ten digits; a country code stays. Area and exchange codes are 200 to 999 without those that end in 11,
    and so are their images."""
    def valid(code: Column) -> Column:
        return (code >= 200) & (code % 100 != 11)

    def index(code: Column) -> Column:
        """0 to 791: each hundred has 99 codes."""
        return code - 200 - F.floor((code - 111) / 100)

    def code(i: Column) -> Column:
        return F.lit(200) + F.floor(i / 99) * 100 + i % 99 + F.when(i % 99 >= 11, 1).otherwise(0)

    def mapped(d: Column) -> Column:
        n = F.length(d)
        area, exchange, line = (F.substr(d, n - at, F.lit(size)).cast("long") for at, size in ((9, 3), (6, 3), (3, 4)))
        wide = F.lit(79200).cast("long")
        image = feistel(index(area) * 100 + F.floor(line / 100), index(exchange) * 100 + line % 100, wide, wide, key, F.lit("phone"))

        def shown(s: Column) -> Column:
            new = F.format_string("%03d%03d%02d%02d", code(F.floor(s["x"] / 100)).cast("long"), code(F.floor(s["y"] / 100)).cast("long"), (s["x"] % 100).cast("long"), (s["y"] % 100).cast("long"))
            return _refill(v, F.concat(F.substr(d, F.lit(1), n - 10), new))

        return F.when(valid(area) & valid(exchange), _let(image, shown))

    return _let(_digits(v), mapped)


def _ssn(v: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    part = lambda i: F.split_part(v, F.lit("-"), F.lit(i)).cast("long")
    area, group, serial = part(1), part(2), part(3)
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    index = (area - F.when(area > 666, 2).otherwise(1)) * 99 + (group - 1)

    def shown(s: Column) -> Column:
        new = F.floor(s["x"] / 99)
        new = new + F.when(new >= 665, 2).otherwise(1)
        return F.format_string("%03d-%02d-%04d", new.cast("long"), (s["x"] % 99 + 1).cast("long"), (s["y"] + 1).cast("long"))

    return F.when(valid, _let(feistel(index, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn")), shown))


def _ip(v: Column, key: str) -> Column:
    part = lambda i: F.split_part(v, F.lit("."), F.lit(i)).cast("long")
    valid = (part(1) <= 255) & (part(2) <= 255) & (part(3) <= 255) & (part(4) <= 255)
    wide = F.lit(65536).cast("long")

    def shown(s: Column) -> Column:
        return F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256)])

    return F.when(valid, _let(feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), wide, wide, key, F.lit("ip")), shown))


def _date(v: Column, key: str) -> Column:
    iso = v.rlike("^[0-9]{4}-")
    mark = F.substring(v, 3, 1)
    as_iso = F.when(iso, v).otherwise(F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2)))
    day = F.try_to_date(as_iso, "yyyy-MM-dd")

    def mapped(d: Column) -> Column:
        n = F.datediff(d, F.lit(FIRST_DAY).cast("date")).cast("long")

        def shown(s: Column) -> Column:
            new = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["x"] * DAYS_B + s["y"]).cast("int"))
            return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat_ws("", F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "yyyy")))

        inside = (d >= F.lit(FIRST_DAY).cast("date")) & (d <= F.lit(LAST_DAY).cast("date"))
        return F.when(inside, _let(feistel(F.floor(n / DAYS_B), n % DAYS_B, F.lit(DAYS_A).cast("long"), F.lit(DAYS_B).cast("long"), key, F.lit("date")), shown))

    return _let(day, mapped)


def _email(v: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), ascii_lower(v)), 256), 1, 16), F.lit("@example.invalid"))


_MAPS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}


def pseudonymise(documents: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, n_found, n_email, n_ip, n_date, n_ssn, n_phone, n_card (long).

    Values that fail their validation (a card's check digit, a date's calendar, an address's bytes, a number's area)
    stay as they are and aren't counted. Cards are looked for after all else, in the digit blocks that are left, so one
    beside an expiry date or a code is found; where a longer grouping passes by chance, it is taken as the card.

    Dates are year-month-day or day-month-year: a month-first one stays if its day is over 12. Telephone numbers have
    the North American layout with a bracket, dot or hyphen after the area; others, such as '+1 555 123 4567', and those
    with an area or exchange code that can't be, stay.

    Null texts stay null with counts of 0; empty ones stay empty; repeated rows are treated alike, and rows without an id
    too; extra columns aren't carried; an empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    may = F.col("text").rlike("[0-9@]")
    found = F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    docs = docs.withColumn("found", found)
    has = (F.size("found") > 0) | F.col("text").rlike(RUN)
    docs = docs.withColumn("cut", F.when(has, F.transform(F.split("text", ANY, -1), lambda p: _with_cards(p, key))))
    docs = docs.withColumn("pieces", F.transform("cut", lambda p: p["text"]))

    def kind_of(v: Column) -> Column:
        """The first kind whose whole pattern the value has; look-arounds hold at its ends."""
        out = F.lit(None).cast("string")
        for kind, pattern in reversed(PATTERNS[:-1]):
            out = F.when(v.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
        return out

    def mapped(v: Column) -> Column:
        def by_kind(k: Column) -> Column:
            out = F.lit(None).cast("string")
            for kind, f in _MAPS.items():
                out = F.when(k == kind, f(v, key)).otherwise(out)
            return F.transform(F.array(out), lambda x: F.struct(F.coalesce(x, v).alias("to"), F.when(x.isNotNull(), k).alias("kind")))[0]

        return _let(kind_of(v), by_kind)

    docs = docs.withColumn("new", F.when(has, F.transform("found", mapped)))
    # pieces and values alternate; there is one more piece
    both = F.flatten(F.zip_with("pieces", F.transform("new", lambda x: x["to"]), lambda p, m: F.array(p, F.coalesce(m, F.lit("")))))
    count = lambda k: F.coalesce(F.size(F.filter("new", lambda x: x["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    cards = F.coalesce(F.aggregate("cut", F.lit(0).cast("long"), lambda n, p: n + p["n"]), F.lit(0).cast("long"))
    counts = [F.when(has, cards if k == "card" else count(k)).otherwise(F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS]
    out = docs.select("doc_id", F.when(has, F.array_join(both, "")).otherwise(F.col("text")).alias("text"), *counts)
    total = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long"))
    return out.select("doc_id", "text", total.alias("n_found"), *[f"n_{k}" for k in KINDS])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), QUERY_KEY)
