"""Format-preserving pseudonyms for personal data: keyed Feistel permutations, in SQL functions.

A value is found by its form, validated, split into two halves and run through ROUNDS rounds in
which one half is shifted by a keyed hash (SHA-2) of the other. That permutes the values of one
format among themselves: equal values have equal pseudonyms in every document, whatever their
punctuation, and with the key the permutation can be undone.

| kind | validated by | permuted | kept |
| --- | --- | --- | --- |
| email | a domain with a dot | letters a-z, A-Z and digits of the local part, class by class | the rest |
| card | 13-19 digits in whole groups, Luhn; usual groupings first | all digits but the last | separators; the last digit is the new check digit |
| iban | mod 97 | digits after the check digits | country, letters; new check digits |
| ip | four numbers up to 255 | the 32 bits | the dots |
| ssn | area, group and serial in use | area, group, serial among those in use | dashes |
| phone | 10 digits after an optional country code | the 10 digits, valid exchanges among themselves | country code, punctuation |
| date | a real day, as 2024-01-31, 31.1.2024 or 31/01/2024 | the day in its 400-year cycle | order, separators, padding |

What is not valid stays as it is. Only built-in functions are used; every value costs a bounded
number of hashes, and documents are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpair.llm.tables import column, packed_rows

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")

_NAME = r"[\p{L}\p{N}._%+-]"
# length of an IBAN by country
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_OF_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![\p{{L}}\p{{N}}])" for n, c in _LENGTHS.items())
_FORMS = {
    "email": rf"(?<!{_NAME}){_NAME}++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])+",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?:{_OF_COUNTRY}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}]))",
    "ip": r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)",
    "date": r"(?<![\p{L}\p{N}./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\1\d{4})(?![\p{L}\p{N}]|[./-]\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}]|-\d)",
}
# groups of digits, up to where another form begins; `_cards` looks for the cards among them
_OTHER = "|".join(_FORMS[k] for k in ("ip", "date", "ssn", "phone")).replace(r"([./])\d{1,2}\1", r"[./]\d{1,2}[./]")
_FORMS["card"] = rf"(?<![\p{{L}}\p{{N}}-])\d(?:(?:[ -](?!{_OTHER}))?\d){{12,}}(?![\p{{L}}\p{{N}}]|-\d)"
_USUAL = "^(4,4,4,4|4,6,5|4,6,4|1[3-9])$"  # digits in a card's groups
FORM = "|".join(_FORMS.values())
_CYCLE = 146_097  # days in 400 years, 189 * 773
_START = "1600-01-01"


def _hash(key: str, *parts: Column) -> Column:
    """A number below 2**60 from the key and the parts."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.sha2(text, 256)), 256), 1, 15), 16, 10).cast("bigint")


def _feistel(key: str, kind: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """The permuted halves `l, r`: numbers below left_size and right_size."""

    def step(halves: Column, i: Column) -> Column:
        l, r = halves["l"], halves["r"]
        return F.when(i % 2 == 0, F.struct(((l + _hash(key, kind, i, r)) % left_size).alias("l"), r.alias("r"))).otherwise(
            F.struct(l.alias("l"), ((r + _hash(key, kind, i, l)) % right_size).alias("r"))
        )

    start = F.struct((left % left_size).alias("l"), (right % right_size).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _number(text: Column, first: Column | int, length: Column | int) -> Column:
    first = F.lit(first) if isinstance(first, int) else first
    length = F.lit(length) if isinstance(length, int) else length
    return F.coalesce(text.substr(first, length).try_cast("bigint"), F.lit(0).cast("bigint"))


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _digits(key: str, kind: str, digits: Column) -> Column:
    """Digits (at most 36) permuted among those of their number."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    size = [F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("bigint") for n in (half, rest)]
    out = _feistel(key, F.concat(F.lit(kind), F.length(digits).cast("string")), _number(digits, 1, half), _number(digits, half + 1, rest), *size)
    return _let(out, lambda x: F.concat(F.when(half > 0, _padded(x["l"], half)).otherwise(F.lit("")), _padded(x["r"], rest)))


def _fit(value: Column, digits: Column) -> Column:
    """The value with its digits replaced, in order."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(
            c.rlike("[0-9]"), F.struct(F.concat(acc["s"], digits.substr(acc["n"], F.lit(1))).alias("s"), (acc["n"] + 1).alias("n"))
        ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n")))

    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("n"))
    return F.aggregate(F.split(value, ""), start, step)["s"]


def _luhn(digits: Column) -> Column:
    """The check digit that belongs behind the digits."""
    doubled = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int") + 1)).otherwise(c.try_cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _card(key: str, value: Column) -> Column:
    def pseudonym(digits: Column) -> Column:
        body = digits.substr(F.lit(1), F.length(digits) - 1)
        return _fit(value, _let(_digits(key, "card", body), lambda b: F.concat(b, _luhn(b))))

    return _let(F.regexp_replace(value, "[^0-9]", ""), pseudonym)


def _cards(key: str, value: Column) -> Column:
    """`s, n`: the digit groups of the value with pseudonyms of the cards in it, and their number.

    A card is a stretch of whole groups. From left to right the longest is taken, unless a
    card in one of the usual groupings begins in it."""

    def is_card(digits: Column) -> Column:
        last = F.length(digits)
        right = digits.substr(last, F.lit(1)) == _luhn(digits.substr(F.lit(1), last - 1))
        return F.when(last.between(13, 19), right).otherwise(F.lit(False))

    def replaced(x: Column) -> Column:
        groups, gaps = x["groups"], x["gaps"]
        places = F.sequence(F.lit(0), F.size(groups) - 1)

        def ends(i: Column) -> Column:
            last = F.least(i + 18, F.size(groups) - 1)
            return F.filter(F.sequence(i, last), lambda j: _let(F.array_join(F.slice(groups, i + 1, j - i + 1), ""), is_card))

        def usual(i: Column, found: Column) -> Column:
            def form(j: Column) -> Column:
                sizes = F.transform(F.slice(groups, i + 1, j - i + 1), lambda g: F.length(g).cast("string"))
                return F.array_join(sizes, ",").rlike(_USUAL)

            return F.coalesce(F.get(F.filter(found, form), F.lit(0)), F.lit(-1))

        def scanned(spans: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                def free(j: Column) -> Column:
                    return ~F.exists(F.slice(spans, i + 2, j - i), lambda s: s["usual"] >= 0)

                own = F.get(spans, i)
                longest = F.coalesce(F.array_max(F.filter(own["ends"], free)), F.lit(-1))

                def taken(j: Column) -> Column:
                    parts = F.transform(F.sequence(i, F.greatest(i, j)), lambda k: F.concat(F.when(k > i, F.get(gaps, k)).otherwise(F.lit("")), F.get(groups, k)))
                    text = _let(F.array_join(parts, ""), lambda t: F.when(j >= 0, _card(key, t)).otherwise(t))
                    return F.struct(
                        F.concat(acc["s"], F.get(gaps, i), text).alias("s"),
                        (acc["n"] + F.when(j >= 0, 1).otherwise(0)).alias("n"),
                        F.when(j >= 0, j + 1).otherwise(i + 1).alias("next"),
                    )

                best = F.when(own["usual"] >= 0, own["usual"]).otherwise(longest)
                return F.when(i < acc["next"], acc).otherwise(_let(best, taken))

            start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(0).alias("next"))
            return F.aggregate(places, start, step)

        spans = F.transform(places, lambda i: _let(ends(i), lambda e: F.struct(e.alias("ends"), usual(i, e).alias("usual"))))
        return _let(spans, scanned)

    return _let(F.struct(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)).alias("groups"), F.split(value, "[0-9]+").alias("gaps")), replaced)


def _mod97(text: Column) -> Column:
    """Remainder of the number that letters (as 10..35) and digits spell."""

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - F.lit(55)
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(key: str, value: Column) -> Column:
    """Of a value that is not valid, its longest valid part up to a space is."""

    def pseudonym(text: Column, plain: Column) -> Column:
        country, body = plain.substr(F.lit(1), F.lit(2)), plain.substr(F.lit(5), F.length(plain))
        new_body = _fit(body, _digits(key, "iban", F.regexp_replace(body, "[^0-9]", "")))
        check = _let(new_body, lambda b: F.concat(_padded(98 - _mod97(F.concat(b, country, F.lit("00"))), 2), F.regexp_replace(b, "[^0-9]", "")))
        return F.when(body.rlike("[0-9]"), _fit(text, check)).otherwise(text)

    def valid(text: Column) -> Column:
        plain = F.regexp_replace(text, " ", "")
        return (F.length(plain) >= 12) & (_mod97(F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))) == 1)

    def cut(words: Column) -> Column:
        parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, 1, k), " "))
        found = F.get(F.filter(parts, valid), F.lit(0))
        return _let(found, lambda t: F.concat(pseudonym(t, F.regexp_replace(t, " ", "")), value.substr(F.length(t) + 1, F.length(value))))

    return _let(F.split(value, " "), cut)


def _ip(key: str, value: Column) -> Column:
    def pseudonym(parts: Column) -> Column:
        n = [parts[i].try_cast("bigint") for i in range(4)]
        out = _feistel(key, F.lit("ip"), n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536))
        text = _let(out, lambda x: F.concat_ws(".", F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))
        return F.when(F.forall(parts, lambda p: p.try_cast("int") <= 255), text)

    return _let(F.split(value, "\\."), pseudonym)


def _ssn(key: str, value: Column) -> Column:
    area, group, serial = _number(value, 1, 3), _number(value, 5, 2), _number(value, 8, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    out = _feistel(key, F.lit("ssn"), index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def text(x: Column) -> Column:
        place = F.floor(x["l"] / 99)
        return F.concat_ws("-", _padded(F.when(place >= 665, place + 2).otherwise(place + 1), 3), _padded(x["l"] % 99 + 1, 2), _padded(x["r"] + 1, 4))

    return F.when(valid, _let(out, text))


def _phone(key: str, value: Column) -> Column:
    def pseudonym(digits: Column) -> Column:
        code = digits.substr(F.lit(1), F.length(digits) - 10)
        own = digits.substr(F.length(digits) - 9, F.lit(10))
        area, exchange, line = _number(own, 1, 3), _number(own, 4, 3), _number(own, 7, 4)
        out = _feistel(
            key, F.lit("phone"), (area - 200) * 100 + F.floor(line / 100), (exchange - 200) * 100 + line % 100, F.lit(80000), F.lit(80000)
        )
        valid = _let(
            out,
            lambda x: F.concat(_padded(F.floor(x["l"] / 100) + 200, 3), _padded(F.floor(x["r"] / 100) + 200, 3), _padded(x["l"] % 100, 2), _padded(x["r"] % 100, 2)),
        )
        # numbers without a valid area or exchange walk on until they meet another of their kind
        other = F.aggregate(
            F.array(*[F.lit(i) for i in range(40)]),
            _digits(key, "phone", own),
            lambda d, _: F.when(d.rlike("^[2-9]..[2-9]"), _digits(key, "phone", d)).otherwise(d),
        )
        return _fit(value, F.concat(code, F.when((area >= 200) & (exchange >= 200), valid).otherwise(other)))

    return _let(F.regexp_replace(value, "[^0-9]", ""), pseudonym)


def _date(key: str, value: Column) -> Column:
    iso = value.substr(F.lit(5), F.lit(1)) == "-"
    parts = F.split(value, "[^0-9]")
    year, month, day = (F.when(iso, parts[i]).otherwise(parts[2 - i]) for i in range(3))
    real = F.try_to_date(F.concat_ws("-", _padded(year, 4), _padded(month, 2), _padded(day, 2)), "yyyy-MM-dd")
    place = F.datediff(real, F.lit(_START).cast("date")).cast("bigint")

    def text(x: Column) -> Column:
        new = F.date_add(F.lit(_START).cast("date"), (F.floor(place / _CYCLE) * _CYCLE + x["l"] * 773 + x["r"]).cast("int"))
        mark = F.regexp_extract(value, "[^0-9]", 0)
        short = [F.when(F.length(parts[i]) == 2, F.date_format(new, f)).otherwise(F.date_format(new, f[0])) for i, f in ((0, "dd"), (1, "MM"))]
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(short[0], mark, short[1], mark, F.date_format(new, "yyyy")))

    def permuted(p: Column) -> Column:
        return _let(_feistel(key, F.lit("date"), F.floor(p / 773), p % 773, F.lit(189), F.lit(773)), text)

    return F.when(real.isNotNull(), _let(F.pmod(place, F.lit(_CYCLE)), permuted))


def _email(key: str, value: Column) -> Column:
    """Letters and digits shift within their class by a keyed hash of the other half."""
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    half = F.floor(F.length(name) / 2).cast("int")

    def shifted(text: Column, other: Column, i: Column) -> Column:
        def one(c: Column, stream: Column, j: Column) -> Column:
            by = F.conv(stream.substr(j % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")

            def turn(first: int, size: int) -> Column:
                return F.chr(F.lit(first) + (F.ascii(c) - first + by) % size)

            return F.when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).when(c.rlike("[0-9]"), turn(48, 10)).otherwise(c)

        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), F.length(name).cast("string"), other), 512)
        return _let(stream, lambda s: F.array_join(F.transform(F.split(text, ""), lambda c, j: one(c, s, j)), ""))

    def step(halves: Column, i: Column) -> Column:
        return F.struct(halves["r"].alias("l"), shifted(halves["l"], halves["r"], i).alias("r"))

    start = F.struct(name.substr(F.lit(1), half).alias("l"), name.substr(half + 1, F.length(name)).alias("r"))
    done = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)
    return _let(done, lambda x: F.concat(x["l"], x["r"], F.lit("@"), domain))


_PSEUDONYMS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}


def _kind(value: Column) -> Column:
    """Which form a found value has: the forms differ in what they are made of."""
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(value.rlike("^[A-Z]"), "iban")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(value.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\2\d{4})$"), "date")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^(\+\d{1,3}[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"), "phone")
        .otherwise("card")
    )


def pseudonym(value: Column, key: str) -> Column:
    """`kind, value, n` of one found value; kind is null, and the value as it was, if nothing in it
    is valid. n: how many values were in it; several only of cards."""

    def named(kind: Column) -> Column:
        new = F.lit(None).cast("string")
        for name, replaced in _PSEUDONYMS.items():
            new = F.when(kind == name, replaced(key, value)).otherwise(new)
        one = _let(new, lambda x: F.struct(F.when(x.isNotNull(), kind).alias("kind"), F.coalesce(x, value).alias("value"), F.lit(1).alias("n")))
        cards = _let(_cards(key, value), lambda x: F.struct(F.when(x["n"] > 0, kind).alias("kind"), x["s"].alias("value"), x["n"].alias("n")))
        return F.when(kind == "card", cards).otherwise(one)

    return _let(_kind(value), named)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with pseudonyms in the text column, and counts `n_email` ... `n_card` of those set.

    A null text stays null with counts of 0; an empty one stays empty. Repeated values, in one
    document or many, get one pseudonym; repeated rows give equal rows. Columns named as the
    counts are replaced; others are passed on.
    """
    kept = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    rows = packed_rows(docs, _text=column(text_col).cast("string"))
    rows = rows.withColumn("_found", F.regexp_extract_all("_text", F.lit(FORM), F.lit(0)))
    rows = rows.withColumn("_new", F.when(F.size("_found") > 0, F.transform("_found", lambda v: pseudonym(v, key))))
    whole = F.array_join(
        F.transform(F.split("_text", FORM, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get("_new", i)["value"], F.lit("")))), ""
    )
    new_text = F.when(F.size("_found") > 0, whole).otherwise(F.col("_text"))

    def count(kind: str) -> Column:
        found = F.filter("_new", lambda v: v["kind"] == kind)
        return F.coalesce(F.aggregate(found, F.lit(0), lambda a, v: a + v["n"]), F.lit(0)).cast("bigint").alias(f"n_{kind}")

    return rows.select(*[new_text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in kept], *[count(k) for k in KINDS])
