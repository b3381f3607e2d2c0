"""Format-preserving pseudonyms for validated numbers and dates.

Each value is permuted within its own format by a keyed Feistel network, so the same
value gets the same pseudonym in every document, different values get different ones,
and a pseudonym passes the checks that the value passed.

What is found, and what is permuted:

* card numbers (13 to 19 digits, single spaces or hyphens between, valid check digit):
  all digits but the last; the check digit is made anew. In a run of groups of digits
  each part that starts and ends with a group is tried,
* IBANs (plain or in groups of four, valid check digits): the account's digits, and its
  letters if it has any; the check digits are made anew,
* social security numbers (ddd-dd-dddd, no part zero): all nine digits, permuted again
  until no part is zero,
* phone numbers (+ with a country code that doesn't start with 0, then 7 to 14 digits in
  one group or in several; or three groups of digits, or a bracketed area code and two
  groups; not all digits zero): the digits after the country code, or after the first
  one if none is set apart, permuted again until they aren't all zero,
* IPv4 addresses (four numbers up to 255): the 32 bits,
* dates (yyyy-mm-dd or yyyy/mm/dd, valid): the day, within 65,536 days from 1900-01-01 if
  it is one of these, else among all other days of the years 1 to 9999,
* e-mail addresses: the name before the @, each place among letters of its kind or
  digits; the domain stays.

Ten rounds; the round function is SHA-256 of key, kind, round and the other half. Where
a result may fail its value's check it is permuted again (cycle walking), which stays
one-to-one. WALKS times are enough but for a share of 1 in 10**12 or less; what is left
then keeps the last result. Only DataFrame functions are used, in one pass without a
shuffle. Patterns are possessive or bounded, so each takes time in proportion to the text.

Defined results: a null text stays null and has n_replaced 0. An empty text stays. What
looks like a value but fails its check stays. Permutations are on values, so repeated
rows get equal results. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY = "1900-01-01"
DAYS = 1 << 16

#: Days of the years 1 to 9999, and the number of the first fast one among them.
ALL_DAYS, BEFORE = 3_652_059, 693_595
WALKS = 8

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
DATE = r"(?<![0-9./\-])[0-9]{4}([/\-])[0-9]{2}\2[0-9]{2}(?![0-9/\-])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SOCIAL = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = r"(?<![0-9A-Za-z+])(?:(?:\+[1-9][0-9]{0,2}[ \-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .\-]?[0-9]{3,4}[ .\-][0-9]{4}|\+[1-9](?:[ .\-]?[0-9]){7,14})(?![0-9A-Za-z])"
#: Groups of digits; a date or the like that follows is not part of it.
OTHER = r"[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}(?![0-9/\-])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
RUN = rf"(?<![0-9A-Za-z+\-])(?=[0-9](?:[ \-]?[0-9]){{12}})[0-9]++(?![A-Za-z])(?:[ \-](?!{OTHER})[0-9]++(?![A-Za-z]))*+"
#: A card number by its groups alone.
REGULAR = r"^(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})$"
#: Earlier kinds win where two could start at one place. First IBANs are cut out, then
#: cards, then the others.
WITH_IBAN = "(" + "|".join([EMAIL, IBAN]) + ")"
WITH_CARD = "(" + "|".join([EMAIL, DATE, ADDRESS, SOCIAL, RUN, PHONE]) + ")"
FOUND = "(" + "|".join([EMAIL, DATE, ADDRESS, SOCIAL, PHONE]) + ")"


def let(value: Column, use) -> Column:
    """use(value), with value computed once: within a lambda it would be for each call."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _function(key: str, kind: str, step: Column, half: Column, size: Column) -> Column:
    """A number of up to 60 bits from a half."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), size.cast("string"), step.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str, size: Column) -> Column:
    """The permuted pair: left below left_size and right below right_size stay so.

    Each round adds a hash of one half to the other, modulo that one's size.
    """

    def step(pair: Column, k: Column) -> Column:
        even = k % 2 == 0
        moved_left = F.pmod(pair["left"] + F.pmod(_function(key, kind, k, pair["right"], size), left_size), left_size)
        moved_right = F.pmod(pair["right"] + F.pmod(_function(key, kind, k, pair["left"], size), right_size), right_size)
        return F.struct(F.when(even, moved_left).otherwise(pair["left"]).alias("left"), F.when(even, pair["right"]).otherwise(moved_right).alias("right"))

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of at least two digits (at most 36), permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    sizes = F.array(*[F.lit(10**k) for k in range(19)])
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n)
    pair = feistel(left, right, F.element_at(sizes, half + 1), F.element_at(sizes, n - half + 1), key, kind, n)
    return let(pair, lambda x: F.concat(F.lpad(x["left"].cast("string"), half, "0"), F.lpad(x["right"].cast("string"), n - half, "0")))


def only_digits(value: Column) -> Column:
    return F.translate(value, " +-.()", "")


def refilled(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by the given ones."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def filled(digits: Column) -> Column:
        def put(state: Column, letter: Column) -> Column:
            digit = letter.between("0", "9")
            return F.struct(F.concat(state["out"], F.when(digit, F.substring(digits, state["at"], F.lit(1))).otherwise(letter)).alias("out"), (state["at"] + digit.cast("int")).alias("at"))

        return F.aggregate(F.split(value, ""), start, put, lambda x: x["out"])

    return let(digits, filled)


def luhn_digit(digits: Column) -> Column:
    """The check digit that follows the digits."""
    letters = F.reverse(F.split(digits, ""))
    doubled = F.transform(letters, lambda x, k: F.when(k % 2 == 0, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, b: a + b)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def remainder_97(value: Column) -> Column:
    """Of the number that letters A-Z (as 10 to 35) and digits make."""
    code = lambda b: F.ascii(b)
    return F.aggregate(F.split(value, ""), F.lit(0), lambda a, b: F.when(code(b) >= 65, a * 100 + code(b) - 55).otherwise(a * 10 + code(b) - 48) % 97)


def valid_card(value: Column) -> Column:
    """Of digits with spaces and hyphens between."""
    digits = F.translate(value, " -", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def valid_iban(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & (remainder_97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)


def _marked_ibans(value: Column, mark: Column) -> Column:
    """value with the longest valid IBAN at its start between marks."""
    groups = F.split(value, " ")
    starts = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, 1, k), " "))
    found = F.get(F.filter(starts, valid_iban), F.lit(0))
    return F.when(found.isNotNull() & ~value.contains("@"), F.concat(mark, found, mark, F.substring(value, F.length(found) + 1, F.length(value)))).otherwise(value)


#: Groups of a run that are joined at a time, so that no text is copied once for each group.
GROUPS = 512


def _marked_cards(value: Column, mark: Column) -> Column:
    """value, if a run of groups of digits, with each valid card number between marks.

    Of those that start at a group the longest is taken, but one whose groups are a
    card's wins, also over those that start before it and reach into it.
    """

    def with_groups(groups: Column) -> Column:
        n = F.size(groups)

        def part(k: Column, size: Column) -> Column:
            return F.rtrim(F.array_join(F.slice(groups, k, size), ""), F.lit(" -"))

        def at(k: Column) -> Column:
            sizes = F.filter(F.sequence(F.least(F.lit(19), n - k + 1), F.lit(1), F.lit(-1)), lambda size: valid_card(part(k, size)))

            def best(valid: Column) -> Column:
                regular = F.get(F.filter(valid, lambda size: part(k, size).rlike(REGULAR)), F.lit(0))
                return F.struct(F.coalesce(regular, F.get(valid, F.lit(0)), F.lit(0)).alias("size"), regular.isNotNull().alias("regular"))

            return let(sizes, best)

        def put_with(found: Column):
            def put(state: Column, k: Column) -> Column:
                here = F.get(found, k - 1)
                taken = (k >= state["next"]) & (here["size"] > 0) & (here["regular"] | ~F.exists(F.slice(found, k + 1, F.greatest(here["size"] - 1, F.lit(0))), lambda x: x["regular"]))
                card = part(k, here["size"])
                whole = F.array_join(F.slice(groups, k, here["size"]), "")
                out = F.when(taken, F.concat(mark, card, mark, F.substring(whole, F.length(card) + 1, F.lit(1)))).when(k < state["next"], F.lit("")).otherwise(F.get(groups, k - 1))
                return F.struct(F.concat(state["out"], out).alias("out"), F.when(taken, k + here["size"]).otherwise(state["next"]).alias("next"))

            return put

        def joined(found: Column) -> Column:
            def chunk(state: Column, first: Column) -> Column:
                ks = F.sequence(first, F.least(first + GROUPS - 1, n))
                start = F.struct(F.lit("").alias("out"), state["next"].alias("next"))
                return let(F.aggregate(ks, start, put_with(found)), lambda x: F.struct(F.concat(state["out"], x["out"]).alias("out"), x["next"].alias("next")))

            return F.aggregate(F.sequence(F.lit(1), n, F.lit(GROUPS)), F.struct(F.lit("").alias("out"), F.lit(1).alias("next")), chunk, lambda x: x["out"])

        return let(F.transform(F.sequence(F.lit(1), n), at), joined)

    is_run = value.rlike("^[0-9][0-9 \\-]*+$") & (F.length(only_digits(value)) >= 13)
    return F.when(is_run, let(F.regexp_extract_all(value, F.lit("[0-9]+[ \\-]?"), 0), with_groups)).otherwise(value)


def _each(text: Column, pattern: str, make) -> Column:
    """text with each match of the pattern replaced by make(match)."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 1), lambda gap, x: F.concat(gap, F.coalesce(make(x), F.lit(""))))
    return F.array_join(pieces, "")


def walked(first: Column, again, bad) -> Column:
    """first permuted again, by again, while it is bad; WALKS times at most."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(bad(x), again(x)).otherwise(x))


def _card(value: Column, key: str) -> Column:
    digits = only_digits(value)
    new = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return let(new, lambda x: refilled(value, F.concat(x, luhn_digit(x))))


def _iban(value: Column, key: str) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    account = F.substring(plain, F.lit(5), F.length(plain))
    new = F.when(account.rlike("^[0-9]+$"), permuted_digits(account, key, "iban")).otherwise(permuted_name(account, key))

    def with_check(x: Column) -> Column:
        check = F.lpad((98 - remainder_97(F.concat(x, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(plain, 1, 2), check, x)

    out = let(new, with_check)
    return F.when(value.contains(" "), F.regexp_replace(out, "(.{4})(?=.)", "$1 ")).otherwise(out)


#: What a social security number's digits can't be.
NOT_SOCIAL = "^(?:000.*|...00.*|.*0000)$"


def _social(value: Column, key: str) -> Column:
    digits = only_digits(value)
    once = lambda x: permuted_digits(x, key, "social")
    return F.when(~digits.rlike(NOT_SOCIAL), refilled(value, walked(once(digits), once, lambda x: x.rlike(NOT_SOCIAL))))


def _phone(value: Column, key: str) -> Column:
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ \-(])|^\+[0-9]", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    digits = only_digits(rest)
    once = lambda x: permuted_digits(x, key, "phone")
    return F.when(~digits.rlike("^0+$"), F.concat(code, refilled(rest, walked(once(digits), once, lambda x: x.rlike("^0+$")))))


def _address(value: Column, key: str) -> Column:
    numbers = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    at = [F.element_at(numbers, k) for k in range(1, 5)]
    pair = feistel(at[0] * 256 + at[1], at[2] * 256 + at[3], F.lit(1 << 16), F.lit(1 << 16), key, "address", F.lit(32))
    text = lambda x: F.concat_ws(".", F.floor(x["left"] / 256).cast("string"), (x["left"] % 256).cast("string"), F.floor(x["right"] / 256).cast("string"), (x["right"] % 256).cast("string"))
    return F.when(F.array_max(numbers) <= 255, let(pair, text))


def _date(value: Column, key: str) -> Column:
    mark = F.substring(value, 5, 1)
    day = F.date_diff(F.try_to_date(F.translate(value, "/", "-"), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
    near = let(feistel(F.floor(day / 256), F.pmod(day, F.lit(256)), F.lit(256), F.lit(256), key, "date", F.lit(16)), lambda p: p["left"] * 256 + p["right"])
    # Other days are numbered from 0; of 2000 x 1794 places some lie behind the last.
    others = ALL_DAYS - DAYS
    start = F.when(day < 0, day + BEFORE).otherwise(day + BEFORE - DAYS)

    def once(x: Column) -> Column:
        return let(feistel(F.floor(x / 2000), F.pmod(x, F.lit(2000)), F.lit(1794), F.lit(2000), key, "date", F.lit(22)), lambda p: p["left"] * 2000 + p["right"])

    far = let(walked(once(start), once, lambda x: x >= others), lambda x: F.when(x < BEFORE, x - BEFORE).otherwise(x - BEFORE + DAYS))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), F.when(day.between(0, DAYS - 1), near).otherwise(far).cast("int"))
    text = F.date_format(new, "yyyy-MM-dd")
    return F.when(day.isNotNull() & ~value.startswith("0000"), F.when(mark == "/", F.translate(text, "-", "/")).otherwise(text))


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _moved(half: Column, digest: Column) -> Column:
    """Each letter and digit moved within its alphabet by a byte of the digest."""

    def move(letter: Column, k: Column) -> Column:
        by = F.conv(F.substring(digest, F.pmod(k, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def within(alphabet: str) -> Column:
            place = F.instr(F.lit(alphabet), letter) - 1
            return F.substring(F.lit(alphabet), F.pmod(place + by, F.lit(len(alphabet))) + 1, F.lit(1))

        return F.when(letter.rlike("^[a-z]$"), within(LOWER)).when(letter.rlike("^[A-Z]$"), within(UPPER)).when(letter.rlike("^[0-9]$"), within(DIGITS)).otherwise(letter)

    return F.array_join(F.transform(F.split(half, ""), move), "")


def permuted_name(name: Column, key: str) -> Column:
    """A name permuted among those with the same kinds of characters in each place."""
    n = F.length(name)
    half = F.floor(n / 2).cast("int")

    def step(pair: Column, k: Column) -> Column:
        other = F.when(k % 2 == 0, pair["right"]).otherwise(pair["left"])
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit("name"), n.cast("string"), k.cast("string"), other), 256)
        return F.struct(
            F.when(k % 2 == 0, _moved(pair["left"], digest)).otherwise(pair["left"]).alias("left"),
            F.when(k % 2 == 0, pair["right"]).otherwise(_moved(pair["right"], digest)).alias("right"),
        )

    start = F.struct(F.substring(name, F.lit(1), half).alias("left"), F.substring(name, half + 1, n).alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["left"], x["right"]))


def _email(value: Column, key: str) -> Column:
    return F.concat(permuted_name(F.substring_index(value, "@", 1), key), F.lit("@"), F.substring_index(value, "@", -1))


def _whole(pattern: str) -> str:
    return "^(?:" + pattern + ")$"


def pseudonym(value: Column, key: str) -> Column:
    """(kind, new) of a value that FOUND matched; new is null if it isn't valid."""
    kinds = [
        ("email", value.contains("@"), _email),
        ("date", value.rlike("^[0-9]{4}([/\\-])[0-9]{2}\\1[0-9]{2}$"), _date),
        ("address", value.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$"), _address),
        ("social", value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _social),
        ("phone", F.lit(True), _phone),
    ]
    kind = new = F.lit(None).cast("string")
    for name, fits, make in reversed(kinds):
        kind, new = F.when(fits, F.lit(name)).otherwise(kind), F.when(fits, make(value, key)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_replaced, kinds; a row per document.

    key is the secret: who has it can undo the permutations.

    Valid IBANs and card numbers are put between marks. What lies between is cut at its
    values, the values are replaced, and all is joined again. A mark holds a hash of its
    text, so no text has it.
    """
    text = F.col("text").cast("string")
    # Most texts have no digit and no address; they pass as they are.
    may = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    rows = docs.select("doc_id", text.alias("text"), may.alias("may"), F.concat(F.lit("\x01"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), F.lit("\x01")).alias("mark"))

    def marked(pattern: str, needs: str, make) -> Column:
        parts = F.split("marked", F.col("mark"), -1)
        each = F.transform(parts, lambda x, k: F.when((k % 2 == 0) & x.rlike(needs), _each(x, pattern, lambda v: make(v, F.col("mark")))).otherwise(x))
        return F.when(F.col("may") & F.col("marked").rlike(needs), F.call_function("array_join", each, F.col("mark"))).otherwise(F.col("marked"))

    rows = rows.withColumn("marked", F.col("text"))
    rows = rows.withColumn("marked", marked(WITH_IBAN, "[A-Z]{2}[0-9]{2}[ A-Z0-9]", _marked_ibans))
    rows = rows.withColumn("marked", marked(WITH_CARD, "[0-9](?:[ \\-]?[0-9]){12}", _marked_cards))
    rows = rows.withColumn("parts", F.when(F.col("may"), F.split("marked", F.col("mark"), -1)).otherwise(F.array().cast("array<string>")))

    def replaced(part: Column, k: Column) -> Column:
        values = F.transform(F.regexp_extract_all(part, F.lit(FOUND), 1), lambda x: F.struct(x.alias("old"), pseudonym(x, key).alias("made")))

        def with_values(made: Column) -> Column:
            pieces = F.zip_with(F.split(part, FOUND, -1), made, lambda gap, x: F.concat(gap, F.coalesce(x["made"]["new"], x["old"], F.lit(""))))
            kinds = F.transform(F.filter(made, lambda x: x["made"]["new"].isNotNull()), lambda x: x["made"]["kind"])
            return F.struct(F.array_join(pieces, "").alias("text"), kinds.alias("kinds"))

        plain = let(values, with_values)
        iban = part.rlike("^[A-Z]")
        special = F.struct(F.when(iban, _iban(part, key)).otherwise(_card(part, key)).alias("text"), F.array(F.when(iban, F.lit("iban")).otherwise(F.lit("card"))).alias("kinds"))
        return F.when(k % 2 == 0, plain).otherwise(special)

    rows = rows.withColumn("made", F.transform("parts", replaced))
    kinds = F.flatten(F.transform("made", lambda x: x["kinds"]))
    return rows.select(
        "doc_id",
        F.when(F.col("may"), F.array_join(F.transform("made", lambda x: x["text"]), "")).otherwise(F.col("text")).alias("text"),
        F.size(kinds).cast("long").alias("n_replaced"),
        F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"),
    )
