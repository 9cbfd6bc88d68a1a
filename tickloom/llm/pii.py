"""Format-preserving pseudonyms for personal numbers, dates and mail addresses.

A value is recognised by its format and validated; its digits are then permuted by a keyed Feistel network over
exactly the values that are valid in that format, and put back between the separators they came with. Equal values get equal
pseudonyms in every document, different values of a kind get different ones, and a pseudonym is valid wherever the
value was:

* dates of the years 1800 to 2199, as ``YYYY-MM-DD`` (or with ``/``), day first with ``.`` or ``-``, month first with
  ``/`` (day first where only that is a date): one of the 146,097 days, 189 x 773;
* social security numbers ``AAA-GG-SSSS`` (no area 000, 666 or 9xx, no group 00, no serial 0000): 898 x 99 x 9999;
* IPv4 addresses with four numbers up to 255: 2^16 x 2^16;
* phone numbers: the last ten digits, 10^5 x 10^5; the country code stays;
* card and account numbers of 13 to 19 digits that pass the Luhn test: all digits but the last are permuted, and the last
  one is set so that the number still passes. In a run of groups of digits a number begins and ends with a group; it is one
  group, or grouped 4-6-4, 4-6-5, 4-4-4-n or 4-4-4-4-n, the first place and there the shortest number that passes. So
  a number gets the same pseudonym whatever short number stands beside it. A run without such a number is taken whole where
  it has 13 to 19 digits and passes, however it is grouped;
* mail addresses: letters and digits of the local part, letter by letter as a Feistel network of two halves; case,
  other characters (letters beyond a to z, too) and the domain stay.

What looks alike but is not valid (month 13, octet 300, area 666, a wrong check digit) stays as it is. One round function is SHA-256 of key,
kind, round and the other half. Everything is built-in expressions; only rows with a match do more than one regular
expression.

Rows: a null text stays null with no pseudonym; texts of any length are read whole; ties and repeated rows are treated
one by one; an empty table stays empty; all other columns are returned as they are, but one that is named like the
count is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1800-01-01", 146097
STRIDE = 512              # groups of digits written to one list; a run may have any number of them

_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Formats in the order in which they are tried at one place of a text.
FORMATS = {
    # possessive groups: Java's others recurse, and a host of thousands of labels would overflow the stack
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ymd": _EDGE + r"\d{4}([-/])\d{2}\1\d{2}" + _END,
    "dmy": _EDGE + r"\d{2}([-./])\d{2}\2\d{4}" + _END,
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    "ip": r"(?<![0-9A-Za-z.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9A-Za-z]|\.\d)",
    "phone": (r"(?<![0-9A-Za-z])(?:\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
              r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\3\d{4})" + _END),
    # the whole run of digits; a date, social security or phone number after it is not part of it
    "account": (_EDGE + r"(?=\d(?:[ -]?\d){12})\d++(?![A-Za-z])(?:[ -](?!(?:\d{4}-\d{2}-\d{2}|\d{2}-\d{2}-\d{4}|\d{3}-\d{2}-\d{4}"
                r"|\d{3}-\d{3}-\d{4}|\d{3} \d{3} \d{4})" + _END + r")\d++(?![A-Za-z]))*+"),
}
#: One pattern for all; places at which no number can begin are left at the first character.
ANY = f"{FORMATS['mail']}|(?=[0-9+(])(?:" + "|".join(f"(?:{p})" for k, p in FORMATS.items() if k != "mail") + ")"


def _prf(key: str, kind: str, turn: Column, half: Column) -> Column:
    """60 pseudorandom bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")),
                                     256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of 0 to ``a * b - 1``: the value as (left below ``a``, right below ``b``), whose halves are
    shifted in turn by a function of the other one."""
    left = F.call_function("div", value, b)
    init = F.struct(left.alias("l"), (value % b).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        shift = _prf(key, kind, i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(even, (s["l"] + shift % a) % a).otherwise(s["l"]).cast("long").alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + shift % b) % b).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), init, turn, lambda s: s["l"] * b + s["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _padded(value: Column, n: Column | int) -> Column:
    return F.lpad(value.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _refilled(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    def filled(new: Column) -> Column:
        def place(i: Column) -> Column:
            c = F.substring(m, i, F.lit(1))
            nth = F.length(_digits(F.substring(m, F.lit(1), i)))
            return F.when(c.between("0", "9"), F.substring(new, nth, F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), place), "")
    return _once(digits, filled)


def luhn(digits: Column) -> Column:
    """The Luhn sum: every second digit from the right counts double, less 9 above 9."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _renumbered(number: Column, key: str) -> Column:
    """A number with other digits, whose Luhn sum keeps its residue."""
    def renumbered(old: Column) -> Column:
        n = F.length(old) - 1
        right = F.floor(n / 2)
        a, b = F.pow(F.lit(10.0), n - right).cast("long"), F.pow(F.lit(10.0), right).cast("long")
        new = _padded(feistel(F.substring(old, F.lit(1), n).cast("long"), a, b, key, "account"), n)

        def checked(body: Column) -> Column:
            last = F.pmod(luhn(old) - luhn(F.concat(body, F.lit("0"))), F.lit(10))
            return F.concat(body, last.cast("string"))
        return _once(new, checked)
    return _refilled(number, _once(_digits(number), renumbered))


def _valid(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (luhn(digits) % 10 == 0)


def _groups_of(digits: Column, i: Column) -> Column:
    """How many groups, from group ``i`` on, make up the number that begins there; null if none does."""
    def size(k: int) -> Column:
        return F.length(F.get(digits, i + k))

    def passes(n: int) -> Column:
        return _valid(F.array_join(F.slice(digits, i + 1, F.lit(n)), ""))

    fours = (size(0) == 4) & (size(1) == 4) & (size(2) == 4)
    return (F.when(size(0) >= 13, F.when(passes(1), 1))
            .when((size(0) == 4) & (size(1) == 6), F.when(size(2).isin(4, 5) & passes(3), 3))
            .when(fours & size(3).between(1, 4) & passes(4), 4)
            .when(fours & (size(3) == 4) & size(4).between(1, 3) & passes(5), 5))


def _account(m: Column, key: str) -> Column:
    """The numbers within a run of groups, from the left, none overlapping another one.

    Lists of ``STRIDE`` groups are filled one by one and joined at the end, so a run of any length takes linear time.
    """
    groups = F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0))

    def read(g: Column) -> Column:
        digits = g["digits"]

        def place(state: Column, i: Column) -> Column:
            def step(n: Column) -> Column:
                number = _renumbered(F.array_join(F.slice(g["spelled"], i + 1, n), ""), key)
                here = F.when(i < state["next"], "").when(n.isNotNull(), number).otherwise(F.get(g["spelled"], i))
                return F.struct(F.when((i >= state["next"]) & n.isNotNull(), i + n).otherwise(state["next"]).alias("next"),
                                F.concat(state["out"], F.array(here)).alias("out"))
            return _once(F.when(i >= state["next"], _groups_of(digits, i)), step)

        def stretch(state: Column, k: Column) -> Column:
            upto = F.least((k + 1) * STRIDE, F.size(digits)) - 1
            filled = F.aggregate(F.sequence(k * STRIDE, upto), F.struct(
                state["next"].alias("next"), F.array().cast("array<string>").alias("out")), place)
            return _once(filled, lambda f: F.struct(f["next"].alias("next"), F.concat(
                state["out"], F.array(F.array_join(f["out"], ""))).alias("out")))

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
        last = F.floor((F.size(digits) - 1) / STRIDE).cast("int")

        def written(f: Column) -> Column:
            return (F.when(f["next"] > 0, F.array_join(f["out"], ""))
                    .when((F.length(m) < 40) & _valid(_digits(m)), _renumbered(m, key)).otherwise(m))
        return _once(F.aggregate(F.sequence(F.lit(0), last), start, stretch), written)

    spelled = F.struct(groups.alias("spelled"), F.transform(groups, _digits).alias("digits"))
    return _once(spelled, read)


def _phone(m: Column, key: str) -> Column:
    def renumbered(old: Column) -> Column:
        n = F.length(old)
        new = feistel(F.substring(old, n - 9, F.lit(10)).cast("long"), F.lit(10 ** 5), F.lit(10 ** 5), key, "phone")
        return F.concat(F.substring(old, F.lit(1), n - 10), _padded(new, 10))
    return _refilled(m, _once(_digits(m), renumbered))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, s, n).cast("int") for s, n in ((1, 3), (5, 2), (8, 4)))
    fine = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    new = feistel(((place * 99 + group - 1).cast("long") * 9999 + serial - 1), F.lit(898 * 99), F.lit(9999), key, "ssn")

    def spelled(v: Column) -> Column:
        head = F.call_function("div", v, F.lit(9999))
        area = F.call_function("div", head, F.lit(99))
        return F.concat_ws("-", _padded(area + F.when(area >= 665, 2).otherwise(1), 3), _padded(head % 99 + 1, 2),
                           _padded(v % 9999 + 1, 4))
    return F.when(fine, _once(new, spelled)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    whole = F.aggregate(part, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    new = feistel(whole, F.lit(65536), F.lit(65536), key, "ip")

    def spelled(v: Column) -> Column:
        return F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.forall(part, lambda p: p < 256), _once(new, spelled)).otherwise(m)


def _date(m: Column, pattern: str, key: str, kind: str) -> Column:
    """``m`` written in ``pattern`` as another day, or null where it is no day of the years covered."""
    day = F.datediff(F.try_to_date(m, pattern), F.lit(FIRST_DAY).cast("date"))
    new = feistel(day.cast("long"), F.lit(189), F.lit(773), key, kind)
    text = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), pattern)
    return F.when((day >= 0) & (day < DAYS), text)


def _dates(m: Column, key: str) -> Column:
    found = [F.when(F.substring(m, 5, 1).isin("-", "/") & m.contains(sep), _date(m, f"yyyy{sep}MM{sep}dd", key, "date"))
             for sep in "-/"]
    found += [F.when(F.substring(m, 3, 1) == sep, _date(m, p, key, "date"))
              for sep, p in ((".", "dd.MM.yyyy"), ("-", "dd-MM-yyyy"), ("/", "MM/dd/yyyy"), ("/", "dd/MM/yyyy"))]
    return F.coalesce(*found, m)


def _mail(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    half = F.floor((F.length(local) + 1) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("l"),
                     F.substring(local, half + 1, F.length(local)).alias("r"))

    def moved(part: Column, other: Column, turn: Column) -> Column:
        def place(c: Column, i: Column, digest: Column) -> Column:
            shift = _prf(key, "mail", F.concat_ws(".", turn.cast("string"), i.cast("string")), digest)
            code = F.ascii(c)

            def within(first: int, n: int) -> Column:
                return F.char((code - first + (shift % n).cast("int")) % n + first)
            return (F.when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26))
                    .when(code.between(48, 57), within(48, 10)).otherwise(c))
        letters = F.regexp_extract_all(part, F.lit("(?s)."), F.lit(0))
        return _once(F.sha2(other, 256), lambda digest: F.array_join(F.transform(letters, lambda c, i: place(c, i, digest)), ""))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(moved(s["r"], s["l"], i)).alias("r"))

    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))
    return F.concat(new, F.substring(m, F.length(local) + 1, F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one recognised value; the value itself where it is not valid."""
    exact = {k: "^(?:" + p.replace(r"\2", r"\1").replace(r"\3", r"\1") + ")$" for k, p in FORMATS.items()}
    return (F.when(m.contains("@"), _mail(m, key))
            .when(m.rlike(exact["ymd"]) | m.rlike(exact["dmy"]), _dates(m, key))
            .when(m.rlike(exact["ssn"]), _ssn(m, key))
            .when(m.rlike(exact["ip"]), _ip(m, key))
            .when(m.rlike(exact["phone"]), _phone(m, key))
            .otherwise(_account(m, key)))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_pseudonyms") -> DataFrame:
    """All columns, with personal values of ``text_col`` replaced, and how many were replaced."""
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    new = F.transform("_found", lambda m: pseudonym(m, key))
    between = F.split(text, ANY, -1)
    joined = F.concat(F.element_at(between, 1), F.array_join(F.zip_with(
        "_new", F.slice(between, F.lit(2), F.size("_new")), lambda n, b: F.concat(n, b)), ""))
    changed = F.size(F.filter(F.arrays_zip("_found", "_new"), lambda p: p["_found"] != p["_new"]))
    rows = docs.drop(count_col).withColumn("_found", found)
    rows = rows.withColumn("_new", F.when(F.size("_found") > 0, new))
    return (rows.withColumn(text_col, F.when(F.size("_found") > 0, joined).otherwise(text))
            .withColumn(count_col, F.when(F.size("_found") > 0, changed).otherwise(0).cast("long"))
            .drop("_found", "_new"))
