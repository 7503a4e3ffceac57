r"""Operator 3: format-preserving Feistel pseudonyms [native].

Personal values are found by pattern and validated (Luhn and mod-97 check digits, octets, calendar dates, number
ranges). Each is split in halves that take turns: one half is moved, modulo the size of its range, by a keyed
hash of the other. Eight rounds make a keyed permutation of all values of a format, so equal
values have equal pseudonyms in all documents, different ones different, and the pseudonym is valid in the
same format: the layout stays, check digits are computed anew, and where the permuted value is invalid
the permutation is applied again until it is valid.

Kinds: email (letters and digits before the @), iban (digits of the account), card (all but the check digit), ssn, phone (after the
country code), ip (v4), date (1900-01-01 to 2079-06-06, with year first or last), secret (32 to 64 hexadecimal digits). Values that fail their
validation stay as they are.

A run of numbers with single spaces or hyphens between them is searched for cards from left to right: from each number, the
longest stretch of 13 to 19 digits that ends with a number and passes Luhn. An IBAN may have single spaces between groups of
four; of the groups that follow its head, the most that pass mod 97 are its own.

Defined cases: a null text stays null and has no findings; an empty one stays empty; repeated rows give equal rows; an empty
table gives no rows; other columns are kept. No shuffle takes place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For the registered queries and tests; a user passes a key of their own, from a secret store.
DEMO_KEY = "cairn demonstration key"
#: Symbols of a block; longer values are chained, forwards and then backwards, so that each symbol depends on all.
BLOCK = 16
#: Times a value may be permuted until it is valid; a tenth of the numbers are invalid at most, and two thirds of the dates are of the other kind.
WALKS, DATE_WALKS = 40, 80

#: Kind and pattern, in the order in which they are tried.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
}
#: A run of numbers whose first 13 to 19 digits end with a number; it stops where a value of another kind starts.
KINDS["card"] = (
    r"(?<![A-Za-z0-9])(?=[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9]))[0-9]++"
    rf"(?:[ -](?!{'|'.join(KINDS[k] for k in ('email', 'secret', 'ssn', 'date', 'ip'))})[0-9]++(?![A-Za-z0-9]))*+"
)
#: An IBAN in groups of four and what may still belong to it, at each place where one may start.
SPACED_IBAN = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?(?![A-Za-z0-9])))"
ANY = "|".join(KINDS.values())
LETTERS, AS_DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def keyed_hash(key: Column, tag: Column, i: Column, half: Column) -> Column:
    said = F.sha2(F.concat_ws("|", key, tag, i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(said, 1, 14), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: Column, tag: Column) -> Column:
    """struct(a, b): a keyed permutation of the pairs below (size_a, size_b)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        new_a = F.pmod(s["a"] + keyed_hash(key, tag, i, s["b"]), size_a.cast("long"))
        new_b = F.pmod(s["b"] + keyed_hash(key, tag, i, s["a"]), size_b.cast("long"))
        even = i % 2 == 0
        return F.struct(F.when(even, new_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(new_b).alias("b"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn)


def permuted(symbols: Column, radix: int, key: Column, kind: str) -> Column:
    """A string of digits of the radix (0-9a-z), permuted within its length.

    Each block's permutation is picked by the new block before it; if there are several, a second pass from the last block to the first follows.
    """

    def block(x: Column, before: Column) -> Column:
        n = F.length(x)
        left = F.floor(n / 2).cast("int")
        number = lambda s: F.coalesce(F.conv(s, radix, 10).cast("long"), F.lit(0))
        size = lambda k: F.pow(F.lit(float(radix)), k).cast("long")
        tag = F.concat(F.concat_ws("/", F.lit(f"{kind}/{radix}"), n.cast("string")), before)
        out = feistel(number(F.substring(x, F.lit(1), left)), number(F.substring(x, left + 1, n)), size(left), size(n - left), key, tag)
        text = lambda v, k: F.lpad(F.lower(F.conv(v.cast("string"), 10, radix)), k, F.lit("0"))
        return let(out, lambda o: F.concat(text(o["a"], left), text(o["b"], n - left)))

    n_blocks = F.floor((F.length(symbols) - 1) / BLOCK).cast("int") + 1
    of_block = lambda x, k: F.substring(x, k * BLOCK + 1, F.lit(BLOCK))

    def step(x: Column, t: Column) -> Column:
        ahead = t < n_blocks
        k = F.when(ahead, t).otherwise(2 * n_blocks - 1 - t)
        before = F.when((t == 0) | (t == n_blocks), "").otherwise(F.concat(F.when(ahead, ">").otherwise("<"), of_block(x, F.when(ahead, k - 1).otherwise(k + 1))))
        return F.concat(F.substring(x, F.lit(1), k * BLOCK), block(of_block(x, k), before), F.substring(x, (k + 1) * BLOCK + 1, F.length(x)))

    steps = F.sequence(F.lit(0), F.when(n_blocks == 1, 0).otherwise(2 * n_blocks - 1))
    return F.when(F.length(symbols) == 0, symbols).otherwise(F.aggregate(steps, symbols, step))


def refilled(layout: Column, symbols: str, new: Column) -> Column:
    """layout with the characters of the class `symbols` replaced by those of new, in order."""
    start = F.struct(F.lit("").alias("said"), F.lit(0).alias("used"))

    def step(s: Column, c: Column) -> Column:
        own = c.rlike(symbols)
        put = F.when(own, F.substring(new, s["used"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["said"], put).alias("said"), (s["used"] + own.cast("int")).alias("used"))

    return F.aggregate(F.split(layout, ""), start, step)["said"]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(x: Column, doubled: int) -> Column:
    """The Luhn sum of a string of digits; the last is doubled if `doubled` is 0, else the one before."""
    n = F.length(x)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(x, n - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == doubled, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def mod97(x: Column) -> Column:
    """Letters count as 10 to 35."""

    def add(s: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return (s * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), add)


def _email(m: Column, key: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    letters = F.translate(F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), LETTERS, AS_DIGITS)
    new = F.translate(permuted(letters, 26, key, "email"), AS_DIGITS, LETTERS)
    start = F.struct(F.lit("").alias("said"), F.lit(0).alias("used"))

    def step(s: Column, c: Column) -> Column:
        put = F.substring(new, s["used"] + 1, F.lit(1))
        upper, lower = c.rlike("[A-Z]"), c.rlike("[a-z]")
        return F.struct(F.concat(s["said"], F.when(upper, F.upper(put)).when(lower, put).otherwise(c)).alias("said"), (s["used"] + (upper | lower).cast("int")).alias("used"))

    named = F.aggregate(F.split(local, ""), start, step)["said"]
    return F.concat(refilled(named, "[0-9]", permuted(digits(local), 10, key, "email")), F.substring(m, F.length(local) + 1, F.length(m)))


def _cards(m: Column, key: Column) -> Column:
    """struct(said, n): a run of numbers with its cards replaced, and how many were."""

    def moved(x: Column) -> Column:
        def of(d: Column) -> Column:
            body = permuted(F.substring(d, F.lit(1), F.length(d) - 1), 10, key, "card")
            return refilled(x, "[0-9]", let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string"))))

        return let(digits(x), of)

    def of(p: Column) -> Column:
        stretch = lambda i, k: F.array_join(F.slice(p, i + 1, k + 1), "")
        valid = lambda d: F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0)
        start = F.struct(F.lit("").alias("said"), F.lit(0).alias("n"), F.lit(0).alias("skip"))

        def step(s: Column, i: Column) -> Column:
            state = lambda said, n, skip: F.struct(said.alias("said"), n.alias("n"), skip.alias("skip"))
            ends = F.filter(F.sequence(F.lit(0), F.least(F.lit(18), F.size(p) - 1 - i)), lambda k: let(digits(stretch(i, k)), valid))
            put = lambda x, k: let(moved(x), lambda y: state(F.concat(s["said"], y), s["n"] + (y != x).cast("int"), k))
            longest = lambda k: F.when(k.isNull(), state(F.concat(s["said"], p[i]), s["n"], F.lit(0))).otherwise(let(stretch(i, k), lambda x: put(x, k)))
            return F.when(s["skip"] > 0, state(s["said"], s["n"], s["skip"] - 1)).otherwise(let(F.array_max(ends), longest))

        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), start, step, lambda s: F.struct(s["said"].alias("said"), s["n"].alias("n")))

    return let(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)), of)


def _is_iban(x: Column) -> Column:
    return mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1


def _iban(m: Column, key: Column) -> Column:
    def of(x: Column) -> Column:
        country, account = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        new = refilled(account, "[0-9]", permuted(digits(account), 10, key, "iban"))
        check = let(new, lambda a: F.concat(country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        return F.when(_is_iban(x), refilled(m, "[A-Z0-9]", check)).otherwise(m)

    return let(F.replace(m, F.lit(" ")), of)


def _spaced_ibans(text: Column) -> Column:
    """The valid IBANs of a text that are in groups of four."""

    def of(m: Column) -> Column:
        g = F.split(m, " ")
        starts = F.transform(F.sequence(F.lit(4), F.size(g)), lambda k: F.array_join(F.slice(g, 1, k), " "))
        stripped = lambda x: F.replace(x, F.lit(" "))
        return F.try_element_at(F.filter(starts, lambda x: let(stripped(x), lambda y: F.length(y).between(15, 34) & _is_iban(y))), F.lit(-1))

    found = F.transform(F.regexp_extract_all(text, F.lit(SPACED_IBAN), F.lit(1)), of)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def _walked(first: Column, again, valid, walks: int = WALKS) -> Column:
    """again(first), and again until it is valid; a permutation comes back to a valid start at the latest."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), again(first), lambda x, i: F.when(valid(x), x).otherwise(again(x)))


def _ssn(m: Column, key: Column) -> Column:
    valid = lambda d: d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    new = _walked(digits(m), lambda d: permuted(d, 10, key, "ssn"), valid)
    return F.when(valid(digits(m)), refilled(m, "[0-9]", new)).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    # After the country code: behind its separator, or the last ten digits if there is none.
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    code = F.when(code == "", F.substring(m, F.lit(1), F.greatest(F.length(m) - 10, F.lit(2)))).otherwise(code)
    return let(code, lambda c: F.concat(c, let(F.substring(m, F.length(c) + 1, F.length(m)), lambda r: refilled(r, "[0-9]", permuted(digits(r), 10, key, "phone")))))


def _ip(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    byte = F.lit(256)

    def of(x: Column) -> Column:
        new = feistel(x[0] * byte + x[1], x[2] * byte + x[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
        return let(new, lambda s: F.concat_ws(".", *[F.shiftright(s[h], k).bitwiseAND(255).cast("string") for h, k in (("a", 8), ("a", 0), ("b", 8), ("b", 0))]))

    return let(o, lambda x: F.when(F.forall(x, lambda v: v < 256), of(x)).otherwise(m))


def _date(m: Column, key: Column) -> Column:
    """Days up to the 12th stay such, and later ones too: a text with the month first, which a later day shows, then stays one, and no two texts of a layout get the same pseudonym."""
    sep = F.substring(m, 3, 1)
    iso = m.rlike("^[0-9]{4}-")
    part = lambda a, n: F.substring(m, a, n)
    day_first = part(4, 2).cast("int") <= 12
    ymd = F.when(iso, m).when(day_first, F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))).otherwise(F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)))
    epoch = F.lit("1900-01-01").cast("date")
    place = F.datediff(F.try_to_date(ymd, "yyyy-MM-dd"), epoch)
    late = lambda n: F.dayofmonth(F.date_add(epoch, n)) > 12

    def moved(n: Column) -> Column:
        new = feistel(F.shiftright(n, 8), n.bitwiseAND(255), F.lit(256), F.lit(256), key, F.lit("date"))
        return let(new, lambda s: (s["a"] * 256 + s["b"]).cast("int"))

    def of(n: Column) -> Column:
        date = let(late(n), lambda x: F.date_add(epoch, _walked(n, moved, lambda y: late(y) == x, DATE_WALKS)))

        def said(d: Column) -> Column:
            day, month, year = F.date_format(d, "dd"), F.date_format(d, "MM"), F.date_format(d, "yyyy")
            return F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(day_first, F.concat(day, sep, month, sep, year)).otherwise(F.concat(month, sep, day, sep, year))

        return let(date, said)

    return let(place, lambda n: F.when(n.between(0, 65535), of(n)).otherwise(m))


def pseudonym(m: Column, key: Column) -> Column:
    """struct(said, n): what is put in place of a value, and how many values were replaced."""
    is_kind = lambda k: m.rlike(f"^(?:{KINDS[k]})$")
    single = (
        F.when(m.contains("@"), _email(m, key)).when(is_kind("iban") | m.rlike("^[A-Z]"), _iban(m, key))
        .when(is_kind("secret"), permuted(m, 16, key, "secret")).when(is_kind("ssn"), _ssn(m, key)).when(is_kind("date"), _date(m, key))
        .when(is_kind("ip"), _ip(m, key)).when(is_kind("phone"), _phone(m, key))
    )
    return let(single, lambda x: F.when(x.isNull(), _cards(m, key)).otherwise(F.struct(x.alias("said"), (x != m).cast("int").alias("n"))))


def pseudonymised(text: Column, key: str) -> Column:
    """struct(text, n_changed): the text with every valid value replaced, and how many were."""
    spaced = let(_spaced_ibans(text), lambda x: F.when(F.size(x) == 0, F.lit(ANY)).otherwise(F.concat(F.lit("(?<![A-Za-z0-9])(?:"), F.array_join(x, "|"), F.lit(f")(?![A-Za-z0-9])|{ANY}"))))

    def of(values: Column, pattern: Column) -> Column:
        new = F.transform(values, lambda m: pseudonym(m, F.lit(key)))

        def put(to: Column) -> Column:
            gaps = F.split(text, pattern, -1)
            said = let(gaps, lambda g: F.concat(g[0], F.array_join(F.zip_with(to, F.slice(g, 2, F.size(g)), lambda p, q: F.concat(p["said"], q)), "")))
            changed = F.aggregate(to, F.lit(0).cast("long"), lambda n, x: n + x["n"])
            return F.struct(said.alias("text"), changed.alias("n_changed"))

        same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_changed"))
        return F.when(F.size(values) == 0, same).otherwise(let(new, put))

    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_changed"))
    found = let(spaced, lambda pattern: let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda values: of(values, pattern)))
    return F.when(text.rlike("[0-9@]"), found).otherwise(same)


def without_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs with their texts pseudonymised; n_chars, where there is one, follows the new text."""
    out = docs.withColumn("text", pseudonymised(F.col("text"), key)["text"])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text and n_changed for each row of docs."""
    return docs.select("doc_id", pseudonymised(F.col("text"), key).alias("_out")).select("doc_id", F.col("_out.text").alias("text"), F.col("_out.n_changed").alias("n_changed"))
