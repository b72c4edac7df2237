"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Every value found is validated (Luhn, ISO 7064, ranges, calendar) and replaced by a keyed permutation of itself within
its own format: an alternating Feistel network over a product of two ranges, so equal values get equal pseudonyms in
every document and different values never meet. Numbers keep their separators and check digits are recomputed.

====== ===============================================  ==========================================
kind   found                                            permuted domain
====== ===============================================  ==========================================
secret key, token, secret, password = 16 or more         hex digits as such; else letters and digits in their places
mail   addresses                                        letters and digits, all but the last label
ip     dotted IPv4                                      65536 x 65536
card   13 to 19 digits that pass Luhn                   the payload; the check digit follows
iban   mod-97 valid                                     the account's digits; check digits follow
ssn    AAA-GG-SSSS in the valid ranges                  898 x (99 x 9999)
phone  NANP (area and exchange from 200)                800 x (800 x 10000)
phone  other +numbers of 8 to 15 digits                 all digits but the first three
date   1800 to 2199: y-m-d, d.m.y, d/m/y, d Month y      146097 days = 189 x 773
====== ===============================================  ==========================================

Where d/m/y reads as a date in one order only, that order holds; else day first. A value that fails its check stays as
it is. A null text stays null and an empty one empty; all columns of the input are kept; rows are independent of each
other, so repeated ones give repeated results. Where the input has a column of the count's name, the count gets an
underscore more. A long secret-like value that nothing names as one stays. The key appears in the query plan, so the plan must be kept as the key is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmatch.llm.common import fresh

ROUNDS = 10
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
#: In order: at one place the first that fits is taken.
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])(?i:api[_-]?key|access[_-]?key|secret[_-]?key|secret|token|password|passwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/\-]{16,}+",
    "mail": r"(?<![A-Za-z0-9._+\-])[A-Za-z0-9._+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "ip": rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": rf"(?<![A-Za-z0-9.])(?:\d{{4}}([-/.])\d{{1,2}}\1\d{{1,2}}|\d{{1,2}}([-/.])\d{{1,2}}\2\d{{4}}|\d{{1,2}} {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}}, \d{{4}})(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
    "nanp": r"(?<![A-Za-z0-9])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9])\+1[2-9]\d{2}[2-9]\d{6}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9])\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def whole(p: str) -> str:
    return f"^(?:{p})$"


class Pseudonyms:
    """Column expressions under one key."""

    def __init__(self, key: str):
        if not key:
            raise ValueError("a key is needed")
        self.key = F.lit(key)

    def prf(self, tweak: Column, i: Column, value: Column) -> Column:
        """60 keyed pseudo-random bits."""
        digest = F.sha2(F.concat_ws("|", self.key, tweak, i.cast("string"), value.cast("string"), self.key), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def feistel(self, x: Column, y: Column, mx: Column, my: Column, tweak: Column) -> Column:
        """A permutation of [0, mx) x [0, my), as a struct of x and y."""
        s = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
        step = lambda acc, i: F.when(i % 2 == 0, s((acc.x + self.prf(tweak, i, acc.y) % mx) % mx, acc.y)).otherwise(s(acc.x, (acc.y + self.prf(tweak, i, acc.x) % my) % my))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), s(x.cast("long"), y.cast("long")), step)

    def digits(self, d: Column, tweak: Column) -> Column:
        """A permutation of the digit strings of one length, up to 34 digits."""
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        num = lambda c: F.when(F.length(c) == 0, F.lit(0)).otherwise(c.cast("long"))
        r = self.feistel(num(F.substring(d, F.lit(1), u)), num(F.substring(d, u + 1, n)), ten(u), ten(n - u), F.concat_ws(":", tweak, n.cast("string")))
        return let(r, lambda v: F.concat(F.when(u > 0, F.lpad(v.x.cast("string"), u, "0")).otherwise(""), F.lpad(v.y.cast("string"), n - u, "0")))

    def letters(self, s: Column, tweak: Column, hexadecimal: bool = False) -> Column:
        """A permutation of the strings with the same places of small and capital letters, digits and other characters, or
        of strings of hexadecimal digits in small letters."""
        n = F.length(s)
        u = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
        code = lambda c: F.ascii(c)

        def shift(part: Column, other: Column, i: Column) -> Column:
            def one(c: Column, k: Column) -> Column:
                add = self.prf(tweak, i, F.concat_ws("|", k.cast("string"), other))
                if hexadecimal:
                    return F.substring(F.lit("0123456789abcdef"), ((F.conv(c, 16, 10).cast("long") + add) % 16 + 1).cast("int"), F.lit(1))
                return F.when(c.rlike("[0-9]"), F.chr((code(c) - 48 + add % 10) % 10 + 48)).when(c.rlike("[a-z]"), F.chr((code(c) - 97 + add % 26) % 26 + 97)).when(c.rlike("[A-Z]"), F.chr((code(c) - 65 + add % 26) % 26 + 65)).otherwise(c)

            return F.array_join(F.transform(F.split(part, ""), one), "")

        t = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
        start = t(F.substring(s, F.lit(1), u), F.substring(s, u + 1, n))
        return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda acc, i: F.when(i % 2 == 0, t(shift(acc.x, acc.y, i), acc.y)).otherwise(t(acc.x, F.when(acc.y == "", acc.y).otherwise(shift(acc.y, acc.x, i))))), lambda v: F.concat(v.x, v.y))

    @staticmethod
    def only_digits(m: Column) -> Column:
        return F.regexp_replace(m, "[^0-9]", "")

    @staticmethod
    def refill(m: Column, d: Column) -> Column:
        """``m`` with its digits replaced by those of ``d``, in order."""
        s = lambda out, k: F.struct(out.alias("out"), k.alias("k"))
        return F.aggregate(F.split(m, ""), s(F.lit(""), F.lit(1)), lambda acc, c: F.when(c.rlike("[0-9]"), s(F.concat(acc.out, F.substring(d, acc.k, F.lit(1))), acc.k + 1)).otherwise(s(F.concat(acc.out, c), acc.k)), lambda acc: acc.out)

    @staticmethod
    def luhn(payload: Column) -> Column:
        """The check digit, as a string."""
        n = lambda c: c.cast("int")
        parts = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(i % 2 == 0, F.floor(n(c) * 2 / 10).cast("int") + n(c) * 2 % 10).otherwise(n(c)))
        return ((F.lit(10) - F.aggregate(parts, F.lit(0), lambda a, c: a + c) % 10) % 10).cast("string")

    @staticmethod
    def mod97(s: Column) -> Column:
        """Of an alphanumeric string, letters counting 10 to 35."""
        return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))

    def card(self, m: Column) -> Column:
        def of(d: Column) -> Column:
            payload = F.substring(d, F.lit(1), F.length(d) - 1)
            new = let(self.digits(payload, F.lit("card")), lambda p: F.concat(p, self.luhn(p)))
            return F.when(self.luhn(payload) == F.substring(d, F.length(d), F.lit(1)), let(new, lambda x: self.refill(m, x))).otherwise(m)

        return let(self.only_digits(m), of)

    def iban(self, m: Column) -> Column:
        def of(s: Column) -> Column:
            head, rest = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
            new = let(self.digits(self.only_digits(rest), F.concat_ws(":", F.lit("iban"), head, F.regexp_replace(rest, "[0-9]", "#"))), lambda d: self.refill(rest, d))
            check = lambda r: F.lpad((F.lit(98) - self.mod97(F.concat(r, head, F.lit("00")))).cast("string"), 2, "0")
            made = let(new, lambda r: F.concat(check(r), self.only_digits(r)))
            return F.when((self.mod97(F.concat(rest, F.substring(s, 1, 4))) == 1) & rest.rlike("[0-9]{2}"), let(made, lambda x: self.refill(m, x))).otherwise(m)

        return let(F.regexp_replace(m, " ", ""), of)

    def ip(self, m: Column) -> Column:
        p = lambda a: F.split(m, r"\.")[a].cast("long")
        r = self.feistel(p(0) * 256 + p(1), p(2) * 256 + p(3), F.lit(65536), F.lit(65536), F.lit("ip"))
        return let(r, lambda v: F.concat_ws(".", *(x.cast("string") for z in (v.x, v.y) for x in (F.floor(z / 256), z % 256))))

    def ssn(self, m: Column) -> Column:
        a, g, s = (F.split(m, "-")[k].cast("long") for k in range(3))
        ok = a.between(1, 899) & (a != 666) & (g > 0) & (s > 0)
        r = self.feistel(a - F.when(a > 666, 2).otherwise(1), (g - 1) * 9999 + s - 1, F.lit(898), F.lit(989901), F.lit("ssn"))
        pad = lambda x, k: F.lpad(x.cast("string"), k, "0")
        new = let(r, lambda v: F.concat_ws("-", pad(v.x + F.when(v.x > 664, 2).otherwise(1), 3), pad(F.floor(v.y / 9999) + 1, 2), pad(v.y % 9999 + 1, 4)))
        return F.when(ok, new).otherwise(m)

    def nanp(self, m: Column) -> Column:
        def of(d: Column) -> Column:
            ten = F.substring(d, F.length(d) - 9, F.lit(10))
            part = lambda at, n: F.substring(ten, at, n).cast("long")
            r = self.feistel(part(1, 3) - 200, (part(4, 3) - 200) * 10000 + part(7, 4), F.lit(800), F.lit(8_000_000), F.lit("nanp"))
            new = let(r, lambda v: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), (v.x + 200).cast("string"), (v.y + 2_000_000).cast("string")))
            return let(new, lambda x: self.refill(m, x))

        return let(self.only_digits(m), of)

    def phone(self, m: Column) -> Column:
        def of(d: Column) -> Column:
            new = F.concat(F.substring(d, 1, 3), self.digits(F.substring(d, F.lit(4), F.length(d)), F.concat_ws(":", F.lit("phone"), F.substring(d, 1, 3))))
            return F.when(F.length(d).between(8, 15), let(new, lambda x: self.refill(m, x))).otherwise(m)

        return let(self.only_digits(m), of)

    def secret(self, m: Column) -> Column:
        head, value = F.regexp_extract(m, r"^(.*[=:]\s*[\"']?)", 1), F.regexp_extract(m, r"([A-Za-z0-9_+/\-]+)$", 1)
        tweak = F.concat_ws(":", F.lit("secret"), F.length(value).cast("string"))
        return F.concat(head, let(value, lambda v: F.when(v.rlike("^[0-9a-f]+$"), self.letters(v, tweak, True)).otherwise(self.letters(v, tweak))))

    def mail(self, m: Column) -> Column:
        low = F.lower(m)
        return F.concat(self.letters(F.regexp_replace(low, r"\.[a-z]+$", ""), F.lit("mail")), F.regexp_extract(low, r"\.[a-z]+$", 0))

    def date(self, m: Column) -> Column:
        num = lambda p: F.regexp_extract(m, p, 1)
        as_int = lambda c: F.when(c == "", F.lit(0)).otherwise(c.cast("int"))
        named, ymd, us = m.rlike("[A-Z]"), m.rlike(r"^\d{4}"), m.rlike("^[A-Z]")
        a, b, c = num(r"^(\d+)\D+\d+\D+\d+$"), num(r"^\d+\D+(\d+)\D+\d+$"), num(r"^\d+\D+\d+\D+(\d+)$")
        swap = ~ymd & ~named & m.contains("/") & (as_int(b) > 12) & (as_int(a) <= 12)  # month first
        year = F.when(named, num(r"(\d{4})$")).when(ymd, a).otherwise(c)
        month = F.when(swap, a).otherwise(b)
        day = F.when(us, num(r"(\d{1,2}),")).when(named, num(r"^(\d{1,2}) ")).when(ymd, c).when(swap, b).otherwise(a)
        by_name = F.floor((F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), num("([A-Z][a-z]{2})")) + 2) / 3).cast("int")
        parts = F.struct(as_int(year).alias("y"), F.when(named, by_name).otherwise(as_int(month)).alias("m"), as_int(day).alias("d"))
        origin = F.lit("1800-01-01").cast("date")

        def show(t: Column) -> Column:
            wide = lambda old, v: F.when(F.length(old) == 2, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
            y, mo, d = F.year(t).cast("string"), wide(month, F.month(t)), wide(day, F.dayofmonth(t))
            sep = F.regexp_extract(m, r"\d([-/.])", 1)
            name = F.date_format(t, "MMMM")
            name = F.when(F.length(num("([A-Z][a-z]+)")) == 3, F.substring(name, 1, 3)).otherwise(name)
            return F.when(us, F.concat(name, F.lit(" "), d, F.lit(", "), y)).when(named, F.concat_ws(" ", d, name, y)).when(ymd, F.concat(y, sep, mo, sep, d)).when(swap, F.concat(mo, sep, d, sep, y)).otherwise(F.concat(d, sep, mo, sep, y))

        def of(p: Column) -> Column:
            ok = F.when(p.y.between(1800, 2199) & p.m.between(1, 12), p.d.between(1, F.dayofmonth(F.last_day(F.make_date(p.y, p.m, F.lit(1)))))).otherwise(False)
            moved = let(F.datediff(F.make_date(p.y, p.m, p.d), origin).cast("long"), lambda at: self.feistel(F.floor(at / 773), at % 773, F.lit(189), F.lit(773), F.lit("date")))
            return F.when(ok, let(let(moved, lambda v: F.date_add(origin, (v.x * 773 + v.y).cast("int"))), show)).otherwise(m)

        return let(parts, of)

    def replace(self, m: Column) -> Column:
        """The pseudonym of one value found."""
        out = m
        for kind in reversed(PATTERNS):
            out = F.when(m.rlike(whole(PATTERNS[kind])), getattr(self, kind)(m)).otherwise(out)
        return out


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """``df`` with the values in ``text_col`` replaced; ``count_col`` tells how many changed."""
    p, text = Pseudonyms(key), F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    work = F.when(text.rlike("[0-9@]"), found)
    pairs = F.transform(work, lambda m: F.struct(m.alias("old"), p.replace(m).alias("new")))
    found, changed = fresh(df, "__pii"), fresh(df, "__new")
    done = df.withColumn(found, pairs)
    new = F.when(F.size(F.col(found)) > 0, F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(found), lambda gap, x: F.concat(gap, F.coalesce(x["new"], F.lit("")))), "")).otherwise(text)
    out = done.withColumn(changed, new)
    if count_col:
        out = out.withColumn(fresh(df, count_col), F.when(F.col(found).isNull(), 0).otherwise(F.size(F.filter(found, lambda x: x["old"] != x["new"]))))
    return out.withColumn(text_col, F.col(changed)).drop(found, changed)
