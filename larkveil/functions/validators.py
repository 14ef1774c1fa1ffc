"""Validators of single values as columns, inside whole-stage code or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkveil.kernel import checks as C


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    return digits.rlike("^[0-9]{2,}$") & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _number_of(c: Column) -> Column:
    """0-9 as they are, A-Z as 10-35."""
    return F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)


def iban(value: Column) -> Column:
    plain = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    lengths = F.create_map(*[F.lit(x) for kv in C.IBAN_LENGTHS.items() for x in kv])
    expected = F.coalesce(F.try_element_at(lengths, F.substring(plain, 1, 2)), F.length(plain))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    rest = F.aggregate(_chars(turned), F.lit(0), lambda a, c: (a * F.when(_number_of(c) > 9, 100).otherwise(10) + _number_of(c)) % 97)
    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$") & (expected == F.length(plain)), rest == 1).otherwise(False)


def bic(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return plain.rlike("^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$") & F.substring(plain, 5, 2).isin(sorted(C.COUNTRY_CODES))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def ipv4_scope(value: Column) -> Column:
    """private, public, or null where it is no IPv4 address (addresses of version 6: kernel/checks.py)."""
    plain = F.trim(value)
    a, b = (F.try_element_at(F.split(plain, r"\."), F.lit(i)).try_cast("int") for i in (1, 2))
    private = (
        a.isin(10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127))
    )
    return F.when(plain.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), F.when(private, "private").otherwise("public"))


_HEXTET = "[0-9a-fA-F]{1,4}"
_HEXTETS = f"(?:(?:{_HEXTET}:)*{_HEXTET})?"


def ipv6_scope(value: Column) -> Column:
    """private, public, or null where it is no IPv6 address (forms with an IPv4 address in them: kernel/checks.py)."""
    plain = F.trim(value)
    given = F.size(F.filter(F.split(plain, ":"), lambda x: x != ""))
    valid = plain.rlike(f"^(?:{_HEXTET}:){{7}}{_HEXTET}$") | (plain.rlike(f"^{_HEXTETS}::{_HEXTETS}$") & (given <= 7))
    first = F.conv(F.coalesce(F.nullif(F.split_part(plain, F.lit(":"), F.lit(1)), F.lit("")), F.lit("0")), 16, 10).cast("int")
    loopback = plain.rlike("^(?:0{1,4}:){7}0{0,3}1$") | plain.rlike("^(?:(?:0{1,4}:)*0{1,4})?::(?:0{1,4}:)*0{0,3}1$")
    private = loopback | first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF)
    return F.when(valid, F.when(private, "private").otherwise("public"))


def ip_scope(value: Column) -> Column:
    return F.coalesce(ipv4_scope(value), ipv6_scope(value))


def fqdn(value: Column) -> Column:
    labels = F.split(F.lower(value), r"\.", -1)
    last = F.element_at(labels, -1)
    fine = F.forall(labels, lambda x: F.length(x).between(1, 63))
    return (F.size(labels) >= 2) & fine & last.isin(C.TOP_DOMAINS) & ~last.isin(C.FILE_ENDINGS)


def mac(value: Column) -> Column:
    return F.trim(value).rlike("^(?:(?:[0-9A-Fa-f]{2}:){5}|(?:[0-9A-Fa-f]{2}-){5})[0-9A-Fa-f]{2}$")


def vin(value: Column) -> Column:
    plain = F.upper(F.trim(value))
    letters = F.create_map(*[F.lit(x) for kv in zip(C.VIN_LETTERS, C.VIN_LETTER_VALUES) for x in kv])
    number = lambda c: F.coalesce(F.try_element_at(letters, c), c.try_cast("int"))
    total = F.aggregate(F.zip_with(_chars(plain), _ints(C.VIN_WEIGHTS), lambda c, w: number(c) * w), F.lit(0), lambda a, x: a + x)
    right = F.substr(F.lit("0123456789X"), total % 11 + 1, F.lit(1))
    return F.when(plain.rlike("^[A-HJ-NPR-Z0-9]{17}$"), right == F.substring(plain, 9, 1)).otherwise(False)


def phone(value: Column) -> Column:
    return F.trim(value).rlike(r"^[0-9+()/ .\-]+$") & F.length(F.regexp_replace(value, "[^0-9]", "")).between(7, 15)


def date(value: Column) -> Column:
    plain = F.trim(value)
    day = F.when(plain.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(plain, "d.M.yyyy")).when(plain.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(plain, "d/M/yyyy")).when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(plain, "yyyy-MM-dd"))
    return F.coalesce(F.year(day).between(1900, 2100), F.lit(False))


def tax_id(value: Column) -> Column:
    plain = F.upper(F.replace(value, F.lit(" "), F.lit("")))

    def step(p: Column, c: Column) -> Column:
        s = (c.cast("int") + p) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2) % 11

    check = (11 - F.aggregate(_chars(F.substring(plain, 1, 10)), F.lit(10), step)) % 10
    number = F.when(plain.rlike("^[0-9]{11}$"), check == F.substring(plain, 11, 1).cast("int"))
    shape = plain.rlike("^[A-Z]{2}[0-9A-Z]{8,12}$") & F.substring(plain, 1, 2).isin(sorted(C.COUNTRY_CODES))
    return F.coalesce(number, F.lit(False)) | (~plain.rlike("^[0-9]+$") & shape)


def ssn(value: Column) -> Column:
    plain = F.regexp_replace(F.upper(F.trim(value)), "[ -]", "")
    expanded = F.concat(F.substring(plain, 1, 8), F.lpad((F.ascii(F.substring(plain, 9, 1)) - 64).cast("string"), 2, "0"), F.substring(plain, 10, 2))
    products = F.zip_with(_chars(expanded), _ints(C.PENSION_WEIGHTS), lambda c, w: c.cast("int") * w)
    total = F.aggregate(products, F.lit(0), lambda a, x: a + F.floor(x / 10).cast("int") + x % 10)
    pension = F.when(plain.rlike(r"^[0-9]{8}[A-Z][0-9]{3}$"), total % 10 == F.substring(plain, 12, 1).cast("int"))
    return F.coalesce(pension, plain.rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))


VALIDATORS = {"luhn": luhn, "iban": iban, "bic": bic, "ip": lambda v: ipv4_scope(v).isNotNull(), "mac": mac, "vin": vin, "phone": phone, "date": date, "tax_id": tax_id, "ssn": ssn, "fqdn": fqdn}
