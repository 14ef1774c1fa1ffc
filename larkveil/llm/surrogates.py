"""Surrogates for personal data: keyed, type-consistent, distinct and the same wherever a value returns.

Found are e-mail addresses, telephone numbers, card numbers, IBANs, social security numbers, IPv4
addresses, secrets (keys, tokens, passwords after their names, or by their prefixes) and names
after one or more titles: first names, initials, particles, last names. The parts of a found name
are then found anywhere in the same text, with or without a title. Each value is replaced by one of
the same type: the same length, grouping, letter case and script; card numbers keep their network
digit and whether their check digit is right, IBANs theirs; addresses stay private or public;
telephone numbers keep the country code. Names keep script and letter case, not their length, and
the gender that titles tell.

How values are drawn. All values of a kind and a shape (which characters of which alphabet stand
where, what is kept) are numbered, and a keyed permutation of these numbers without a fixed point
gives the surrogate: ``back(forth(x) + step)`` with a Feistel network for ``forth`` and a step that
has no factor in common with the size, so it is one cycle through all of them. Two values of one
shape so have two surrogates, those of different shapes differ in shape, and no value is its own
surrogate, without any table. Letters of any script are drawn from the letters of the same Unicode
block, category and script; long values are permuted in chunks that depend on what stands before.
A secret of signs only is drawn from signs. A value that is alone in its shape gets a drawn word.

Names are drawn as syllables from a hash of their normal form, so one name has one surrogate in all
documents, whatever its titles; a first name ends as the gender says that all its titled mentions
tell, if they agree.

Collision check, over the whole corpus: all distinct values are gathered as a table (aggregated
before the shuffle, so a value that fills a third of the rows counts once for each task), their
surrogates are grouped, and a value whose surrogate another value has, or that is itself a value of
the corpus, draws again (names one syllable longer). After ``MAX_ROUNDS`` the shapes in which that
didn't help, because the corpus has most of their values, go back to the first draw as a whole:
there surrogates are distinct as shown above, but can be values of other rows. Values that drew more
than once, and names whose gender is told by some documents only, are exceptions. Exceptions are
sent to all tasks if they were counted to be few, else they are joined to the documents that need
them.

The key comes from the caller, else from the session's ``larkveil.surrogates.key``, else from the
environment's ``LARKVEIL_SURROGATES_KEY``. Without any of them ``DEMO_KEY`` is used, which protects
nothing; it is for tests and demonstrations.

Each text is read whole, on its own; two passes (find, replace), no shuffle of texts in the usual
case. Defined results: null text stays null with 0 replacements; empty text stays empty; where two
kinds could claim the same characters the first of KINDS wins; other columns pass through, a column
n_replaced is replaced; repeated rows are replaced alike; an empty table gives an empty table.
``n_replaced`` counts the replaced spans.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkveil.llm.common import cut, discard, fresh_name, lean

DEMO_KEY = b"larkveil-demo-key"
KEY_SETTING, KEY_VARIABLE = "larkveil.surrogates.key", "LARKVEIL_SURROGATES_KEY"
#: Exceptions that may be sent to every task: some 100 bytes each, so 10 MB at most.
SEND_EXCEPTIONS = 100_000
MAX_ROUNDS = 16
#: Characters that are numbered and permuted at once.
CHUNK = 32

# --- Fixed values ---
KINDS = ("SECRET", "EMAIL", "IBAN", "CARD", "IP", "SSN", "PHONE", "NAME")
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "herrn": "m", "monsieur": "m", "señor": "m", "don": "m", "господин": "m",
    "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "madame": "f", "mme": "f", "mlle": "f", "señora": "f", "señorita": "f", "doña": "f", "госпожа": "f",
    "dr": "", "prof": "", "doctor": "", "professor": "",
}
#: Words that stand inside names in lower case.
PARTICLES = ("von", "vom", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "al", "bin", "ben", "ter", "ten", "фон")
#: Signs that a secret without letters and digits can hold.
SIGNS = "!#$%&()*+-./:=?@[\\]^_`{|}~"
SYLLABLES = {
    "latin": ("b br d f g k l m n p r s t v w".split(), "a e i o u".split(), {"m": "ron len mas tor".split(), "f": "ina ella ria nda".split(), "": "ley son man berg".split()}),
    "cyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split(), {"m": "ман тор лен рад".split(), "f": "ина елла рия нда".split(), "": "ский енко ов ман".split()}),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ".split(), "α ε ι ο".split(), {"m": "νος ρος τας κης".split(), "f": "ινα ρια νη λια".split(), "": "ιδης ακης ου ας".split()}),
}
#: How keys and tokens of well-known makers begin; kept in surrogates.
PREFIXES = ("sk-", "sk_", "pk-", "pk_", "rk-", "rk_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AKIA", "xox", "eyJ")
# --- End of fixed values ---

_SECRET = re.compile(
    r"""(?i)(?<![A-Za-z0-9])(?:[a-z0-9_-]{0,24}(?:token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential)s?)["']?\s*[:=]+\s*["']?([^\s"'<>,;]{6,})"""
    r"""|(?<![A-Za-z0-9])((?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16}|xox[a-z]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"""
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5})(?!\w|-\d)")
_COUNTRY = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-я]"
_TITLES = "(?:" + "|".join(y for x in sorted(TITLES, key=len, reverse=True) for y in (x.capitalize(), x.upper())) + r")(?!\w)"
_WORD = rf"(?!{_TITLES}){_CAPITAL}(?:[^\W\d_]+(?:[-'’][^\W\d_]+)*|(?:[-'’][^\W\d_]+)+)"
_INSIDE = rf"(?:(?:{_CAPITAL}\.|{'|'.join(PARTICLES)})[ \t]*(?<=[. \t]))*"
_NAME = re.compile(rf"(?<!\w)((?:{_TITLES}\.?[ \t]+)+)({_INSIDE}{_WORD}(?:[ \t]+{_INSIDE}{_WORD}){{0,3}})")
#: Titles as they are written, so that the first letters alone keep the pattern off most places.
_TITLE = re.compile(_TITLES)
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_PRIVATE = re.compile(r"10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|169\.254\.")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


# --- finding ---


def _address(text: str, at: int) -> tuple[int, int] | None:
    """The address around an "@", letters and marks of any script."""
    own = lambda c: c.isalnum() or c in "._-" or (c > "\u02ff" and unicodedata.category(c)[0] == "M")
    start = at
    while start and (own(text[start - 1]) or text[start - 1] in "+%'"):
        start -= 1
    while start < at and text[start] in ".'":
        start += 1
    end = at + 1
    while end < len(text) and own(text[end]):
        end += 1
    while end > at + 1 and text[end - 1] in "._-":
        end -= 1
    labels = text[at + 1 : end].split(".")
    if start == at or text[at - 1] in ".'" or len(labels) < 2 or not all(labels) or labels[0][0] in "_-":
        return None
    return start, end


def _card(text: str, start: int, end: int) -> int | None:
    """Where the card number ends that begins a run of digits; none if none does."""
    ends, n = {}, 0
    for i in range(start, end):
        if text[i].isdigit():
            n += 1
            ends[n] = i + 1
    digits = re.sub(r"\D", "", text[start:end])
    if luhn(digits) or n == 16:
        return end
    for k in (16, 15, 19, 18, 17, 14, 13):  # another number may follow after a space
        if k < n and not text[ends[k]].isdigit() and luhn(digits[:k]):
            return ends[k]
    return None


def _candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) but for names, kinds in the order of KINDS; cheap tests keep the patterns off most texts."""
    if "=" in text or ":" in text or any(x in text for x in PREFIXES):
        for m in _SECRET.finditer(text):
            yield *m.span(1 if m[1] else 2), "SECRET"
    at = text.find("@")
    while at >= 0:
        if span := _address(text, at):
            yield *span, "EMAIL"
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IBAN.finditer(text):
            yield *m.span(), "IBAN"
        for m in _CARD.finditer(text):
            if end := _card(text, *m.span()):
                yield m.start(), end, "CARD"
        for kind, pattern in (("IP", _IP), ("SSN", _SSN), ("PHONE", _PHONE)):
            for m in pattern.finditer(text):
                if kind != "PHONE" or 7 <= sum(map(str.isdigit, m[0])) <= 15:
                    yield *m.span(), kind


def _names(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, gender) of the parts of names after titles; the last part and initials tell no gender."""
    for m in _NAME.finditer(text):
        gender = next((g for w in _LETTERS.findall(m[1]) if (g := TITLES.get(w.lower()))), "")
        words = [(w.start(), w.end()) for w in re.finditer(r"\S+", m[2])]
        for i, (a, b) in enumerate(words):
            for part in _LETTERS.finditer(text, m.start(2) + a, m.start(2) + b):
                if part[0].lower() not in PARTICLES and (len(part[0]) > 1 or text[part.end() : part.end() + 1] == "."):
                    yield *part.span(), gender if i < len(words) - 1 and len(part[0]) > 1 else ""


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans that don't overlap, in order; names' kinds end with the gender that this text tells."""
    taken = bytearray(len(text))
    spans: list[tuple[int, int, str]] = []

    def take(start: int, end: int, kind: str) -> None:
        if end > start and taken.find(1, start, end) < 0:
            taken[start:end] = b"\x01" * (end - start)
            spans.append((start, end, kind))

    for span in _candidates(text):
        take(*span)
    if _TITLE.search(text):
        told: dict[str, set[str]] = {}
        for start, end, gender in _names(text):
            if end - start > 1:
                told.setdefault(text[start:end].lower(), set()).update(gender)
            take(start, end, "NAME" if end - start > 1 else "INITIAL")
        for m in _LETTERS.finditer(text) if told else ():
            word = m[0]
            if word[0].isupper() and not word.islower():
                if word.lower() in told:
                    take(*m.span(), "NAME")
                elif word[-1] in "sS" and word[:-1].lower() in told:
                    take(m.start(), m.end() - 1, "NAME")
        spans = [(s, e, f"NAME:{''.join(g) if len(g := told[text[s:e].lower()]) == 1 else ''}" if k == "NAME" else k) for s, e, k in spans]
    return sorted(spans)


def kind_of(kind: str) -> str:
    """A kind without the gender."""
    return kind.partition(":")[0]


def normal(kind: str, value: str) -> str:
    """The form under which two mentions are the same value."""
    kind = kind_of(kind)
    if kind in ("CARD", "SSN"):
        return re.sub(r"\D", "", value)
    if kind == "PHONE":
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    if kind == "IBAN":
        return value.replace(" ", "")
    if kind == "IP":
        return ".".join(str(int(x)) for x in value.split("."))
    return value if kind == "SECRET" else value.lower()


# --- drawing ---


def _hash(key: bytes, *what: str) -> bytes:
    return hashlib.blake2b("\x1f".join(what).encode("utf-8", "surrogatepass"), key=key[:64]).digest()


class _Draw:
    """Numbers that depend on key and what is drawn for only."""

    def __init__(self, key: bytes, *what: str):
        self.seed, self.n, self.pool = _hash(key, *what), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.n.to_bytes(8, "little"), key=self.seed).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "little"), self.pool[4:]
        return value % n

    def pick(self, options: str | list[str]) -> str:
        return options[self.below(len(options))]


def moved(x: int, n: int, seed: bytes) -> int:
    """The number that follows x in a keyed cycle through all numbers below n; x itself only if n is 1."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    step = 1 + int.from_bytes(hashlib.blake2b(b"step", key=seed).digest(), "little") % (n - 1)
    while math.gcd(step, n) > 1:
        step = step % (n - 1) + 1
    f = lambda i, v: int.from_bytes(hashlib.blake2b(bytes([i]) + v.to_bytes(size, "little"), key=seed, digest_size=size).digest(), "little") & mask

    def walk(v: int, rounds: range, forth: bool) -> int:
        while True:
            a, b = v >> half, v & mask
            for i in rounds:
                a, b = (b, a ^ f(i, b)) if forth else (b ^ f(i, a), a)
            v = a << half | b
            if v < n:
                return v

    there = (walk(x, range(8), True) + step) % n
    return walk(there, range(7, -1, -1), False)


@lru_cache(maxsize=4096)
def alphabet(c: str, hexadecimal: bool = False, signs: bool = False) -> str:
    """The characters that may stand for c: of its block, category, script and behaviour under case folding; c alone if it is a sign."""
    if c in "0123456789":
        return "0123456789"
    if c.isascii():
        letters = "abcdef" if hexadecimal and c in "abcdefABCDEF" else "abcdefghijklmnopqrstuvwxyz"
        if c.isalpha():
            return letters if c.islower() else letters.upper()
        return SIGNS if signs and c in SIGNS else c
    like = lambda x: (unicodedata.category(x), unicodedata.name(x, "-").split()[0], x.lower() == x, len(x.upper()) == 1 and x.upper().lower() == x.lower() and len(x.lower()) == 1, x.isalnum(), x.isspace())
    own = like(c)
    if own[0][0] not in "LMN" and not signs or own[0] in ("Cn", "Cs", "Co", "Cc"):
        return c
    block = ord(c) >> 8 << 8
    return "".join(x for x in map(chr, range(block, block + 256)) if like(x) == own)


def _permuted(value: str, alphabets: list[str], seed: bytes) -> str:
    """A value with each character from its alphabet, by chunks."""
    out = []
    for i in range(0, len(value), CHUNK):
        part, own = value[i : i + CHUNK], alphabets[i : i + CHUNK]
        n = x = 0
        n = 1
        for c, a in zip(part, own):
            x, n = x * len(a) + a.index(c), n * len(a)
        y, chars = moved(x, n, seed), []
        for a in reversed(own):
            y, r = divmod(y, len(a))
            chars.append(a[r])
        out += reversed(chars)
        seed = hashlib.blake2b(part.encode("utf-8", "surrogatepass"), key=seed).digest()
    return "".join(out)


def _alphabets(kind: str, value: str) -> list[str]:
    """What each character of a value in normal form can become; itself where it is kept."""
    if kind == "EMAIL":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        keep = len(labels) - (2 if len(labels) > 2 and labels[-2] == "example" else 1)
        kept = "." + ".".join(labels[keep:])
        return [*map(alphabet, local), "@", *map(alphabet, domain[: len(domain) - len(kept)]), *kept]
    if kind == "PHONE":
        head = (m := _COUNTRY.match(value)) and m.end() or 0
        rest = value[head:]
        out = [*value[:head], *(["0123456789"] * len(rest))]
        out[head : head + 1] = ["23456789" if c in "23456789" else c for c in rest[:1]]
        if rest[3:6] == "555" and len(rest) == 10:
            out[head + 3 : head + 6] = "555"
        return out
    if kind == "SECRET":
        head = next((len(x) for x in PREFIXES if value.startswith(x)), 0)
        hexadecimal = not re.search("[g-zG-Z]", value[head:])
        out = [*value[:head], *(alphabet(c, hexadecimal) for c in value[head:])]
        return out if any(len(a) > 1 for a in out) else [*value[:head], *(alphabet(c, signs=True) for c in value[head:])]
    return [alphabet(c) for c in value]


def shape(kind: str, value: str) -> str:
    """What a value's surrogate has in common with it."""
    kind = kind_of(kind)
    if kind == "CARD":
        return f"CARD {value[0]} {len(value)} {_card_offset(value)}"
    if kind == "IBAN":
        return f"IBAN {value[:2]} {_iban_offset(value)} " + "".join(alphabet(c)[0] for c in value[4:])
    if kind == "IP":
        m = _PRIVATE.match(value)
        return f"IP {m[0] if m else 'public' if 1 <= int(value.split('.')[0]) <= 223 else 'special'}"
    return kind + " " + "".join(f"\0{a[0]}" if len(a) > 1 else a for a in _alphabets(kind, value))


def _card_offset(digits: str) -> int:
    return (int(digits[-1]) - _card_check(digits[:-1])) % 10


def _card_check(body: str) -> int:
    return next(d for d in range(10) if luhn(f"{body}{d}"))


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban_offset(value: str) -> int:
    return (int(value[2:4]) - _iban_check(value[:2], value[4:])) % 100


def _cycle(kind: str, value: str, key: bytes, own: str, attempt: int) -> Callable[[str], str]:
    """What follows each value of a shape in a cycle; the cycle may hold values of other shapes too, but no value is in two."""
    seed = _hash(key, own, str(attempt))
    if kind == "CARD":
        n, offset = len(value) - 2, _card_offset(value)

        def card(v: str) -> str:
            body = v[0] + str(moved(int(v[1:-1]), 10**n, seed)).zfill(n)
            return body + str((_card_check(body) + offset) % 10)

        return card
    alphabets = _alphabets(kind, value)
    if kind == "IBAN":
        country, offset = value[:2], _iban_offset(value)

        def iban(v: str) -> str:
            rest = _permuted(v[4:], alphabets[4:], seed)
            return f"{country}{(_iban_check(country, rest) + offset) % 100:02d}{rest}"

        return iban
    if kind == "IP":
        m = _PRIVATE.match(value)
        head = m[0] if m else ""

        def address(v: str) -> str:
            rest = bytes(map(int, v[len(head) :].split(".")))
            return head + ".".join(map(str, moved(int.from_bytes(rest), 256 ** len(rest), seed).to_bytes(len(rest))))

        return address
    if kind == "EMAIL":
        at = value.rindex("@")

        def mail(v: str) -> str:
            domain, begin = [], at + 1
            for label in v[at + 1 :].split("."):  # a label has one surrogate in all addresses
                spot = alphabets[begin : begin + len(label)]
                domain.append(_permuted(label, spot, _hash(key, "LABEL", "".join(a[0] for a in spot), str(attempt))))
                begin += len(label) + 1
            return _permuted(v[:at], alphabets[:at], _hash(seed, v[at:])) + "@" + ".".join(domain)

        return mail
    return lambda v: _permuted(v, alphabets, seed)


@lru_cache(maxsize=65536)
def draw_normal(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The surrogate of a value, both in normal form; never the value itself."""
    base, _, gender = kind.partition(":")
    if base == "NAME" and (script := _script(value)):
        draw = _Draw(key, "NAME", value, str(attempt))
        consonants, vowels, ends = SYLLABLES[script]
        stem = "".join(draw.pick(consonants) + draw.pick(vowels) for _ in range(3 + draw.below(2) + attempt))
        out = stem + draw.pick(ends[gender])
        return out if out != value else stem + draw.pick(consonants) + draw.pick(vowels) + draw.pick(ends[gender])
    own = shape(base, value)
    follow = _cycle(base, value, key, own, attempt)
    out = follow(value)
    while out != value and shape(base, out) != own:
        out = follow(out)
    return out if out != value else _hash(key, own, value, str(attempt)).hex()[: max(12, min(len(value), 64))]


@lru_cache(maxsize=65536)
def _script(value: str) -> str | None:
    """The syllables that a name of this script is made of; none for scripts without."""
    scripts = {unicodedata.name(c, "-").split()[0].lower() for c in value}
    return scripts.pop() if len(scripts) == 1 and scripts <= SYLLABLES.keys() else "latin" if "latin" in scripts else None


def dress(kind: str, raw: str, out: str) -> str:
    """A surrogate in normal form, in the format of the mention."""
    kind = kind_of(kind)
    if kind in ("CARD", "SSN", "PHONE", "IBAN"):
        chars = iter(out.lstrip("+"))
        return "".join(next(chars, "") if c.isalnum() else c for c in raw)
    if kind in ("NAME", "INITIAL"):
        return out.upper() if raw.isupper() else out[:1].upper() + out[1:]
    if kind == "EMAIL":
        return "".join(y.upper() if x.isupper() else y for x, y in zip(raw, out)) if len(raw) == len(out) else out
    return out


#: Of a kind and value: the attempt that counts, and the gender (None: the one that the text tells).
Exceptions = dict[tuple[str, str], tuple[int, str | None]]


def replace(text: str, key: bytes, exceptions: Exceptions) -> tuple[str, int]:
    spans = find(text)
    if not spans:
        return text, 0
    out, at = [], 0
    for s, e, kind in spans:
        raw, base = text[s:e], kind_of(kind)
        value = normal(kind, raw)
        attempt, gender = exceptions.get((base, value), (0, None))
        out += [text[at:s], dress(kind, raw, draw_normal(kind if gender is None else f"{base}:{gender}", value, key, attempt))]
        at = e
    return "".join([*out, text[at:]]), len(spans)


# --- the corpus ---


def drawing_key(spark: SparkSession) -> bytes:
    """The session's or the environment's key, else the one for demonstrations."""
    named = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    return hashlib.blake2b(named.encode()).digest() if named else DEMO_KEY


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct values of all texts: kind, value (normal form), gender, mixed (whether documents tell different genders)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(kind_of(k), normal(k, t[s:e]), k.partition(":")[2]) for x in b.column(0) if (t := x.as_py()) for s, e, k in find(t)}
            columns = list(zip(*sorted(found))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "value", "gender"])

    told = docs.select(text).mapInArrow(lean(run), "kind string, value string, gender string").groupBy("kind", "value").agg(F.collect_set("gender").alias("g"))  # three at most
    known = F.array_remove("g", "")
    return told.select("kind", "value", F.when(F.size(known) == 1, known[0]).otherwise(F.lit("")).alias("gender"), (F.size("g") > 1).alias("mixed"))


def _drawn(values: DataFrame, key: bytes) -> DataFrame:
    """kind, value, gender, mixed, attempt of ``values`` with out and space (where a draw can be taken back as a whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("kind", "value", "gender", "attempt"))))
            out = pa.array([draw_normal(f"{k}:{g}" if g else k, v, key, a) for k, v, g, a in rows], pa.string())
            space = pa.array([None if k == "NAME" else hashlib.blake2b(shape(k, v).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest() for k, v, _, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out, space], names=[*b.schema.names, "out", "space"])

    names = ("kind", "value", "gender", "mixed", "attempt")
    return values.select(*names).mapInArrow(lean(run), "kind string, value string, gender string, mixed boolean, attempt int, out string, space string")


def exceptions(values: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt and gender of those values that can't keep their first surrogate, or whose gender isn't told everywhere."""
    if "gender" not in values.columns:
        values = values.withColumns({"gender": F.lit(""), "mixed": F.lit(False)})
    state = cut(_drawn(values.withColumn("attempt", F.lit(0)), key))
    originals = values.select("kind", F.col("value").alias("out"))
    own = ("kind", "value", "gender", "mixed", "attempt")
    for _ in range(MAX_ROUNDS):
        # of the values with one surrogate the one that drew least often keeps it, then the smallest
        holders = state.groupBy("kind", "out").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "value")).alias("keep")).where("n > 1")
        taken = state.join(originals, ["kind", "out"], "left_semi").select("kind", "value")
        shared = state.join(holders, ["kind", "out"]).where(F.col("value") != F.col("keep.value")).select("kind", "value")
        clash = cut(taken.unionByName(shared).distinct())
        if clash.isEmpty():
            break
        again = state.join(clash, ["kind", "value"], "left_semi").select(*own).withColumn("attempt", (F.col("attempt") + 1).cast("int"))
        before, state = state, cut(state.join(clash, ["kind", "value"], "left_anti").unionByName(_drawn(again, key)))
        discard(before)
    else:
        full = state.join(clash, ["kind", "value"], "left_semi").where("space IS NOT NULL").select("space").distinct().withColumn("back", F.lit(0))
        state = state.join(full, "space", "left").withColumn("attempt", F.coalesce("back", "attempt"))
    return state.where("attempt > 0 OR mixed").select("kind", "value", "attempt", "gender")


def surrogate(docs: DataFrame, text: str = "text", key: bytes | None = None, row_key: str = "doc_id", send: int = SEND_EXCEPTIONS) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_replaced."""
    key = drawing_key(docs.sparkSession) if key is None else key
    values = cut(entities(docs, text))
    again = cut(exceptions(values, key))
    discard(values)
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), "n_replaced")]
    extra = fresh_name(docs.columns, "again")
    if again.count() <= send:
        known = {(x["kind"], x["value"]): (x["attempt"], x["gender"]) for x in again.collect()}
        source = docs.select(*kept, text)
    else:
        known = {}
        source = _with_exceptions(docs.select(*kept, text), text, row_key, again, extra)
    schema = T.StructType([*docs.select(kept).schema.fields, T.StructField(text, T.StringType()), T.StructField("n_replaced", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda n: b.column(b.schema.get_field_index(n))  # noqa: E731, B023
            own = column(extra).to_pylist() if extra in b.schema.names else None
            out = []
            for i, x in enumerate(column(text)):
                t = x.as_py()
                special = known if own is None else {(y["kind"], y["value"]): (y["attempt"], y["gender"]) for y in own[i] or ()}
                out.append((None, 0) if t is None else replace(t, key, special))
            arrays = [pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(column(k) for k in kept), *arrays], names=[*kept, text, "n_replaced"])

    return source.mapInArrow(lean(run), schema)


def _with_exceptions(docs: DataFrame, text: str, row_key: str, again: DataFrame, extra: str) -> DataFrame:
    """``docs`` with the exceptions among its values, by a join on the values and one on the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(k, kind_of(kind), normal(kind, t[s:e])) for k, x in zip(b.column(0).to_pylist(), b.column(1)) if (t := x.as_py()) for s, e, kind in find(t)}
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.column(0).type), *(pa.array(c, pa.string()) for c in columns[1:])], names=[row_key, "kind", "value"])

    schema = T.StructType([docs.schema[row_key], T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
    found = docs.select(row_key, text).mapInArrow(lean(run), schema).distinct().join(again, ["kind", "value"])
    lists = found.groupBy(row_key).agg(F.collect_set(F.struct("kind", "value", "attempt", "gender")).alias(extra))
    own = fresh_name(docs.columns, "key")
    return docs.join(lists.withColumnRenamed(row_key, own), F.col(row_key).eqNullSafe(F.col(own)), "left").drop(own)
