"""Structured values: addresses of resources, connection strings, keys, headers, manifests, mail addresses."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

from larkveil.kernel.hits import Hit
from larkveil.plans.catalog import Settings

# --- Fixed values: formats, names and confidences ---
URL = r"(?:https?|wss?|ftp)://[^\s>\"')]+"
MAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
WEB_TOKEN = r"(?<![A-Za-z0-9_.\-])[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?![A-Za-z0-9_.\-])"
KEY_BLOCK = r"-----BEGIN ([A-Z ]*)PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END \1PRIVATE KEY(?: BLOCK)?-----"
DATABASE_URL = r"(?:postgresql|postgres|mysql|mongodb\+srv|mongodb|redis|amqp|mssql)://[^\s>\"')]+"
KEY_VALUES = r"[A-Za-z][A-Za-z ]{1,24}=[^;\n]*(?:;[ \t]*[A-Za-z][A-Za-z ]{1,24}=[^;\n]*)+"
HEADER = r"(?m)^([A-Za-z][A-Za-z-]*):[ \t]*(.+)$"
CREDENTIAL = r"(?i)(?:bearer|basic)\s+(\S+)"
API_PATH = r"/(?:api|v\d+|rest|graphql)(?:/|$)"
SECRET_KIND, DATA_BLOCK, DATA_ENTRY, NEXT_MANIFEST = r"(?m)^kind:[ \t]*Secret[ \t]*$", r"(?m)^([ \t]*)data:[ \t]*$", r"([ \t]+)[\w.\-]+:[ \t]*(\S+)[ \t]*$", r"(?m)^---[ \t]*$"
INTERNAL_ENDINGS = (".local", ".internal", ".corp", ".lan")
SIGNATURES = {"sig", "signature", "x-amz-signature", "x-goog-signature"}
QUERY_SECRETS = {"token": "ACCESS_TOKEN", "access_token": "ACCESS_TOKEN", "api_key": "API_KEY", "apikey": "API_KEY", "key": "API_KEY"}
COOKIE_SECRETS = {
    "sessionid": "SESSION_COOKIE", "jsessionid": "SESSION_COOKIE", "phpsessid": "SESSION_COOKIE", "connect.sid": "SESSION_COOKIE", "sid": "SESSION_COOKIE",
    "auth": "AUTH_COOKIE", "token": "AUTH_COOKIE", "access_token": "AUTH_COOKIE", "id_token": "AUTH_COOKIE",
    "csrf": "CSRF_TOKEN", "xsrf": "CSRF_TOKEN", "_csrf": "CSRF_TOKEN",
}
DATABASE_KEYS = {
    "server": "DATABASE_HOST", "data source": "DATABASE_HOST", "host": "DATABASE_HOST", "addr": "DATABASE_HOST", "address": "DATABASE_HOST",
    "database": "DATABASE_NAME", "initial catalog": "DATABASE_NAME", "user id": "DATABASE_USER", "uid": "DATABASE_USER", "user": "DATABASE_USER",
    "password": "PASSWORD", "pwd": "PASSWORD",
}
DATABASE_MARKS = {"database", "user id", "password", "pwd"}
CONFIDENCE, SURE = 0.98, 0.99
# --- End of fixed values ---

_URL, _MAIL, _WEB_TOKEN, _KEY_BLOCK, _DATABASE_URL, _KEY_VALUES, _HEADER = map(re.compile, (URL, MAIL, WEB_TOKEN, KEY_BLOCK, DATABASE_URL, KEY_VALUES, HEADER))
_TWO_DOTS = re.compile(r"\.[A-Za-z0-9_-]+\.")
_PLACE = re.compile(r"[^:]+://(?P<net>[^/?#]*)(?P<path>[^?#]*)(?:\?(?P<query>[^#]*))?")


def _hit(start: int, end: int, cls: str, parts: list[Hit] | None = None, conf: float = CONFIDENCE) -> Hit:
    return Hit(start, end, cls, "structured", conf, {}, parts or [])


def _pairs(text: str, start: int, end: int, separator: str) -> Iterator[tuple[str, int, str, int]]:
    """(key, where, value, where) of each item that isn't blank; an item without = has an empty value after it."""
    for m in re.compile(rf"[^{separator}]+").finditer(text, start, end):
        item = m[0].strip()
        if not item:
            continue
        at = m.start() + m[0].index(item)
        key, equals, value = item.partition("=")
        yield key, at, value, at + len(key) + len(equals)


def _listed(host: str, names: tuple[str, ...]) -> bool:
    return any(host == n or host.endswith("." + n) for x in names if (n := x.strip().lower().lstrip(".")))


class Structured:
    def __init__(self, settings: Settings):
        self.customer = settings.dictionaries.get("CUSTOMER_DOMAIN", ())
        self.internal = settings.dictionaries.get("INTERNAL_DOMAIN", ())

    def host_class(self, host: str, usual: str) -> str:
        if _listed(host, self.customer):
            return "CUSTOMER_DOMAIN"
        return "INTERNAL_DOMAIN" if _listed(host, self.internal) or host.endswith(INTERNAL_ENDINGS) else usual

    def is_internal(self, host: str) -> bool:
        return "." not in host or host.endswith(INTERNAL_ENDINGS) or _listed(host, self.internal)

    def authority(self, net: str, at: int, usual: str) -> list[Hit]:
        """User, password and host of an authority that begins at ``at``."""
        out = []
        account, sign, rest = net.partition("@")
        if sign:
            user, colon, password = account.partition(":")
            if user:
                out.append(_hit(at, at + len(user), "PERSON_USERNAME"))
            if password:
                begin = at + len(user) + len(colon)
                out.append(_hit(begin, begin + len(password), "PASSWORD"))
            at += len(account) + 1
        else:
            rest = net
        if rest.startswith("["):
            host = rest[: rest.find("]") + 1] or rest
        else:
            host = rest.rpartition(":")[0] if ":" in rest else rest
        if host:
            out.append(_hit(at, at + len(host), self.host_class(host.lower(), usual)))
        return out

    def urls(self, text: str) -> Iterator[Hit]:
        if "://" not in text:
            return
        for m in _URL.finditer(text):
            place = _PLACE.match(m[0])
            base = m.start()
            net, path, query = place["net"], place["path"], place["query"]
            named = net.rpartition("@")[2]
            host = (named[1:].partition("]")[0] if named.startswith("[") else named.partition(":")[0]).lower()
            parts = self.authority(net, base + place.start("net"), "FQDN" if "." in host else "HOSTNAME")
            if re.match(API_PATH, path):
                parts.append(_hit(base + place.start("path"), base + place.end("path"), "API_PATH"))
            cls = "INTERNAL_URL" if self.is_internal(host) else "URL"
            if query:
                begin = base + place.start("query")
                keys = set()
                for key, at, value, where in _pairs(text, begin, begin + len(query), "&"):
                    keys.add(key.lower())
                    parts.append(_hit(at, at + len(key), "QUERY_PARAMETER"))
                    if value:
                        parts.append(_hit(where, where + len(value), "QUERY_VALUE"))
                        if secret := QUERY_SECRETS.get(key.lower()):
                            parts.append(_hit(where, where + len(value), secret))
                if keys & SIGNATURES:
                    cls = "SAS_TOKEN" if "sv" in keys else "SIGNED_URL"
            yield _hit(base, m.end(), cls, sorted(parts, key=lambda p: p.start))

    def connections(self, text: str) -> Iterator[Hit]:
        hosts = {"FQDN", "HOSTNAME", "DOMAIN", "INTERNAL_DOMAIN", "CUSTOMER_DOMAIN"}
        for m in _DATABASE_URL.finditer(text) if "://" in text else ():
            place = _PLACE.match(m[0])
            base = m.start()
            parts = self.authority(place["net"], base + place.start("net"), "DATABASE_HOST")
            for p in parts:
                p.cls = "DATABASE_USER" if p.cls == "PERSON_USERNAME" else "DATABASE_HOST" if p.cls in hosts else p.cls
            if name := place["path"].lstrip("/").split("/")[0]:
                begin = base + place.start("path") + 1
                parts.append(_hit(begin, begin + len(name), "DATABASE_NAME"))
            yield _hit(base, m.end(), "DATABASE_CONNECTION_STRING", parts)
        for m in _KEY_VALUES.finditer(text) if "=" in text and ";" in text else ():
            found = [(key.strip().lower(), value, at) for key, _, value, at in _pairs(text, m.start(), m.end(), ";")]
            keys = {k for k, _, _ in found}
            if not keys & DATABASE_MARKS or "DATABASE_HOST" not in {DATABASE_KEYS.get(k) for k in keys}:
                continue
            parts = []
            for key, value, at in found:
                if key in DATABASE_KEYS and (bare := value.strip()):
                    begin = at + value.index(bare)
                    parts.append(_hit(begin, begin + len(bare), DATABASE_KEYS[key]))
            yield _hit(*m.span(), "DATABASE_CONNECTION_STRING", parts)

    def key_blocks(self, text: str) -> Iterator[Hit]:
        if "-----BEGIN" not in text:
            return
        for m in _KEY_BLOCK.finditer(text):
            kind = "SSH_" if "OPENSSH" in m[1] else "TLS_" if "RSA" in m[1] or "EC" in m[1] else ""
            yield _hit(*m.span(), kind + "PRIVATE_KEY", conf=SURE)

    def headers(self, text: str) -> Iterator[Hit]:
        if ":" not in text:
            return
        for m in _HEADER.finditer(text):
            name, (begin, end) = m[1].lower(), m.span(2)
            if name == "authorization":
                if c := re.match(CREDENTIAL, m[2]):
                    yield _hit(begin + c.start(1), begin + c.end(1), "ACCESS_TOKEN")
            elif name in ("cookie", "set-cookie"):
                parts = []
                for i, (key, _, value, at) in enumerate(_pairs(text, begin, end, ";")):
                    if value and not (i and name == "set-cookie"):
                        classes = ["COOKIE_VALUE", COOKIE_SECRETS.get(key.strip().lower())]
                        parts += [_hit(at, at + len(value), c) for c in classes if c]
                if parts:
                    yield _hit(*m.span(), "COOKIE", parts)
            elif name.startswith("x-") and not name.startswith("x-forwarded-") and name != "x-request-id":
                yield _hit(*m.span(), "CUSTOM_HEADER", [_hit(begin, end, "HEADER_VALUE")])

    def manifests(self, text: str) -> Iterator[Hit]:
        if "Secret" not in text:
            return
        borders = [0, *(p for m in re.finditer(NEXT_MANIFEST, text) for p in m.span()), len(text)]
        for begin, end in zip(borders[::2], borders[1::2]):
            part = text[begin:end]
            if not re.search(SECRET_KIND, part):
                continue
            for block in re.finditer(DATA_BLOCK, part):
                at = begin + block.end() + 1
                for line in part[block.end() + 1 :].split("\n"):
                    entry = re.match(DATA_ENTRY, line)
                    if line.strip():
                        if not entry or len(entry[1]) <= len(block[1]):
                            break
                        yield _hit(at + entry.start(2), at + entry.end(2), "KUBERNETES_SECRET")
                    at += len(line) + 1

    def web_tokens(self, text: str) -> Iterator[Hit]:
        if not _TWO_DOTS.search(text):
            return
        for m in _WEB_TOKEN.finditer(text):
            head = m[0].partition(".")[0]
            try:
                decoded = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
            except ValueError:
                continue
            if isinstance(decoded, dict) and "alg" in decoded:
                yield _hit(*m.span(), "JWT", conf=SURE)

    def mails(self, text: str) -> Iterator[Hit]:
        if "@" not in text:
            return
        for m in _MAIL.finditer(text):
            at = m.start() + m[0].index("@")
            yield _hit(*m.span(), "EMAIL", [_hit(m.start(), at, "PERSON_USERNAME"), _hit(at + 1, m.end(), self.host_class(text[at + 1 : m.end()].lower(), "DOMAIN"))])

    def find(self, text: str) -> list[Hit]:
        """All of them; what lies inside one that was found before it is left out."""
        kept: list[Hit] = []
        for reader in (self.urls, self.connections, self.key_blocks, self.headers, self.manifests, self.web_tokens, self.mails):
            for hit in reader(text):
                if not any(k.holds(hit) for k in kept):
                    kept.append(hit)
        return sorted(kept, key=lambda h: (h.start, -h.size))
