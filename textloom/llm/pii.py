"""Personal data replaced by format-preserving Feistel pseudonyms.

Found values: e-mail addresses, phone numbers, payment cards (Luhn), IBANs (mod 97), IPv4 addresses, US social security numbers,
dates (of the calendar, any year) and secrets: what is assigned to a name that ends in password, passwd, passphrase or pwd, if it has a digit and 6
characters, or 16 characters; and of 16 letters, digits, + / _ - or more to one that ends in token, key or secret (shorter ones can't be told from words);
names in upper or lower case, values of any length. A value is ranked as an integer among the values of its format, permuted by a keyed Feistel network with cycle walking, and written in the same
format: separators, letter case, length, prefixes and check digits stay valid. The permutation depends only on key, kind and
format, so equal values have equal pseudonyms in all documents, different values different ones, and depseudonymise() inverts it. Dates of
1900 to 2099 become such dates, others others.

Numbers: 16-digit groups and others of 13 to 19 digits that pass Luhn become Luhn-valid numbers with a new check digit; those
that fail it aren't cards: they are permuted as plain digits if they look like one all the same (CARD_LIKE digits), else left alone, as numbers of other lengths are mostly times and keys. A match that isn't valid, or takes
in what follows a value, is cut at the ends of its groups of digits: to the longest card, IBAN, or phone number of its country's length or
that ends before the next value. Where no cut is valid, the search goes on at the next character.

Defined cases: an empty table gives no rows; a null text stays null, an empty one empty, both with no spans; a row with a null doc_id is treated like
any other, and rows repeated with one doc_id give as many rows; a text of any length is scanned whole; overlapping finds (ties) go to the
earlier and longer; a value is never mapped to itself unless its format has one value; other columns are ignored by
pseudonymised() and kept by redact().
"""

from __future__ import annotations

import hashlib
import hmac
import re
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import renamed

#: In production the key comes from a secret store; the pseudonyms are linkable only with the same key.
KEY = b"textloom-pseudonym-key"
ROUNDS, CARD_LIKE = 8, (15, 16)
#: Values with more permuted characters are permuted as strings: arithmetic on one number of that many digits is quadratic.
WIDE = 512

#: Each kind's pattern, the earlier one first; what is replaced is the group value, where there is one. No part has a longest length.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<email_value>[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++)",
    "secret": r"(?:(?P<password>(?i:passwords?|passwd|passphrase|pwd))|(?i:token|secret|key))[\"']?\s*+[:=]\s*+[\"']?"
    r"(?P<secret_value>(?(password)(?:(?=[^\s\"',;<>]*[0-9])[^\s\"',;<>]{6,}+|[^\s\"',;<>]{16,}+)|[A-Za-z0-9+/_-]{16,}+))",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
}
_KIND = {k: re.compile(p) for k, p in PATTERNS.items()}
FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: A text without any of these has nothing to find.
HINT = re.compile(r"[0-9@]|(?i:token|secret|passw|passp|pwd|key)")


def _round(key: bytes, tweak: bytes, k: int, x: int, m: int) -> int:
    mac = hmac.new(key, b"%d|%d|%b|%x" % (k, m, tweak, x), hashlib.sha256).digest()
    return int.from_bytes(mac, "big") % m if m < 1 << 200 else int.from_bytes(hashlib.shake_256(mac).digest((m.bit_length() + 135) // 8), "big") % m


def permute(x: int, n: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(n): an alternating Feistel network on a x b >= n, walked until inside."""
    if n < 2:
        return x
    a = 1 << ((n - 1).bit_length() + 1) // 2  # the least power of 2 with a * a >= n
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)  # left < a, right < b
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2 == 0:
                left = (left + sign * _round(key, tweak, k, right, a)) % a
            else:
                right = (right + sign * _round(key, tweak, k, left, b)) % b
        x = left * b + right
        if x < n:
            return x


def _alphabet(s: str, digits: str = "0123456789") -> list[str]:
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [digits if c.isdigit() else lower if c in lower else upper if c in upper else c for c in s]


def _chars(s: str, kind: str, key: bytes, back: bool, alphabets: list[str] | None = None) -> str:
    """Every character permuted within its alphabet (others stay), the string as one number."""
    alphabets = alphabets or _alphabet(s)
    if sum(len(a) > 1 for a in alphabets) > WIDE:
        return _long(s, kind, key, back, alphabets)
    n, x = 1, 0
    for c, a in zip(s, alphabets, strict=True):
        n, x = n * len(a), x * len(a) + a.index(c)
    tweak = f"{kind}|{'|'.join(f'{len(a)}' for a in alphabets)}".encode()
    y = _moved(x, n, key, tweak, back)
    out = []
    for a in reversed(alphabets):
        y, r = divmod(y, len(a))
        out.append(a[r])
    return "".join(reversed(out))


def _long(s: str, kind: str, key: bytes, back: bool, alphabets: list[str]) -> str:
    """_chars() in linear time: the Feistel network's halves are strings, its sums are taken character by character."""
    at = [k for k, a in enumerate(alphabets) if len(a) > 1]
    size = np.array([len(alphabets[k]) for k in at], np.int64)
    v = np.array([alphabets[k].index(s[k]) for k in at], np.int64)
    tweak = hashlib.sha256(f"{kind}|{'|'.join(f'{len(a)}' for a in alphabets)}".encode()).digest()
    mid = len(v) // 2
    left, right = slice(0, mid), slice(mid, None)

    def network(inverse: bool) -> None:
        for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            to, by = (left, right) if k % 2 == 0 else (right, left)
            mac = hmac.new(key, b"long|%d|%b|" % (k, tweak) + v[by].astype(np.uint8).tobytes(), hashlib.sha256).digest()
            add = (np.frombuffer(hashlib.shake_256(mac).digest(8 * len(v[to])), np.uint64) % size[to].astype(np.uint64)).astype(np.int64)
            v[to] = (v[to] + (-add if inverse else add)) % size[to]

    network(False)
    v[-1] = (v[-1] + (-1 if back else 1)) % size[-1]  # as _moved(): no fixed points
    network(True)
    out = list(s)
    for k, x in zip(at, v.tolist(), strict=True):
        out[k] = alphabets[k][x]
    return "".join(out)


def _moved(x: int, n: int, key: bytes, tweak: bytes, back: bool) -> int:
    """A keyed permutation without fixed points: one step along the cycle into which permute() orders range(n)."""
    if n < 2:
        return x
    return permute((permute(x, n, key, tweak) + (-1 if back else 1)) % n, n, key, tweak, True)


def luhn(digits: str) -> bool:
    t = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        t += (v if k % 2 == 0 else v * 2 - 9 * (v > 4))
    return t % 10 == 0


def _into(shape: str, digits: str) -> str:
    """The digits in the places of shape's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(s: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if luhn(d):
        body = _chars(d[:-1], "card", key, back)
        return _into(s, next(body + c for c in "0123456789" if luhn(body + c)))
    if len(d) in CARD_LIKE:
        # the ranks of numbers that fail Luhn: the body, and which of the nine wrong check digits
        good = next(c for c in "0123456789" if luhn(d[:-1] + c))
        x = int(d[:-1]) * 9 + (int(d[-1]) - int(good) - 1) % 10
        y = _moved(x, 9 * 10 ** (len(d) - 1), key, f"number|{len(d)}".encode(), back)
        body = str(y // 9).zfill(len(d) - 1)
        good = next(c for c in "0123456789" if luhn(body + c))
        return _into(s, body + str((int(good) + 1 + y % 9) % 10))
    return None


def _iban(s: str, key: bytes, back: bool) -> str | None:
    flat = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _chars(flat[4:], "iban" + flat[:2], key, back)
    body = f"{flat[:2]}{98 - number(body + flat[:2] + '00') % 97:02d}{body}"
    it = iter(body)
    return "".join(c if c == " " else next(it) for c in s)


def _ip(s: str, key: bytes, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    # octets keep their number of digits
    span = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
    n, x = 1, 0
    for p in parts:
        lo, size = span[len(p)]
        n, x = n * size, x * size + int(p) - lo
    y = _moved(x, n, key, ("ip|" + "|".join(str(len(p)) for p in parts)).encode(), back)
    out = []
    for p in reversed(parts):
        lo, size = span[len(p)]
        y, r = divmod(y, size)
        out.append(str(r + lo))
    return ".".join(reversed(out))


FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def _date(s: str, key: bytes, back: bool) -> str | None:
    a, b, c = (int(x) for x in re.split(r"[-/.]", s))
    year_first = s[:4].isdigit()
    day_first = not year_first and not (b > 12 and s[2] == "/")
    try:
        day = date(a, b, c) if year_first else date(c, b, a) if day_first else date(c, a, b)
    except ValueError:
        return None
    # usual dates stay usual ones, others others
    lo, n = (FIRST_DAY, LAST_DAY - FIRST_DAY + 1) if FIRST_DAY <= day.toordinal() <= LAST_DAY else (1, date.max.toordinal() - (LAST_DAY - FIRST_DAY + 1))
    x = day.toordinal() - (LAST_DAY - FIRST_DAY + 1) * (lo == 1 and day.toordinal() > LAST_DAY) - lo
    # the order of day and month is read from the value, so it is permuted among the dates of its own reading
    while True:
        x = _moved(x, n, key, b"date" if lo == FIRST_DAY else b"far date", back)
        d = x + lo
        d = date.fromordinal(d + (LAST_DAY - FIRST_DAY + 1) * (lo == 1 and d >= FIRST_DAY))
        if day_first or year_first or d.day > 12:
            break
    if year_first:
        return f"{d.year:04d}{s[4]}{d.month:02d}{s[7]}{d.day:02d}"
    p = (d.day, d.month) if day_first else (d.month, d.day)
    return f"{p[0]:02d}{s[2]}{p[1]:02d}{s[5]}{d.year:04d}"


def _email(s: str, key: bytes, back: bool) -> str:
    local, _, domain = s.rpartition("@")
    host, dot, top = domain.rpartition(".")
    if not top.isalpha():
        host, dot, top = domain, "", ""
    return _chars(local + "@" + host, "email", key, back) + dot + top


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
    if not (0 < a < 900 and a != 666 and g and n):
        return None
    ok = 898  # area numbers but 000, 666 and 900 to 999
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1
    y, n = divmod(_moved(x, ok * 99 * 9999, key, b"ssn", back), 9999)
    a, g = divmod(y, 99)
    a += 1 + (a >= 665)
    return f"{a:03d}-{g + 1:02d}-{n + 1:04d}"


def _phone(s: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 8 <= len(d) <= 15:
        return None
    code = re.match(r"\+([0-9]{1,3})(?=[ .(-])", s)
    keep = len(code[1]) if code else 0  # the country code is format
    return _into(s, d[:keep] + _chars(d[keep:], f"phone{d[:keep]}", key, back))


def _hex(s: str) -> str | None:
    """The digits of a hexadecimal number, of lower or upper case."""
    return "0123456789abcdef" if re.fullmatch("[0-9a-f]+", s) else "0123456789ABCDEF" if re.fullmatch("[0-9A-F]+", s) else None


def _secret(s: str, key: bytes, back: bool) -> str:
    digits = _hex(s)
    kind = "secret" if digits is None else "hex" if digits.islower() else "HEX"
    # the form is read from the value, so it is permuted among the values of its form
    while True:
        s = _chars(s, kind, key, back, [digits] * len(s) if digits else None)
        if _hex(s) == digits:
            return s


KINDS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


@lru_cache(100_000)
def pseudonym(kind: str, value: str, key: bytes = KEY) -> str | None:
    """The pseudonym of a value, None if it isn't valid for its kind."""
    return KINDS[kind](value, key, False)


def depseudonymise(kind: str, value: str, key: bytes = KEY) -> str | None:
    return KINDS[kind](value, key, True)


def scan(text: str, key: bytes = KEY) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with pseudonyms, and (start, end, kind, pseudonym) of each in the original text (characters)."""
    if not HINT.search(text):
        return text, []
    out, spans, at, pos = [], [], 0, 0
    while m := FIND.search(text, pos):
        found = _valid(text, m, key)
        if found is None:
            pos = m.start() + 1
            continue
        kind, a, b, new = found
        out += [text[at:a], new]
        spans.append((a, b, kind, new))
        at = pos = b
    return ("".join([*out, text[at:]]), spans) if spans else (text, [])


_NATIONAL = re.compile(r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])")
#: Digits of a phone number, with the country code, where a country has one length.
PHONE_DIGITS = {"1": 11, "7": 11, "33": 11, "34": 11, "41": 11, "44": 12, "45": 10, "47": 10, "48": 11, "61": 11, "91": 12}


def _ends(text: str, a: int, b: int) -> list[int]:
    """Where text[a:b] can end, at the ends of its groups of digits, the longest first."""
    return [a + m.end() for m in re.finditer("[0-9]+", text[a:b])][::-1]


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _card_end(text: str, m: re.Match) -> int | None:
    """The end of the longest card in the match: one that passes Luhn, else one of a card's length."""
    a, b = m.span()
    inside = re.search(r"[0-9][ -]?$", text[max(a - 2, 0) : a]) is not None  # earlier digits were passed over
    likely: list[int] = []
    if inside and len(re.match("[0-9]+", text[a:b])[0]) < 4:
        return None
    for end in _ends(text, a, b):
        groups = re.findall("[0-9]+", text[a:end])
        # in a row of numbers every tenth choice passes Luhn, so only the whole of it may have small groups
        if 13 <= sum(map(len, groups)) <= 19 and (end == b and not inside or all(len(g) > 3 for g in groups[:-1])):
            likely.append(end)
    good = [end for end in likely if luhn(_digits(text[a:end]))]
    if good:
        return good[0]
    like = next((end for end in likely if len(_digits(text[a:end])) in CARD_LIKE), None)
    if like is None:
        return None
    # it must not take the head of a card that begins at a later group
    for g in re.finditer("(?<=[ -])[0-9]+", text[a:b]):
        later = _KIND["card"].match(text, a + g.start())
        if later and any(len(_digits(text[later.start() : e])) > 12 and luhn(_digits(text[later.start() : e])) and all(len(x) > 3 for x in re.findall("[0-9]+", text[later.start() : e])[:-1]) for e in _ends(text, *later.span())):
            return None
    return like


def _phone_end(text: str, m: re.Match, key: bytes) -> int | None:
    """The end of the phone number in the match: of its country's length, else the longest that takes nothing of a value behind it."""
    a, b = m.span()
    ends = [end for end in _ends(text, a, b) if 8 <= len(_digits(text[a:end])) <= 15 and _KIND["phone"].fullmatch(text, a, end)]
    if not ends:
        return None
    digits = _digits(text[a:b])
    if text[a] == "+" and (code := next((c for c in PHONE_DIGITS if digits.startswith(c)), None)):
        if exact := [end for end in ends if len(_digits(text[a:end])) == PHONE_DIGITS[code]]:
            return exact[0]
    for g in re.finditer("(?<=[ .-])[(+]?[0-9]+", text[a:b]):
        at = a + g.start()
        # an email, date, ... or card that begins at a group ends the number before it
        if any(end < at for end in ends) and any((v := p.match(text, at)) and (_card_end(text, v) if k == "card" else pseudonym(k, v[0], key)) for k, p in _KIND.items() if k not in ("phone", "secret")):
            ends = [end for end in ends if end < at]
            break
    clean = [end for end in ends if not re.match("[.-][0-9]", text[end : end + 2])]
    return next(iter(clean or ends), None)


def _valid(text: str, m: re.Match, key: bytes) -> tuple[str, int, int, str] | None:
    """Kind, place and pseudonym of the value that begins where m does: m's kind first, then the kinds behind it."""
    kinds = list(_KIND)
    first = next(k for k, name in enumerate(kinds) if m[name] is not None)
    for kind in kinds[first:]:
        p = _KIND[kind].match(text, m.start())
        if not p:
            continue
        a, b = p.span(f"{kind}_value" if kind in ("email", "secret") else 0)
        if kind == "card":
            b = None if _NATIONAL.match(text, a) else _card_end(text, p)
        elif kind == "phone":
            b = _phone_end(text, p, key)
        elif kind == "iban":
            # groups behind it may look like its last ones
            b = next((a + e.end() for e in [*re.finditer(r"[A-Z0-9]+", p[0])][::-1] if pseudonym(kind, text[a : a + e.end()], key)), None)
        if b is None:
            continue
        # long values would fill the cache
        if (new := (pseudonym if b - a <= WIDE else pseudonym.__wrapped__)(kind, text[a:b], key)) is not None:
            return kind, a, b, new
    return None


def _scanner(key: bytes):
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("pseudonym", pa.string())])
    kind = pa.struct([("text", pa.string()), ("spans", pa.list_(span))])

    @F.arrow_udf("text string, spans array<struct<start:bigint,stop:bigint,kind:string,pseudonym:string>>")
    def found(text: pa.Array) -> pa.Array:
        texts, spans = [], []
        for t in text.to_pylist():
            new, s = (None, []) if t is None else scan(t, key)
            texts.append(new)
            spans.append([{"start": a, "stop": b, "kind": k, "pseudonym": p} for a, b, k, p in s])
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))], fields=list(kind))

    return found


def pseudonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, n_pii and spans (place in the original text, kind, pseudonym) of every row of docs."""
    src = renamed(docs, doc_id="doc_id", text="text")
    return src.select("doc_id", _scanner(key)(F.col("text")).alias("p")).select("doc_id", "p.text", F.size("p.spans").cast("bigint").alias("n_pii"), "p.spans")


def redact(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs, all columns, with pseudonyms in text."""
    return docs.withColumn("text", _scanner(key)(F.col("text"))["text"])
