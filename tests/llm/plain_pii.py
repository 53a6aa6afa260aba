"""Format-preserving pseudonyms in plain Python: a loop over the matches of a text, halves of a string and numbers as they are."""

import datetime as dt
import hashlib
import re

from siltstone.llm import pii

FOUND = re.compile("|".join(pii.KINDS.values()), re.A)
FIRST = dt.date(1800, 1, 1)


def digest(*parts) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def permuted(text: str, alphabet: str, key: str, tweak: str) -> str:
    n = len(text) // 2
    a, b = text[:n], text[n:]
    for r in range(1, 9):
        h = digest(key, tweak, r, b)
        stream = b"".join(bytes.fromhex(digest(h, j)) for j in range(-(-len(a) // 32)))
        a, b = b, "".join(alphabet[(alphabet.index(c) + stream[i]) % len(alphabet)] for i, c in enumerate(a))
    return a + b


def pair(a: int, size_a: int, b: int, size_b: int, key: str, tweak: str) -> tuple[int, int]:
    for r in range(1, 9):
        a = (a + int(digest(key, tweak, r, b)[:15], 16)) % size_a
        b = (b + int(digest(key, tweak, -r, a)[:15], 16)) % size_b
    return a, b


def in_class(text: str, charset: str, alphabet: str, key: str, tweak: str) -> str:
    new = iter(permuted("".join(re.findall(f"[{charset}]", text)), alphabet, key, f"{tweak} {charset}"))
    return "".join(next(new) if re.match(f"[{charset}]", c) else c for c in text)


def in_classes(text: str, key: str, tweak: str) -> str:
    for charset, alphabet in (("a-z", "abcdefghijklmnopqrstuvwxyz"), ("A-Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0-9", "0123456789")):
        text = in_class(text, charset, alphabet, key, tweak)
    return text


def put(shape: str, charset: str, filling: str) -> str:
    new = iter(filling)
    return "".join(next(new) if re.match(f"[{charset}]", c) else c for c in shape)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(body)))
    return str(-total % 10)


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def day_of(text: str):
    """The date, its order (whether the month is first) and whether day and month have two figures."""
    parts = re.split("[-./]", text)
    if "-" in text:
        y, m, d, turned = *parts, False
    else:
        turned = "/" in text and int(parts[1]) > 12
        d, m = (parts[1], parts[0]) if turned else (parts[0], parts[1])
        y = parts[2]
    try:
        return dt.date(int(y), int(m), int(d)), turned, len(m) == len(d) == 2
    except ValueError:
        return None, turned, True


def moved_day(day: dt.date, wide: bool, key: str) -> dt.date:
    if wide:
        n = (day - FIRST).days
        a, b = pair(n % 189, 189, n // 189, 773, key, "date")
        return FIRST + dt.timedelta(b * 189 + a)
    if (day.month, day.day) == (2, 29):
        years = [y for y in range(1800, 2200) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
        return dt.date(years[pair(years.index(day.year), 97, 0, 1, key, "leap day")[0]], 2, 29)
    width = (len(str(day.day)), len(str(day.month)))
    year = [dt.date(2023, 1, 1) + dt.timedelta(k) for k in range(365)]
    days = [(x.month, x.day) for x in year if (len(str(x.day)), len(str(x.month))) == width]
    at, y = pair(days.index((day.month, day.day)), len(days), day.year - 1800, 400, key, f"day of {width[0]} and month of {width[1]}")
    return dt.date(1800 + y, *days[at])


def stand_in(m: str, key: str) -> str:
    kind = next(k for k, p in pii.KINDS.items() if re.fullmatch(p, m, re.A))
    digits = re.sub(r"\D", "", m)
    if kind == "mail":
        name, domain = m.rsplit("@", 1)
        new = in_classes(name.lower(), key, "mail")
        return "".join(b.upper() if a.isupper() else b for a, b in zip(name, new, strict=True)) + "@" + domain
    if kind in ("access", "token", "signed"):
        start = re.match(r"A[KS]IA|eyJ|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|[sprw]k_live_|[sprw]k_test_|AIza|hf_|npm_", m)[0]
        return start + in_classes(m[len(start) :], key, "token")
    if kind == "iban":
        sizes = {x[:2]: int(x[2:]) for x in pii.IBAN_LENGTHS.split()}
        size, plain = sizes.get(m[:2], 0), m.replace(" ", "")
        whole = plain[:size]
        if len(whole) < 15 or mod97(whole[4:] + whole[:4]) != 1:
            return m
        body = in_classes(whole[4:], key, "iban")
        return put(m, "A-Z0-9", f"{m[:2]}{98 - mod97(body + m[:2] + '00'):02}{body}{plain[size:]}")
    if kind in ("secret", "ip6"):
        if kind == "ip6" and len([x for x in m.split(":") if x]) > (7 if "::" in m else 8):
            return m
        new = in_class(m.lower(), "0-9a-f", "0123456789abcdef", key, kind)
        return new.upper() if re.search("[A-F]", m) else new
    if kind == "ip":
        new = in_class("".join(f"{int(x):02x}" for x in m.split(".")), "0-9a-f", "0123456789abcdef", key, "ip")
        return ".".join(str(int(new[k : k + 2], 16)) for k in range(0, 8, 2))
    if kind in ("iso", "dmy"):
        day, turned, wide = day_of(m)
        if day is None:
            return m
        new = moved_day(day, wide, key)
        if kind == "iso":
            return new.isoformat()
        mark, (one, two, _) = "/" if "/" in m else ".", re.split("[./]", m)
        x, y = (new.month, new.day) if turned else (new.day, new.month)
        return f"{x:0{len(one)}}{mark}{y:0{len(two)}}{mark}{new.year}"
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        a, b = pair(area - 1 - (area > 666), 898, (group - 1) * 9999 + serial - 1, 99 * 9999, key, "ssn")
        return f"{a + 1 + (a + 1 >= 666):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    if kind == "card":
        body, last = digits[:-1], digits[-1]
        if luhn_digit(body) != last:
            return m
        body = in_classes(body, key, "card")
        return put(m, "0-9", body + luhn_digit(body))
    code = re.match(r"(\+\d{1,3})(?=[ .(-])", m)
    code = code[0] if code else ""
    return code + in_classes(m[len(code) :], key, "phone")


def pseudonymised(text: str | None, key: str) -> str | None:
    return text if text is None else FOUND.sub(lambda m: stand_in(m[0], key), text)
