"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def join_shingles(text):
    """Shingles of the similarity join: lower-cased words without the punctuation around them."""
    edge = re.compile(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$")
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", lowered(text or "").encode()) if w]
    words = [edge.sub(b"", w) or w for w in words]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(docs, threshold=0.8):
    """{doc_id: (class_id, copy_id, n_copies, n_links)} from (doc_id, text) rows with distinct ids."""
    by_set = collections.defaultdict(list)
    for doc, text in docs:
        by_set[join_shingles(text)].append(doc)
    alone = by_set.pop(frozenset(), [])
    sets = list(by_set)
    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = collections.Counter((a, b) for v in holders.values() for i, b in enumerate(v) for a in v[:i])
    parent, links = list(range(len(sets))), collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for k, s in enumerate(sets):
        least[root(k)] = min([least.get(root(k), by_set[s][0]), *by_set[s]])
    out = {d: (d, d, 1, 0) for d in alone}
    for k, s in enumerate(sets):
        out |= {d: (least[root(k)], min(by_set[s]), len(by_set[s]), links[k]) for d in by_set[s]}
    return out


def window_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def contaminated(docs, items, threshold=0.8):
    """Ids of documents in which some stretch holds most shingles of an item."""
    def shingles(text):
        words = window_words(text)
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    wanted = {item: set(shingles(text)) for item, text in items}
    found = set()
    for doc, text in docs:
        here = shingles(text)
        for s in wanted.values():
            if s and len(s & set(here)) >= threshold * len(s) - 1e-9:
                span = [i for i, x in enumerate(here) if x in s]
                if span[-1] - span[0] < 3 * len(s):
                    found.add(doc)
    return found


def prf(key, kind, i, half, modulus):
    return int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16) % modulus


def feistel(key, kind, value, high, low, rounds=10):
    a, b = divmod(value, low)
    for i in range(rounds):
        if i % 2 == 0:
            a = (a + prf(key, kind, i, b, high)) % high
        else:
            b = (b + prf(key, kind, i, a, low)) % low
    return a * low + b


def unfeistel(key, kind, value, high, low, rounds=10):
    a, b = divmod(value, low)
    for i in reversed(range(rounds)):
        if i % 2 == 0:
            a = (a - prf(key, kind, i, b, high)) % high
        else:
            b = (b - prf(key, kind, i, a, low)) % low
    return a * low + b


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def refill(old, new):
    new = iter(new)
    return re.sub(r"\d", lambda _: next(new), old)


def pseudonym_card(key, old):
    digits = re.sub(r"\D", "", old)
    n = len(digits)
    halves = 10 ** (n - 2 - (n - 2) // 2), 10 ** ((n - 2) // 2)
    body = digits[0] + str(feistel(key, f"card{n}", int(digits[1:-1]), *halves)).zfill(n - 2)
    return refill(old, next(body + c for c in "0123456789" if luhn(body + c)))


def pseudonym_phone(key, old):
    digits = re.sub(r"\D", "", old)
    value = int(digits[-10:])
    inside = digits[-10] >= "2" and digits[-7] >= "2"  # by area and exchange rules; others are permuted among themselves
    while True:
        value = feistel(key, "phone" if inside else "phone-other", value, 10**5, 10**5)
        text = str(value).zfill(10)
        if (text[0] >= "2" and text[3] >= "2") == inside:
            return refill(old, digits[:-10] + text)


def pseudonym_ip(key, old):
    value = 0
    for part in old.split("."):
        value = value * 256 + int(part)
    value = feistel(key, "ipv4", value, 1 << 16, 1 << 16)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def letters(key, kind, value, n):
    digest = hashlib.sha256(f"{key}|{kind}|{value}".encode()).hexdigest()[:n]
    return digest.translate(str.maketrans("0123456789", "ghijklmnop"))


def pseudonym_email(key, old):
    low = old.lower()
    return f"{letters(key, 'email', low, 12)}@{letters(key, 'domain', low.split('@')[1], 8)}.{old.rsplit('.', 1)[1]}"


def pseudonym_secret(key, old):
    at = re.match(r"[A-Za-z_]+[^A-Za-z0-9]{0,3}[=:][^A-Za-z0-9]{0,4}", old).end()
    digest = hashlib.sha256(f"{key}|secret|{old[at:]}".encode()).hexdigest()
    return old[:at] + (digest * 9)[: len(old) - at]


def pseudonymised(text, key="pseudonym-key-1"):
    """The forms that the given tables hold."""
    rules = [
        (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", pseudonym_email),
        (r"\b(?i:password|passwd|secret|token|api_?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[^\s\"']{8,}", pseudonym_secret),
        (r"\bAKIA[0-9A-Z]{16}\b", lambda k, m: "AKIA" + hashlib.sha256(f"{k}|akia|{m}".encode()).hexdigest()[:16].upper()),
        (r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", pseudonym_ip),
        (r"\+1 \(\d{3}\) \d{3}-\d{4}(?![\w-])", pseudonym_phone),
        (r"(?<![\w.-])\d{16}(?![\w-])", lambda k, m: pseudonym_card(k, m) if luhn(m) else m),
    ]
    whole = "|".join(f"({p})" for p, _ in rules)
    return re.sub(whole, lambda m: rules[m.lastindex - 1][1](key, m.group(0)), text)
