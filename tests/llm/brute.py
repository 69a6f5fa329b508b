"""Brute-force versions of the operators, for small inputs."""

import re


def removed_bytes(texts):
    """(doc_id, text, bytes removed, runs, rest) by looking at every 50-byte string."""
    first = {}
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - 49):
                first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49 if i is not None else 0):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield i, t, sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)


def components(fps, distance):
    """Smallest index reachable over pairs within the distance."""
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_spans(text):
    def good(kind, value):
        d = [int(c) for c in value if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(c if k % 2 == 0 else 2 * c - 9 * (c > 4) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text) if good(k, m[0])]


def quality_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n
