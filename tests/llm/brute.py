"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def white_words(text):
    return WHITE.findall(text or "")


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def conversations(rows):
    """conv_id -> (turns, loss text)"""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((-1 if turn is None else turn, role or "", text or ""))
    return {c: ([(r, t) for _, r, t in sorted(ts)], "".join(t for _, r, t in sorted(ts) if r == "assistant"))
            for c, ts in by.items()}


def shingles(text, words):
    ws = WHITE.findall((text or "").translate(LOWER))
    if not ws:
        return set()
    return {tuple(ws[i:i + words]) for i in range(max(1, len(ws) - words + 1))}


def linked(rows, words=4, percent=85):
    """doc_id -> (set size, smallest id reachable)"""
    sets = {i: shingles(t, words) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, size):
    """doc_id -> (bytes, removed, spans, kept bytes); rows are (id, text), ids distinct"""
    counts = Counter()
    data = {i: (t or "").encode() for i, t in rows}
    for b in data.values():
        counts.update(b[s:s + size] for s in range(len(b) - size + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if counts[b[s:s + size]] > 1:
                gone[s:s + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


def passage_words(rows, size):
    """doc_id -> words inside windows of ``size`` words that another row has"""
    texts = [(i, white_words(t)) for i, t in rows]
    windows = [{tuple(ws[s:s + size]) for s in range(len(ws) - size + 1)} for _, ws in texts]
    counts = Counter(w for held in windows for w in held)
    return {i: len({k for s in range(len(ws) - size + 1) if counts[tuple(ws[s:s + size])] > 1 for k in range(s, s + size)})
            for i, ws in texts}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0
