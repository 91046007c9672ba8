"""Plain single-machine versions of the query contracts, for comparison."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def overlaps(docs, items, window=10):
    """doc rows (id, text), items (id, text) -> (id, n_words, n_hit, n_items, sha, contaminated)."""
    index: dict[tuple, set] = {}
    for i, t in items:
        w = ITEM_WORD.findall(lower(t))
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            index.setdefault(tuple(w[p:p + n]), set()).add(i)
    lengths = {len(k) for k in index}
    out = []
    for d, t in docs:
        w = ITEM_WORD.findall(lower(t))
        hit, got = set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                ids = index.get(tuple(w[p:p + n]))
                if ids is not None:
                    hit.update(range(p, p + n))
                    got |= ids
        ids = sorted(str(i) for i in got if i is not None)
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    seen: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def conversation(turns):
    """turns: (role, text) in order -> (n_turns, sha, loss_chars, loss_sha)."""
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha(said), len(loss), sha(loss)


def simhash(text, shingle=3):
    import xxhash

    w = words(lower(text))
    parts = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, bits=3):
    """Root index of each fingerprint over all pairs within ``bits``."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def substring(docs, window=50):
    """rows (id, text) -> (id, n_words, n_removed, kept sha)."""
    first: dict[tuple, int] = {}
    lists = [words(t) for _, t in docs]
    for (d, _), w in zip(docs, lists):
        if d is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p:p + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(docs, lists):
        gone = set()
        if d is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p:p + window])] < d:
                    gone.update(range(p, p + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), sha(" ".join(kept))))
    return out


_BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def _passes(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        odd = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(odd) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def entities(text):
    """(kind, start, end) in order, by the plain patterns."""
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(_BASE.items()) for m in p.finditer(text or "") if _passes(k, m[0])]
    return [(k, a, b) for a, _, b, k in sorted(found)]
