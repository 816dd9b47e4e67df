"""Plain Python versions of the operators' results, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def without_word_windows(rows, width=13):
    """{row number: (id, words, removed, hash of what is left)}"""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in texts:
        for a in range(len(w) - width + 1):
            k = tuple(w[a:a + width])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for a in range(len(w) - width + 1):
            if least[tuple(w[a:a + width])] < i:
                gone.update(range(a, a + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone).encode())))
    return sorted(out)


def without_byte_strings(rows, width=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[a:a + width] for _, b in texts for a in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for a in range(len(b) - width + 1):
            if times[b[a:a + width]] > 1:
                gone[a:a + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for s in bytes(gone).split(b"\0") if s), sha(kept)))
    return sorted(out)


def contamination(rows, items, width=13):
    windows = {}
    for name, t in items:
        w = ALNUM.findall(lower(t or ""))
        for a in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[a:a + width]), set()).add(str(name))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w = ALNUM.findall(lower(t or ""))
        hit, names = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[a:a + n]))):
                    hit.update(range(a, a + n))
                    names |= found
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out)


def components(fps, most=2):
    """{position: smallest position reachable} by comparing all pairs."""
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return [root(x) for x in range(len(fps))]


def repaired(rows):
    """{conversation: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines)} of (conv, turn, role, text)
    rows in order, trying every edit."""
    import functools

    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, r, x) for c, t, r, x in rows if c == conv]
        faults, seen = [], set()
        for _, role, text in mine:
            words = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))

        @functools.cache
        def best(i, last, inserted):
            """(cost, audit, lines) for the rows from i on after a row with the initial ``last``."""
            ways = []
            if i == len(mine) and last in ("", "a"):
                ways.append((0, "", ()))
            turn = "assistant" if last == "u" else "user"
            if inserted < 3:
                c, a, lines = best(i, turn[0], inserted + 1)
                ways.append((c + 2, "I" + a, (turn + ":", *lines)))
            if i < len(mine):
                _, role, text = mine[i]
                c, a, lines = best(i + 1, last, 0)
                ways.append((c + 3, "D" + a, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more = faults[i] == "truncated"
                    if (last, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                        c, a, lines = best(i + 1, role[:1], 0)
                        ways.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                    c, a, lines = best(i + 1, turn[0], 0)
                    ways.append((c + 2 + more, "R" + a, (f"{turn}:{text}", *lines)))
            return min(ways, default=(10 ** 9, "", ()))

        turns = [t for t, _, _ in mine if t is not None]
        first = "".join(r[:1] or "-" for _, r, _ in mine)
        cost, audit, lines = best(0, "", 0)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(first[i:i + 2] not in ("su", "ua", "au") for i in range(len(first) - 1)), cost, audit, "\n".join(lines))
    return out
