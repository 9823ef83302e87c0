"""Plain versions of the operators' results, one text or all texts at a time."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_secrets(text):
    out = []
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I | re.A,
    )
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def quality(text):
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def repeated_bytes(rows, size=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of rows sorted by id, ids distinct."""
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            if s in seen:
                gone[p : p + size] = b"\x01" * size
            else:
                seen.add(s)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def repeated_windows(rows, size=35):
    places, out = {}, []
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in cut:
        for p in range(len(w) - size + 1):
            places.setdefault(tuple(w[p : p + size]), set()).add((i, p))
    for i, w in cut:
        gone = set()
        for p in range(len(w) - size + 1):
            if len(places[tuple(w[p : p + size])]) > 1:
                gone.update(range(p, p + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def components(rows, n=3, percent=90):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                c = len(a & b)
                if 100 * c >= percent * (len(a) + len(b) - c):
                    x, y = sorted((top(i), top(j)))
                    up[y] = x
    return [(r[0], len(s), rows[top(k)][0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]
