"""Plain versions of the operators, written from their definitions and run on small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def secrets(text):
    """Base spans as the contract states them."""
    text, found = text or "", []
    kinds = [
        ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
    ]
    for number, (kind, pattern, group, least) in enumerate(kinds):
        found += [(m.start(), number, m.end(), kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found)


def quality(text):
    ws = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {i + k for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(ws) < 10 or 100 * len(covered) > 20 * len(ws),
    }


def url(value):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    if not value or "://" not in value:
        host = path = ""
    else:
        rest = value.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.translate(LOWER)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def shingles(text, k):
    ws = words((text or "").translate(LOWER))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)])


def components(rows, k, percent):
    """{position: (set size, component id)} for (id, text) rows."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in holders[x] if j > i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(j)] = find(i)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        if key is not None and (smallest.get(r) is None or key < smallest[r]):
            smallest[r] = key
    return [(len(s), smallest.get(find(i))) for i, s in enumerate(sets)]


def repeated_words(texts, window):
    """(words, removed, digest of the rest) per text."""
    lists = [words(t) for t in texts]
    counts = collections.Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = {i + k for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def repeated_bytes(rows, window):
    """(bytes, removed, spans, digest of the rest) per (id, text); null ids come last, equal ids are not earlier than each other."""
    order = lambda key: (key is None, key or 0)
    raw = [(t or "").encode() for _, t in rows]
    first = {}
    for (key, text), b in zip(rows, raw):
        for i in range(len(b) - window + 1):
            s = b[i : i + window]
            first[s] = min(first.get(s, order(key)), order(key))
    out = []
    for (key, text), b in zip(rows, raw):
        gone, seen = bytearray(len(b)), set()
        for i in range(len(b) - window + 1):
            s = b[i : i + window]
            if first[s] < order(key) or s in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(s)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def repaired(rows):
    """Contract of the conversation repair for all rows ``(conv_id, turn, role, text)``: one tuple per conversation."""
    import functools
    import zlib

    conversations = {}
    for conv, turn, role, text in rows:
        after = conversations.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(name.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        after += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = []
    for conv, after in conversations.items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, role, text in after:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        roles = [r[:1] for _, r, _ in after]

        @functools.cache
        def best(i, state, inserts):
            """Cheapest (cost, audit, rows) from row i on; state is the last role's letter."""
            found = [(0, "", ())] if i == len(after) and state in ("", "a") else []
            then = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            full = {"u": "user", "a": "assistant"}[then]
            if inserts < 3:
                c, a, r = best(i, then, inserts + 1)
                found.append((c + 3, "I" + a, (f"{full}:", *r)))
            if i < len(after):
                _, role, text = after[i]
                c, a, r = best(i + 1, state, 0)
                found.append((c + 4, "D" + a, r))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    c, a, r = best(i + 1, then, 0)
                    found.append((c + 3 + more, "R" + a, (f"{full}:{text}", *r)))
                    if roles[i] == then or (roles[i] == "s" and state == ""):
                        c, a, r = best(i + 1, roles[i], 0)
                        found.append((c + more, "K" + a, (f"{role}:{text}", *r)))
            return min(found, default=(10**9, "", ()))

        cost, audit, kept = best(0, "", 0)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(kept))))
    return out


def ranked(docs, items, k=50):
    """(item_id, rank, doc_id, score) of the ranked search."""
    import math

    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    texts = [(key, collections.Counter(term.findall((t or "").translate(LOWER)))) for key, t in docs]
    texts = [(key, c, sum(c.values())) for key, c in texts if c]
    n_docs, total = len(texts), sum(n for _, _, n in texts)
    df = collections.Counter(x for _, c, _ in texts for x in c)
    out = []
    for item, text in set(items):
        asked = set(term.findall((text or "").translate(LOWER)))
        found = []
        for key, c, n in texts:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 20 * m)) for x in asked if x in c)
            if score > 0:
                found.append((-score, key is None, key))
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return out


def archived(pages):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archive round trip."""
    raw = [(key, (html or "").encode()) for key, html in pages]
    last = {}
    for key, b in raw:
        last.setdefault(b, []).append(key)
    out = []
    for key, b in raw:
        known = [x for x in last[b] if x is not None]
        top = max(known) if known else None
        revisit = len(b) >= 1000 and key != top
        out.append((key, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return out
