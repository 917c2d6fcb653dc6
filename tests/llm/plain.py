"""What the text operators should return, in plain Python."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def shingles(text, size):
    found = words((text or "").translate(LOWER))
    if len(found) < size:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(zip(*(found[k:] for k in range(size))))


def classes(rows, size=2, percent=80):
    """doc_id -> (set size, least linked id) over (doc_id, text) rows; rows of one id count as one document."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return [(i, len(s), root(i)) for i, s in sets]


def base_pii(text):
    def luhn(d):
        z = [int(c) for c in d][::-1]
        return (sum(z[::2]) + sum(sum(divmod(2 * x, 10)) for x in z[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x.lstrip("0")[:4] or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII,
)


def base_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(rows, window=50):
    """(n_words, n_removed, digest of what is kept) per row."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    w, seen, dups = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = [False] * len(w)
    for k in range(len(w) - 4):
        if windows[tuple(w[k : k + 5])] > 1:
            inside[k : k + 5] = [True] * 5
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dups, sum(inside)


def passing(rows):
    """Ids of the (doc_id, text, source) rows that pass the rules: base failures go, and mild ones unless their host fails less than expected."""
    judged = []
    for i, text, source in rows:
        n, chars, symbols, dups, repeats = counts(text)
        lines = sum(bool(WORD.search(line)) for line in (text or "").split("\n"))
        base = n < 10 or 100 * repeats > 20 * n
        mild = 100 * symbols > 10 * chars or 100 * dups > 30 * lines or chars < 2 * n or chars > 20 * n
        judged.append((i, source, base, mild))
    docs, failed = Counter(), Counter()
    for _, source, base, mild in judged:
        if source is not None:
            docs[source] += 1
            failed[source] += base or mild
    rates = [failed[s] / docs[s] for s in docs]
    mean = sum(rates) / len(rates) if rates else 0.0
    spread = sum((r - mean) ** 2 for r in rates) / len(rates) if rates else 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread else 1e6
    excused = set()
    for s, n in docs.items():
        rate = (failed[s] + mean * strength) / (n + strength)
        if rate + (rate * (1 - rate) / (n + strength + 1)) ** 0.5 < mean:
            excused.add(s)
    return {i for i, source, base, mild in judged if not base and (not mild or source in excused)}


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) of the (turn, role, text) rows of one conversation, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        again = (role, text) in seen
        seen.add((role, text))
        faults.append("blank" if not solid else "duplicate" if again else "truncated" if solid[-1] not in ".!?" else "")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def cheapest(i, state, memo, inserts=0):
        """(cost, letters, lines) from row ``i`` on; lists of edits in full, without any table."""
        if (i, state, inserts) not in memo:
            found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if inserts < 4:
                for to, role in (("u", "user"), ("a", "assistant")):
                    if to in steps[state]:
                        c, e, o = cheapest(i, to, memo, inserts + 1)
                        found.append((2 + c, "I" + e, (f"{role}:", *o)))
            if i < len(rows):
                c, e, o = cheapest(i + 1, state, memo)
                found.append((3 + c, "D" + e, o))
                if faults[i] not in ("blank", "duplicate"):
                    _, role, text = rows[i]
                    more = faults[i] == "truncated"
                    if initials[i] in steps[state]:
                        c, e, o = cheapest(i + 1, steps[state][initials[i]], memo)
                        found.append((more + c, "K" + e, (f"{role}:{text}", *o)))
                    for to, name in (("u", "user"), ("a", "assistant")):
                        if to in steps[state]:
                            c, e, o = cheapest(i + 1, to, memo)
                            found.append((2 + more + c, "R" + e, (f"{name}:{text}", *o)))
            memo[i, state, inserts] = min(found) if found else (10**9, "", ())
        return memo[i, state, inserts]

    memo: dict = {}
    for i in range(len(rows), -1, -1):
        for state in steps:
            cheapest(i, state, memo)
    cost, audit, lines = memo[0, "", 0]
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, lines


def damaged(rows):
    """(conv_id, turn, role, text) rows after the planted damage."""
    out = []
    for conv, turn, role, text in rows:
        address = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(address.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def collocations(rows, threshold=10, top=2000):
    """Rows of (lang, rank, phrase, a, l, r, n, score) from (text, lang) rows."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for size in (1, 2, 3):
                counts.update((lang, tuple(w[k : k + size])) for k in range(len(w) - size + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= threshold}
    dropped = {(g, part) for (g, p), a in found.items() if len(p) == 3 for part in (p[:2], p[1:]) if 100 * a >= 50 * counts[g, part]}
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in dropped:
            cuts = [(1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    ranks = Counter()
    for lang, score, a, p, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            yield lang, ranks[lang], p.decode(), -a, left, right, totals[lang], -score
