"""Plain versions of the operators, against which they are tested."""

import collections
import hashlib
import itertools
import re
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n)


def without_repeats(texts, length=200):
    """(bytes, removed, spans, remaining bytes) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def shingles(text, k):
    words = SPACED.findall(lower(text))
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def components(sets, num, den):
    """For each set the smallest position it hangs together with; every pair is looked at."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def contaminated(docs, items, window=10):
    """(words, hit words, items found) of each document."""
    grams = collections.defaultdict(set)
    for key, text in items:
        words = ALNUM.findall(lower(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            grams[tuple(words[i : i + n])].add(key)
    sizes = {len(g) for g in grams}
    out = []
    for text in docs:
        words, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                got = grams.get(tuple(words[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((len(words), len(hit), sorted(map(str, found))))
    return out


PERSONAL = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def personal(text):
    """(start, kind number, end) of all seeds."""
    out = []
    for k, (kind, pattern) in enumerate(PERSONAL.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


READS = re.compile("(s?(ua)+)?")


def damage(rows):
    """{conversation: [(turn, role, text)]} in order."""
    out = {}
    for conv, turn, role, text in rows:
        number = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(number.encode()) % 20
        turns = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        turns += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, t in out.items()}


def faults(turns):
    out, seen = [], set()
    for _, role, text in turns:
        said = SPACED.sub(lambda m: m.group(), text).rstrip(" \t\n\v\f\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repair(turns):
    """The result columns of a conversation; every script of edits with up to two insertions at a place is tried."""
    flaws = faults(turns)
    best = None
    ways = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in flaws]
    added = ["", "u", "a", "ua", "au"]
    for script in itertools.product(*ways):
        for more in itertools.product(added, repeat=len(turns) + 1):
            said, letters, cost = [], "", 0
            for i, extra in enumerate(more):
                for x in extra:
                    said.append(({"u": "user", "a": "assistant"}[x], ""))
                    letters, cost = letters + "I", cost + 2
                if i < len(turns):
                    edit, (_, role, text) = script[i], turns[i]
                    letters += edit[0]
                    cost += {"D": 3, "K": 0, "R": 2}[edit[0]] + (edit != "D" and flaws[i] == "truncated")
                    if edit != "D":
                        said.append((role if edit == "K" else {"u": "user", "a": "assistant"}[edit[1]], text))
            if READS.fullmatch("".join(r[:1] or "-" for r, _ in said)) and (best is None or (cost, letters) < best[:2]):
                best = (cost, letters, "\n".join(f"{r}:{t}" for r, t in said))
    numbers = [t for t, _, _ in turns if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    counts = [flaws.count(f) for f in ("blank", "duplicate", "truncated")]
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *counts, illegal, best[0], best[1], sha(best[2].encode()))


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(docs):
    """{word: (n, near, form, form's n, root)}"""
    counts = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            i = h % len(run)
            counts[run[:i] + run[i + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= 2 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out
