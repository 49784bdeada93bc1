"""Slow, plain versions of the operators, written from their definitions alone."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

SPACES = " \t\n\x0b\x0c\r"
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(w)
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def simhash(text):
    w = words(ascii_lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_roots(prints):
    """fingerprint -> smallest member of its component, links being at most 2 differing bits."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {p: top(p) for p in prints}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def overlap(text, items):
    """hit flags of the words, and the items that occur"""
    w, hit, found = bench_words(text), set(), set()
    for item, body in items:
        b = bench_words(body)
        n = min(13, len(b))
        for i in range(len(b) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return [i in hit for i in range(len(w))], found


def secrets(text):
    """Base spans by plain scans of the whole text."""
    text, out = text or "", []
    out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def mix(rows, weights=(5, 2, 1), most=3, seed=11):
    """(doc_id, source, size) -> list of (doc_id, size, source_size, target, copies)"""
    size = Counter()
    for _, source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(size.values()) - most * sum(size[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and most * size[s] * share < weight[s] * left}
        if not more:
            break
        full |= more
    target = {s: float(most * size[s]) if s in full else weight[s] * left / share for s in order}
    out = []
    for doc_id, source, n in rows:
        rate = target[source] / size[source] if size[source] else 0.0
        draw = int(hashlib.md5(f"{'null' if doc_id is None else doc_id}|{seed}".encode()).hexdigest()[:13], 16)
        out.append((doc_id, n, size[source], target[source], int(rate) + (draw < (rate - int(rate)) * 2**52)))
    return out


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(docs, least=5, factor=5):
    """(doc_id, text) -> sorted (word, form, root, n, n_near, form_n)"""
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", ascii_lower(text)):
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def cheapest(rows):
    """(cost, audit) over all edit sequences, state by state: rows are (role initial, fault 0 to 3)."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    to = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(at):
        for _ in range(3):
            for s, (cost, audit) in list(at.items()):
                at[to[s]] = min(at.get(to[s], (1 << 60, "")), (cost + 5, audit + "I"))
        return at

    at = inserted({0: (0, "")})
    for initial, fault in rows:
        after = {}
        for s, (cost, audit) in at.items():
            options = [(s, 2, "D")]
            if fault not in (1, 2):
                more = 5 * (fault == 3)
                options += [(to[s], 1 + more, "R")] + [(end, more, "K") for role, end in step[s].items() if role == initial]
            for end, price, edit in options:
                after[end] = min(after.get(end, (1 << 60, "")), (cost + price, audit + edit))
        at = inserted(after)
    return min(at[s] for s in (0, 3) if s in at)


def conversation(rows):
    """(turn, role, text) after the damage -> gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    faults = []
    for i, (_, role, text) in enumerate(rows):
        body = re.sub("[ \t-\r]", "", text)
        earlier = any(r[1:] == (role, text) for r in rows[:i])
        faults.append(1 if not body else 2 if earlier else 3 if body[-1] not in ".!?" else 0)
    cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
    lines, left = [], iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(left)[1:]
        if edit in "IR":
            role = "assistant" if lines and lines[-1][0] == "u" else "user"
        if edit != "D":
            lines.append(f"{role}:{text}")
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    """(conv_id, turn, role, text) -> conv_id: rows (turn, role, text) after the damage"""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def jaccard(docs):
    """(doc_id, text) -> sorted (doc_id, n_shingles, component_id)"""
    sets = []
    for _, text in docs:
        w = words(ascii_lower(text))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((doc, len(s), least.get(top(i))) for i, ((doc, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def clause_totals(text, weights):
    """Totals of the clauses that hold an insult (word -> weight) or a threat, by explicit states."""
    from swaymeter.llm import toxicity as t

    totals = []
    for line in (text or "").lower().split("\n"):
        quoted = False
        for clause in re.split("[.!?;]+", line):
            total, negated, reported, target, future, heaped = 0.0, 0, quoted, False, False, False
            for token in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]", clause):
                speech = 0.5 if reported else 1.0
                factor = speech * (0.3 if negated else 1.0) * (1.5 if target else 1.0)
                insult = weights.get(token, 0.0)
                if insult:
                    total += insult * factor * (1.25 if heaped else 1.0)
                elif token in t.THREATS and (future or target):
                    total += 4.0 * factor
                if not insult and token in t.NEGATIONS:
                    negated = 3
                elif negated:
                    negated -= 1
                heaped = bool(insult)
                if not insult and token in t.TARGETS:
                    target = future = True
                elif not insult and token in t.FUTURES:
                    future = True
                elif not insult and token in t.REPORTS:
                    reported = True
                elif quoted and token in '"”»':
                    reported = quoted = False
                elif reported and not quoted and token in '"“«':
                    quoted = True
            if total > 0:
                totals.append(total)
    return totals


def language_grams(text, orders, step, mix, features):
    """Counts of hashed runs of 1 to 3 characters that hold a letter; other characters are blanks, one is added at both ends."""
    low = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    out = Counter()
    for n in orders if text else ():
        for i in range(len(low) - n + 1):
            run = low[i : i + n]
            if run.strip(" "):
                h = 0
                for c in run:
                    h = (h * step + ord(c)) % 2**32
                out[(h * mix % 2**32) >> (32 - features.bit_length() + 1)] += 1
    return out


def gaussian_scores(train, rows, pooled, diagonal, floor, temperature):
    """Scores of `rows` from log-densities of two shrunken Gaussians fitted on (label, x), by determinants and solves."""
    import numpy as np

    by_class = {c: np.array([x for y, x in train if y == c]) for c in (0, 1)}
    n = sum(map(len, by_class.values()))
    cov = {c: np.cov(x, rowvar=False, bias=True) for c, x in by_class.items()}
    common = sum(len(by_class[c]) * cov[c] for c in (0, 1)) / n
    density = {}
    for c, x in by_class.items():
        own = (1 - diagonal) * ((1 - pooled) * cov[c] + pooled * common) + diagonal * np.diag(np.diag(common)) + floor * np.eye(len(common))
        away = np.array(rows) - x.mean(axis=0)
        density[c] = np.log(len(x) / n) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("ij,ij->i", away, np.linalg.solve(own, away.T).T)
    return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / temperature, -60, 60)))
