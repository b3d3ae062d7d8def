"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def shingle_set(text, n):
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def components(rows, n, percent):
    """{doc_id: (size of the set, component)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y >= x or not sets[x] or not sets[y]:
                continue
            common = len(sets[x] & sets[y])
            if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def rule_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, t in enumerate(windows) if n[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
    }


def quality(rows, rate=0.5):
    """{doc_id: (counts, base_failed, host_failed)} of (doc_id, text, host) rows."""
    out, hosts = {}, defaultdict(list)
    for i, text, host in rows:
        c = rule_counts(text)
        base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        more = 10 * c["n_symbols"] > c["n_words"] or 100 * c["n_dup_lines"] > 30 * c["n_lines"]
        out[i] = (c, base, host)
        hosts[host].append(base or more)
    total = sum(map(len, hosts.values()))
    mean = sum(map(sum, hosts.values())) / total
    squares = sum(sum(v) ** 2 / len(v) for v in hosts.values()) / total
    between = squares - mean**2 - mean * (1 - mean) * len(hosts) / total
    k = min(1e6, max(0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6
    failed = {h: (sum(v) + mean * k) / (len(v) + k) > rate for h, v in hosts.items()}
    return {i: (c, base, failed[h]) for i, (c, base, h) in out.items()}


def without_lines(rows, ratio=0.1, least=3):
    """{doc_id: text} of (doc_id, text, host) rows; equal texts of a host count once."""
    docs, counts = Counter(), Counter()
    bare = lambda line: line.strip(" \t\n\x0b\f\r")
    for text, host in {(t, h) for _, t, h in rows}:
        docs[host] += 1
        for line in {bare(x) for x in (text or "").split("\n")} - {""}:
            counts[host, line] += 1
    bad = {x for x, n in counts.items() if n >= least and n > ratio * docs[x[0]]}
    return {
        i: None
        if t is None
        else "\n".join(x for x in t.split("\n") if (h, bare(x)) not in bad)
        for i, t, h in rows
    }


def repeats(texts, length):
    """For each text: bytes, bytes removed, runs removed, digest of the rest."""
    texts = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def item_words(text):
    return re.findall(r"[^\s!-/:-@\[-`{-~]+", (text or "").lower())


def best_overlap(equal):
    """Equal words and length of the stretch with the most points; ties: first end, last start."""
    best, found = (0, -len(equal), 0), (0, 0)
    for i in range(len(equal)):
        points = same = 0
        for j in range(i, len(equal)):
            points += 1 if equal[j] else -2
            same += equal[j]
            if points > 0 and (points, -j, i) > best:
                best, found = (points, -j, i), (same, j - i + 1)
    return found


def holds(document, item, least=12, share=0.8):
    """Whether some alignment of all words has a stretch that is alike enough."""
    d, w = item_words(document), item_words(item)
    if len(w) < 8:
        return False
    for shift in range(-len(w) + 1, len(d)):
        low, high = max(0, -shift), min(len(w), len(d) - shift)
        equal = [d[k + shift] == w[k] for k in range(low, high)]
        if sum(equal) < min(least, len(w)):
            continue
        same, length = best_overlap(equal)
        if same >= min(least, len(w)) and same >= share * length:
            return True
    return False
