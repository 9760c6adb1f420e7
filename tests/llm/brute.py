"""Plain one-text-at-a-time statements of the operators' rules, for comparison."""

import hashlib
import re
from collections import Counter

import xxhash

ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def overlap(text, items, window=10):
    """(n_words, n_hit, n_items, items_sha256, longest match) of a text against {item_id: text}."""
    words = BENCH_WORD.findall(lower_ascii(text or ""))
    hit, found, longest = set(), set(), 0
    for item_id, item in items:
        w = BENCH_WORD.findall(lower_ascii(item or ""))
        if not w:
            continue
        size = min(window, len(w))
        for j in range(len(w) - size + 1):
            for p in range(len(words) - size + 1):
                if words[p:p + size] == w[j:j + size]:
                    hit |= set(range(p, p + size))
                    found.add(item_id)
                    k = size
                    while j + k < len(w) and p + k < len(words) and w[j + k] == words[p + k]:
                        k += 1
                    longest = max(longest, k)
    return len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), longest


def fingerprint(text, size=3):
    words = ASCII_WORD.findall(lower_ascii(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, max_bits=2):
    """{index: smallest index reachable} by comparing every pair."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= max_bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def base_rules(text):
    text = text or ""
    words = ASCII_WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if ASCII_WORD.search(x)]
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    """[(start, kind number, end)] of the base kinds, by start, then kind."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6 and m[1].isascii()]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)
