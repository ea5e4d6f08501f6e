"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, size: int) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_duplicates(texts: list[str | None], size: int, percent: int) -> list[int]:
    """Smallest position reachable, from a comparison of all pairs."""
    sets = [shingles(t, size) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    links.append((i, j))
    return components(len(texts), links)


def one_word_apart(a: list[str], b: list[str]) -> bool:
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def units_of(line: str, least: int) -> list[tuple[str, str]]:
    """Words, or code points where there are too few words."""
    words = line.split(" ")
    return [("word", w) for w in words] if len(words) >= least else [("point", c) for c in line]


def without_repeated_lines(texts: list[str], min_chars: int = 20, min_units: int = 5) -> list[str]:
    """Texts in order, each line compared with every earlier distinct one."""
    first: dict[str, tuple[int, int]] = {}
    for i, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            if len(line) >= min_chars:
                first.setdefault(line, (i, k))
    split = [(at, line, units_of(line, min_units)) for line, at in first.items()]
    near = {
        line for at, line, words in split if len(words) >= min_units
        and any(other < at and len(w) >= min_units and abs(len(w) - len(words)) <= 1 and one_word_apart(w, words)
                for other, _, w in split)
    }
    return [
        "\n".join(line for k, line in enumerate(text.split("\n"))
                  if len(line) < min_chars or (line not in near and first[line] == (i, k)))
        for i, text in enumerate(texts)
    ]


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    words = words_of(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if words_of(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def chat_digest(turns: list[tuple[str, str]]) -> tuple[int, str, int, str]:
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def water_fill(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Shares of (capacity, weight) children: nobody above capacity, the rest by weight."""
    given = [0.0] * len(children)
    open_ones = set(range(len(children)))
    left = min(budget, sum(c for c, _ in children))
    while open_ones and left > 1e-9:
        weight = sum(children[i][1] for i in open_ones)
        full = [i for i in open_ones if children[i][0] - given[i] <= left * children[i][1] / weight + 1e-12]
        if not full:
            for i in open_ones:
                given[i] += left * children[i][1] / weight
            break
        for i in full:
            left -= children[i][0] - given[i]
            given[i] = children[i][0]
            open_ones.discard(i)
    return given


def mixture(docs, fraction: float, epochs: int, seed: int, domain_weights: dict, lang_weights: dict) -> set:
    """(doc_id, epoch) of every text taken; ``docs`` has doc_id, lang, source and size."""
    leaves: dict = defaultdict(list)
    for doc, lang, source, size in docs:
        tail = re.search(r"([0-9]{1,9})$", source or "")
        leaves[("web", "web", "books", "code")[int(tail[1]) % 4 if tail else 0], lang, source].append((doc, size))
    given = {(): fraction * sum(size for *_, size in docs) // 1}
    for depth in (1, 2, 3):
        for parent in list(given):
            if len(parent) == depth - 1:
                children = sorted({leaf[:depth] for leaf in leaves if leaf[:depth - 1] == parent}, key=str)
                weights = ({}, domain_weights, lang_weights, {})[depth]
                held = [epochs * sum(size for leaf, texts in leaves.items() if leaf[:depth] == c for _, size in texts) for c in children]
                given |= zip(children, water_fill(given[parent], [(h, weights.get(c[-1], 1.0)) for h, c in zip(held, children)]))
    taken = set()
    for leaf, texts in leaves.items():
        budget, whole = int(given[leaf] + 1e-6), sum(size for _, size in texts)
        passes = budget // whole
        rest = budget - passes * whole
        taken |= {(doc, e) for doc, _ in texts for e in range(passes)}
        for doc, size in sorted(texts, key=lambda t: (hashlib.md5(f"{seed}:{passes}:{t[0]}".encode()).hexdigest(), t)):
            rest -= size
            if rest < 0:
                break
            taken.add((doc, passes))
    return taken


def by_key(rows, key: str) -> dict:
    out = defaultdict(list)
    for row in rows:
        out[row[key]].append(row)
    return out


_MASK = (1 << 64) - 1


def _scrambled(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def closed_syncmers(text: str, s: int = 8, k: int = 23) -> list[tuple[int, int]]:
    """(place, hash) of each run of ``k`` whose smallest inner run of ``s`` is its first or last, run by run."""
    a, b = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53

    def paired(value: int, other: int) -> int:
        both = value * a + other * b & _MASK
        return both ^ both >> 29

    def inner(run: str) -> int:
        values = [_scrambled(ord(c) + a & _MASK) for c in run]
        while len(values) > 1:
            half = len(values) // 2
            values = [paired(values[2 * i], values[2 * i + 1]) for i in range(half)]
        return _scrambled(values[0])

    found = []
    values = [inner(text[i:i + s]) for i in range(len(text) - s + 1)]
    for at in range(len(text) - k + 1):
        parts = values[at:at + k - s + 1]
        if min(parts) in (parts[0], parts[-1]):
            mixed = parts[0] * a + _scrambled(parts[s] + b & _MASK) + parts[-1] * b & _MASK
            found.append((at, _scrambled(mixed) >> 32))
    if text and not found:
        found = [(0, int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big"))]
    return found


def kept_anchors(anchors: list[tuple[int, int]], keep: int = 64, sparsest: int = 3) -> tuple[int, list[tuple[int, int]]]:
    """Level and anchors below it, each hash at its first place."""
    first: dict[int, int] = {}
    for place, value in anchors:
        first.setdefault(value, place)
    level = 0
    while level < sparsest and sum(v < 1 << 32 - level for v in first) > keep:
        level += 1
    return level, [(p, v) for v, p in first.items() if v < 1 << 32 - level]


def anchor_likeness(a: tuple[int, list], b: tuple[int, list]) -> float:
    """Longest common subsequence of the anchors at the stricter level, over all of both."""
    if not a[1] and not b[1]:
        return 1.0
    level = max(a[0], b[0])
    left, right = ([v for _, v in x[1] if v < 1 << 32 - level] for x in (a, b))
    row = [0] * (len(right) + 1)
    for x in left:
        new = [0]
        for j, y in enumerate(right):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    both = len(left) + len(right) - row[-1]
    return row[-1] / both if both else 0.0
