"""Plain Python twins of the operations, for small tables."""

import re

import regex

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    if 0 < len(w) < size:
        return {tuple(w)}
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def near_duplicates(docs):
    """doc_id -> (set size, component) for {doc_id: text}, by comparing what shares a shingle."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}
    having = {}
    for d in sorted(docs):
        seen = set()
        for s in sets[d]:
            for e in having.setdefault(s, []):
                seen.add(e)
            having[s].append(d)
        for e in seen:
            common = len(sets[d] & sets[e])
            if 100 * common >= 75 * (len(sets[d]) + len(sets[e]) - common):
                a, b = sorted((find(parent, d), find(parent, e)))
                parent[b] = a
    return {d: (len(sets[d]), find(parent, d)) for d in docs}


SCRIPTS = regex.compile(
    r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
)


def line_words(line):
    """Words between white space; each character of a script without blanks is one."""
    return len(SPACE.findall(SCRIPTS.sub(" ", line))) + len(SCRIPTS.findall(line))


def repeated_lines(docs, least):
    """doc_id -> numbers of lines inside a run of ``least`` words that stands earlier too."""
    seqs = []
    for d in sorted(docs):
        lines = [(i, x) for i, x in enumerate((docs[d] or "").split("\n")) if line_words(x)]
        seqs.append((d, [i for i, _ in lines], [x for _, x in lines]))
    gone = {d: set() for d in docs}
    for k, (d, at, mine) in enumerate(seqs):
        for i in range(len(mine)):
            longest = 0
            for j, (_, _, other) in enumerate(seqs[: k + 1]):
                for p in range(len(other) if j < k else i):
                    n = 0
                    while i + n < len(mine) and p + n < len(other) and mine[i + n] == other[p + n]:
                        n += 1
                    longest = max(longest, n)
            if sum(map(line_words, mine[i : i + longest])) >= least:
                gone[d] |= set(at[i : i + longest])
    return {d: sorted(x) for d, x in gone.items() if x}


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licence_words(text):
    return LICENCE_WORD.findall((text or "").translate(LOWER))


def phrases(text, table):
    """Number of words, and (start, label) of every place of a phrase, rising."""
    w = licence_words(text)
    found = []
    for phrase, label in table.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(found)
