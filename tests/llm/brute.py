"""Plain Python versions of the operators, for small inputs."""

import hashlib
from collections import Counter, defaultdict

SPACE = b" \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def passages(docs, window):
    """op1: (n_words, n_removed, digest of the words left) for each text."""
    split = [words(t) for t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def repeated_bytes(docs, window):
    """op10: (n_bytes, n_removed, n_spans, digest of the bytes left) for each (doc_id, text)."""
    last = float("inf")
    least = defaultdict(lambda: last)
    data = [(last if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for at in range(len(b) - window + 1):
            piece = b[at : at + window]
            least[piece] = min(least[piece], i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for at in range(len(b) - window + 1):
            if least[b[at : at + window]] < i:
                gone[at : at + window] = b"\x01" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(text, size):
    w = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near(docs, size, percent=80):
    """op7: (n_shingles, component) for each (doc_id, text), ids present."""
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = min(d, least.get(r, d))
    return [(len(sets[i]), least[root(i)]) for i in range(len(docs))]
