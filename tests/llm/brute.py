"""Plain Python versions of the operators, for small inputs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter


def words(text):
    return [w.lower() for w in (text or "").encode().split()]


def shingle_sets(docs, width=5):
    out = []
    for _, text in docs:
        w = words(text)
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def jaccard_components(docs, percent=80):
    """(n_shingles, component) of each row."""
    sets = shingle_sets(docs)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        r = find(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(len(sets[i]), least.get(find(i)) if sets[i] else docs[i][0]) for i in range(len(docs))]


def repeated(docs, length):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each row."""
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


SECRETS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]


def secret_spans(text):
    found = []
    for place, (kind, pattern, group, least) in enumerate(SECRETS):
        for m in re.finditer(pattern, text or "", re.I | re.A if kind == "assign" else 0):
            if len(m.group(group)) >= least:
                found.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def license_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    found = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def add_one_scores(docs):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    counts = Counter()
    for h, (_, t) in zip(held, docs):
        if not h:
            counts.update([*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for h, (_, t) in zip(held, docs):
        tokens = [*words(t), None]
        out.append((h, len(tokens), sum(counts[w] > 0 for w in tokens), total, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)))
    return out


def greedy_tokens(text, pieces, longest):
    total = 0
    for w in (text or "").encode().split():
        data, at = b" " + w, 0
        while at < len(data):
            end = min(len(data), at + longest)
            while data[at:end] not in pieces:
                end -= 1
            at, total = end, total + 1
    return total


def vocabulary(path):
    with open(path, "rb") as lines:
        return {base64.b64decode(x.split()[0]) for x in lines}


def mixed(rows, weights=(1, 2, 3), epochs=3):
    """target of each source of rows (source, size)."""
    sizes = Counter()
    for source, size in rows:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    clamped = set()
    while True:
        free = [s for s in order if s not in clamped]
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in clamped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in clamped else weight[s] * level for s in order}, sizes
        clamped |= over
