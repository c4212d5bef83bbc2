"""Plain-Python versions of the operators, for small tables."""

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def remove_repeats(rows, k=13):
    least, out = {}, []
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - k + 1) if d is not None else ():
            key = tuple(w[i:i + k])
            least[key] = min(least.get(key, d), d)
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1) if d is not None else ():
            if least[tuple(w[i:i + k])] < d:
                gone[i:i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def link_documents(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for members in where.values():
        for n, i in enumerate(members):
            for j in members[n + 1:]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def token_rows(rows, tokenizer, end_id=1):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def edit_distance_inside(item, text):
    """Least edit distance of ``item`` to a substring of ``text``."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def viterbi(score, switch):
    """Best path of one text, by the plain recurrence."""
    n, m = score.shape
    best, back = score[0].astype(float), []
    for t in range(1, n):
        top = int(best.argmax())
        come = [lang if best[lang] >= best[top] - switch else top for lang in range(m)]
        best = np.array([max(best[lang], best[top] - switch) + score[t, lang] for lang in range(m)])
        back.append(come)
    path = [int(best.argmax())]
    for come in reversed(back):
        path.append(come[path[-1]])
    return path[::-1]
