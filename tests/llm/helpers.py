"""Small fixtures and brute-force versions."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score double, rest string"


def rows(texts, ids=None):
    return [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or ""), -i, "k", 0.5, "r") for i, t in enumerate(texts)]


def documents(spark, texts, ids=None):
    """Documents with further columns, whose names operators use themselves."""
    return spark.createDataFrame(rows(texts, ids), SCHEMA)


def corpus(n=60, seed=3, long=3000):
    """Texts with copies, near copies, shared passages, periodic parts, nulls, empty and long ones."""
    r = random.Random(seed)
    vocabulary = [f"w{r.randrange(400)}{c}" for c in "abcé"] + [f"wort{i}" for i in range(300)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, texts = say(70), []
    for i in range(n):
        t = say(r.choice([3, 30, 80, 150]))
        if i % 5 == 0:
            t = t + " " + passage + " " + say(20)
        if i % 7 == 0 and texts:
            t = texts[r.randrange(len(texts))]
        if i % 11 == 0 and texts:
            t = (texts[-1] or "").replace("wort1", "Wort1")
        texts.append(t)
    return [*texts, None, "", "   ", "a", "x" * long, "ab" * 400, "Ai. " * 200, passage, passage, say(long)]


def removed_bytes(items, length=100):
    seen, out = set(), []
    for i, t in items:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def removed_words(items, width=50):
    first, out = {}, []
    for i, t in items:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        for p in range(len(w) - width + 1):
            k = b" ".join(w[p : p + width])
            first[k] = min(first.get(k, i), i)
    for i, t in items:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = [0] * len(w)
        for p in range(len(w) - width + 1):
            if first[b" ".join(w[p : p + width])] < i:
                gone[p : p + width] = [1] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def linked_components(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]
