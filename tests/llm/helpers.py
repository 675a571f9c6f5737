"""Small corpora and brute-force versions that the corpus operators are held against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """(doc_id, text): random texts with shared passages, near and exact copies, blanks, nulls and one long document."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    line = lambda k: [rng.choice(words) for _ in range(k)]
    shared = [line(70) for _ in range(3)]
    docs = []
    for i in range(n):
        body = line(rng.randint(5, 150))
        if i % 4 == 1:
            body[3:3] = rng.choice(shared)[: rng.randint(25, 70)]
        if i % 9 == 2:
            body += body[:60]
        docs.append((i * 3, " ".join(body)))
    docs += [(500 + i, docs[4][1]) for i in range(5)]  # copies
    docs += [(600 + i, " ".join([*docs[7][1].split(), *line(i % 3)])) for i in range(6)]  # near copies
    docs += [(700, None), (701, ""), (702, " \n\t "), (703, "one"), (704, " ".join(line(3000) + shared[0])), (705, "\x1c ünï\tcode\u00a0x " * 9)]
    docs += [(None, docs[9][1]), (703, "one"), (706, "aaaa " * 90), (707, "b" * 900)]
    rng.shuffle(docs)
    return docs


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def order(doc_id):
    return (doc_id is not None, doc_id or 0)


def repeated_bytes(docs, length):
    """Per row: (n_bytes, removed ranges, kept bytes) with every string of `length` bytes judged on its own."""
    seen = {}
    for r, (_, text) in enumerate(docs):
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            seen.setdefault(data[p : p + length], []).append((r, p))
    out = []
    for _, text in docs:
        data = (text or "").encode()
        mask = [False] * len(data)
        for p in range(len(data) - length + 1):
            if len(seen[data[p : p + length]]) > 1:
                mask[p : p + length] = [True] * length
        edges = [i for i in range(len(mask) + 1) if (i < len(mask) and mask[i]) != (i > 0 and mask[i - 1])]
        out.append((len(data), list(zip(edges[::2], edges[1::2])), bytes(b for b, m in zip(data, mask) if not m)))
    return out


def later_windows(docs, length):
    """{(id, text): (n_words, n_removed, kept)}; rows of one id and text are one document."""
    out, seen = {}, set()
    for doc_id, text in sorted(set(docs), key=lambda d: order(d[0])):
        own = words(text)
        mask = [False] * len(own)
        for p in range(len(own) - length + 1):
            window = tuple(own[p : p + length])
            if window in seen:
                mask[p : p + length] = [True] * length
            seen.add(window)
        out[doc_id, text] = (len(own), sum(mask), " ".join(w for w, m in zip(own, mask) if not m))
    return out


def shingles(text, k=5):
    own = words(text)
    return {tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def jaccard_classes(docs, threshold=0.8):
    """Per row (class id, other texts linked), by all pairs of distinct texts."""
    texts = {}
    for doc_id, text in docs:
        if words(text):
            texts.setdefault(text, []).append(doc_id)
    sets = {t: shingles(t) for t in texts}
    links = {t: [u for u in texts if u != t and len(sets[t] & sets[u]) >= threshold * len(sets[t] | sets[u])] for t in texts}
    out = []
    for doc_id, text in docs:
        if text not in texts:
            out.append((doc_id, 0))
            continue
        group, open_ = {text}, [text]
        while open_:
            new = [u for u in links[open_.pop()] if u not in group]
            group.update(new)
            open_ += new
        ids = [i for t in group for i in texts[t] if i is not None]
        out.append((min(ids) if ids else None, len(links[text])))
    return out


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text):
    return BENCH_WORD.findall((text or "").translate(LOW))


def hits(text, items, length=10):
    """(n_words, hit places, item ids as sorted text)."""
    own, places, found = bench_words(text), set(), set()
    for item, body in items:
        wanted = bench_words(body)
        for i in range(max(1, len(wanted) - length + 1)) if wanted else ():
            window = wanted[i : i + length]
            for p in range(len(own) - len(window) + 1):
                if own[p : p + len(window)] == window:
                    places.update(range(p, p + len(window)))
                    found.add(str(item))
    return len(own), sorted(places), sorted(found)
