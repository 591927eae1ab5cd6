"""Small tables with every awkward row, and brute-force versions of the operators."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = ["n_words", "n_removed", "kept", "spans", "item_ids", "simhash", "component", "score", "lang_pred", "ids", "decoded", "predicted", "n_lines", "shard", "slot", "size", "__spans", "__ord"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def documents(seed=1, n=60):
    """(doc_id, text, lang, source): copies, near copies, shared passages and lines, and awkward rows."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéüñ") for _ in range(rnd.randint(1, 6))) for _ in range(400)] + ["The", "the", "a!", "x\x00y", "日本", "I'm"]
    line = lambda: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 24)))
    passage = " ".join(rnd.choice(vocab) for _ in range(45))
    common = " ".join(rnd.choice(vocab) for _ in range(9))
    texts = ["\n".join(line() for _ in range(rnd.randint(1, 8))) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] = rnd.choice(texts)
    for i in range(1, n, 7):
        words = rnd.choice(texts).split(" ")
        words[rnd.randrange(len(words))] = rnd.choice(vocab)
        texts[i] = " ".join(words)
    for i in range(2, n, 6):
        texts[i] += "\n" + passage + "\t " + line()
    for i in range(3, n, 4):
        texts[i] = common + "\n" + texts[i]
    rows = [(i * 3, t, rnd.choice(["en", "fr"]), f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(1000, None, "en", "s"), (1001, "", None, None), (1002, " \t\n ", "fr", "s"), (1003, "12 .. 3", None, "s"), (None, texts[4], "en", "s")]
    rows += [rows[2], rows[2], (1004, "la " * 3000 + texts[8], "fr", "s"), (1005, "\n" * 50 + common, "en", "s")]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows, extra=()):
    """The rows as a table, with extra columns that have the operators' own names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in extra}).repartition(3)


def order(key):
    return (1, 0) if key is None else (0, key)


def substrings(rows, window=20):
    """Counter of (doc_id, n_words, n_removed, kept)."""
    first, docs = {}, [(k, WORD.findall(t or "")) for k, t, *_ in rows]
    for k, w in docs:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, ((2, 0), 0)), (order(k), i))
    out = Counter()
    for k, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (order(k), i):
                gone.update(range(i, i + window))
        out[k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def line_dedup(rows, least=1):
    lines = [(order(k), i, frozenset(WORD.findall(x))) for k, t, *_ in rows if t is not None for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    out = Counter()
    for k, t, *_ in rows:
        parts = t.split("\n") if t is not None else []
        gone = set()
        for i, x in enumerate(parts):
            mine = frozenset(WORD.findall(x))
            if len(mine) >= least and any((ok, j) < (order(k), i) and 5 * len(mine & s) >= 4 * len(mine | s) for ok, j, s in lines):
                gone.add(i)
        out[k, len(parts), len(gone), "\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else t] += 1
    return out


def decontaminate(rows, items, window=10):
    phrases = defaultdict(set)
    for name, t in items:
        w = ITEM_WORD.findall(lower(t or ""))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[i : i + window])].add(name)
    out = Counter()
    for k, t, *_ in rows:
        w, hit, names = ITEM_WORD.findall(lower(t or "")), set(), set()
        for p, who in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    names |= {str(x) for x in who if x is not None}
        out[k, len(w), len(hit), tuple(sorted(names))] += 1
    return out


def fingerprint(text, shingle=4):
    w = lower(text or "").encode().split()
    parts = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, budget=4, shingle=4):
    prints = [(k, fingerprint(t, shingle)) for k, t, *_ in rows]
    root = list(range(len(prints)))
    again = True
    while again:
        again = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i][1] ^ prints[j][1]).bit_count() <= budget and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    again = True
    least = defaultdict(list)
    for (k, _), r in zip(prints, root):
        least[r].append(k)
    best = {r: min((x for x in ks if x is not None), default=None) for r, ks in least.items()}
    return Counter((k, f, best[r]) for (k, f), r in zip(prints, root))


def backoff(rows, min_count=2):
    docs = [(k, WORD.findall(lower(t or ""))) for k, t, *_ in rows]
    count = Counter(tuple(w[i - n : i]) for _, w in docs for n in (1, 2, 3) for i in range(n, len(w) + 1))
    total = sum(len(w) for _, w in docs)
    out = []
    for k, w in docs:
        s = 0.0
        for i in range(len(w)):
            for n in range(min(3, i + 1), 0, -1):
                gram = tuple(w[i + 1 - n : i + 1])
                if n == 1:
                    s += math.log(count[gram] / total)
                elif count[gram] >= min_count:
                    s += math.log(count[gram] / count[gram[:-1]])
                    break
                else:
                    s += math.log(0.4)
        out.append((k, len(w), s))
    return out


def sha(raw):
    return hashlib.sha256(raw).hexdigest()
