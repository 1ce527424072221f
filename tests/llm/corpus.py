"""Small corpora with what real ones hold: copies, near copies, shared passages, odd texts."""

import random


def words(rng, n, size=400):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(size)}" for _ in range(n)]


def documents(seed=1, plain=40, copies=12, near=30):
    """(doc_id, text, lang, source, n_chars) rows in no order of ids."""
    rng = random.Random(seed)
    passage, base = words(rng, 90), words(rng, 130)
    texts = [None, "", "   \n\t", "one", "two words", "a b c d e", "x" * 1000, "x" * 401, "x" * 400, "é" * 300, "tab\tnew\nline  double " * 40, "é ﬁ 日本 🎈 " * 30, "!!! 123"]
    for _ in range(plain):
        texts.append(" ".join(words(rng, rng.randrange(1, 200))))
    for k in range(8):  # a passage that several share, between other words
        texts.append(" ".join(words(rng, rng.randrange(5, 60)) + passage + words(rng, rng.randrange(5, 60))) + "é" * (k % 3))
    texts += [" ".join(base)] * copies + [" ".join(base).upper()]
    for _ in range(near):
        changed = list(base)
        for _ in range(rng.randrange(1, 5)):
            changed[rng.randrange(len(changed))] = rng.choice(words(rng, 3))
        texts.append(" ".join(changed))
    texts += [" ".join(words(rng, 20000))]
    rows = [(7 * k % 1009, t, rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "books", "code", None]), None if t is None else len(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
