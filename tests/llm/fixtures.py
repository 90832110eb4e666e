"""Small hostile tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

HOSTILE = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (4, "one"), (None, "nobody owns this text"), (5, "Ünïcode ñandú K İ 漢字 🙂 don't"), (6, "x" * 5000)]


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def copies(seed: int, groups: int = 25, vocabulary: int = 300):
    """(doc_id, text): groups of near copies of many lengths, in shuffled order, lines of about ten words."""
    rnd = random.Random(seed)
    words = ["".join("abcdefghij"[int(c)] for c in f"{i:03d}") for i in range(vocabulary)]
    docs = []
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 6, 15, 40, 120, 260]))]
        for _ in range(rnd.choice([1, 2, 5])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                k = rnd.randrange(len(w))
                if rnd.random() < 0.6:
                    w[k] = rnd.choice(words)
                else:
                    w.insert(k, rnd.choice(words))
            docs.append((len(docs), "".join(x + ("\n" if i % 10 == 9 else " ") for i, x in enumerate(w))))
    rnd.shuffle(docs)
    return docs


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
