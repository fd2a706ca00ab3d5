"""Each stage of the pipeline on its own input against a plain version."""

import re
from collections import Counter

from creditflow.llm import toxicity

SF = "/root/testdata/sf0.001"


def words_of(text):
    return text.encode().split()  # at 0x20 and 0x09-0x0D


def folded(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))


def without_repeats(rows):
    lines = [(i, k, frozenset(words_of(x))) for i, t in rows for k, x in enumerate(t.split("\n"))]
    by_word = {}
    for n, (_, _, words) in enumerate(lines):
        for w in words:
            by_word.setdefault(w, []).append(n)
    out, n = {}, 0
    for i, t in rows:
        kept = []
        for k, x in enumerate(t.split("\n")):
            a, n = lines[n][2], n + 1
            common = Counter(m for w in a for m in by_word[w] if lines[m][:2] < (i, k))
            if not any(c >= 0.8 * (len(a) + len(lines[m][2]) - c) - 1e-9 for m, c in common.items()):
                kept.append(x)
        out[i] = "\n".join(kept)
    return out


def first_of_classes(rows):
    bags = {}
    for i, t in rows:
        w = words_of(t)
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sum(bags[a].values()), sum(bags[b].values())
            if x and y and min(x, y) >= 0.8 * max(x, y) - 1e-9:
                both = sum((bags[a] & bags[b]).values())
                if both >= 0.8 * (x + y - both) - 1e-9:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i for i in ids if root(i) == i}


def leaked(text, items):
    words = folded(text)
    held = Counter(words)
    for item in items:
        allowed = int(0.2 * len(item) + 1e-9)
        if len(item) < 5 or sum(min(n, held[w]) for w, n in Counter(item).items()) < len(item) - allowed:
            continue
        row = [0] * (len(words) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(words):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        if min(row) <= allowed:
            return True
    return False


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(p.STAGES)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}

    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out("doc_id", 3, 1))
    kept = stages["toxicity"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.7}

    lines = {r.doc_id: r.text or "" for r in stages["line_dedup"](spark, docs, SF).collect()}
    assert lines == without_repeats(sorted(rows.items()))

    assert {r.doc_id for r in stages["near_dedup"](spark, docs, SF).collect()} == first_of_classes(sorted(rows.items()))

    items = [folded(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    assert {r.doc_id for r in stages["decontamination"](spark, docs, SF).collect()} == {i for i, t in rows.items() if not leaked(t, items)}
