"""Rule ensemble, token alignment and heap clusters against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditflow.llm import heap_clusters, rule_quality, token_alignment
from creditflow.llm.packing import public_tokenizer

A, B = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model")
ODD = [
    "", None, "▁x", "a▁ b", "x", " ", "  ", "   a  b\n\n c ", "tab\tand\x00nul", "日本語 テキスト。", "é è ü ß", "<s> hi </s> <|endoftext|> <0x41> <unk>", "emoji 😀😀 x", "a b   c",
    "don't 'll we're", "x\n\n\ny", "foo \n bar", "\nstart", "end\n", "a" * 5000, " ".join(f"w{i}" for i in range(5000)), "é x ́x", "﻿bom", "a　b", "ﬁ １２３", " line", "a\x85b c",
]


def aligned(texts):
    """The digest rows by walking both token lists of whole texts side by side."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    printable, value, n = [*range(33, 127), *range(161, 173), *range(174, 256)], {}, 0
    for b in range(256):
        value[chr(b if b in printable else 256 + n)] = b
        n += b not in printable
    docs, counts = [], Counter()
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        raw_a = [bytes(value[c] for c in t.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            docs.append(None)
            continue
        links, groups, side_a, side_b, i, j, end_a, end_b = [], [], [], [], 0, 0, len(raw_a[0]), len(raw_b[0])
        while True:
            links.append((a[i], b[j]))
            if end_a <= end_b:
                side_a.append(str(a[i]))
            if end_b <= end_a:
                side_b.append(str(b[j]))
            if end_a == end_b:
                groups.append(",".join(side_a) + "|" + ",".join(side_b))
                side_a, side_b, i, j = [], [], i + 1, j + 1
                if i == len(a):
                    break
                end_a, end_b = end_a + len(raw_a[i]), end_b + len(raw_b[j])
            elif end_a < end_b:
                i += 1
                end_a += len(raw_a[i])
            else:
                j += 1
                end_b += len(raw_b[j])
        docs.append((len(a), len(b), groups, links))
        counts.update(links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    digest = lambda d: (0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == best[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest())
    return list(map(digest, docs))


@pytest.mark.parametrize("frequent", [1_000_000, 60, 0])
def test_alignment_of_odd_texts(spark, frequent):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, row string").repartition(3)
    rows, counts = token_alignment.align(df, A, B, frequent)
    assert [tuple(r)[1:] for r in rows.orderBy("doc_id").collect()] == aligned(ODD)
    assert counts.agg(F.sum("n")).first()[0] == sum(d[3] for d in aligned(ODD))


def test_alignment_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, token_alignment.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted((i, *d) for (i, _), d in zip(docs, aligned([t for _, t in docs]), strict=True))


def test_alignment_of_repeated_rows_nulls_and_no_rows(spark, odd_docs, no_docs):
    rows = token_alignment.align(odd_docs, A, B)[0].collect()
    assert len(rows) == odd_docs.count() and len({r for r in rows if r.doc_id == 5}) == 1
    assert token_alignment.align(no_docs, A, B)[0].count() == 0


def test_units_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_UNITS", 20)
    draw = random.Random(5)
    words = ["the", "▁", "mañana", "x" * 70, "don't", "a▁", "1234", " ", "", "z\n", "¿qué?", *(f"w{i}" for i in range(60))]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 12))) for _ in range(300)]
    aligner, fresh = token_alignment.Aligner(A, B), token_alignment.Aligner(A, B)
    fresh.cuts = False  # whole texts
    got = [x for k in range(0, 300, 10) for x in aligner.encode(texts[k : k + 10])]
    assert all((p == q).all() and len(p) == len(q) for g, w in zip(got, fresh.encode(texts), strict=True) for p, q in zip(g, w, strict=True))
    assert any(not len(g[0]) for g in got) and any(len(g[0]) for g in got)


def lloyd(x, ids, k, rounds, salt="3"):
    order = sorted(range(len(x)), key=lambda i: hashlib.sha256(f"{salt}:{ids[i]}".encode()).hexdigest())[:k]
    centres = [x[i].tolist() for i in order]
    nearest = lambda v: min(range(len(centres)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centres[c], strict=True)), c))
    for _ in range(rounds):
        home = [nearest(v) for v in x.tolist()]
        for c in range(len(centres)):
            own = [v for v, h in zip(x.tolist(), home, strict=True) if h == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [nearest(v) for v in x.tolist()], centres


@pytest.mark.parametrize(("scale", "spread"), [(1, 40), (1, 1_000_000), (1024, 0.01)])
def test_clusters_against_plain_rounds(spark, scale, spread):
    draw = np.random.default_rng(7)
    heart = draw.normal(size=(6, 5)) * spread * 10
    v = heart[draw.integers(0, 6, 400)] + draw.normal(size=(400, 5)) * spread
    v[50:90] = v[3]  # equal vectors
    ids = list(range(400))
    df = spark.createDataFrame([(i, x.tolist(), i) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, cluster int").repartition(5)
    log = []
    rows, centres = heap_clusters.cluster(df, k=7, rounds=8, dim=5, scale=scale, log=log)
    x = np.floor(v * scale).astype(np.int64)
    home, want = lloyd(x, ids, 7, 8)
    assert centres == want
    assert sorted(map(tuple, rows.collect())) == [(i, home[i], sum((a - b) ** 2 for a, b in zip(x[i].tolist(), want[home[i]], strict=True))) for i in ids]
    assert log[0] == 400 and min(log[1:], default=0) < 200  # most gaps do not expire


def test_clusters_of_odd_vectors(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, None]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (None, [2.0, 2.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, centres = heap_clusters.cluster(df, k=8, rounds=3, dim=2, scale=1)
    assert len(centres) == 3 and sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str) == [(1, 0, 0), (1, 0, 0), (None, 2, 0)]
    assert heap_clusters.cluster(df.limit(0))[0].count() == 0
    with pytest.raises(Exception, match="beyond"):
        heap_clusters.cluster(spark.createDataFrame([(1, [1e9, 0.0])], df.schema), dim=2)[0].count()


def test_clusters_against_sql(spark, same_as_sql):
    same_as_sql(heap_clusters.op13_heap_clusters, heap_clusters.ORACLE_SQL, "/root/testdata/sf0.001")


def plain_statistics(text):
    import regex

    text = text or ""
    words, lines = [w for w in regex.split(r"[ \t\n\x0B\f\r]+", text) if w], text.split("\n")
    n = lambda pattern: sum(len(m) for m in regex.findall(pattern, text))
    share = lambda a, b: a / b if b else 0.0
    letters, solid, w = n(r"\p{L}"), sum(map(len, words)), len(words)
    return {
        "log_words": math.log1p(w), "word_size": share(solid, w), "letter_share": share(letters, solid), "upper_share": share(n(r"\p{Lu}"), letters), "digit_share": share(n(r"\p{N}"), solid),
        "distinct_share": share(len(set(words)), w), "again_share": share(sum(a == b for a, b in zip(words, words[1:])), w), "short_share": share(sum(len(x) <= 3 for x in words), w),
        "long_share": share(sum(len(x) >= 16 for x in words), w), "line_words": share(w, len(lines)), "line_share": share(len(set(lines)), len(lines)),
        "bare_share": share(len(regex.findall(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)", text)), w), "run_share": share(len(regex.findall(r"[^\p{L}\p{N}\s]{2,}", text)), w), "stop_share": share(len(regex.findall(r"[.?!](?!\S)", text)), w),
    }


def test_quality_scores_against_plain_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from creditflow.llm.toxicity import held_out

    model = rule_quality.fit(docs, labels, ~held_out("doc_id", 5, 0))
    assert model.rules
    got = {r.doc_id: r.score for r in rule_quality.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, text in texts.items():
        x = plain_statistics(text)
        z = model.intercept + sum(w for rule, w in model.rules.items() if all(low < x[name] <= high for name, low, high in rule.bounds))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9
    rows = rule_quality.op11_rule_quality(spark, sf).join(labels.where("quality is not null"), "doc_id").where("held_out").select("quality", "predicted").collect()
    assert len(rows) > 50 and sum(r.quality == r.predicted for r in rows) >= 0.93 * len(rows)


def test_rules_are_the_paths_of_trees():
    tree = "Tree 0 (weight 1.0):\n  If (feature 1 <= 2.5)\n   If (feature 0 <= 1.0)\n    Predict: 0.0\n   Else (feature 0 > 1.0)\n    If (feature 1 <= 0.5)\n     Predict: 1.0\n    Else (feature 1 > 0.5)\n     Predict: 0.0\n  Else (feature 1 > 2.5)\n   Predict: 1.0\n"
    inf = math.inf
    got = [r.bounds for r in rule_quality.rules_of([tree, tree], ("p", "q"))]
    assert got == [(("q", -inf, 2.5),), (("p", -inf, 1.0), ("q", -inf, 2.5)), (("p", 1.0, inf), ("q", -inf, 2.5)), (("p", 1.0, inf), ("q", -inf, 0.5)), (("p", 1.0, inf), ("q", 0.5, 2.5)), (("q", 2.5, inf),)]


def test_quality_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, None), (None, 0)], "doc_id long, quality int")
    one = rule_quality.fit(odd_docs, labels, F.lit(True))
    assert not one.rules and abs(1 / (1 + math.exp(-one.intercept)) - 3 / 4) < 1e-12
    rows = rule_quality.score(odd_docs, one).collect()
    assert len(rows) == odd_docs.count() and {r.score for r in rows} == {rows[0].score}
    few = rule_quality.fit(odd_docs, labels.unionByName(spark.createDataFrame([(9, 0)], labels.schema)), F.lit(True))
    assert rule_quality.score(no_docs, few).count() == 0
    empty = rule_quality.fit(no_docs, labels, F.lit(True))
    assert empty.intercept == 0.0
    stats = {r.id: r.asDict() for r in rule_quality.statistics(odd_docs.select("doc_id", "text").withColumnRenamed("doc_id", "id")).collect()}
    assert all(stats[1][s] == 0.0 for s in rule_quality.STATISTICS if s != "line_share")
    assert all(abs(stats[7][s] - v) < 1e-12 for s, v in plain_statistics("w1 x \x1c y\n" + " ".join(f"k{i}" for i in range(120))).items())
