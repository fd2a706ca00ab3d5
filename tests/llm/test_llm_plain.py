"""Token attribution, language machines and toxicity features against plain versions."""

import math
import random

import numpy as np

from creditflow.llm import language_id, packing, token_attribution, toxicity
from creditflow.llm.packing import public_tokenizer

SF = "/root/testdata/sf0.001"


def attributed(text, encoder):
    """Tokens by section, one token and one character at a time."""
    sections = text.replace("\n", "\n\0").split("\0")
    if len(sections) > 1 and not sections[-1]:
        sections.pop()
    section_of = [k for k, s in enumerate(sections) for _ in s]
    first_byte, at = [], 0
    for c in text:
        first_byte.append(at)
        at += len(c.encode())
    begins = {b: i for i, b in enumerate(first_byte)}
    out, given, ceded = [0] * len(sections), [0] * len(sections), [0] * len(sections)
    at = seen = 0
    for token in encoder.encode_ordinary(text):
        size = len(encoder.decode_single_token_bytes(token))
        held = [begins[b] for b in range(at, at + size) if b in begins]
        at += size
        if not held:  # a part of a character: it counts where the next one begins
            out[section_of[min(seen, len(text) - 1)]] += 1
            continue
        seen = held[-1] + 1
        share = {}
        for c in held:
            share[section_of[c]] = share.get(section_of[c], 0) + 1
        home = max(share, key=lambda k: (share[k], -k))
        out[home] += 1
        if len(share) > 1:
            given[home] += 1
            for k in share:
                ceded[k] += k != home
    return [(len("".join(sections[:k])), len("".join(sections[: k + 1])), out[k], given[k], ceded[k]) for k in range(len(sections))]


def test_attribution_of_every_token(spark):
    path = public_tokenizer("byte_bpe_50k.tiktoken")
    encoder, _ = token_attribution.encoding(path)
    draw = random.Random(5)
    pieces = ["\n", "\n\n", "\n\n\n\n", " ", "word", "é", "日本", "🙂", "a\n b", "\t\n", "    \n", "{\n", "}\n\n", "."]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 60))) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and len(r.text) < 3000][:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in token_attribution.attribute_tokens(df, path).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.n_tokens, r.n_given, r.n_ceded))
    crossing = 0
    for k, text in enumerate(texts):
        assert got[k] == attributed(text, encoder), repr(text)
        crossing += sum(x[3] for x in got[k])
    assert crossing > 50


def test_language_margins_and_votes():
    draw = np.random.default_rng(6)
    languages, family_of, pairs = ["a", "b", "c", "d"], [0, 0, 1, 0], [(0, 1), (0, 3), (1, 3)]
    model = language_id.Model(languages, family_of, 2, pairs, draw.normal(size=(1 << language_id.BITS, 5)).astype(np.float32), draw.normal(size=5) * 0.01)
    texts = ["Où est-il? Là-bas.", "x", "the 12 CATS", "", "ñandú " * 40, "zz top"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = language_id._margins(model, np.frombuffer(raw, dtype=np.uint8), offsets)

    def plain(text):
        folded = " " + "".join(chr(b).lower() if chr(b).isascii() and chr(b).isalpha() else chr(b) if b > 127 else " " for b in text.encode()) + " "
        total, n = np.zeros(5), 0
        for size in language_id.ORDERS:
            for i in range(len(folded) - size + 1):
                code = 0
                for c in folded[i : i + size]:
                    code = (code << 8 | ord(c)) & 0xFFFFFFFF
                bucket = ((code ^ (size * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language_id.BITS)
                total += model.weights[bucket]
                n += 1
        return total / max(1, n) + model.intercepts

    want = np.array([plain(t) for t in texts])
    assert np.allclose(got, want, atol=1e-6)

    def vote(m):
        family = int(m[1] > m[0])
        mine = [k for k in range(4) if family_of[k] == family]
        wins = dict.fromkeys(mine, 0.0)
        for k, (a, b) in enumerate(pairs):
            x = min(10, max(-10, m[2 + k]))
            if a in wins:
                wins[a] += (m[2 + k] >= 0) + 1e-3 * x
                wins[b] += (m[2 + k] < 0) - 1e-3 * x
        return languages[max(mine, key=lambda k: wins[k])]

    margins = draw.normal(size=(300, 5))
    assert language_id.decide(model, margins)[0] == [vote(m) for m in margins]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_lexicon_against_plain_edit_distance():
    draw = random.Random(9)
    word = lambda n, letters="abcd": "".join(draw.choice(letters) for _ in range(n))
    weights = {word(draw.randint(3, 8)): 1 + draw.random() for _ in range(60)} | {word(4) + "*": 1 + draw.random() for _ in range(8)}
    trie = toxicity.Trie(weights)
    for _ in range(3000):
        w = word(draw.randint(1, 9), "abcde")
        exact = max((v for t, v in weights.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)), default=0.0)
        assert trie.exact(w) == exact
        near = max((v for t, v in weights.items() if not t.endswith("*") and len(t) >= toxicity.FUZZY_FROM and edits(w, t) <= 1), default=0.0)
        if len(w) >= toxicity.FUZZY_FROM - 1:
            assert trie.fuzzy(w) == near, w


def test_features_and_quotation():
    weights = {"zwackel": 2.0, "quir*": 3.0}
    known = toxicity.Known(toxicity.Trie(weights))
    hit = lambda *sums, n, words: [*map(math.log1p, sums), math.log1p(n), math.log1p(100 * n / words)]
    assert toxicity.features("you zwackel and quirbus", known) == hit(5.0, 0.0, 0.0, n=2, words=4)
    assert toxicity.features("you zwakel there", known) == hit(0.0, 2.0, 0.0, n=1, words=3)
    assert toxicity.features('she said "you zwackel" to him', known) == hit(0.0, 0.0, 2.0, n=1, words=6)
    assert toxicity.features('"yes" you zwackel "no"', known) == hit(2.0, 0.0, 0.0, n=1, words=4)
    assert toxicity.features('"a b c d e f g zwackel h"', known) == hit(2.0, 0.0, 0.0, n=1, words=9)
    assert toxicity.features("", known) == toxicity.features(None, known) == [0.0] * 5


def test_toxicity_recall_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op8_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas())
    held = rows[rows["held_out"] & (rows["toxic"] == 1)]
    assert len(held) and (held["predicted"] == 1).mean() >= 0.9
    clean = rows[rows["held_out"] & (rows["toxic"] == 0)]
    assert (clean["predicted"] == 0).mean() >= 0.99


def test_ids_of_letters_beside_punctuation():
    """Every letter of the first planes before and behind punctuation, and inside a word, as the tokenizer has them."""
    import numpy as np

    path = packing.public_tokenizer("word_bpe_49k.json")
    encode = packing.WordEncoder(path)
    ideograms = (range(0x3400, 0xA000), range(0xAC00, 0xD7A4), range(0x20000, 0x30000))
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha() and (c % 64 == 0 or not any(c in r for r in ideograms))]
    words = [w for c in letters for w in (f"{c},", f",{c}", f"a{c}.", f"{c}b)")] + ["TAKSİ,", "İKİ.", "é.", "<|endoftext|>,", "x<|endoftext|>."]
    whole = encode.tokenizer.encode_batch(words, add_special_tokens=False)
    assert [w for w, e in zip(words, whole, strict=True) if np.array(e.ids, dtype="<u4").tobytes() != encode(w)] == []
