"""MinHash near-duplicate detection for multisets (BagMinHash).

A text is the multiset of its five-word shingles. Each shingle has Poisson
processes over its weight axis, one for each dyadic weight interval [0,1), [1,2),
[2,4), [4,8) ...; a point falls in a unit cell of its interval by hash bits and
counts where the cell is below the shingle's weight. Points are dealt over the
``n_hashes`` components, and a component keeps the first arrival. Two texts agree
in a component with probability equal to their weighted Jaccard similarity. Only
points before a horizon (set from the text's weight, doubled where a component
got none) are made, so a text costs about ``n_hashes * (ln n_hashes + 3)`` points
whatever its length.

Bands of components give candidates; each is verified on the real multisets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creditflow.llm import arrow_text as at
from creditflow.llm.held import lean, release
from creditflow.llm.components import components
from creditflow.llm.storage import broadcast_if_small, small_batches, stored

if TYPE_CHECKING:  # only tasks that are given pandas frames load it
    import pandas as pd

_U = np.uint64
_BASE_SHINGLE, _BASE_TEXT = 0xA24BAED4963EE407, 0x9FB21C651E98DF25
#: A block of the last step: at most about so many rows, and words.
BLOCK_ROWS, BLOCK_WORDS = 2000, 1_000_000
_COLUMNS = 2048
_STEP = _U(0xD6E8FEB86659FD93)


def shingles(words: at.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and where each row's begin; a row of 1 to k-1 words has one, of all its words."""
    total = len(words.h1)
    full = at.rolling(words.h1, k, _BASE_SHINGLE)
    ok = at.inside(words.first, k, total)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(first[-1], dtype=_U)
    mine = np.ones(first[-1], dtype=bool)
    mine[first[short]] = False
    out[mine] = full[ok]
    for r in short:
        a, b = words.first[r], words.first[r + 1]
        out[first[r]] = at.rolling(words.h1[a:b], b - a, _BASE_SHINGLE)[0] + _U(b - a)
    return out, first


def bags(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles, ascending, and their counts, for each row."""
    for i, j in at.groups(texts):
        values, first = shingles(at.words_of(*at.text_buffer(texts.slice(i, j - i))), k)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(values[a:b], return_counts=True)


def signatures(values: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash signatures, one row of m for each non-empty multiset (zeros for an empty one)."""
    rows = len(first) - 1
    ordered = values.copy()
    for a, b in zip(first[:-1], first[1:], strict=True):
        ordered[a:b].sort()
    row = np.repeat(np.arange(rows), np.diff(first))
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    weight = np.diff(np.append(begin, len(ordered)))
    element, owner = ordered[begin], row[begin]
    total = np.diff(first).astype(np.float64)
    parts = [(element, owner, np.ones(len(element)), np.zeros(len(element), np.int64), weight)]
    low = 1
    while (many := weight > low).any():  # the intervals above the first unit
        parts.append((at.mix(element[many] + _U(low)), owner[many], np.full(many.sum(), float(low)), np.full(many.sum(), low, np.int64), weight[many]))
        low *= 2
    seed, owner, length, base, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    best, out = np.full(rows * m, np.inf), np.zeros(rows * m, dtype=_U)
    horizon = np.zeros(rows)
    horizon[total > 0] = (np.log(m) + 3) / total[total > 0]
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        best.reshape(rows, m)[todo] = np.inf
        s, o, ln, bs, wt = seed[mine], owner[mine], length[mine], base[mine], weight[mine]
        t, step = np.zeros(len(s)), 0
        while len(s):
            bits = at.mix(s + _U((int(_STEP) * (2 * step + 1)) % (1 << 64)))
            t = t - np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * ln)
            live = t <= horizon[o]
            s, o, ln, bs, wt, t, bits = s[live], o[live], ln[live], bs[live], wt[live], t[live], bits[live]
            point = at.mix(bits + _STEP)
            component = ((point >> _U(32)) % _U(m)).astype(np.int64)
            cell = bs + ((point & _U(0xFFFFFFFF)).astype(np.int64) % ln.astype(np.int64))
            ok = cell < wt
            slot, when, name = (o * m + component)[ok], t[ok], point[ok]
            np.minimum.at(best, slot, when)
            won = best[slot] == when
            out[slot[won]] = name[won]
            step += 1
        todo = todo & np.isinf(best.reshape(rows, m)).any(axis=1)
        horizon[todo] *= 2
    return out.reshape(rows, m)


@lean
def _signature_rows(batches: Iterator[pa.RecordBatch], k: int, n_bands: int, per_band: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, j in at.groups(texts):
            words = at.words_of(*at.text_buffer(texts.slice(i, j - i)))
            values, first = shingles(words, k)
            sig = signatures(values, first, n_bands * per_band).reshape(-1, n_bands, per_band)
            band = np.broadcast_to(np.arange(n_bands, dtype=_U) + _U(1), sig.shape[:2])
            for c in range(per_band):
                band = at.mix(band * _STEP + sig[:, :, c])
            n = words.counts
            keys = []
            for h in (words.h1, words.h2):  # the content address: all words in order
                p, q = at.powers(_BASE_TEXT, len(h) + 1)
                run = np.zeros(len(h) + 1, dtype=_U)
                np.cumsum(h * p[: len(h)], out=run[1:])
                keys.append(at.mix((run[words.first[1:]] - run[words.first[:-1]]) * q[words.first[:-1]] + n.astype(_U)))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, n_bands, dtype=np.int32)), pa.array(at.signed(band.ravel())), mask=pa.array(n == 0))
            columns = [ids.slice(i, j - i), pa.array(at.signed(keys[0])), pa.array(at.signed(keys[1])), pa.array(n.astype(np.int64)), bands]
            yield pa.RecordBatch.from_arrays(columns, ["id", "c1", "c2", "n_words", "bands"])


@lean
def _overlap(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    release()
    last: tuple = (None, None)
    for batch in batches:
        a, b, ta, tb = batch.columns
        keep = []
        for (ua, na), ib, xb in zip(bags(ta, k), b.to_pylist(), tb, strict=True):
            if last[0] != (ib, xb):
                last = ((ib, xb), next(bags(pa.array([xb.as_py()], pa.string()), k)))
            ub, nb = last[1]
            _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
            both = int(np.minimum(na[x], nb[y]).sum())
            union = int(na.sum() + nb.sum()) - both
            keep.append(union > 0 and both >= threshold * union - 1e-9)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


def _block_links(pdf: pd.DataFrame, k: int, threshold: float) -> pd.DataFrame:
    """Links from the asked rows of a block to rows of other classes: one for each row and class."""
    import pandas as pd

    values, rows = [], []
    for r, (u, n) in enumerate(bags(pa.array(pdf["text"], pa.string()), k)):
        values.append(np.concatenate([u, *(at.mix(u[n > c] + _U(c)) for c in range(1, int(n.max(initial=1))))]))  # a multiset as a set
        rows.append(np.full(len(values[-1]), r))
    size = np.array([len(v) for v in values])
    _, name, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    keep = count[name] > 1  # what one row has alone is common to no pair
    column, row = (np.cumsum(count > 1) - 1)[name[keep]], np.concatenate(rows)[keep]
    asked, others = np.flatnonzero(pdf["asked"]), np.flatnonzero(~pdf["asked"])
    place = np.empty(len(pdf), dtype=np.int64)
    place[asked], place[others] = np.arange(len(asked)), np.arange(len(others))
    is_asked, common = pdf["asked"].to_numpy()[row], np.zeros((len(asked), len(others)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, row, is_asked = column[order], row[order], is_asked[order]
    for low in range(0, int(column.max(initial=-1)) + 1, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        c, r, q = column[a:b] - low, row[a:b], is_asked[a:b]
        left, right = np.zeros((len(asked), _COLUMNS), np.float32), np.zeros((len(others), _COLUMNS), np.float32)
        left[place[r[q]], c[q]] = 1
        right[place[r[~q]], c[~q]] = 1
        common += left @ right.T
    union = size[asked][:, None] + size[others][None, :] - common
    group = pdf["g"].to_numpy()
    x, y = np.nonzero((common >= threshold * union - 1e-4) & (group[asked][:, None] != group[others][None, :]))
    ids = pdf["rep"].to_numpy()
    return pd.DataFrame({"a": ids[asked[x]], "b": ids[others[y]], "g": group[others[y]]}).drop_duplicates(["a", "g"])[["a", "b"]]


def _rest_links(placed: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links of the members outside their centre's class to the other members of its buckets.

    A group (all that share a centre) is cut into blocks of bounded rows and
    words; each block of asked rows meets each block of the group.
    """
    members = placed.where("rep <> centre").select("centre", "rep", "g", (F.col("g") != F.col("gc")).alias("out")).distinct().join(sizes, "rep")
    groups = members.groupBy("centre").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"), F.max("out").alias("any"), F.countDistinct("g").alias("classes")).where("any and classes > 1")
    groups = groups.select("centre", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("w") / BLOCK_WORDS)).cast("int").alias("blocks"))
    members = stored(members.join(groups, "centre").withColumn("own", F.pmod(F.hash("rep"), F.col("blocks"))), "rest")
    wanted = stored(members.select(F.col("rep").alias("id")).distinct(), "candidates")
    with_text = members.join(texts.join(broadcast_if_small(wanted), "id").withColumnRenamed("id", "rep"), "rep")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = with_text.where("out").select("centre", F.col("own").alias("x"), every.alias("y"), "rep", "g", "text", F.lit(True).alias("asked"))
    others = with_text.select("centre", every.alias("x"), F.col("own").alias("y"), "rep", "g", "text", F.lit(False).alias("asked"))
    return asked.unionByName(others).groupBy("centre", "x", "y").applyInPandas(lambda pdf: _block_links(pdf, k, threshold), "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts have a weighted Jaccard similarity of threshold or more."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidates")
    texts = rows.join(broadcast_if_small(wanted), "id")
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    full = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(lambda x: _overlap(x, k, threshold), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, n_bands: int = 20, per_band: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and class_id, the least id of its class.

    Classes are the connected components of the links between texts whose
    weighted Jaccard similarity (k-word shingles) is threshold or more. Identical
    word sequences are merged first and never expanded. In a bucket of a band all
    members are compared with the most central one; members that end in another
    class than it are then compared, block by block, with all other members that
    have that centre, so no link that joins classes is left out. A pair of similarity 0.8 shares no bucket
    with probability (1 - 0.8**per_band)**n_bands, 3 in 100,000 by default.

    Defined cases: a text that is null or has no word is alone in its class;
    1 to k-1 words are one shingle; rows that share an id are one document (any
    of its texts can link it); a null id gives a null class_id; other columns do
    not matter.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = rows.where("id is not null and text is not null")
    sig = stored(known.mapInArrow(lambda b: _signature_rows(b, k, n_bands, per_band), "id long, c1 long, c2 long, n_words long, bands array<long>"), "signatures").where("bands is not null")
    first = sig.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    members = first.select("rep", F.explode(F.array_distinct("bands")).alias("bucket")).distinct()
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(members.join(shared, "bucket"), "members")
    degree = members.groupBy("rep").agg(F.sum("n").alias("degree"))
    centre = members.join(degree, "rep").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("rep"))).alias("c")).select("bucket", (-F.col("c.rep")).alias("centre"))
    members = stored(members.join(centre, "bucket").select("bucket", "rep", "centre"), "members")
    tested = stored(members.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    links = stored(verified(tested, known, k, threshold), "links")
    group = components(links)
    placed = (
        members.join(group.select(F.col("id").alias("rep"), F.col("component").alias("g")), "rep", "left")
        .join(group.select(F.col("id").alias("centre"), F.col("component").alias("gc")), "centre", "left")
        .select("bucket", "rep", "centre", F.coalesce("g", "rep").alias("g"), F.coalesce("gc", "centre").alias("gc"))
    )
    placed = stored(placed, "placed")
    if not placed.where("g <> gc").isEmpty():
        sizes = first.select("rep", "n_words").groupBy("rep").agg(F.max("n_words").alias("n_words"))
        more = stored(_rest_links(placed, sizes, known, k, threshold), "links")
        if not more.isEmpty():
            group = components(links.unionByName(more))
    # identical texts follow their least id
    same = sig.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = sig.join(same, ["c1", "c2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    copies = copies.join(group.select(F.col("id").alias("b"), "component"), "b", "left").select(F.col("a").alias("id"), F.coalesce("component", "b").alias("component"))
    classes = group.unionByName(copies).groupBy("id").agg(F.min("component").alias("class_id"))
    return rows.select("id").join(classes, "id", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))


def op9_bag_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, md5(g) AS g, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE common >= 0.8 * (sa.total + sb.total - common) - 1e-9),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS label FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id WHERE r.label < e.b)
SELECT id AS doc_id, min(label) AS class_id FROM r GROUP BY id
"""
