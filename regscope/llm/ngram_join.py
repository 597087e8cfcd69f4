"""N-gram Jaccard join by a blocked sparse matrix product.

Rows of the incidence matrix are the distinct texts, columns their n-grams
(64-bit hashes). The product of the matrix with its transpose holds all
overlaps; it is computed in two parts that together miss no link:

Sparse part. Each text posts its n-grams below a fixed cut of the hash space
(short texts post all of them), at least its prefix of
``p = n - ceil(t * n) + 1`` smallest hashes. Columns of at most ``HOT`` texts are
multiplied by a self-join and the overlaps accumulated per pair. A pair is
discarded as soon as accumulated + shared hot columns + what neither posted
stays below the size-derived bound ``ceil(t / (1 + t) * (n_a + n_b))``.
A text is *settled* if at least p of its posted n-grams are in such columns:
a linked text that posted as far lacks fewer than p of them, so the pair is
found here. Texts that posted to another cut than the rest are never settled
where a pair could need it (lengths around ``SHORT``, prefixes beyond the cut).

Second sparse part. The texts that are not settled, read again, post all their
n-grams, and columns count them alone: of these, a text is settled unless more
than ``n - p`` of its n-grams are hot. Pairs of two texts that are open in a part
are left to the next one.

Dense part. Pairs of texts that are still not settled (mostly made of passages
that many texts share, such as a large family of near copies) share a column.
Stars over those columns, with the pairs of the sparse parts, group texts into
families. A family is cut into blocks by size band and hash; every pair of
blocks whose sizes can meet the bound is multiplied in one task with numpy:
frequent columns as a dense product, rare ones by counting. A task returns the
number of links per text and a spanning forest of them, never all pairs.

So no group is gathered whole: columns that are frequent in one task are
summed there before the shuffle, families are blocks, copies are collapsed
first, and every link between different texts is tested on its whole sets.

Cases: null, empty or white texts have no n-grams and no links. A text with
fewer than n words has one n-gram, its whole sequence. Copies (equal words) are
one text, whatever their ids; repeated rows and rows with one id are rows of
their own. Null ids keep their row (component null if all are null). Empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Cache, broadcast_if_small, dropped, written
from .components import components

N, THRESHOLD = 5, 75          # words per n-gram; link from this similarity in per cent
HOT = 16                      # texts in a column of the sparse part
CUT = np.uint64(int(0.375 * 2 ** 64))
SHORT = 128                   # n-grams up to which a text posts all of them
CHUNK = 1_000_000             # posted hashes that a task looks at together
BLOCK_ROWS, BLOCK_GRAMS = 512, 1_000_000
CACHE = 16 << 20              # bytes of hashed words per worker


class _Words(Cache):
    """Hash of a word, computed once per worker."""

    def __missing__(self, word: bytes) -> int:
        return self.keep(word, xxhash.xxh3_64_intdigest(word), len(word))


@functools.cache
def _word_hashes() -> _Words:
    return _Words(CACHE)


def gram_hashes(text: str | None, n: int = N) -> tuple[bytes, np.ndarray]:
    """The words (joined by spaces) and the sorted distinct hashes of the n-grams.

    ``bytes.lower`` maps A-Z alone and ``bytes.split`` cuts at x09-x0D and x20.
    """
    words = text.encode().lower().split() if text else []
    joined = b" ".join(words)
    if not words:
        return joined, np.zeros(0, np.uint64)
    if len(words) < n:
        return joined, np.array([xxhash.xxh3_64_intdigest(joined, seed=1)], np.uint64)
    w = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = (h ^ w[j:len(w) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return joined, np.unique(h)


def prefix_size(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def _posted(h: np.ndarray, threshold: int) -> np.ndarray:
    if len(h) <= SHORT:
        return h
    return h[:max(int(np.searchsorted(h, CUT)), prefix_size(len(h), threshold))]


def _texts(docs: DataFrame, n: int, threshold: int, whole: bool = False) -> DataFrame:
    """One written row per document: rid, doc_id, key of the words, n_shingles,
    n_posted (all, if ``whole``), and for the first of a chunk's copies ``cold`` and ``hot`` posted
    hashes (hot: in more than HOT texts of this chunk) and ``marks``, the chunk's
    hot hashes, each once."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _word_hashes().alone()
        held: list[tuple] = []
        size, seen = 0, {}

        def flush() -> pd.DataFrame:
            first = [i for i, r in enumerate(held) if r[5]]
            every = np.concatenate([held[i][4] for i in first] or [np.zeros(0, np.uint64)])
            values, counts = np.unique(every, return_counts=True)
            hot = values[counts > HOT]
            out = []
            for i, (d, key, total, n_posted, post, lead) in enumerate(held):
                at = np.searchsorted(hot, post)
                is_hot = (at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == post) if len(hot) else np.zeros(len(post), bool)
                out.append((d, key, total, n_posted, lead, post[~is_hot].view(np.int64) if lead else [],
                            post[is_hot].view(np.int64) if lead else [], hot.view(np.int64) if i == 0 else []))
            held.clear()
            seen.clear()
            return pd.DataFrame(out, columns=["doc_id", "key", "n_shingles", "n_posted", "lead", "cold", "hot", "marks"]).astype({"doc_id": "Int64"})

        for batch in batches:
            for d, t in zip(batch["doc_id"], batch["text"]):
                joined, h = gram_hashes(t, n)
                key = hashlib.md5(joined).digest()
                post = h if whole else _posted(h, threshold)
                lead = key not in seen and len(h) > 0
                seen[key] = True
                held.append((None if pd.isna(d) else int(d), key, len(h), len(post), post if lead else post[:0], lead))
                size += len(post) + 50
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    got = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(
        rows, "doc_id long, key binary, n_shingles long, n_posted long, lead boolean, "
              "cold array<long>, hot array<long>, marks array<long>")
    return written(got.select(F.monotonically_increasing_id().alias("rid"), "*"), "join-texts")


def _need(a: Column, b: Column, threshold: int) -> Column:
    """Least overlap of linked sets of a and b: ceil(t (a + b) / (100 + t))."""
    return F.ceil((a + b) * threshold / F.lit(100 + threshold) - 1e-9)


def _sizes_fit(a: Column, b: Column, threshold: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * threshold)


def _sparse_part(texts: DataFrame, one: DataFrame, threshold: int, whole: bool, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the rows ``one`` of ``texts``: written columns (h, rid, n, is_hot) of two texts or
    more; written stats of each text, ``open`` if it is not settled; and the candidate
    pairs (u, v) that are not both open. ``whole``: all n-grams are posted."""
    # What a chunk found hot comes as one mark.
    posts = one.select(F.explode("cold").alias("h"), "rid", F.col("n_shingles").cast("int").alias("n"))
    marks = texts.select(F.explode("marks").alias("h"), F.lit(None).cast("long").alias("rid"), F.lit(0).alias("n"))
    total = F.sum(F.when(F.col("rid").isNull(), HOT + 1).otherwise(1)).over(W.partitionBy("h"))
    columns = written(
        posts.unionByName(marks).select("*", total.alias("total"))
        .where("total > 1 and rid is not null").select("h", "rid", "n", (F.col("total") > HOT).alias("is_hot")), f"{label}-columns")

    # How much of each text is posted, and in hot columns.
    found_hot = columns.where("is_hot").groupBy("rid").agg(F.count("*").alias("found"))
    p = F.col("n") - F.ceil(F.col("n") * threshold / F.lit(100) - 1e-9) + 1
    hot = F.size("hot") + F.coalesce("found", F.lit(0))
    # A long text whose prefix reaches beyond the cut posted further than others do.
    beyond = (F.col("n") > SHORT) & (F.col("n_posted") <= p)
    mixed = F.lit(False) if whole else beyond | F.col("n").between(SHORT * threshold // 100, SHORT)
    stats = written(
        one.select("rid", "hot", F.col("n_shingles").alias("n"), "n_posted").join(found_hot, "rid", "left")
        .select("rid", "n", "n_posted", hot.alias("n_hot"), beyond.alias("beyond"), ((F.col("n_posted") - hot < p) | mixed).alias("open")),
        f"{label}-stats")

    # Overlaps accumulated over the columns, discarded by size-derived bounds.
    sparse = columns.where("not is_hot")
    a, b = (sparse.select("h", F.col("rid").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    overlaps = (a.join(b, "h").where((F.col("a") < F.col("b")) & _sizes_fit(F.col("n_a"), F.col("n_b"), threshold))
                .groupBy("a", "b").agg(F.count("*").alias("overlap")))
    side = lambda x: stats.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("n_hot").alias(f"hot_{x}"),
                                  F.col("open").alias(f"open_{x}"), (F.col("n") - F.col("n_posted")).alias(f"rest_{x}"),
                                  ((F.col("n") > SHORT) & ~F.col("beyond")).alias(f"at_cut_{x}"))
    # What both posted to the same cut: at most the lesser rest is shared and unseen.
    # Else it is within the rest of the one that posted less far, at most the greater.
    unposted = F.when(F.col("at_cut_a") & F.col("at_cut_b"), F.least("rest_a", "rest_b")).otherwise(F.greatest("rest_a", "rest_b"))
    pairs = (overlaps.join(side("a"), "a").join(side("b"), "b").where(~(F.col("open_a") & F.col("open_b")))
             .where(F.col("overlap") + F.least("hot_a", "hot_b") + unposted >= _need(F.col("n_a"), F.col("n_b"), threshold))
             .select(F.col("a").alias("u"), F.col("b").alias("v")))
    return columns, stats, pairs


def ngram_join(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: rid, doc_id, key, n_shingles, text_id (the row that
    stands for its text), n_links (other texts linked with it), component (row id)
    and component_id (smallest doc_id of the component)."""
    texts = _texts(docs, n, threshold)
    leads = texts.where("lead").groupBy("key").agg(F.min("rid").alias("text_id"))
    member = written(
        texts.where("n_shingles > 0").select("rid", "doc_id", "key", "n_shingles").join(leads, "key")
        .unionByName(texts.where("n_shingles = 0").select("rid", "doc_id", "key", "n_shingles", F.col("rid").alias("text_id"))),
        "join-members")
    extra = written(texts.where("lead").select("rid", "key").join(leads, "key").where("rid <> text_id").select("rid"), "join-extra")
    one = texts.where("lead").join(broadcast_if_small(extra), "rid", "left_anti")

    columns, stats, near = _sparse_part(texts, one, threshold, False, "join")
    pairs = written(near, "join-pairs")
    open_rows = written(one.join(stats.where("open").select("rid"), "rid", "left_semi").select("rid", "doc_id", "key"), "join-open")
    dropped(texts, extra, columns, stats)

    # Second sparse part: the open texts alone, with all their n-grams.
    several = written(member.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").select("doc_id"), "join-several")
    again = _texts(_with_text(docs, several, open_rows).select(F.col("rid").alias("doc_id"), F.col("_text").alias("text")), n, threshold, whole=True)
    dropped(open_rows)
    rest = again.where("lead").select(F.col("doc_id").alias("rid"), "n_shingles", "n_posted", "cold", "hot")
    columns, stats, near = _sparse_part(again, rest, threshold, True, "join-again")

    # Dense part: stars over all columns of the texts still open.
    open_ids = written(stats.where("open").select("rid"), "join-still-open")
    open_posts = rest.join(broadcast_if_small(open_ids), "rid", "left_semi").select(
        "rid", F.explode(F.concat("cold", "hot")).alias("h"))
    centre = open_posts.groupBy("h").agg(F.min("rid").alias("v"), F.count("*").alias("c")).where("c > 1").select("h", "v")
    stars = open_posts.join(centre, "h").where("rid <> v").select(F.col("rid").alias("u"), "v").distinct()

    families = written(components(pairs.unionByName(near).unionByName(stars), "join-families"), "join-family-of")
    dropped(again, columns, stats, open_ids, pairs)
    links = written(_products(docs, member, several, families, n, threshold), "join-links")
    joined = components(links.where("v is not null").select("u", "v"), "join-components")
    degree = links.where("v is null").groupBy("u").agg(F.sum("links").alias("n_links"))

    by_text = families.select(F.col("node").alias("text_id")).join(
        joined.select(F.col("node").alias("text_id"), "component"), "text_id", "left").join(
        degree.select(F.col("u").alias("text_id"), "n_links"), "text_id", "left")
    rows = written(
        member.join(by_text, "text_id", "left")
        .withColumn("component", F.coalesce("component", "text_id"))
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")), "join-rows")
    # Only components of more than one row need their smallest id looked up.
    several = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    return rows.join(several, "component", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def _products(docs: DataFrame, member: DataFrame, several: DataFrame, families: DataFrame, n: int, threshold: int) -> DataFrame:
    """Links inside families: rows (u, v) of spanning forests, and (u, null, links)."""
    band = F.floor(F.log(F.col("n")) / math.log(100 / threshold * 1.005)).cast("int")
    nodes = written(
        families.join(member.where("rid = text_id").select(F.col("rid").alias("node"), "doc_id", "key", F.col("n_shingles").alias("n")), "node")
        .select("node", "doc_id", "key", "n", F.col("component").alias("family"), band.alias("band")), "join-nodes")
    need = lambda: F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    whole = nodes.groupBy("family").agg(need().alias("k"))
    bands = nodes.groupBy("family", "band").agg(need().alias("k"))
    # A family of one block is a unit of its own. Else a unit is a pair of blocks of the same or neighbouring bands.
    single = nodes.join(whole.where("k = 1"), "family").select(
        "node", "doc_id", "key", F.col("family"), F.array(F.lit("all")).alias("units"), F.lit(None).cast("string").alias("block"))
    around = (bands.select("family", "band", F.col("k").alias("k0"))
              .join(bands.select("family", (F.col("band") - 1).alias("band"), F.col("k").alias("k1")), ["family", "band"], "left")
              .join(bands.select("family", (F.col("band") + 1).alias("band"), F.col("k").alias("k_1")), ["family", "band"], "left"))
    own = F.pmod(F.xxhash64("node"), F.col("k0").cast("long")).cast("int")
    name = lambda x, y: F.concat_ws(".", x.cast("string"), y.cast("string"))
    beside = lambda count, step, up: F.transform(
        F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>")),
        lambda j: F.concat_ws("/", *([name(F.col("band"), F.col("own")), name(F.col("band") + step, j)][::1 if up else -1])))
    same = F.transform(F.sequence(F.lit(0), F.col("k0") - 1), lambda j: F.concat_ws(
        "/", name(F.col("band"), F.least(j, F.col("own"))), name(F.col("band"), F.greatest(j, F.col("own")))))
    blocked = (nodes.join(whole.where("k > 1").select("family"), "family").join(around, ["family", "band"])
               .withColumn("own", own)
               .select("node", "doc_id", "key", "family",
                       F.concat(same, beside(F.col("k1"), 1, True), beside(F.col("k_1"), -1, False)).alias("units"),
                       name(F.col("band"), F.col("own")).alias("block")))
    wanted = written(single.unionByName(blocked), "join-wanted")

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for node, key, family, units, block, text in batch.itertuples(index=False):
                joined, h = gram_hashes(text, n)
                if hashlib.md5(joined).digest() == bytes(key):
                    rows.append((node, family, units, block, h.tobytes()))
            yield pd.DataFrame(rows, columns=["node", "family", "units", "block", "grams"])

    filled = _with_text(docs, several, wanted).select("node", "key", "family", "units", "block", "_text").mapInPandas(
        arrays, "node long, family long, units array<string>, block string, grams binary")
    units = filled.select("node", "family", F.explode("units").alias("unit"), "block", "grams")
    return units.groupBy("family", "unit").applyInPandas(lambda pdf: block_product(pdf, threshold), "u long, v long, links long")


def _with_text(docs: DataFrame, several: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (with doc_id and key) and the text that they stand for, in ``_text``.

    An id on ``several`` rows (null among them) doesn't tell their texts: those are met by id and
    words, once per text, so that rows of one id don't meet each other's texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").alias("_text"))
    repeated = broadcast_if_small(several)
    clear = wanted.join(repeated, wanted["doc_id"].eqNullSafe(repeated["doc_id"]), "left_anti")
    unclear = wanted.join(repeated, wanted["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi").withColumn("_words", F.lower(F.hex("key")))
    met = texts.join(broadcast_if_small(several.withColumnRenamed("doc_id", "_several")), F.col("_d").eqNullSafe(F.col("_several")), "left_semi")
    met = met.withColumn("_words", words_key(F.col("_text"))).dropDuplicates(["_d", "_words"])
    columns = [*wanted.columns, "_text"]
    return texts.join(broadcast_if_small(clear), texts["_d"] == clear["doc_id"]).select(*columns).unionByName(
        met.join(unclear, (met["_words"] == unclear["_words"]) & met["_d"].eqNullSafe(unclear["doc_id"])).select(*columns))


def words_key(text: Column) -> Column:
    """The md5 of a text's words, as ``gram_hashes`` joins them."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.md5(F.coalesce(F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " ")), F.lit("")))


def block_product(pdf: pd.DataFrame, threshold: int = THRESHOLD) -> pd.DataFrame:
    """The links of one unit: between its two blocks, or within its only block."""
    pdf = pdf.drop_duplicates("node").sort_values("node")
    node = pdf["node"].to_numpy()
    sides = pdf["unit"].iloc[0].split("/")
    if len(sides) == 1 or sides[0] == sides[1]:
        rows = cols = np.arange(len(pdf))
    else:
        rows, cols = (np.flatnonzero((pdf["block"] == s).to_numpy()) for s in sides)
    grams = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
    found = links_between([grams[i] for i in rows], [grams[j] for j in cols], rows is cols, threshold)
    x, y = node[rows[found[0]]], node[cols[found[1]]]
    degree = pd.Series(np.concatenate([x, y])).value_counts()
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.get(v, v)) != v:
            parent[v] = parent.get(up, up)
            v = up
        return v

    forest = []
    for s, t in zip(x.tolist(), y.tolist()):
        a, b = root(s), root(t)
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((s, t))
    out = pd.DataFrame({"u": [f[0] for f in forest] + degree.index.tolist(),
                        "v": pd.array([f[1] for f in forest] + [None] * len(degree), "Int64"),
                        "links": pd.array([0] * len(forest) + degree.tolist(), "Int64")})
    return out.astype({"u": "int64"})


def links_between(left: list[np.ndarray], right: list[np.ndarray], same: bool, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of linked sets: overlaps of two blocks of the incidence matrix."""
    n, m = len(left), len(right)
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = [np.array([len(g) for g in part], np.int64) for part in (left, right)]
    hashes, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = int(sizes[0].sum())
    owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
    column = [at[:split], at[split:]]
    in_left, in_right = (np.bincount(c, minlength=len(hashes)) for c in column)
    work = in_left * in_right
    useful = (work > 1) if same else (work > 0)
    dense = useful & (work >= max(64, n * m // 64))
    overlap = np.zeros((n, m), np.float32)
    # Frequent columns: dense products, some hundred columns at a time.
    ranks = np.cumsum(dense) - 1
    total = int(dense.sum())
    for start in range(0, total, 2048):
        width = min(2048, total - start)
        part = []
        for c, o, count in zip(column, owner, (n, m)):
            keep = dense[c] & (ranks[c] >= start) & (ranks[c] < start + width)
            x = np.zeros((count, width), np.float32)
            x[o[keep], ranks[c[keep]] - start] = 1
            part.append(x)
        overlap += part[0] @ part[1].T
    # Rare columns: every (i, j) of a column is counted, in steps of bounded size.
    rare = useful & ~dense
    lists = []
    for c, o in zip(column, owner):
        keep = rare[c]
        order = np.argsort(c[keep], kind="stable")
        lists.append((c[keep][order], o[keep][order]))
    (cl, ol), (cr, orr) = lists
    if len(cl):
        first, count = np.searchsorted(cr, cl, "left"), in_right[cl]
        ends = np.cumsum(count)
        begin = 0
        while begin < len(cl):
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + 2_000_000, "right")))
            reps = count[begin:stop]
            i = np.repeat(ol[begin:stop], reps)
            within = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            j = orr[np.repeat(first[begin:stop], reps) + within]
            overlap += np.bincount(i * m + j, minlength=n * m).reshape(n, m)
            begin = stop
    union = sizes[0][:, None] + sizes[1][None, :] - overlap
    linked = (100 * overlap.astype(np.int64) >= threshold * union.astype(np.int64)) & (overlap > 0)
    if same:
        linked = np.triu(linked, 1)
    return np.nonzero(linked)


def keep_one(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, that stay when one row of each
    component does: the first one with its smallest id. Rows without words stay.

    Only ids travel: rows are dropped by an anti-join on the ids to drop. Ids on
    several rows (and null ids) can't tell rows apart; those rows alone are
    looked up by id and words.
    """
    rows = written(ngram_join(docs, n, threshold), "keep-rows")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("rid").alias("c"))
    first = rows.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("least")).select(
        F.col("least.c").alias("rid"), F.lit(True).alias("first"))
    marked = rows.join(first, "rid", "left").select(
        "doc_id", "key", "n_shingles", (F.col("first").isNotNull() | (F.col("n_shingles") == 0)).alias("stays"))
    per_id = written(marked.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("stays").alias("stays")), "keep-ids")
    unclear = F.col("doc_id").isNull() | (F.col("c") > 1)
    gone = written(per_id.where(unclear | ~F.col("stays")).select(F.col("doc_id").alias("_id"), unclear.alias("_unclear")), "keep-gone")
    # The input's columns travel in one struct, so no name of theirs can clash.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), docs["text"].alias("text"))
    simple = whole.select("row", "id").join(broadcast_if_small(gone.select("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_anti")

    several = gone.where("_unclear").select("_id")
    kept = marked.where("stays").join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(
        F.col("doc_id").alias("kept_id"), F.lower(F.hex("key")).alias("kept_key"), (F.col("n_shingles") == 0).alias("empty")).distinct()
    looked = (whole.join(broadcast_if_small(several), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
              .select("row", "id", words_key(F.col("text")).alias("words")))
    found = looked.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("words") == F.col("kept_key")))
    one = found.where(~F.col("empty")).dropDuplicates(["id", "words"]).unionByName(found.where("empty"))
    return simple.select("row.*").unionByName(one.select("row.*"))
