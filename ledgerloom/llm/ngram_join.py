"""N-gram Jaccard join with adaptive multi-match prefixes.

Every document is the set of its distinct word shingles. Under one global
order of shingles (rare before common, then by hash) two sets that must share o
shingles to link share at least l of them within their l-prefixes, the first
n - o + l shingles of a set of n. Each document picks its own
l: the one with the least estimated cost, from the posting lengths estimated on
a hashed share of the documents. A longer prefix reads more postings, but a
partner must then share l of its shingles before it is verified.

The steps, each a Spark job over all rows:

1. set sizes and set signatures; equal sets form a class at once;
2. the shingles that are common in a 1/16 share of the documents, at most
   ``MAX_COMMON`` of them: they only decide the order, so any estimate gives
   the same links;
3. prefix rows (shingle, document), kept where a shingle has two documents;
4. each shingle names one of its documents as leader; of every document's
   leaders the one that shares most with it is verified, and what links that way
   is a class already; large groups repeat this with other leaders;
5. all remaining pairs from different classes that share l prefix shingles are
   verified, whatever their number.

A shingle is a 64-bit hash of its words. Candidates are found by one lane of
these hashes and verified on all shingles of both sets in another, independent
lane; equal sets are told by sums over both lanes, 128 bits.

The result's classes are those of all verified links: a pair that is skipped
in step 5 lies within one class already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import text_groups
from .common import connected_components, cut, discard, only_ids, release, small_batches, table
from .textnum import chunks, grams, mix, utf8, word_hashes

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: The order's list of common shingles holds so many at most (16 bytes each when it is broadcast).
MAX_COMMON = 200_000
#: Copies that share their set with at least so many others are left out of the prefix index if among the MAX_HOT largest classes.
HOT_COPIES, MAX_HOT = 16, 20_000
SAMPLE, SAMPLE_COUNT = 16, 3
#: A document asks for so many shared shingles at most, and for an eighth of its set at most.
MAX_MATCHES = 24
#: Step 4 verifies a partner that shares at least this part of the first prefix.
STRONG = 0.25
#: Step 4 goes on with LEADERS other leaders a shingle while postings hold more than STAR_WORTH pairs a row, for STAR_ROUNDS at most; step 5 does what is left.
STAR_ROUNDS, STAR_WORTH, LEADERS = 2, 4, 4
#: What verifying a candidate costs, in postings read.
VERIFY_COST = 20.0


def shingle_sets(rows: list[tuple], k: int, lanes: int = 1) -> Iterator[tuple]:
    """(row, sorted distinct shingle hashes of each lane) for rows whose last member is the text in bytes."""
    words, bounds = word_hashes([r[-1] for r in rows], lower=True, lanes=lanes)
    all_grams = [grams(w, k, lane) for lane, w in enumerate(words)]
    for row, lo, hi in zip(rows, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield row, [np.unique(g[lo : hi - k + 1]) for g in all_grams]
        elif hi > lo:
            yield row, [grams(w[lo:hi], hi - lo, lane) for lane, w in enumerate(words)]
        else:
            yield row, [np.zeros(0, np.uint64)] * lanes


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for lo, hi in text_groups(b.column(1)):
            yield from ((i, utf8(t)) for i, t in zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist(), strict=True))


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sum(s: np.ndarray) -> int:
    """A hash of the whole set."""
    return int(mix(s).sum().view(np.int64))


def _signatures(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64())])

    def run(batches):
        release()
        for part in chunks(_rows(batches)):
            out = []
            for (doc, _), (s, t) in shingle_sets(part, k, lanes=2):
                out.append((doc, len(s), _sum(s), _sum(t)) if len(s) else (doc, 0, None, None))
            yield _batch(schema, *zip(*out, strict=True))

    return run


def _tokens(k: int):
    schema = pa.schema([("token", pa.int64())])

    def run(batches):
        for part in chunks(_rows(batches)):
            yield _batch(schema, np.concatenate([s for _, (s,) in shingle_sets(part, k)]).view(np.int64))

    return run


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set it links with."""
    return -(-percent * n // 100)


def pair_overlap(n: int, m: int, percent: int) -> int:
    """The least overlap of linked sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def ordered(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in the global order, with the estimated posting length of each shingle."""
    if not len(common):
        return s, np.ones(len(s))
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    est = np.where(common[at] == s, counts[at], 1)
    order = np.argsort(est, kind="stable")
    return s[order], est[order].astype(float)


def most_matches(n: int, percent: int) -> int:
    """Grows with n, so that the larger document of a pair indexes all that the smaller one may ask for."""
    return max(1, min(MAX_MATCHES, n // 8, needed(n, percent)))


def choose_matches(est: np.ndarray, n: int, percent: int) -> int:
    """The l of least cost: postings read, and candidates with l of them to verify."""
    o = pair_overlap(n, n, percent)
    best, least = 1, None
    for matches in range(1, most_matches(n, percent) + 1):
        postings = float(est[: n - o + matches].sum())
        cost = postings + VERIFY_COST * postings / matches**2
        if least is None or cost < least:
            best, least = matches, cost
    return best


def _prefixes(k: int, percent: int, order, hot):
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("meta", pa.int64())])

    def run(batches):
        common, counts = order.value
        skip = hot.value
        for part in chunks(_rows(batches)):
            tokens, docs, metas = [], [], []
            for (doc, _), (s,) in shingle_sets(part, k):
                n = len(s)
                if not n or skip and skip.get((_sum(s), n), doc) != doc:
                    continue
                s, est = ordered(s, common, counts)
                take = s[: n - needed(n, percent) + most_matches(n, percent)]
                tokens.append(take)
                docs.append(np.full(len(take), doc, np.int64))
                metas.append(n << 32 | np.arange(len(take)) << 8 | choose_matches(est, n, percent))
            if tokens:
                yield _batch(schema, np.concatenate(tokens).view(np.int64), np.concatenate(docs), np.concatenate(metas))

    return run


def _shared(batches):
    """Of rows sorted by token and document, those whose token has another row, with the first document of the token."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("meta", pa.int64()), ("leader", pa.int64())])
    last_token, last_row, leader, last_out = None, None, None, True
    for b in batches:
        t, d, m = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(t):
            continue
        same = np.empty(len(t), bool)
        same[0], same[1:] = last_token is not None and t[0] == last_token, t[1:] == t[:-1]
        first = np.maximum.accumulate(np.where(same, -1, np.arange(len(t))))
        lead = np.where(first >= 0, d[np.maximum(first, 0)], leader if leader is not None else 0)
        keep = same.copy()
        keep[:-1] |= same[1:]
        keep[-1] = same[-1]
        if same[0] and not last_out:
            yield _batch(schema, *([x] for x in last_row))
        yield _batch(schema, t[keep], d[keep], m[keep], lead[keep])
        last_token, leader, last_out = t[-1], lead[-1], bool(keep[-1])
        last_row = (t[-1], d[-1], m[-1], lead[-1])


def _sets(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("members", pa.binary())])

    def run(batches):
        for part in chunks(_rows(batches)):
            out = [(doc, s.tobytes()) for (doc, _), (_, s) in shingle_sets(part, k, lanes=2)]
            yield _batch(schema, *zip(*out, strict=True))

    return run


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                ok.append(both * 100 >= percent * (len(x) + len(y) - both) and both > 0)
            ok = np.array(ok, bool)
            yield _batch(schema, b.column(0).to_numpy()[ok], b.column(1).to_numpy()[ok])

    return run


def _stars(rows: DataFrame, percent: int, each: list[str]) -> DataFrame:
    """(a, b): to each document b (and each numbered leader) the leader a with which it shares most, if that is a good part of b's first prefix."""
    votes = rows.groupBy(*each, "leader").agg(F.count(F.lit(1)).alias("count"), F.max(F.expr("shiftright(meta, 32)")).alias("n"))
    votes = votes.where(F.col("count") >= STRONG * (100 - percent) / 100 * F.col("n"))
    stars = votes.groupBy(*each).agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    return stars.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets, made anew from the texts, are similar enough."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = cut(only_ids(docs, ids).mapInArrow(_sets(k), "doc_id long, members binary"))
    x = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    linked = cut(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"))
    discard(ids, sets)
    return linked


def jaccard_classes(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per document of docs(doc_id, text).

    Null and empty texts have an empty set and are a class of their own. A
    document of fewer than k words is one shingle, its whole sequence. Rows that
    repeat a doc_id are rows of one class, each with its own size. Rows without
    doc_id keep their size and get a null class. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = base.where("doc_id IS NOT NULL")
    sizes = cut(base.mapInArrow(_signatures(k), "doc_id long, n_shingles long, sig_a long, sig_b long"))
    signed = sizes.where("doc_id IS NOT NULL AND sig_a IS NOT NULL")
    classes = cut(signed.groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    copy_links = signed.join(classes, ["sig_a", "sig_b", "n_shingles"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    hot = {(r.sig_a, r.n_shingles): r.rep for r in classes.where(F.col("copies") >= HOT_COPIES).orderBy(F.desc("copies"), "sig_a").limit(MAX_HOT).collect()}

    share = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    common = share.mapInArrow(_tokens(k), "token long").groupBy("token").count().where(F.col("count") >= SAMPLE_COUNT)
    top = common.orderBy(F.desc("count"), "token").limit(MAX_COMMON).toPandas()
    tokens, counts = top["token"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64) * SAMPLE
    by = np.argsort(tokens)
    order = spark.sparkContext.broadcast((tokens[by], counts[by]))
    skip = spark.sparkContext.broadcast(hot)

    rows = known.mapInArrow(_prefixes(k, percent, order, skip), "token long, doc_id long, meta long")
    shared = cut(rows.repartition("token").sortWithinPartitions("token", "doc_id", "meta").mapInArrow(_shared, "token long, doc_id long, meta long, leader long"))

    pairs = cut(_stars(shared.where("doc_id <> leader"), percent, ["doc_id"]))
    near = verified(pairs, known, k, percent)
    labels = connected_components(near.union(copy_links))
    discard(pairs, near, classes)

    rest, token = shared.drop("leader"), Window.partitionBy("token")
    for seed in range(STAR_ROUNDS):
        joined = rest.select("token", "doc_id", "meta").join(labels, rest.doc_id == labels.id, "left").select("token", "doc_id", "meta", F.coalesce("component", "doc_id").alias("class"))
        chiefs = [F.min(F.struct(F.xxhash64(F.lit(LEADERS * seed + k), "doc_id").alias("by"), F.col("doc_id").alias("leader"), F.col("class").alias("leader_class"))).over(token) for k in range(LEADERS)]
        mixed = joined.select("*", (F.min("class").over(token) < F.max("class").over(token)).alias("mixed"), F.count(F.lit(1)).over(token).alias("n"), F.array(*chiefs).alias("chiefs")).where("mixed")
        read = shared if seed == 0 else rest
        rest = cut(mixed.select("token", "doc_id", "meta", "class", "n", F.transform("chiefs", lambda c: F.struct(c["leader"].alias("leader"), c["leader_class"].alias("leader_class"))).alias("chiefs")))
        discard(read)
        load = rest.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") - 1).alias("pairs")).first()
        if seed == STAR_ROUNDS - 1 or not load.rows or load.pairs <= STAR_WORTH * load.rows:
            break
        led = rest.select("doc_id", "meta", "class", F.posexplode("chiefs").alias("k", "chief")).where("class <> chief.leader_class").select("doc_id", "meta", "k", "chief.leader")
        stars = cut(_stars(led, percent, ["doc_id", "k"]).distinct())
        new = verified(stars, known, k, percent)
        discard(stars)
        if not new.limit(1).count():
            break
        links = labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(new)
        labels = connected_components(links)
    # Rows are (size << 32 | place in the order << 8 | l). The smaller document of a pair asks, with its own l, and the
    # prefixes are those of the pair's own least overlap.
    part = {f"{x}_{k}": v.format(x) for x in "rs" for k, v in (("n", "shiftright({0}.meta, 32)"), ("at", "(shiftright({0}.meta, 8) & 16777215)"), ("l", "({0}.meta & 255)"))}
    part["o"] = "(({percent} * ({r_n} + {s_n}) + 99 + {percent}) div (100 + {percent}))".format(percent=percent, **part)
    first = "({r_n} < {s_n} OR {r_n} = {s_n} AND r.doc_id < s.doc_id)".format(**part)
    near = "100 * {r_n} >= {percent} * {s_n}".format(percent=percent, **part)
    within = "{r_at} < {r_n} - {o} + {r_l} AND {s_at} < {s_n} - {o} + {r_l}".format(**part)
    met = rest.alias("r").join(rest.alias("s"), F.expr(f"r.token = s.token AND r.class <> s.class AND r.doc_id <> s.doc_id AND {first} AND {near} AND {within}"))
    enough = met.groupBy(F.col("r.doc_id").alias("a"), F.col("s.doc_id").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.first(F.expr(part["r_l"])).alias("l")).where("n >= l")
    asked = cut(enough.select("a", "b"))
    discard(rest)
    more = verified(asked, known, k, percent)
    final = connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)) if more.limit(1).count() else labels
    return sizes.join(final, sizes.doc_id == final.id, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """Of each class the document with the smallest doc_id, all columns kept; rows without doc_id stay."""
    classes = jaccard_classes(docs)
    gone = classes.where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; null and empty texts link with nothing."""
    return jaccard_classes(table(spark, sf_dir, "documents"))
