"""Document fingerprints by consistent weighted sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples in a fingerprint.
SAMPLES = 32
#: Rows of a bucket, and most buckets, for finding each document's neighbour in the order of ids.
BUCKET_ROWS, FANOUT = 512, 256


#: Halvings of the chance to be a candidate, and the least expected number of candidates of a sample.
LEVELS, CANDIDATES = 8, 20


def _exponential(h: Column, shift: int) -> Column:
    """An exponential number from 20 bits of a hash."""
    return -F.log((F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 20) - 1)) + F.lit(0.5)) / F.lit(float(1 << 20)))


def bids(weighted: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """`keys`, j and bid of each (term, weight, total) of `weighted` for each sample j in which it is a candidate.

    Consistent weighted sampling draws r and c of Gamma(2, 1) and b uniform from a hash of term and j, rounds a weight w down
    in the log domain to y = exp(r (t - b)) with t = floor(ln w / r + b), and bids a = c / (y exp(r)). The least bid's (term, t)
    agrees between two texts with the probability of their generalised Jaccard similarity. `total` is the text's summed weight.

    The draw is made in an order that leaves most of the work undone. At w = 1 the bid is a1 = c exp(-r (1 - b)), and a1,
    c - a1 and r b are independent exponentials; so these are drawn, and r = ln(c / a1) + r b, b = r b / r follow. a1 comes from
    a uniform u = 1 - exp(-a1), whose leading bits for all samples stand side by side in the terms' first hashes. The least
    of a text's bids is below k halvings of u unless all its weight misses there, exp(-CANDIDATES) or less if k is chosen by
    the total; so terms of weight 1, which are most, go on only where u is that small. Terms of larger weight go on for all j.

    A null term, which stands for a text without words, bids null. A bid holds ln a to 2**-20 in its high bits and 24 bits that tell (term, t) in its low ones.
    """
    k = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(F.col("total") / CANDIDATES)))).cast("int")
    first = weighted.select(*keys, "term", F.col("weight").cast("double").alias("w"), F.when(F.col("weight") == 1, k).otherwise(0).alias("k"), *[F.xxhash64("term", F.lit(i)).alias(f"h{i}") for i in range(LEVELS)])
    for i in range(LEVELS):  # bit j of m_i is set if the first i + 1 bits of sample j's u are 0
        first = first.withColumn(f"m{i}", F.col(f"h{i}").bitwiseAND(F.col(f"m{i - 1}")) if i else F.col("h0"))
    open_ = F.lit(-1).cast("long")
    for i in range(LEVELS):
        open_ = F.when(F.col("k") > i, F.col(f"m{i}")).otherwise(open_)
    kept = [*keys, "term", "w", *[f"m{i}" for i in range(LEVELS)]]
    dealt = first.select(*kept, open_.alias("open")).select(*kept, "open", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("j"))
    bit = lambda c: F.expr(f"shiftrightunsigned({c}, j) & 1L")
    dealt = dealt.where(bit("open") == 1)
    level = bit("m0")
    for i in range(1, LEVELS):
        level = level + bit(f"m{i}")
    drawn = dealt.select(*keys, "j", "w", level.cast("int").alias("level"), F.col("term").isNull().alias("none"), F.xxhash64("term", "j").alias("h"))
    # u lies in [2**-(level + 1), 2**-level), or below 2**-LEVELS
    fraction = (F.shiftrightunsigned("h", 24).bitwiseAND(F.lit((1 << 40) - 1)) + F.lit(0.5)) / F.lit(float(1 << 40))
    u = F.when(F.col("level") == LEVELS, fraction * F.lit(0.5**LEVELS)).otherwise((fraction + 1) / F.expr("cast(shiftleft(2L, level) as double)"))
    drawn = drawn.select(*keys, "j", "w", "none", "h", (-F.log1p(-u)).alias("a1"))
    one = drawn.select(*keys, "j", "w", "none", "h", "a1", F.log("a1").alias("ln_a1"))
    heavy = F.col("w") > 1
    one = one.select("*", F.when(heavy, F.xxhash64("h")).alias("g"))
    one = one.select("*", F.when(heavy, F.log(F.col("a1") + _exponential(F.col("g"), 0))).alias("ln_c"), F.when(heavy, _exponential(F.col("g"), 20)).alias("rb"))
    one = one.select("*", F.when(heavy, F.col("ln_c") - F.col("ln_a1") + F.col("rb")).alias("r"))
    one = one.select("*", F.when(heavy, F.floor((F.log("w") + F.col("rb")) / F.col("r"))).otherwise(F.lit(0).cast("long")).alias("t"))
    ln_a = F.when(heavy, F.col("ln_c") - F.col("r") * (F.col("t") + 1) + F.col("rb")).otherwise(F.col("ln_a1"))
    who = F.col("h").bitwiseXOR(F.shiftrightunsigned("h", 40)).bitwiseXOR(F.col("t") * 40503).bitwiseAND(F.lit((1 << 24) - 1))
    return one.select(*keys, "j", F.when(F.col("none"), None).otherwise(F.shiftleft(F.floor(ln_a * F.lit(float(1 << 20))), 24).bitwiseOR(who)).alias("bid"))


def terms(text: Column) -> Column:
    """Hashes of the words of a text, A-Z lower-cased, sorted; repeats stand side by side."""
    low = F.btrim(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(low != "", F.sort_array(F.transform(F.split(low, r"[ \t-\r]+"), lambda w: F.xxhash64(w)))).otherwise(F.array(F.lit(None).cast("long")))


def _last_places(hashes: Column) -> Column:
    """Places (from 0) of the last of each run of equal elements."""
    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: ~F.get(hashes, i).eqNullSafe(F.get(hashes, i + 1)) | F.get(hashes, i).isNull())


def neighbours(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, fanout: int = FANOUT) -> DataFrame:
    """Each row of `docs` with the next document's text, by descending doc_id, after the last the first.

    doc_id, text, next_text, bucket, nth and copy. Documents are dealt once, with their texts, into buckets of consecutive
    ids; each bucket also gets, as rows marked copy, the documents that follow its last one. Bucket bounds come from
    approximate quantiles of the ids, at most fanout**2 of them. Rows with one doc_id follow in the order of their texts'
    hashes; rows without an id come last.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = whole.select("doc_id")
    count = min(fanout * fanout, max(1, -(-ids.count() // bucket_rows)))
    shares = [i / count for i in range(1, count)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 20 * count)).first()[0] if shares else None
    bounds = sorted(set(found or []))
    groups = [bounds[i : i + fanout] for i in range(0, len(bounds), fanout)]
    below = lambda a, d: F.size(F.filter(a, lambda x: x <= d))
    if bounds:
        coarse = F.array(*[F.lit(g[0]).cast("long") for g in groups])
        fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
        group = F.greatest(below(coarse, F.col("doc_id")) - 1, F.lit(0))
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(group * fanout + below(F.get(fine, group), F.col("doc_id")))
    else:
        bucket = F.lit(0)
    heads = ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head"))
    every = Window.partitionBy(F.lit(0)).orderBy("bucket")  # a row for each bucket, fanout**2 at most
    to = heads.select("bucket", "head", F.coalesce(F.lead("bucket").over(every), F.min("bucket").over(Window.partitionBy(F.lit(0)))).alias("receiver"))
    dealt = whole.withColumn("bucket", bucket).join(F.broadcast(to), "bucket")
    own = F.struct(F.col("bucket"), F.lit(0).alias("copy"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, F.struct(F.col("receiver").alias("bucket"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    dealt = dealt.select("doc_id", "text", F.explode(copies).alias("at")).select("doc_id", "text", "at.bucket", "at.copy")
    along = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return dealt.select("*", F.lead("text").over(along).alias("next_text"), F.row_number().over(along).alias("nth"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; fingerprints of texts without words are equal to each other and unlike all others."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.greatest(F.size(a), F.lit(1)))


def fingerprints(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """`keys` of each row and its fingerprint: 16 bits of each consistent weighted sample of its terms(), column hashes, by term frequency.

    An empty array stands for texts without words. A sample without any candidate, which is as good as impossible, is 0.
    """
    counted = rows.select(*keys, "hashes", _last_places(F.col("hashes")).alias("last"))
    runs = counted.select(*keys, "hashes", "last", F.posexplode("last").alias("nth_run", "at"))
    weight = F.col("at") - F.when(F.col("nth_run") == 0, -1).otherwise(F.get(F.col("last"), F.col("nth_run") - 1))
    long = runs.select(*keys, F.size("hashes").alias("total"), F.get(F.col("hashes"), F.col("at")).alias("term"), weight.alias("weight"))
    least = bids(long, keys, samples).groupBy(*keys, "j").agg(F.min("bid").alias("bid"))
    found = least.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("j", F.col("bid").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("bid")))).alias("by_j"))
    every = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda j: F.coalesce(F.try_element_at("by_j", j), F.lit(0)))
    empty = F.forall(F.map_values("by_j"), lambda v: v.isNull())
    return found.select(*keys, F.when(empty, F.array().cast("array<int>")).otherwise(every).alias("samples"))


def hex_of(samples: Column) -> Column:
    return F.concat_ws("", F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every row of `docs`, of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    in descending doc_id. doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts
    count as empty; a text without words has an empty fingerprint, like only to another such. Repeated rows each have a
    result; a single row follows itself; other columns are not read. The texts are shuffled once, by bucket of ids; all
    later groups and windows lie within a bucket.
    """
    rows = neighbours(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - floor(char_length(text) / 2))"), F.when(half > 0, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)).otherwise(""))
    rows = rows.select("bucket", "nth", "copy", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.select("bucket", "nth", "copy", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    # exploding the hashes, not the texts, keeps them from being made anew for each place at which they are used
    both = F.when(F.col("copy") == 0, F.array(terms(F.col("text")), terms(F.col("edited")))).otherwise(F.array(terms(F.col("text"))))
    rows = rows.select("bucket", "nth", "copy", "doc_id", "n_chars", "edited_sha256", F.posexplode(both).alias("which", "hashes"))
    prints = fingerprints(rows, ["bucket", "nth", "which", "copy", "doc_id", "n_chars", "edited_sha256"], samples)
    along = Window.partitionBy("bucket").orderBy("nth", "which")
    prints = prints.select("*", F.lead("samples", 1).over(along).alias("edited"), F.lead("samples", 2).over(along).alias("next")).where("which = 0 AND copy = 0")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("samples")).alias("fingerprint"), hex_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited")).alias("near_edited"), likeness(F.col("samples"), F.col("next")).alias("near_next"),
    )
