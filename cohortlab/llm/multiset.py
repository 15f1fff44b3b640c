"""Document fingerprints by a homomorphic multiset hash.

A paragraph becomes a wide vector: lanes hashed from the whole paragraph, and lanes that sum +1 or -1 hashed from each
of its three-word shingles. The fingerprint of a text is the sum of the vectors of its paragraphs, lane by lane
modulo a power of two. It does not depend on their order, and a paragraph is added or taken away by adding
or subtracting its vector. Equal first lanes mean equal multisets of paragraphs; the angle between the other lanes
estimates how much two texts share.

An edited text is not hashed anew: the paragraphs that it shares with the original are summed once, and both fingerprints
are that sum plus the vectors of the paragraphs that differ.

All of it is DataFrame operations: shingles are summed in hash aggregation, in the task that reads the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.tables import BLANK, SPACES, field, keep, ranked

EQUAL_LANES, EQUAL_BITS = 16, 32
SIGN_LANES, SIGN_BITS = 128, 32
SHINGLE = 3
# Shingles whose bits are counted in bytes, eight to a number; 127 keep the sign free.
CHUNK = 127


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def equal_lanes(paragraphs: Column) -> Column:
    """Lanes of the whole paragraphs, summed modulo 2^32, as signed numbers."""
    lanes = F.array(*(_lit(i) for i in range(EQUAL_LANES)))
    mask = F.lit((1 << EQUAL_BITS) - 1)

    def vector(paragraph: Column) -> Column:
        digests = F.transform(F.array(F.sha2(paragraph, 256)), lambda d: F.transform(
            lanes, lambda i: F.xxhash64(d, i).bitwiseAND(mask)
        ))
        return digests[0]

    zero = F.array(*(_lit(0) for _ in range(EQUAL_LANES)))
    return F.aggregate(
        F.transform(paragraphs, vector), zero,
        lambda total, v: F.zip_with(total, v, lambda a, b: (a + b).bitwiseAND(mask)),
        lambda total: F.transform(total, lambda x: _signed(x, EQUAL_BITS)),
    )


def added(a: Column, b: Column) -> Column:
    """The lanes of two multisets taken together."""
    return F.zip_with(a, b, lambda x, y: _signed(x.cast("long") + y.cast("long"), EQUAL_BITS))


def _signed(x: Column, bits: int) -> Column:
    half = F.lit(1 << bits - 1)
    return (F.pmod(x + half, 2 * half) - half).cast("int")


def _lit(i: int) -> Column:
    return F.lit(i).cast("long")


def shingles(text: Column) -> Column:
    """Hashes of the three-word shingles of each paragraph; of all its words if there are fewer."""

    def of(paragraph: Column) -> Column:
        trimmed = F.btrim(paragraph, F.lit(BLANK))
        split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))

        def hashed(w: Column) -> Column:
            n = F.size(w) - (SHINGLE - 1)
            few = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(w)))
            each = F.transform(
                F.slice(w, SHINGLE, n), lambda last, i: F.xxhash64(*(w[i + k] for k in range(SHINGLE - 1)), last)
            )
            return F.when(n > 0, each).otherwise(few)

        # A lambda over a one-element array splits the paragraph once.
        return F.transform(F.array(split), hashed)[0]

    return F.flatten(F.transform(paragraphs(text), of))


def _byte_counts() -> list[Column]:
    """Numbers of shingles with each bit set, eight to a sum."""
    ones = F.lit(int("01" * 8, 16))
    return [
        F.sum(F.shiftrightunsigned(F.col(f"h{i // 8}"), i % 8).bitwiseAND(ones)).alias(f"c{i}")
        for i in range(SIGN_LANES // 8)
    ]


def _sign_sums() -> list[Column]:
    """The same over all chunks, two lanes to a sum: the lower one counts up to 2^32."""
    low = F.lit(255 << 32 | 255)
    return [
        F.sum(F.shiftrightunsigned(F.col(f"c{i // 32 * 8 + i % 8}"), i % 32 // 8 * 8).bitwiseAND(low)).alias(f"s{i}")
        for i in range(SIGN_LANES // 2)
    ]


def _sign_lanes(n: Column) -> Column:
    """Sums of +1 and -1 modulo 2^32, as signed numbers."""
    lanes = []
    for i in range(SIGN_LANES // 2):
        s = F.coalesce(F.col(f"s{i}"), F.lit(0))
        for count in (s.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright(s, 32)):
            lanes.append(_signed(2 * count - n, SIGN_BITS))
    return F.array(*lanes)


def sign_lanes(rows: DataFrame, keys: list[str], text: str, within: Column | None = None) -> DataFrame:
    """``(*keys, signs)`` of the text of each row. Keys must tell rows apart; if ``rows`` is already partitioned by some
    of them, nothing is shuffled.

    With ``within``, an array of numbers, a row is a part of the texts of these numbers: ``(*keys, version, signs)``. Keys
    and ``within`` must then tell rows apart.
    """
    parts = F.array(F.lit(0)) if within is None else within
    units = rows.select(*keys, parts.alias("within"), F.posexplode_outer(shingles(F.col(text))).alias("at", "h0"))
    units = units.withColumn("h1", F.when(F.col("h0").isNotNull(), F.xxhash64("h0", F.lit(1))))
    chunk = F.floor(F.col("at") / CHUNK).alias("chunk")
    counted = units.groupBy(*keys, "within", chunk).agg(F.count("h0").alias("n"), *_byte_counts())
    by = [*keys, "version"]
    summed = counted.withColumn("version", F.explode("within")).groupBy(*by).agg(F.sum("n").alias("n"), *_sign_sums())
    signs = summed.select(*by, _sign_lanes(F.col("n")).alias("signs"))
    return signs.drop("version") if within is None else signs


def as_text(equal: Column, signs: Column) -> Column:
    """A fingerprint in hexadecimal digits, all bits of all lanes: what it shows gives the likeness, too."""

    def digits(lanes: Column, bits: int) -> Column:
        low = F.lit((1 << bits) - 1)
        return F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(low)), bits // 4, "0")), "")

    return F.lower(F.concat(digits(equal, EQUAL_BITS), digits(signs, SIGN_BITS)))


def likeness(equal_a: Column, signs_a: Column, equal_b: Column, signs_b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the angle between the sign lanes, 0 at least."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)

    norm = F.sqrt(dot(signs_a, signs_a) * dot(signs_b, signs_b))
    angle = F.when(norm > 0, dot(signs_a, signs_b) / norm).otherwise(0.0)
    same = (equal_a == equal_b) & (signs_a == signs_b)
    return F.when(same, 1.0).otherwise(F.least(F.greatest(angle, F.lit(0.0)), F.lit(1.0)))


def _some(equal: str) -> Column:
    """128 bits of the first lanes."""
    return F.slice(equal, 1, 4)


def _narrow(signs: str) -> Column:
    """Sign lanes in the narrowest type that all of them fit, for shuffles and files."""
    widest = F.array_max(F.transform(signs, lambda x: F.abs(x.cast("long"))))

    def lanes(kind: str) -> Column:
        return F.transform(signs, lambda x: x.cast(kind))

    return F.struct(
        F.when(widest < 1 << 7, lanes("tinyint")).alias("bytes"),
        F.when((widest >= 1 << 7) & (widest < 1 << 15), lanes("smallint")).alias("shorts"),
        F.when(widest >= 1 << 15, F.col(signs)).alias("ints"),
    ).alias(signs)


def _widened(signs: str) -> Column:
    bytes_, shorts = (F.transform(F.col(f"{signs}.{c}"), lambda x: x.cast("int")) for c in ("bytes", "shorts"))
    return F.coalesce(bytes_, shorts, F.col(f"{signs}.ints"))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` for each document of ``docs(doc_id, text)``; cases as in ``compare_with_next``."""
    keys = ["k1", "k2", "k3"]
    rows = _documents(docs)
    lanes = rows.select(*keys, equal_lanes(paragraphs(F.col("text"))).alias("equal")).join(
        sign_lanes(rows, keys, "text"), keys
    )
    return lanes.select(_id().alias("doc_id"), as_text(F.col("equal"), F.col("signs")).alias("fingerprint"))


def _id() -> Column:
    return F.when(~F.col("k2"), F.col("k1"))


def _documents(docs: DataFrame) -> DataFrame:
    doc_id, text = field("doc_id").cast("long"), field("text").cast("string")
    return docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("k1"), doc_id.isNull().alias("k2"), F.xxhash64(text).alias("k3"),
        F.coalesce(text, F.lit("")).alias("text"),
    ).dropDuplicates(["k1", "k2", "k3"])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of the document after an edit, and how alike they are.

    The edited text has its last half (rounded down) replaced by the beginning of the next document, by descending id;
    after the last one comes the first. Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    Null text: empty. Null ids come last. Rows that repeat an id and a text are one document and give one row; texts
    with one id follow their hashes. A single document is its own next one. Very long texts are read whole. An
    empty table gives no rows. Other columns are not used.
    """
    keys = ["k1", "k2", "k3"]
    rows = _documents(docs)
    light = docs.select(
        F.coalesce(field("doc_id").cast("long"), F.lit(0)).alias("k1"), field("doc_id").isNull().alias("k2"),
        F.xxhash64(field("text").cast("string")).alias("k3"), F.coalesce(F.length(field("text")), F.lit(0)).alias("n"),
    ).groupBy(*keys).agg(F.max("n").alias("n"))
    order = [F.col("k2").asc(), F.col("k1").desc(), F.col("k3").asc()]
    placed = ranked(light, order, "order")
    total = placed.count()
    # Who asks for the beginning of whom, and for how much of it.
    asking = placed.select(
        *(F.col(k).alias(f"a{k}") for k in keys), F.floor(F.col("n") / 2).cast("int").alias("half"),
        F.pmod(F.col("rank") + 1, F.lit(max(total, 1))).alias("rank"),
    )
    asked = placed.select(*keys, "rank").join(asking, "rank").drop("rank")
    heads = rows.join(asked, keys).select(
        *(F.col(f"a{k}").alias(k) for k in keys), *(F.col(k).alias(f"n{k}") for k in keys), "half",
        F.substring("text", F.lit(1), F.col("half")).alias("head"),
    )
    following = ["nk1", "nk2", "nk3"]
    # Whole paragraphs before the cut are in both versions; the paragraph that is cut belongs to what differs.
    n = F.length("text")
    whole = rows.join(heads, keys).withColumn("left", F.substring("text", F.lit(1), n - F.col("half")))
    whole = whole.withColumn("cut", F.substring_index("left", "\n", -1))
    whole = whole.withColumn("same", F.length("left") - F.length("cut"))
    both_in = F.when(F.col("same") > 0, F.substring("text", F.lit(1), F.col("same") - 1))
    whole = whole.select(
        *keys, *following, n.cast("long").alias("n_chars"), F.concat("left", "head").alias("edited"), both_in.alias("both"),
        F.substring("text", F.col("same") + 1, n).alias("old"), F.concat("cut", "head").alias("new"),
    )
    parts = {"both": (0, 1), "old": (0,), "new": (1,)}
    units = whole.select(*keys, F.explode(F.array(*(
        F.struct(F.array(*map(F.lit, versions)).alias("within"), F.col(part).alias("text")) for part, versions in parts.items()
    ))).alias("part")).select(*keys, "part.within", "part.text")
    signs = sign_lanes(units, keys, "text", F.col("within")).groupBy(*keys).agg(
        F.max(F.when(F.col("version") == 0, F.col("signs"))).alias("signs"),
        F.max(F.when(F.col("version") == 1, F.col("signs"))).alias("edited_signs"),
    )
    none = F.array().cast("array<string>")
    shared = equal_lanes(F.when(F.col("both").isNull(), none).otherwise(paragraphs(F.col("both"))))
    info = whole.select(
        *keys, *following, "n_chars", F.unhex(F.sha2("edited", 256)).alias("digest"), shared.alias("shared"),
        *(equal_lanes(paragraphs(F.col(part))).alias(part) for part in ("old", "new")),
    ).select(
        *keys, *following, "n_chars", "digest", added(F.col("shared"), F.col("old")).alias("equal"),
        added(F.col("shared"), F.col("new")).alias("edited_equal"),
    )
    # Kept because each document is looked up by the one before it. A few lanes tell whether two are equal.
    both = info.join(signs, keys)
    own = keep(both.withColumns({c: _narrow(c) for c in ("signs", "edited_signs")}), "fingerprints")
    after = own.select(*(F.col(k).alias(f"n{k}") for k in keys), _some("equal").alias("next_equal"),
                       F.col("signs").alias("next_signs"))
    mine = (F.col("equal"), F.col("signs"))
    pairs = own.join(after, following)
    return pairs.withColumns({c: _widened(c) for c in ("signs", "edited_signs", "next_signs")}).select(
        _id().alias("doc_id"), "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), as_text(*mine).alias("fingerprint"),
        as_text(F.col("edited_equal"), F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(*mine, F.col("edited_equal"), F.col("edited_signs")).alias("near_edited"),
        likeness(_some("equal"), F.col("signs"), F.col("next_equal"), F.col("next_signs")).alias("near_next"),
    )
