"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are words (cut at white space) and single letters of scripts without case (CJK and others). Each k-gram of
tokens gets a 32-bit hash; of every window of ``w`` neighbouring k-grams the least hash is chosen, of equal ones the
rightmost; each choice is kept once with its position (in tokens). Any passage of at least w + k - 1 tokens that two
texts share gives them a common hash. A text with fewer k-grams than a window has one window of all of them; one of
fewer than k tokens is one k-gram; a text without tokens has an empty fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 5, 8
PER_RANGE = 20_000  # rows that one range of ids has, about
RANGES = 16_384  # ranges at most; then they grow with the table
TOKEN = r"\p{Lo}|[^\x20\x09-\x0D\p{Lo}]+"
_LOW = 4_294_967_295  # 2**32 - 1


def _first(values: Column, n: Column) -> Column:
    return F.slice(values, F.lit(1), n)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<hash int, pos long>> of a text, in order of position. Null for a null text.

    Hash and place are packed into one number, the hash above and the place counted down below it, so that the least
    number is the least hash with the rightmost place. ``get`` gives null past the end, which hash and least skip.
    """

    def packed(tokens: Column) -> Column:
        grams = F.transform(tokens, lambda t, i: F.shiftleft(F.hash(t, *[F.get(tokens, i + j) for j in range(1, k)]).cast("long"), 32) + (F.lit(_LOW) - i))
        return _first(grams, F.greatest(F.size(tokens) - (k - 1), F.least(F.size(tokens), F.lit(1))))

    def chosen(p: Column) -> Column:
        minima = F.transform(p, lambda x, i: F.least(x, *[F.get(p, i + j) for j in range(1, w)]))
        return F.array_distinct(_first(minima, F.greatest(F.size(p) - (w - 1), F.least(F.size(p), F.lit(1)))))

    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    picks = _let(_let(tokens, packed), chosen)
    return F.transform(picks, lambda v: F.struct(F.shiftright(v, 32).cast("int").alias("hash"), (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).alias("pos")))


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Common hashes over all hashes of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def told(fingerprint: Column) -> Column:
    """A fingerprint as text: hash (hexadecimal, 8 digits) and position of each choice."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lpad(F.hex(x["hash"].cast("long").bitwiseAND(F.lit(_LOW))), 8, "0"), F.lit("@"), x["pos"].cast("string"))), " ")


def _range_of(bounds: list[int], value: Column) -> Column:
    """Number of ``bounds`` (in order) below ``value``, found in two steps of about the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = F.greatest(F.size(F.filter(F.lit([x[0] for x in blocks]), lambda b: b < value)), F.lit(1)) - 1
    inside = F.get(F.array(*[F.lit(x) for x in blocks]), block)
    return block * step + F.size(F.filter(inside, lambda b: b < value))


def with_next(df: DataFrame, carried: list[str], ranges: int | None = None) -> DataFrame:
    """(doc_id, *carried, next_*): each row with the columns of the row that follows in descending doc_id; the first
    row follows the last.

    Rows are dealt by ranges of ids, cut at ids that occur (found by approximate quantiles, which are all that comes to
    the driver; their number grows with the table, up to RANGES). The row at a cut is also sent to the range above it,
    where it follows that range's last row; so every row is shuffled once and no task orders more than one range. Equal
    ids follow each other in the order of their columns; a null id comes last.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    ranges = ranges or min(RANGES, max(1024, df.count() // PER_RANGE))
    cuts = df.select(F.percentile_approx(key, [i / ranges for i in range(ranges)] + [1.0], 100_000).alias("cuts"), F.max(key).alias("high")).first()
    bounds = [0] if cuts["high"] is None else sorted({*cuts["cuts"], cuts["high"]})
    rows = df.select(key.alias("id"), "doc_id", *carried).withColumn("range", _range_of(bounds, F.col("id")).cast("int"))
    at_cut = F.get(F.lit(bounds), F.col("range")) == F.col("id")
    above = F.when(F.col("range") + 1 < len(bounds), F.col("range") + 1).otherwise(F.lit(0))
    own = F.struct(F.col("range").alias("to"), F.lit(0).alias("ghost"))
    sent = F.when(at_cut, F.array(own, F.struct(above.alias("to"), F.lit(1).alias("ghost")))).otherwise(F.array(own))
    dealt = rows.withColumn("sent", F.explode(sent)).select("sent.to", "sent.ghost", "id", "doc_id", *carried)
    order = Window.partitionBy("to").orderBy("ghost", F.desc("id"), *[c for c in carried if dict(df.dtypes)[c] in ("string", "bigint", "int")])
    following = F.lead(F.struct(*carried)).over(order)
    return dealt.withColumn("following", following).filter("ghost = 0").select("doc_id", *carried, *[F.col("following")[c].alias(f"next_{c}") for c in carried])


def edited_fingerprints(df: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the start of the next document).

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text
    counts as empty; repeated rows stay; extra columns are not read; an empty table gives no rows.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(docs, ["text"])
    n = F.char_length("text").cast("long")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    out = pairs.withColumn("n_chars", n).withColumn("edited", edited)
    # the next text's fingerprint is made again here: choices don't compress, so carrying them doubles the shuffle
    out = out.withColumns({"fp": winnow(F.col("text"), k, w), "edited_fp": winnow(F.col("edited"), k, w), "next_fp": winnow(F.col("next_text"), k, w)})
    out = out.withColumn("own", hashes(F.col("fp")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), told(F.col("fp")).alias("fingerprint"), told(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_fp"))).alias("near_edited"), likeness(F.col("own"), hashes(F.col("next_fp"))).alias("near_next"),
    )
