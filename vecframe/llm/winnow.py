"""Operator 8: benchmark decontamination by winnowing, in DataFrame operations only.

Texts are lower-cased in A-Z and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is 13 consecutive
words of an item (a shorter item is one window). Both sides keep, of each 7 neighbouring hashes of 7 words, the
least: any shared span of 13 words then shares a kept hash, so joining the kept hashes finds every document that
can hold a window. In those documents the hits are extended: the windows around each hit are compared in full, as
text. Items of fewer than 13 words are found by the hash of all their words, and compared likewise.

The benchmark side is broadcast only if it has at most ``BROADCAST`` rows, and shuffled otherwise. Documents are
identified by two hashes of doc_id and text, so equal rows share their result and nulls need no care: a null text
has no words (no hits, not contaminated), an item without words has no windows. Items that repeat count once by
item_id; windows of items whose item_id is null hit like any others, and these items count as one in n_items but have
no part in items_sha256. Empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, row_keys

SPAN, GRAM = 13, 7
WINDOW = SPAN - GRAM + 1
BROADCAST = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same by what it holds, which Java matches several times faster; and the same words before lower-casing.
WORD_HOLDS, WORD_ANY_CASE = r"[0-9a-z\x{80}-\x{10FFFF}]+", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # then lower() changes A-Z alone
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD_HOLDS), F.lit(0))


def _span(low: Column | int, high: Column) -> Column:
    """low, ..., high; empty if high < low."""
    low = F.lit(low) if isinstance(low, int) else low
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that comes out of a generator, so that what refers to it again doesn't compute it again."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def _each(of: str, size: int, f: Callable[..., Column]) -> Column:
    """f of each ``size`` consecutive entries of the array column."""
    starts = F.slice(of, 1, F.greatest(F.size(of) - (size - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: f(x, *[F.get(F.col(of), i + k) for k in range(1, size)]))


def hashed_words(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its words w and their hashes hw."""
    return _once(_once(df, "w", words(F.col(text))), "hw", F.transform("w", lambda x: F.xxhash64(x)))


def grams(size: int) -> Column:
    """The hash of each ``size`` consecutive words, from their hashes hw."""
    return _each("hw", size, F.xxhash64)


def winnowed(hashes: str) -> Column:
    """The least of each WINDOW consecutive hashes (all there are, if fewer), once each."""
    few = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.when(F.size(hashes) < WINDOW, few).otherwise(_each(hashes, WINDOW, F.least)))


def _small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """df, to be broadcast if it has few enough rows, or entries where a row has size of them."""
    n = df.agg(F.sum(F.lit(1) if size is None else size)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST else df


def with_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ka and kb, the identity of a row by which decontaminate names it."""
    return docs.select("*", *row_keys(key, text))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(column(key).alias("doc_id"), column(text).alias("text"), *row_keys(key, text))


def _covered(spans: Column) -> Column:
    """Words under the union of spans (a, b), a to b - 1; spans sorted."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda s: s["n"])


def _numbered(n: int, hashes: Column) -> Column:
    return F.transform(hashes, lambda x: F.struct(F.lit(n).alias("n"), x.alias("fp")))


def _found(n: int) -> Column:
    """The hashes of number n that a document shares."""
    return F.transform(F.filter("found", lambda x: x["n"] == n), lambda x: x["fp"])


def _places_of(n: int) -> Column:
    """Where n words have a hash that is among fps<n>."""
    all_ = F.transform(grams(n), lambda x, i: F.struct(i.alias("a"), x.alias("fp")))
    return F.transform(F.filter(all_, lambda x: F.array_contains(f"fps{n}", x["fp"])), lambda x: F.struct(x["a"].alias("a"), F.lit(n).alias("size")))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and ka, kb, the row's identity."""
    base = _keyed(docs, key, text)
    split = items.select(column(item).cast("string").alias("item"), words(column(item_text)).alias("w")).where(F.size("w") > 0)
    split = materialize(split, "items")
    pieces = split.select("item", "w", F.explode(_span(0, F.greatest(F.size("w") - SPAN, F.lit(0)))).alias("at"))
    windows = pieces.select("item", F.array_join(F.slice("w", F.col("at") + 1, SPAN), " ").alias("window"))
    windows = windows.groupBy("window").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull().cast("int")).alias("unnamed"))
    windows = materialize(windows, "windows")
    coded = split.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    kept = coded.where(F.size("w") >= SPAN).select(grams(GRAM).alias("h")).select(F.explode(winnowed("h")).alias("fp"))
    kept = materialize(kept.distinct(), "fingerprints")
    whole = F.coalesce(*[F.when(F.size("w") == n, F.get(grams(n), 0)) for n in range(1, SPAN)])
    short = coded.where(F.size("w") < SPAN).select(F.size("w").alias("n"), whole.alias("fp")).distinct()
    short = materialize(short, "short-items")
    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # at most 12

    # Documents that share a kept hash, with those hashes; n is 0 for the winnowed ones.
    prints = materialize(kept.select(F.lit(0).alias("n"), "fp").unionByName(short), "prints")
    hashed = _once(hashed_words(base.select("ka", "kb", "text")).select("ka", "kb", "hw"), "h", grams(GRAM))
    own = F.concat(_numbered(0, winnowed("h")), *[_numbered(n, F.array_distinct(grams(n))) for n in lengths])
    found = hashed.select("ka", "kb", F.explode(own).alias("x")).select("ka", "kb", "x.*").join(_small(prints), ["n", "fp"])
    found = materialize(found.groupBy("ka", "kb").agg(F.collect_set(F.struct("n", "fp")).alias("found")), "candidates")

    # Their windows around the hits, compared as text.
    near = base.select("ka", "kb", "text").join(found, ["ka", "kb"])
    near = hashed_words(near).select("ka", "kb", "w", "hw", F.size("w").alias("n"), *[_found(n).alias(f"fps{n}") for n in (0, *lengths)])
    near = _once(near, "h", grams(GRAM))
    around = lambda i: _span(F.greatest(i - (WINDOW - 1), F.lit(0)), F.least(i, F.col("n") - SPAN))
    hit = F.filter(_span(0, F.size("h") - 1), lambda i: F.array_contains("fps0", F.element_at("h", i + 1)))
    starts = F.transform(F.array_distinct(F.flatten(F.transform(hit, around))), lambda i: F.struct(i.alias("a"), F.lit(SPAN).alias("size")))
    none = F.array().cast("array<struct<a:int,size:int>>")
    places = F.when(F.size("fps0") > 0, starts).otherwise(none)
    for n in lengths:
        places = F.concat(places, F.when(F.size(f"fps{n}") > 0, _places_of(n)).otherwise(none))
    near = near.select("ka", "kb", "w", places.alias("places"))
    texts = F.transform("places", lambda p: F.struct(p["a"].alias("a"), (p["a"] + p["size"]).alias("b"), F.array_join(F.slice("w", p["a"] + 1, p["size"]), " ").alias("window")))
    hits = near.select("ka", "kb", F.explode(texts).alias("x")).select("ka", "kb", "x.*").join(_small(windows, F.size("items") + 1), "window")
    hits = hits.groupBy("ka", "kb").agg(F.collect_set(F.struct("a", "b")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("unnamed").alias("unnamed"))
    hits = hits.select("ka", "kb", _covered(F.array_sort("spans")).alias("n_hit"), (F.size("items") + F.col("unnamed")).cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))

    counted = base.select("doc_id", "ka", "kb", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"))
    out = counted.join(hits, ["ka", "kb"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), "ka", "kb",
    )


ORACLE = r"""
with d as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select cast(item_id as varchar) as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
win as (
  select distinct item, least(13, len(w)) as n, array_to_string(list_slice(w, i, i + 12), ' ') as s
  from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
pos as (
  select r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as s
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)),
hit as (select r, i, pos.n as n, item from pos join win on pos.n = win.n and pos.s = win.s),
cov as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from hit) group by r),
its as (
  select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join cov using (r) left join its using (r)"""
