"""Scalar building blocks as Spark columns: white space, lines, normal forms, hashes, word sets, n-grams, brackets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split and \\s take for white space, over the whole BMP.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What str.splitlines breaks at.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Not printable, the three usual control characters apart.
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\r\t]]"
#: Anything but the Latin characters that are all printable: most texts have none, so the class above is seldom tried.
COMMON = r"[^\x20-\x7e\n\r\t\xa1-\xac\xae-\u024f]"
WORD = r"[a-zA-Z_][a-zA-Z0-9_]*"
PRETOKEN = r"[A-Za-z_]+|[0-9]+|[^\sA-Za-z_0-9]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with its argument evaluated once a row; the optimizer would repeat a plain expression inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, the ends are bare; case stays. A table look-up per character, then a plain run of blanks."""
    return F.trim(F.regexp_replace(F.translate(c, _SPACES, " " * len(_SPACES)), "  +", " "))


def normal(c: Column) -> Column:
    return F.lower(squeeze(c))


def lines(c: Column) -> Column:
    """The lines of a text, without the empty one that a final line end leaves."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def longest_line_bytes(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(c, LINE_END), F.octet_length)), F.lit(0))


def printable_fraction(c: Column) -> Column:
    exact = (F.length(c) - F.regexp_count(c, F.lit(UNPRINTABLE))) / F.greatest(F.lit(1), F.length(c))
    return F.when((c != "") & ~c.rlike(COMMON), F.lit(1.0)).otherwise(exact)


def fraction(hex_digest: Column) -> Column:
    """The first 64 bits of a hexadecimal digest as a number in [0, 1)."""
    return F.conv(F.substring(hex_digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def seeded(seed: int, *parts: Column) -> Column:
    """A uniform draw that depends on the seed and the parts alone."""
    return fraction(sha(F.concat_ws(":", F.lit(str(seed)), *parts)))


def pretokens(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(PRETOKEN), 0)).cast("long")


def word_set(c: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(c, F.lit(WORD), 0), lambda w: F.length(w) > 2), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks; none if there are fewer words."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return bind(words, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(runs(w)))


def ngram_hashes(words: Column, n: int) -> Column:
    """Hashes of all runs of n words; none if there are fewer words. A word is hashed once, a run from its words' hashes."""
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))
    return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < n, F.array().cast("array<bigint>")).otherwise(runs(h)))


def ngram_hash(words: list[Column]) -> Column:
    """The hash of one run, as in ngram_hashes."""
    return F.xxhash64(*(F.xxhash64(w) for w in words))


def distinct_ngram_ratio(tokens: Column, n: int = 4) -> Column:
    """Distinct n-grams over all, by their 64-bit hashes; 1 for fewer than n + 1 tokens."""
    ratio = bind(ngram_hashes(tokens, n), lambda g: F.size(F.array_distinct(g)) / F.size(g))
    return F.when(F.size(tokens) < n + 1, F.lit(1.0)).otherwise(ratio)


def bracket_fraction(c: Column) -> Column:
    """The share of characters inside square or curly brackets, these themselves apart; depth never falls below 0."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("inside"))

    def step(s: Column, x: Column) -> Column:
        up, down = x.isin("[", "{"), x.isin("]", "}")
        depth = F.when(up, s["depth"] + 1).when(down, F.greatest(F.lit(0), s["depth"] - 1)).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), (s["inside"] + F.when(~up & ~down & (s["depth"] > 0), 1).otherwise(0)).alias("inside"))

    return F.aggregate(F.split(c, ""), start, step)["inside"] / F.greatest(F.lit(1), F.length(c))


def slug(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore, none at the ends, 80 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), 1, 80)
