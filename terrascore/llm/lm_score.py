"""Stupid-backoff language-model scores, with the corpus's own n-gram counts.

For a word w after v, S(w | v) = c(v w) / c(v) if the pair occurs at least ``LEAST`` times in the corpus, otherwise
BACKOFF * c(w) / N; a document's first word has c(w) / N. A document's score is the sum of ln S.

All of it is relational. Texts are exploded into words, each with the word before it; a table counts the pairs, and the
words from the pairs. Every word is first scored as if it were single and backed off, ln(BACKOFF / N). A *weight* says
by how much an n-gram departs from that: ln c(w) for a word, ln c(v w) - ln c(v) - ln c(w) - ln(BACKOFF / N) for a pair.
N-grams that occur once have weight 0 and no row. The weights, one row for each n-gram, are joined to the exploded
n-grams by the n-gram's hash and summed per document.

The most frequent n-grams, at most ``HOT`` rows, are broadcast; their number is counted, not guessed. All others are
joined by a shuffle on their hash, and none of them is frequent enough to make a partition large. A partition's weights,
one row a key, are hashed; the exploded n-grams, many times as many, stream by without being sorted. Words and pairs are
named by 64-bit hashes.

Texts: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; whole texts count, copies and repeated rows as often as
they occur. A null or empty text has no words and the score 0. Ids may be null; rows of one id and text come back as
often as they are there. Extra columns are not read. An empty table gives an empty result; equal texts have equal scores
but for the order in which doubles are added.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_stored, stored

LEAST, BACKOFF = 2, 0.4
#: Most rows of a table that are broadcast.
HOT = 400_000
#: Repeats of a row are given out by blocks of so many.
REPEATS = 4096
SPACE = " \t\n\x0b\x0c\r"


def _plain(word: Column) -> Column:
    """A word with A-Z in lower case. Words of ASCII alone, the most, take the quicker way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, of, pos, v, w): a row for each word w, the one before it (null for a first word) and its place from 0; a text
    without words has one row without a word. `of` is a hash of the text, which tells rows of one id apart."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("of"), F.split(F.btrim(text, F.lit(SPACE)), r"[\x20\x09-\x0D]+").alias("words"))
    rows = rows.select("id", "of", "words", F.posexplode_outer("words").alias("pos", "word"))
    before = F.when(F.col("pos") > 0, F.xxhash64(_plain(F.get("words", F.col("pos") - 1))))
    return rows.select("id", "of", "pos", before.alias("v"), F.when(F.col("word") != "", F.xxhash64(_plain(F.col("word")))).alias("w"))


def pair_key(v: Column, w: Column) -> Column:
    """The hash of a pair of words; null without a word before."""
    return F.when(v.isNotNull(), F.xxhash64(v, w))


def _level(c: Column) -> Column:
    return F.floor(F.log2(c) * 8)


def frequent_from(table: DataFrame, most: int) -> int:
    """The lowest level of counts such that at most `most` rows of the table have it or a higher one."""
    sizes = dict(table.groupBy(_level(F.col("c")).alias("level")).count().collect())  # at most 8 * 64 levels
    have, least = 0, 8 * 64
    for level in sorted(sizes, reverse=True):
        have += sizes[level]
        if have > most:
            break
        least = level
    return least


def _split(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The frequent rows of a table (broadcast) and the others."""
    least = frequent_from(table, most)
    return F.broadcast(table.where(_level(F.col("c")) >= least).drop("c")), table.where(_level(F.col("c")) < least).drop("c")


def counts(words: DataFrame) -> DataFrame:
    """(size, v, w, c) of tokens(): how often each pair (size 2; v null at the start of a text) and each word (size 1, v
    null) occurs, from LEAST up, and in one row of size 0 how many words occur less often. Texts are exploded once: the
    words are counted from the pairs, which all branches read from one shuffle, so no filter may go below it."""
    pairs = words.where(F.col("w").isNotNull()).groupBy("v", "w").agg(F.count("*").alias("c"))
    singles = pairs.groupBy("w").agg(F.sum("c").alias("c"))
    size, none = (lambda n: F.lit(n).alias("size")), F.lit(None).cast("long")
    rare = singles.agg(F.sum(F.when(F.col("c") < LEAST, F.col("c"))).alias("c"))
    return (
        pairs.where(F.col("c") >= LEAST).select(size(2), "v", "w", "c")
        .unionByName(singles.where(F.col("c") >= LEAST).select(size(1), none.alias("v"), "w", "c"))
        .unionByName(rare.select(size(0), none.alias("v"), none.alias("w"), F.coalesce("c", F.lit(0)).alias("c")))
    )


def _with_count(pairs: DataFrame, word: str, name: str, frequent: DataFrame, other: DataFrame) -> DataFrame:
    """pairs with the logarithm of the count of one of their words."""
    named = [t.select(F.col("w").alias(word), F.col("log_c").alias(name)) for t in (frequent, other)]
    return pairs.join(F.broadcast(named[0]), word).unionByName(pairs.join(named[0], word, "left_anti").join(named[1], word))


def weights(counted: DataFrame, n: int, most: int = HOT) -> DataFrame:
    """(key, weight, c) of every word and pair of counts() that occurs LEAST times or more, of n words in all."""
    words = counted.where("size = 1").select("w", "c", F.log("c").alias("log_c"))
    frequent, other = _split(words, most)
    pairs = counted.where("size = 2 AND v IS NOT NULL").select("v", "w", "c")
    pairs = _with_count(_with_count(pairs, "v", "log_v", frequent, other), "w", "log_w", frequent, other)
    weight = F.log("c") - F.col("log_v") - F.col("log_w") - F.lit(math.log(BACKOFF / n))
    return words.select(F.col("w").alias("key"), F.col("log_c").alias("weight"), "c").unionByName(pairs.select(pair_key(F.col("v"), F.col("w")).alias("key"), weight.alias("weight"), "c"))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = HOT) -> DataFrame:
    """(id, n_words, log_score, mean_log_score), a row for each row; the mean is 0 for a text without words. At most
    `most` n-grams are broadcast."""
    words = tokens(docs, id_col, text_col)
    counted = stored(counts(words), "ngram-counts")
    n = counted.where("size < 2").agg(F.sum("c")).first()[0] or 1
    weighed = stored(weights(counted, n, most), "ngram-weights")
    drop_stored(counted)
    frequent, other = _split(weighed, most)

    pair = pair_key(F.col("v"), F.col("w"))
    of_word, of_pair = (frequent.select(F.col("key").alias(k), F.col("weight").alias(f"of_{k}")) for k in ("w", "p"))
    near = (
        words.withColumn("p", pair).join(F.broadcast(of_word), "w", "left").join(F.broadcast(of_pair), "p", "left")
        .select("id", "of", (F.coalesce("of_w", F.lit(0.0)) + F.coalesce("of_p", F.lit(0.0))).alias("weight"),
                F.col("w").isNotNull().cast("long").alias("word"), (F.col("pos") == 0).cast("long").alias("row"))
    )
    grams = words.select("id", "of", F.explode(F.array("w", pair)).alias("key")).where(F.col("key").isNotNull())
    far = grams.join(frequent, "key", "left_anti").join(other.hint("shuffle_hash"), "key").select("id", "of", "weight", F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("row"))
    sums = near.unionByName(far).groupBy("id", "of").agg(F.sum("weight").alias("weight"), F.sum("word").alias("word"), F.sum("row").alias("row"))

    size = (F.col("word") / F.col("row")).cast("long")
    backed = F.col("weight") / F.col("row") + size * math.log(BACKOFF / n) - math.log(BACKOFF)
    found = sums.select("id", "row", size.alias("n_words"), F.when(F.col("word") > 0, backed).otherwise(F.lit(0.0)).alias("log_score"))
    blocks = found.select("*", F.explode(F.sequence(F.lit(0), ((F.col("row") - 1) / REPEATS).cast("long"))).alias("block"))
    each = blocks.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.col("row") - F.col("block") * REPEATS))))
    return each.select("id", "n_words", "log_score", (F.col("log_score") / F.greatest("n_words", F.lit(1))).alias("mean_log_score"))
