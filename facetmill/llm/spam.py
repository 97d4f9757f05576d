"""Problem 10: pages made of repeated keywords, lists of links, menus, hash tags or product tags.

Method: the rank-frequency curve of each page's words is fitted with SQL windows, and the page's word frequencies are held
against those of prose in the nearest language. In prose the n-th most frequent word has a frequency near
n ** -slope; keyword pages are flat or steep, lists bend, and all of them lack the words that hold sentences together. Slope,
residual and divergence of a page are measured in spreads of those of prose of its language and length. A
page is flagged when its divergence is extreme, or its slope or residual is and its divergence half as far out, and,
as the problem asks for pages mainly of such lists, when no more than MOST_PROSE of it stands in sentences.

Prose is what mainly stands in sentences: stretches between full stops, question or exclamation marks without a break, bar, bullet or hash. So
a corpus rich in spam doesn't make it the norm, as pages without sentences give no frequencies, centres or spreads.
Nothing looks for links, tags, prices or any word.

Texts are read once and never shuffled. What moves is the spectrum of each page (how many words occur how often), a few rows
whatever its length. The frequencies of prose, WORD_BUCKETS for each two-letter language, are sent to all tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.sources.scratch import Scratch

#: Hash buckets of the words of a language.
WORD_BUCKETS = 1 << 14
#: Least part of a page in sentences that makes it prose, and the most of it that a flagged page has.
PROSE, MOST_PROSE = 0.6, 0.4
#: Spreads from the centre of prose that are extreme, and the least spread there is.
EXTREME = 7.0
LEAST_SPREAD = 0.15
#: Pages of a length, of all languages, that weigh on the centre and spread of one language.
SHARED = 50
#: Shortest stretch that counts as a sentence, in characters.
SENTENCE = 25

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"[.!?\n\r|•#>]")
#: ASCII characters that are no letters or digits become blanks, capitals small letters.
_PLAIN = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(128)


def language(c: Column) -> Column:
    """The two-letter language of a code in any spelling; ``xx`` where there is none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]{2})(?![A-Za-z])", 1)), F.lit("")), F.lit("xx"))


def words_of(text: str) -> list[str]:
    if text.isascii():
        return text.encode().translate(_PLAIN).decode().split()
    return _WORD.findall(text.lower())


def in_sentences(text: str) -> float:
    """The part of a text's characters that stands in sentences."""
    held, last, n = 0, 0, len(text)
    for m in _BREAK.finditer(text):
        at = m.start()
        if text[at] in ".!?":
            if at + 1 < n and not (text[at + 1].isspace() or text[at + 1] in "\"”’)»"):
                continue
            if at - last >= SENTENCE:
                held += at - last
        last = at + 1
    return held / n if n else 0.0


def page_counts(df: DataFrame, id_col: str, text_col: str, lang_col: str, scratch: Scratch) -> DataFrame:
    """(page, doc_id, lang, n_words, sentences, buckets, counts, often, many): the words of each page by bucket, and how many words occur how often.

    page numbers the rows, so that an id delivered twice is two pages.
    """
    lists = pa.list_(pa.int32())
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("sentences", pa.float64()), ("buckets", lists), ("counts", lists), ("often", lists), ("many", lists)])

    def run(batches):
        seen: dict[str, int] = {}

        def bucket(word: str) -> int:
            if len(seen) > 500_000:
                seen.clear()
            seen[word] = b = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
            return b

        for b in batches:
            columns: list[list] = [[] for _ in out]
            for doc, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                words = Counter(words_of(text))
                if not words:
                    continue
                held: Counter = Counter()
                for w, n in words.items():
                    k = seen.get(w)
                    held[bucket(w) if k is None else k] += n
                spectrum = Counter(words.values())
                row = doc, lang, sum(words.values()), in_sentences(text), [*held.keys()], [*held.values()], [*spectrum.keys()], [*spectrum.values()]
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), language(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and length(text) > 0")
    pages = docs.mapInArrow(run, "doc_id bigint, lang string, n_words bigint, sentences double, buckets array<int>, counts array<int>, often array<int>, many array<int>")
    return scratch.write(pages.withColumn("page", F.monotonically_increasing_id()), "pages")


def page_fits(pages: DataFrame) -> DataFrame:
    """(page, slope, residual): the line through each page's rank-frequency curve; words equally frequent share their middle rank."""
    spectrum = pages.select("page", "n_words", F.explode(F.arrays_zip("often", "many")).alias("s")).select("page", F.col("s.many").cast("double").alias("w"), (F.col("s.often") / F.col("n_words")).alias("p"))
    last = F.sum("w").over(Window.partitionBy("page").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0))
    x, y, w = F.ln(last - (F.col("w") - 1) / 2), F.ln("p"), F.col("w")
    points = spectrum.withColumn("x", x).withColumn("y", y)
    sums = points.groupBy("page").agg(*(F.sum(w * e).alias(n) for n, e in (("s", F.lit(1.0)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") ** 2), ("sxy", F.col("x") * F.col("y")), ("syy", F.col("y") ** 2))))
    own = sums.select("page", "s", (F.col("sxx") - F.col("sx") ** 2 / F.col("s")).alias("vx"), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("s")).alias("c"), (F.col("syy") - F.col("sy") ** 2 / F.col("s")).alias("vy"))
    slope = F.when(F.col("vx") > 1e-9, F.col("c") / F.col("vx")).otherwise(0.0)
    return own.select("page", slope.alias("slope"), F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - slope * F.col("c")) / F.col("s")).alias("residual"))


def prose_frequencies(pages: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages with prose, and the mean frequency of each of WORD_BUCKETS buckets of words in each: at most 26 * 26 languages."""
    prose = pages.where((F.col("sentences") >= PROSE) & (F.col("lang") != "xx"))
    held = prose.select("lang", "n_words", F.explode(F.arrays_zip("buckets", "counts")).alias("b"))
    sums = held.groupBy("lang", F.col("b.buckets").alias("bucket")).agg(F.sum(F.col("b.counts") / F.col("n_words")).alias("s")).toPandas()
    size = {r.lang: r.n for r in prose.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(size)
    out = np.full((len(names), WORD_BUCKETS), 1.0 / WORD_BUCKETS)
    at = {n: i for i, n in enumerate(names)}
    out[sums["lang"].map(at).to_numpy(np.int64), sums["bucket"].to_numpy(np.int64)] += sums["s"].to_numpy(float)
    return names, out / (np.array([size[n] for n in names], float)[:, None] + 1)


def divergences(pages: DataFrame) -> DataFrame:
    """(page, doc_id, nearest, length, sentences, divergence): from the nearest language's prose; without any prose there is no row."""
    names, usual = prose_frequencies(pages)
    held = pages.sparkSession.sparkContext.broadcast((names, np.log(usual)))

    def run(batches):
        names, logs = held.value
        for b in batches:
            if not b.num_rows or not names:
                continue
            size = np.diff(b.column("buckets").offsets.to_numpy())
            bucket, n = (b.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            ends = np.r_[0, np.cumsum(size)][:-1]
            p = n / np.repeat(b.column("n_words").to_numpy(), size)
            each = np.add.reduceat(p * np.log(p), ends)[:, None] - np.stack([np.add.reduceat(p * log[bucket], ends) for log in logs], 1)
            best = each.argmin(1)
            columns = [b.column("page"), b.column("doc_id"), pa.array(best, pa.int32()), pa.array(np.log2(b.column("n_words").to_numpy()).astype(np.int32)), b.column("sentences"), pa.array(each[np.arange(len(best)), best])]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "doc_id", "nearest", "length", "sentences", "divergence"])

    picked = pages.select("page", "doc_id", "n_words", "sentences", "buckets", "counts")
    return picked.mapInArrow(run, "page bigint, doc_id bigint, nearest int, length int, sentences double, divergence double")


def in_spreads(scored: DataFrame) -> DataFrame:
    """Adds z_divergence, z_slope and z_residual: distances from the centre of prose of the page's language and length, in spreads.

    A class counts with SHARED pages' weight of the same length in all languages, and these with as much weight of all prose.
    """
    prose = scored.where(F.col("sentences") >= PROSE)
    kinds = ("divergence", "slope", "residual")
    sums = [f(k).alias(f"{n}_{k}") for k in kinds for n, f in (("m", F.avg), ("v", F.var_pop))]
    by_class = prose.groupBy("nearest", "length").agg(F.count("*").alias("n"), *sums)
    by_length = prose.groupBy("length").agg(F.count("*").alias("n_l"), *(c.alias(f"{n}l_{k}") for k in kinds for n, c in (("m", F.avg(k)), ("v", F.var_pop(k)))))
    whole = prose.agg(*(c.alias(f"{n}w_{k}") for k in kinds for n, c in (("m", F.avg(k)), ("v", F.var_pop(k))))).withColumn("one", F.lit(1))
    # classes are languages times binary logarithms of lengths, a few hundred rows
    out = scored.join(F.broadcast(by_class), ["nearest", "length"], "left").join(F.broadcast(by_length), "length", "left").withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")
    n, n_l = F.coalesce("n", F.lit(0)), F.coalesce("n_l", F.lit(0))
    for k in kinds:
        centre = {x: (F.coalesce(f"{x}l_{k}", F.lit(0.0)) * n_l + F.col(f"{x}w_{k}") * SHARED) / (n_l + SHARED) for x in "mv"}
        centre = {x: (F.coalesce(f"{x}_{k}", F.lit(0.0)) * n + c * SHARED) / (n + SHARED) for x, c in centre.items()}
        out = out.withColumn(f"z_{k}", (F.col(k) - centre["m"]) / F.greatest(F.sqrt(centre["v"]), F.lit(LEAST_SPREAD)))
    return out.select("page", "doc_id", "sentences", *kinds, *(f"z_{k}" for k in kinds))


def spam_pages(df: DataFrame, id_col: str, text_col: str, lang_col: str, extreme: float = EXTREME) -> DataFrame:
    """(doc_id, sentences, divergence, slope, residual and their z_ distances) of the flagged pages.

    Null ids and null, empty or wordless texts are left out; an unknown or wrong language counts as the nearest one. Each row is a
    page, also where ids repeat. A table without any prose has nothing to compare with and gives no row. Texts are read whole.
    """
    scratch = Scratch(df.sparkSession, "spam")
    pages = page_counts(df, id_col, text_col, lang_col, scratch)
    scored = scratch.write(divergences(pages).join(page_fits(pages), "page"), "scored")
    z = in_spreads(scored)
    bent = F.greatest(F.abs("z_slope"), F.abs("z_residual")) >= extreme
    flagged = (F.col("z_divergence") >= extreme) | (bent & (F.col("z_divergence") >= extreme / 2))
    return z.where(flagged & (F.col("sentences") <= MOST_PROSE)).drop("page")
