"""Problem 9: sources combined so that each gives a target share of all tokens, small ones repeated at most a capped number of times.

Method: min-cost flow for overlapping sources. Documents are reduced to their membership patterns,
the sets of sources that hold them, with the tokens of each. The flow routes a pattern's tokens to
the quotas of its sources: using a pattern again costs more each time, a source may take a pattern
at most ``max_repeats`` times, and a slack arc shows what a quota lacks. Documents are then laid
out along each pattern in a seeded order, and each source takes a stretch of that line.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from facetmill.llm.flow import Network
from facetmill.sources.scratch import Scratch

#: Recipe rows and membership patterns are collected; more than this are refused.
MOST_ROWS = 100_000
#: Documents of a pattern that are laid out within one task.
LINE_DOCS = 20_000
#: Pieces between white space, and separators that Python's split takes for white space besides.
_PIECE = re.compile("[^ \\t\\n\\x0b\\f\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_OTHER_BLANK = re.compile("[\\x1c-\\x1f]")


def letters(c: Column) -> Column:
    """A source's name by its letters, without case; null where it has none."""
    x = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    return F.when(x != "", x)


def _pieces(texts: pd.Series) -> pd.Series:
    return pd.Series([0 if t is None else len(t.split()) if not _OTHER_BLANK.search(t) else len(_PIECE.findall(t)) for t in texts], dtype="int64")


def blank_tokens(c: Column) -> Column:
    """The number of pieces of a text between white space; 0 for null.

    A Python function in Arrow batches: splitting takes a fraction of the CPU time of the same rule as an expression of the JVM.
    """
    return F.pandas_udf(_pieces, LongType())(c.cast("string"))


def model_tokens(docs: DataFrame, doc_id: str, text_col: str, source_col: str, tokenizer: str) -> DataFrame:
    """(doc_id, text, source, n_tokens): tokens of the text under the tokenizer file; 0 for null and empty texts."""

    def run(batches: Iterable[pa.RecordBatch]):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [len(e.ids) for i in range(0, len(texts), 256) for e in model.encode_batch(texts[i : i + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "n_tokens"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    return picked.mapInArrow(run, "doc_id bigint, text string, source string, n_tokens bigint")


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, tuple[int, int]]) -> tuple[dict[tuple, int], dict[str, int]]:
    """Tokens that go from (pattern, source), and what each source lacks; quotas is source -> (tokens wanted, most repeats).

    The n-th use of a pattern costs n - 1, so the flow spreads repeats evenly; what a source lacks costs more than any repeat.
    """
    net = Network()
    uses = max((r for _, r in quotas.values()), default=1)
    arcs, lack = {}, {}
    for pattern, tokens in patterns.items():
        own = [s for s in pattern if s in quotas]
        for n in range(uses * len(own)):
            net.arc("all", ("pattern", pattern), tokens, n)
        for s in own:
            arcs[pattern, s] = net.arc(("pattern", pattern), ("source", s), tokens * quotas[s][1])
    total = 0
    for s, (wanted, _) in quotas.items():
        lack[s] = net.arc("all", ("source", s), wanted, 1000 * (uses * len(quotas) + 1))
        net.arc(("source", s), "mix", wanted)
        total += wanted
    net.send("all", "mix", total)
    return {k: net.flow(a) for k, a in arcs.items() if net.flow(a)}, {s: net.flow(a) for s, a in lack.items()}


def memberships(docs: DataFrame, doc_id: str, text_col: str, source_col: str, tokens: Column, merge: bool) -> DataFrame:
    """(doc_id, pattern, n_tokens): each document with the letters of its sources, those without one left out.

    With ``merge`` a text that several documents hold is one document, the smallest id, in all their sources.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), letters(F.col(source_col)).alias("source"), F.sha2(F.col(text_col), 256).alias("digest"), tokens.cast("long").alias("n_tokens"))
    rows = rows.where("doc_id is not null and source is not null")
    if not merge:
        return rows.select("doc_id", F.array("source").alias("pattern"), "n_tokens")
    # the sources of a text are few, however many documents hold it
    return rows.where("n_tokens > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("pattern"), F.max("n_tokens").alias("n_tokens")).drop("digest")


def merged_away(docs: DataFrame, doc_id: str, text_col: str, source_col: str, tokens: Column) -> DataFrame:
    """(key, merged_tokens): by the letters of each source, the tokens of its repeats of a text, which ``merge`` counts once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), letters(F.col(source_col)).alias("key"), F.sha2(F.col(text_col), 256).alias("digest"), tokens.cast("long").alias("n_tokens"))
    texts = rows.where("doc_id is not null and key is not null and n_tokens > 0").groupBy("key", "digest").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("once"))
    return texts.groupBy("key").agg(F.sum(F.col("n") - F.col("once")).alias("merged_tokens"))


def mix_report(members: DataFrame, targets: DataFrame, recipe: str = "recipe_id", source: str = "source", share: str = "target_share", repeats: str = "max_repeats", factor: str = "total_factor") -> tuple[list[tuple], list[tuple]]:
    """Rows (recipe, source, wanted, reached, lacking, share wanted, share reached), and the flow (recipe, pattern, source, from, to, tokens).

    Targets with a null recipe, source, share, repeats or factor are left out. wanted is share * factor * all tokens, rounded up.
    """
    patterns = {tuple(r.pattern): int(r.n) for r in members.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).limit(MOST_ROWS + 1).collect()}
    held = targets.select(F.col(recipe).alias("recipe"), F.col(source).alias("source"), letters(F.col(source)).alias("key"), F.col(share).alias("share"), F.col(repeats).alias("repeats"), F.col(factor).alias("factor")).dropna().limit(MOST_ROWS + 1).collect()
    if max(len(patterns), len(held)) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} membership patterns or recipe rows")
    total = sum(patterns.values())
    recipes: dict = {}
    for r in held:
        recipes.setdefault(r.recipe, {})[r.key] = (r.source, math.ceil(r.share * r.factor * total), int(r.repeats), float(r.share))
    report, flows = [], []
    for name, rows in sorted(recipes.items()):
        used, lack = route(patterns, {k: (wanted, most) for k, (_, wanted, most, _) in rows.items()})
        reached = {k: wanted - lack[k] for k, (_, wanted, _, _) in rows.items()}
        whole = sum(reached.values())
        report += [(name, spelled, wanted, reached[k], lack[k], part, reached[k] / whole if whole else 0.0) for k, (spelled, wanted, _, part) in sorted(rows.items())]
        at: dict = {}
        for (pattern, k), n in sorted(used.items()):
            flows.append((name, [*pattern], rows[k][0], at.get(pattern, 0), at.get(pattern, 0) + n, patterns[pattern]))
            at[pattern] = at.get(pattern, 0) + n
    return report, flows


REPORT = "recipe_id bigint, source string, wanted bigint, reached bigint, lacking bigint, target_share double, reached_share double"
FLOWS = "recipe_id bigint, pattern array<string>, source string, start bigint, stop bigint, tokens bigint"


def select_documents(members: DataFrame, flows: DataFrame, seed: int = 5) -> DataFrame:
    """(recipe_id, source, doc_id, copies, n_tokens): the documents each source takes, in a seeded order along their pattern.

    The line of a pattern is its documents one after another, over and over; a document is taken as often as its first token lies
    in the source's stretch, so what is taken differs from the flow by less than one document.
    """
    scratch = Scratch(members.sparkSession, "mix")
    sized = scratch.write(members.where("n_tokens > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")), "members")
    buckets = max(1, sized.count() // LINE_DOCS)
    laid = sized.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = laid.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = before.select("pattern", "bucket", (F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = laid.withColumn("within", within).join(before, ["pattern", "bucket"]).select("pattern", "doc_id", "n_tokens", (F.col("within") + F.col("before")).alias("at"))
    times = lambda end: F.floor((F.col(end) - 1 - F.col("at")) / F.col("tokens"))
    taken = placed.join(flows, "pattern").withColumn("copies", (times("stop") - times("start")).cast("long"))
    return taken.where("copies > 0").select("recipe_id", "source", "doc_id", "copies", "n_tokens")
