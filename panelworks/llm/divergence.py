"""Source divergence audit: how far each source's words are from the other sources of its language, and which words it overuses.

A CountVectorizer for each language (no term dropped for room, terms in too few documents left out) turns documents into sparse
count vectors. Their sums by source stay sparse: a row for each source and term that it uses. Pairs of sources are compared on the
terms that both use, on each one's counts, and on what is left, all of which has the same share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.llm import textops as T
from panelworks.llm.common import new_path, saved

#: Bytes between terms: ASCII other than letters. Every byte of a character beyond ASCII is part of a term.
APART = np.array([c < 0x80 and not chr(c).isalpha() for c in range(256)])
MIN_DOCS, TOP = 10, 10
#: CountVectorizer's limit as high as it goes, so that it drops nothing.
ALL_TERMS = 2**31 - 1
#: A vocabulary lives on the driver and in every task while its documents are counted; languages with more terms are counted a slice of terms at a time.
SLICE_TERMS = 1 << 21
#: In every vocabulary, as fitting an empty one is an error; no text has it as a term.
BLANK = " "


LISTS = "lang string, source string, n_terms long, terms array<string>, counts array<int>"


def term_lists(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``LISTS``: the distinct terms of each whole text, A-Z as a-z, and how often each occurs; null reads as ''."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in T.blocks(batch.column(2), lower=True, apart=APART):
                at = np.concatenate([[0], np.cumsum(b.ends - b.starts)]).astype(np.int32)
                every = pa.StringArray.from_buffers(len(b.starts), pa.py_buffer(at), pa.py_buffer(b.data[~APART[b.data]]))
                own = [every[x:y].value_counts() for x, y in zip(b.edges[:-1].tolist(), b.edges[1:].tolist(), strict=True)]
                edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]), pa.int32())
                terms, counts = (pa.concat_arrays([x.field(k) for x in own]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[b.first:b.last], batch.column(1)[b.first:b.last], pa.array(np.diff(b.edges)), pa.ListArray.from_arrays(edges, terms), pa.ListArray.from_arrays(edges, counts.cast(pa.int32()))],
                                                 names=["lang", "source", "n_terms", "terms", "counts"])

    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    return own.mapInArrow(found, LISTS)


def sliced(lists: DataFrame, slices: int) -> DataFrame:
    """(source, terms, counts, slice): every list cut into the terms of each slice, in JVM columns; no list is gathered anywhere."""
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    pairs = F.filter(F.arrays_zip("terms", "counts"), lambda x: F.pmod(F.xxhash64(x["terms"]), F.lit(slices)) == F.col("slice"))
    cut = lists.select("source", "terms", "counts", each).withColumn("own", pairs).where(F.size("own") > 0)
    return cut.select("source", F.col("own.terms").alias("terms"), F.col("own.counts").alias("counts"), "slice")


def group_sums(lists: DataFrame, min_docs: int) -> DataFrame:
    """(source, term, n): the documents' sparse vectors of kept terms, added up by source.

    The vocabulary is fitted on each document's distinct terms, which decide alone in how many documents a term is. A document's vector
    is the places of its terms in the vocabulary and its counts of them; a task adds up the vectors of a batch before they are shuffled."""
    spark = lists.sparkSession
    blanks = spark.range(min_docs).select(F.array(F.lit(BLANK)).alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=ALL_TERMS).fit(lists.select("terms").unionByName(blanks))
    words = pa.array(model.vocabulary, pa.string())
    sent = spark.sparkContext.broadcast(words)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            sources, lists = b.column(0).dictionary_encode(), b.column(1)
            at = pc.index_in(lists.flatten(), value_set=known)
            kept = at.is_valid().to_numpy(zero_copy_only=False)
            of = np.repeat(sources.indices.to_numpy(), np.diff(lists.offsets.to_numpy()))[kept].astype(np.int64)
            cell, inverse = np.unique(of * len(known) + at.drop_null().to_numpy(), return_inverse=True)
            n = np.zeros(len(cell), np.int64)
            np.add.at(n, inverse, b.column(2).flatten().to_numpy()[kept])
            yield pa.RecordBatch.from_arrays([sources.dictionary.take(pa.array(cell // len(known))), pa.array((cell % len(known)).astype(np.int32)), pa.array(n)], names=["source", "at", "n"])

    sums = lists.select("source", "terms", "counts").mapInArrow(add, "source string, at int, n long").groupBy("source", "at").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame(pa.table({"at": pa.array(range(len(words)), pa.int32()), "term": words}))
    return sums.join(names, "at").where(F.col("term") != BLANK).select("source", "term", "n")


def counted(docs: DataFrame, text: str, lang: str, source: str, min_docs: int, slice_terms: int) -> tuple[DataFrame, DataFrame]:
    """((lang, source, term, n) of kept terms with n > 0, (lang, source) of all groups)."""
    spark = docs.sparkSession
    folder, out = new_path(spark, "terms"), new_path(spark, "term-counts")
    term_lists(docs, text, lang, source).withColumn("folder", F.sha1(F.col("lang").cast("binary"))).write.partitionBy("folder").parquet(folder)
    lists = spark.read.schema(LISTS + ", folder string").parquet(folder)
    groups = saved(lists.groupBy("lang", "source").agg(F.max("folder").alias("folder"), F.sum("n_terms").alias("n_terms")), "groups")
    sizes = groups.groupBy("lang", "folder").agg(F.sum("n_terms").alias("n_terms")).collect()  # a row for each language
    large = [x["folder"] for x in sizes if x["n_terms"] > min_docs * slice_terms]  # a kept term occurs min_docs times, so any other has few enough
    distinct = {x["folder"]: x["n"] for x in lists.where(F.col("folder").isin(large)).select("folder", F.explode("terms").alias("t")).groupBy("folder").agg(F.approx_count_distinct("t", 0.02).alias("n")).collect()} if large else {}
    empty = spark.createDataFrame([], "lang string, source string, term string, n long")
    empty.write.parquet(out)
    for x in sizes:
        own = lists.where(F.col("folder") == x["folder"])
        slices = -(-min(x["n_terms"] // min_docs, distinct.get(x["folder"], x["n_terms"]) * 11 // 10) // slice_terms) if x["folder"] in distinct else 1
        parts = [own]
        if slices > 1:
            path = new_path(spark, "term-slices")
            sliced(own, slices).write.partitionBy("slice").parquet(path)
            cut = spark.read.schema("source string, terms array<string>, counts array<int>, slice int").parquet(path)
            parts = [cut.where(F.col("slice") == k) for k in range(slices)]
        for part in parts:
            group_sums(part, min_docs).select(F.lit(x["lang"]).alias("lang"), "source", "term", "n").write.mode("append").parquet(out)
    return spark.read.schema(empty.schema).parquet(out), groups.select("lang", "source")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(1000000000 * (n + 2) / (total + 2 * terms)), exact in decimals; null where there is no term."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (1000000000BD * CAST({n} + 2 AS DECIMAL(20, 0))) DIV CAST({total} + 2 * {terms} AS DECIMAL(20, 0)) END")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares up to 1000000001: within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by divergence (part ``pair``), and the terms that
    a source uses more than its language does (part ``term``, ranks to ``top``).

    A language keeps terms of ``min_docs`` documents or more. Null text, lang and source read as ''. A group without kept terms has
    the same share of each term; a language without kept terms gives pairs of value 0 and no terms. Repeated rows count each; texts
    of any length count whole; ties go to the smaller item in UTF-8. Other columns are ignored. An empty table gives an empty result.

    The driver loops over languages; it and the tasks hold one vocabulary of about ``slice_terms`` terms at a time."""
    counts, groups = counted(docs, text, lang, source, min_docs, slice_terms)
    whole = saved(counts.groupBy("lang", "term").agg(F.sum("n").alias("n")), "language-terms")
    langs = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("n").alias("whole"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("used"))
    zero = F.lit(0).cast("long")
    known = groups.join(own, ["lang", "source"], "left").join(langs.select("lang", "V"), "lang", "left").na.fill(0, ["total", "used", "V"])
    known = saved(known.withColumn("p0", share("0", "total", "V")), "sources")
    rows = saved(counts.join(known.select("lang", "source", "total", "V", "p0"), ["lang", "source"]).withColumn("p", share("n", "total", "V")).select("lang", "source", "term", "p", "p0"), "shares")

    a, b = rows.toDF("lang", "source", "term", "pa", "pa0"), rows.toDF("lang", "item", "term", "pb", "pb0")
    f = gap(F.col("pa"), F.col("pb")) - gap(F.col("pa"), F.col("pb0")) - gap(F.col("pa0"), F.col("pb"))
    both = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(f).alias("both"), F.count(F.lit(1)).alias("n_both"))
    both = saved(both, "shared-terms")
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both", "n_both"))
    other = known.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")).join(other, "lang").where("source <> item")
    alone = saved(alone.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * gap(F.col("p"), F.col("q0"))).alias("one")), "own-terms")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("one").alias("two"))
    pairs = known.select("lang", "source", "used", "V", "p0").join(known.select("lang", F.col("source").alias("item"), F.col("used").alias("used2"), F.col("p0").alias("q0")), "lang").where("source <> item")
    for more in (alone, back, both):
        pairs = pairs.join(more, ["lang", "source", "item"], "left")
    pairs = pairs.na.fill(0, ["one", "two", "both", "n_both"])
    rest = (F.col("V") - F.col("used") - F.col("used2") + F.col("n_both")) * gap(F.col("p0"), F.col("q0"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("V") > 0, F.col("one") + F.col("two") + F.col("both") + rest).otherwise(zero).alias("value"))

    usual = whole.join(langs, "lang").select("lang", "term", share("n", "whole", "V").alias("q"))
    over = rows.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(over)
