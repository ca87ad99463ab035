"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, in order of code points with null last, weigh 1, 2, 3, repeating, and share
the words of all documents; no target exceeds ``max_repeats`` times its source (what is
over goes to the others by weight, in closed form). A source gives
``floor(target / size)`` complete epochs; the rest is a selection of whole documents in order of
``-ln(u) / quality``, with ``u`` a hash of the document, while the running sum of words
stays within the rest. The last gap goes to the one document left whose size is
nearest to it, if that brings the sum nearer.

Rows alike in doc_id, source and text are copies with one key; they are kept as one row with a count, and as many
of them are taken as fit.

Running sums over a source of any size: where the sum crosses the rest is closed in by histograms of the keys, each
``SPLIT`` cells inside the cell of the one before, until a cell holds ``BUCKET_ROWS`` rows or fewer. Cells before it are
taken whole, and only this one is sorted. Histograms are combined map-side, so no task sees a whole source, whatever the
distribution of the qualities.

Defined results: a null or empty text has size zero and takes no words; a null source is a source of
its own; a quality that is null or not above zero counts as the least one; an
empty table gives an empty result; other columns are ignored by ``mix`` and passed through by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import n_words
from sparkloom.storage import table

MAX_REPEATS = 3
#: Rows that are sorted together, cells of a histogram, least quality, and copies put out together.
BUCKET_ROWS, SPLIT, LEAST, RUN = 4096, 1024, 0.05, 4096
SEED = "mix-1"


def letter_share(text: Column) -> Column:
    """Quality weight: share of letters, of any script, among the characters that are no white space."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    solid = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]"))
    return letters / F.nullif(solid, F.lit(0))


def row_key(id_col: str, text_col: str, source_col: str) -> Column:
    """What tells documents apart, whatever their order or partition."""
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (id_col, source_col)]
    return F.md5(F.concat_ws("|", F.lit(SEED), *shown, F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, n_docs`` with ``target``: shares by weight under the caps."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    rows = sizes.withColumn("w", ((place - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(max_repeats))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    rows = rows.withColumn("level", level).withColumn("at", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("at", "level"))).over(everything)
    return rows.select(
        "source", "source_size", "n_docs", F.coalesce(F.least("cap", first["level"] * F.col("w")), F.col("cap")).alias("target")
    )


def crossings(rows: DataFrame) -> DataFrame:
    """``_s, low, high, before``: for each source the cell of keys where the running sum passes ``rest``.

    ``rows(source, key, words, rest)``; ``before`` is the sum of words below ``low``. A source whose sum
    stays within its rest has no row.
    """
    whole = rows.groupBy("source").agg(F.sum("words").alias("all"), F.first("rest").alias("rest"), F.max("key").alias("top"), F.min("key").alias("low"), F.count("*").alias("n"))
    cells = table(whole.where(F.col("all") > F.col("rest")).select(F.col("source").alias("_s"), "low", (F.col("top") * 2).alias("high"), F.lit(0).cast("long").alias("before"), "n", "rest"))
    scale = F.log2  # keys spread over many orders of magnitude: the first histogram is logarithmic
    while cells.where(F.col("n") > BUCKET_ROWS).limit(1).count():
        wide = cells.where(F.col("n") > BUCKET_ROWS)
        inside = rows.select("source", "key", "words").join(wide, F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") >= F.col("low")) & (F.col("key") < F.col("high")))
        place = (scale(F.col("key")) - scale(F.col("low"))) / (scale(F.col("high")) - scale(F.col("low")))
        cell = F.least(F.greatest(F.floor(place * SPLIT), F.lit(0)), F.lit(SPLIT - 1))
        counts = inside.withColumn("cell", cell).groupBy("_s", "cell").agg(
            F.sum("words").alias("words"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("top"), F.first("before").alias("base"), F.first("rest").alias("rest")
        )
        upto = Window.partitionBy("_s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
        over = counts.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        found = over.select("_s", "low", F.col("top"), "before", "n", "rest")
        # the cell's keys are those from its least to its largest; one of equal keys cannot be split further
        closer = found.select("_s", "low", (F.col("top") * (1 + 1e-15)).alias("high"), "before", F.when(F.col("low") == F.col("top"), 0).otherwise(F.col("n")).alias("n"), "rest")
        cells = table(cells.where(F.col("n") <= BUCKET_ROWS).unionByName(closer))
        scale = lambda c: c
    return cells.select("_s", "low", "high", "before")


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None
) -> DataFrame:
    """One row per input row: ``doc_id, row_key, size, source_size, target, taken, copies``."""
    groups = _groups(df, id_col, text_col, source_col, quality)
    # a group of equal rows goes out in runs; the first ones are those taken once more
    runs = groups.where("n > 1").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))).repartition("row_key", "_at")
    until = F.least(F.col("_at") + RUN, F.col("n")) - 1
    several = runs.withColumn("no", F.explode(F.sequence(F.col("_at"), until))).drop("_at")
    rows = groups.where("n = 1").withColumn("no", F.lit(0).cast("long")).unionByName(several)
    copies = F.col("epochs") + F.when(F.col("no") < F.col("more"), 1).otherwise(0)
    return rows.select(
        F.col("doc_id").alias(id_col), "row_key", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies")
    )


def _groups(df: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None = None) -> DataFrame:
    """One row per group of equal rows, with ``n`` of them, ``epochs`` for all, and ``more``: how many are taken once more."""
    text = F.col(f"`{text_col}`").cast("string")
    h = F.conv(F.substring("row_key", 1, 13), 16, 10).cast("double")
    weight = (letter_share(text) if quality is None else quality).cast("double")
    docs = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        n_words(text).alias("size"),
        row_key(id_col, text_col, source_col).alias("row_key"),
        F.greatest(F.coalesce(weight, F.lit(LEAST)), F.lit(LEAST)).alias("q"),
    )
    docs = docs.groupBy("row_key", "doc_id", "source", "size", "q").agg(F.count("*").alias("n"))
    docs = table(docs.withColumn("key", -F.log((h + 0.5) / float(1 << 52)) / F.col("q")).withColumn("words", F.col("size") * F.col("n")).drop("q"))

    sizes = docs.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))
    targets = table(source_targets(sizes)).withColumnRenamed("source", "_s").drop("n_docs")
    rows = docs.join(targets, docs.source.eqNullSafe(targets._s)).drop("_s")
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = table(rows.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    cells = table(crossings(rows))
    at = rows.join(cells, rows.source.eqNullSafe(F.col("_s")), "left")
    inside = (F.col("key") >= F.col("low")) & (F.col("key") < F.col("high"))
    sure = at.where(F.col("low").isNull() | ~inside)
    sure = sure.withColumn("more", F.when(F.col("low").isNull() | (F.col("key") < F.col("low")), F.col("n")).otherwise(0))
    running = Window.partitionBy("source").orderBy("key", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("words").over(running), F.lit(0))
    fits = F.when(F.col("size") == 0, F.col("n")).otherwise(F.floor(left / F.col("size")))
    crossing = at.where(inside).withColumn("more", F.greatest(F.least(fits, F.col("n")), F.lit(0)).cast("long"))
    rows = table(sure.unionByName(crossing).drop("_s", "low", "high", "before"))

    taken = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("more")).alias("got"), F.first("rest").alias("_rest"))
    gaps = table(taken.select(F.col("source").alias("_s"), (F.col("_rest") - F.col("got")).alias("gap")))
    rest = rows.where((F.col("more") < F.col("n")) & (F.col("size") > 0)).join(gaps, rows.source.eqNullSafe(gaps._s))
    miss = F.abs(F.col("size") - F.col("gap"))
    last = rest.where(miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(miss.alias("m"), "key", "row_key"))["row_key"].alias("_last"))
    last = table(last.withColumnRenamed("source", "_s"))
    rows = rows.join(last, rows.source.eqNullSafe(last._s), "left")
    more = F.col("more") + F.when(F.coalesce(F.col("row_key") == F.col("_last"), F.lit(False)), 1).otherwise(0)
    return table(rows.select("doc_id", "row_key", "size", "n", "source_size", "target", "epochs", F.when(F.col("size") > 0, more).otherwise(0).cast("long").alias("more")))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``df``, each as often as it is taken. A document without words is not taken.

    Of equal rows one stands for all, as often as they are taken together; columns besides id, source and text are those of any of them.
    """
    names = [f"_{k}" for k in range(len(df.columns))]
    plain = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)), row_key(id_col, text_col, source_col).alias("row_key"))
    groups = _groups(df, id_col, text_col, source_col).where("size > 0")
    single = groups.where("n = 1").select(F.col("row_key").alias("_key"), (F.col("epochs") + F.col("more")).alias("_times")).where("_times > 0")
    several = groups.where("n > 1").select(F.col("row_key").alias("_key"), (F.col("epochs") * F.col("n") + F.col("more")).alias("_times")).where("_times > 0")
    alone = plain.join(single, F.col("row_key") == F.col("_key"))
    stands = plain.join(several, F.col("row_key") == F.col("_key"), "left_semi").groupBy("row_key").agg(F.first(F.struct(*names)).alias("_one"))
    joined = stands.join(several, F.col("row_key") == F.col("_key")).select("row_key", "_one.*", "_times")
    runs = joined.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(RUN).cast("long")))).repartition("row_key", "_at")
    rows = alone.select(*names, "_times").unionByName(runs.select(*names, F.least(F.col("_times") - F.col("_at"), F.lit(RUN)).alias("_times")))
    repeated = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return repeated.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns)))
