"""Evidence per (entity, question): deduplication, ranking, conflicts, ledgers, matrices and digests.

Evidence rows carry entity, question, value, quote, source_url, verified, score, match_type, semantic and ord, the
arrival order. All groupings reduce rows by partial aggregates before a shuffle, so a cell that holds a large part
of all rows does not gather them in one task unless its distinct values do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import at_least

CELL = ["entity", "question"]
#: Values at least this similar show as one.
SAME_VALUE = 85.0


def evidence_rank() -> Column:
    return F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "fuzzy", 1).otherwise(2)


def deduplicate(evidence: DataFrame) -> DataFrame:
    """The first row of each normalised value, quote and source in a cell; rows without a value go."""
    rows = evidence.where("value is not null and value <> ''").withColumn("norm", text.normalise_value(F.col("value")))
    keys = [*CELL, "norm", F.coalesce("quote", F.lit("")).alias("quote_key"), F.coalesce("source_url", F.lit("")).alias("url_key")]
    rest = [c for c in rows.columns if c not in (*CELL, "norm")]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("e"))
    return first.select(*CELL, "norm", *(F.col(f"e.{c}").alias(c) for c in rest))


def _first_matches(cells: DataFrame, column: str, least: float = SAME_VALUE) -> DataFrame:
    """cells with flags: which texts of the array column, in its order, are unlike every one kept before.

    A cell is a row of a batch; what a pair of texts is like is remembered for the cells after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = lru_cache(100_000)(lambda x, y: at_least(x, y, least))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, flags = batch.slice(at, 256), []
                for norms in part.column(part.schema.get_field_index(column)).to_pylist():
                    kept: dict[str, None] = {}
                    row = []
                    for norm in norms:
                        x = " ".join(sorted(norm.split()))
                        row.append(x not in kept and not any(like(x, k) for k in kept))
                        if row[-1]:
                            kept[x] = None
                    flags.append(row)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(flags, pa.list_(pa.bool_()))], names=[*part.schema.names, "flags"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields), "flags array<boolean>"])
    return cells.mapInArrow(run, schema)


def first_match_values(values: DataFrame, least: float = SAME_VALUE) -> DataFrame:
    """Of each cell's distinct values, in order of arrival, those unlike every one kept before."""
    rest = [c for c in values.columns if c not in (*CELL, "ord", "norm")]
    cells = values.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("ord", "norm", *rest))).alias("vs")).withColumn("norms", F.col("vs.norm"))
    return _first_matches(cells, "norms", least).select(*CELL, F.inline(F.filter("vs", lambda v, k: F.get("flags", k)))).select(*values.columns)


def aggregate_cells(evidence: DataFrame, list_questions: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """One row a cell: values to show, conflict, sources, mean score. list_questions: a column question of those that ask for lists.

    Evidence is read once: rows go to the first of a value, quote and source, these to the values and sources of a cell,
    and these to the cell.
    """
    rows = evidence.where("value is not null and value <> ''").withColumn("norm", text.normalise_value(F.col("value")))
    keys = [*CELL, "norm", F.coalesce("quote", F.lit("")).alias("quote_key"), F.coalesce("source_url", F.lit("")).alias("url_key")]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("value", F.coalesce("verified", F.lit(False)).alias("verified"), "score", "ord"), "ord").alias("e"))
    # all rows that fall together have one source, so the sources of rows that go count, too
    kind = first.select("e").schema["e"].dataType.simpleString()
    pieces = F.array(F.struct(F.lit(True).alias("is_value"), F.col("norm").alias("key"), F.col("e")), F.struct(F.lit(False).alias("is_value"), F.col("url_key").alias("key"), F.lit(None).cast(kind).alias("e")))
    parts = first.select(*CELL, F.inline(pieces)).where("is_value or key <> ''").select(*CELL, "is_value", "key", "e.*")
    parts = parts.groupBy(*CELL, "is_value", "key").agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"), F.count("*").alias("n"), F.bool_and("verified").alias("verified"), F.sum("score").alias("total"), F.count("score").alias("scores"))
    item = F.struct("ord", F.col("key").alias("norm"), "value", "n", "verified", "total", "scores", text.null_sentinel(F.col("key")).alias("sentinel"))
    cells = parts.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.when(F.col("is_value"), item))).alias("found"), F.array_sort(F.collect_list(F.when(~F.col("is_value"), F.col("key")))).alias("source_urls"))
    cells = cells.withColumn("real", F.filter("found", lambda x: ~x["sentinel"]))
    cells = cells.withColumn("kept", F.when(F.size("real") > 0, F.col("real")).otherwise(F.col("found"))).drop("found")
    add = lambda name: F.aggregate("kept", F.lit(0).cast("bigint"), lambda t, x: t + x[name])
    total = F.aggregate("kept", F.lit(0.0), lambda t, x: t + F.coalesce(x["total"].cast("double"), F.lit(0.0)))
    cells = cells.select(*CELL, "source_urls", add("n").alias("num_evidence"), F.forall("kept", lambda x: x["verified"]).alias("verified"), F.when(add("scores") > 0, total / F.when(add("scores") > 0, add("scores"))).alias("verification_score"), F.element_at("kept", 1)["value"].alias("marker"), F.col("real.norm").alias("norms"), F.col("real.value").alias("shown"))
    if fuzzy:
        cells = _first_matches(cells, "norms").withColumn("shown", F.filter("shown", lambda v, k: F.get("flags", k)))
    listed = list_questions.select("question", F.lit(True).alias("is_list")).distinct() if list_questions is not None else None
    out = cells.join(listed, "question", "left") if listed is not None else cells.withColumn("is_list", F.lit(False))
    n = F.size("shown")
    return out.select(
        *CELL,
        F.when(n > 0, F.col("shown")).otherwise(F.array("marker")).alias("values"),
        "num_evidence",
        "verified",
        "verification_score",
        (~F.coalesce("is_list", F.lit(False)) & (n > 1)).alias("has_conflict"),
        F.size("source_urls").cast("bigint").alias("num_sources"),
        n.cast("bigint").alias("num_unique_values"),
        "source_urls",
    )


def ranked(evidence: DataFrame, most: int | None = None) -> DataFrame:
    """Evidence of a cell best first: exact, fuzzy, the rest; then semantic score; then arrival."""
    w = Window.partitionBy(*CELL).orderBy(evidence_rank(), F.desc(F.coalesce("semantic", F.lit(-1.0))), "ord")
    out = evidence.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= most) if most else out


def _range_of(x: Column, cuts: list, base: int = 0) -> Column:
    """How many of the sorted cuts lie below x, by halving."""
    if not cuts:
        return F.lit(base)
    m = len(cuts) // 2
    return F.when(x > F.lit(cuts[m]), _range_of(x, cuts[m + 1 :], base + m + 1)).otherwise(_range_of(x, cuts[:m], base))


def claim_ids(evidence: DataFrame, ranges: int = 200, rows_a_task: int = 50_000, most_ranges: int = 1000) -> DataFrame:
    """Consecutive ids C0001, C0002, ... in order of ord, without one task that sorts all rows.

    ord is cut at quantiles taken once; each range counts its rows, and a running sum over the ranges gives its start.
    Ranges and tasks grow with the rows, so that a task's memory does not.
    """
    spark = evidence.sparkSession
    tasks = -(-evidence.count() // rows_a_task)
    ranges = max(ranges, min(2 * tasks, most_ranges))
    steps = [k / ranges for k in range(1, ranges)]
    cuts = evidence.agg(F.percentile_approx("ord", steps, 10_000)).first()[0] or []
    dealt = evidence.withColumn("part", _range_of(F.col("ord"), sorted(set(cuts))))
    sizes = dealt.groupBy("part").count()
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        dealt = dealt.repartition(min(tasks, ranges), "part")
    local = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("ord")))
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    number = (F.col("before") + F.col("at")).cast("bigint")
    # starts: at most a row for each of the ranges
    return local.join(F.broadcast(starts), "part").withColumn("claim_id", F.format_string("C%04d", number)).drop("part", "at", "before")


def claim_index(ledger: DataFrame) -> DataFrame:
    """For each cell and normalised value the claim to cite: the first verified, else the first.

    Ids are those of claim_ids, whose numbers follow ord: numbers are hashed in place where rows with texts are sorted.
    """
    rows = ledger.select(*CELL, text.normalise_value(F.col("value")).alias("norm"), F.substring("claim_id", F.lit(2), F.length("claim_id")).cast("bigint").alias("n"), "verified")
    best = rows.groupBy(*CELL, "norm").agg(F.min(F.when(F.col("verified"), F.col("n"))).alias("checked"), F.min("n").alias("n"))
    return best.select(*CELL, "norm", F.format_string("C%04d", F.coalesce("checked", "n")).alias("claim_id"))


def attestation(evidence: DataFrame) -> DataFrame:
    """How many evidence rows of a cell hold each value, and the best candidate: verified first, most attested, earliest."""
    rows = evidence.where("value is not null and value <> ''").withColumn("norm", text.normalise_value(F.col("value")))
    per = rows.groupBy(*CELL, "norm").agg(F.count("*").alias("n"), F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"), F.bool_or(F.coalesce("verified", F.lit(False))).alias("v"))
    best = per.groupBy(*CELL).agg(F.max_by(F.struct("value", "n", "v"), F.struct("v", "n", (-F.col("ord")).alias("o"))).alias("b"), F.count("*").alias("candidates"))
    return best.select(*CELL, F.col("b.value").alias("best"), F.col("b.n").alias("attested"), F.col("b.v").alias("verified"), "candidates")


def union_lists(evidence: DataFrame) -> DataFrame:
    """Comma lists of a cell as one list of distinct items, first spelling and order kept."""
    items = evidence.select(*CELL, "ord", F.posexplode(F.split("value", ",")).alias("pos", "item")).withColumn("item", F.trim("item")).where("item <> ''")
    first = items.groupBy(*CELL, F.lower("item").alias("key")).agg(F.min(F.struct("ord", "pos", "item")).alias("f"))
    return first.groupBy(*CELL).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["item"]), ", ").alias("items"), F.count("*").alias("n_items"))


def matrix(cells: DataFrame, questions: list[str], most: int = 50) -> DataFrame:
    """Entities by questions; each text lists the values, up to most, with a mark for the rest and for conflicts."""
    more = F.size("values") - most
    lines = F.concat(F.lit("- "), F.array_join(F.slice("values", 1, most), "\n- "), F.when(more > 0, F.concat(F.lit("\n[+"), more.cast("string"), F.lit(" more items — see Provenance]"))).otherwise(""))
    shown = F.concat(F.when(F.col("has_conflict"), "(sources conflict)\n").otherwise(""), F.when(F.col("verified"), "").otherwise("(unverified)\n"), lines)
    wide = cells.withColumn("text", text.clamp_cell(shown)).groupBy("entity").pivot("question", questions).agg(F.first("text"))
    return wide.fillna("No data found", questions)


def entity_summary(evidence: DataFrame) -> DataFrame:
    """Pages, claims and verified claims of each entity."""
    per_page = evidence.groupBy("entity", "source_url").agg(F.count("*").alias("n"), F.count_if("verified").alias("v"), F.count_if(F.coalesce("value", F.lit("")) == "").alias("e"))
    return per_page.groupBy("entity").agg(F.count_if(F.col("source_url").isNotNull()).alias("pages"), F.sum("n").alias("claims"), F.sum("v").alias("verified"), (F.sum("n") - F.sum("v")).alias("unverified"), F.sum("e").alias("no_data"))


def digest(groups: DataFrame, most: int = 3) -> DataFrame:
    """One line a cell from its themes (theme, n_items): how many, and the largest ones."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("n_items")).alias("o"), "theme", "n_items")))
    per = groups.groupBy(*CELL).agg(F.sum("n_items").alias("items"), F.count("*").alias("themes"), order.alias("t"))
    top = F.array_join(F.transform(F.slice("t", 1, most), lambda x: F.concat(x["theme"], F.lit(" ("), x["n_items"].cast("string"), F.lit(" items)"))), "; ")
    line = F.concat(F.col("items").cast("string"), F.lit(" items across "), F.col("themes").cast("string"), F.lit(" themes. Top: "), top)
    return per.select(*CELL, "items", "themes", line.alias("digest"))


def with_depth(ledger: DataFrame, log: DataFrame) -> DataFrame:
    """Each claim's page depth from the fetch log (page_url, depth, ord): the last entry counts, unknown pages 0."""
    last = log.groupBy("page_url").agg(F.max_by("depth", "ord").alias("depth"))
    return ledger.join(last, ledger["source_url"] == last["page_url"], "left").drop("page_url").withColumn("depth", F.coalesce("depth", F.lit(0)))


def theme_refs(groups: DataFrame, index: DataFrame) -> DataFrame:
    """Claim ids of each theme's members (theme, values), and the anchor: the theme's own claim, else the first found."""
    members = groups.select(*CELL, "theme", F.posexplode("values").alias("pos", "value")).withColumn("norm", text.normalise_value(F.col("value")))
    found = members.join(index, [*CELL, "norm"], "left").where("claim_id is not null")
    own = F.min_by("claim_id", "pos")
    per = found.groupBy(*CELL, "theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "claim_id"))), lambda x: x["claim_id"]).alias("claim_ids"), own.alias("first"), F.max(F.when(F.col("value") == F.col("theme"), F.col("claim_id"))).alias("named"))
    return per.select(*CELL, "theme", "claim_ids", F.coalesce("named", "first").alias("anchor"))
