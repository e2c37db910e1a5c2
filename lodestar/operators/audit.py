"""Q10: audits of a drawn sample. What a record states is computed again and held against it, row by row.

A digest tree holds, for each cell of each level of a path, how many rows there
are and the sum of their hashes: sums need no order and are combined before the
shuffle, whatever a cell's size. Two trees are compared from the root down, and
rows are compared only in the cells where the deepest level differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.stored import write_once

from . import label, stats

FINDING = "audit string, check string, status string, detail string"


def row_hash(text: Column) -> Column:
    """60 bits of a row's md5, as any engine computes them."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")


def digest_tree(df: DataFrame, path: list[str], row: Column) -> DataFrame:
    """level (0: the whole), the path's columns (null below the level), n and digest; one pass for all levels."""
    out = df.withColumn("_h", row_hash(row)).rollup(*path).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.sum("_h").cast("decimal(38,0)").alias("digest"))
    return out.select((F.lit(len(path)) - F.bit_count("_g")).alias("level"), *path, "n", "digest")


def differences(left: DataFrame, right: DataFrame, path: list[str]) -> DataFrame:
    """The nodes of two trees that are not the same: level, path, n of both sides (0: not there)."""
    b = right.select(F.col("level").alias("_l"), *[F.col(p).alias(f"_p{i}") for i, p in enumerate(path)], F.col("n").alias("n_right"), F.col("digest").alias("_d"))
    same = (F.col("level") == F.col("_l")) & F.lit(True)
    for i, p in enumerate(path):
        same = same & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    rows = left.withColumnsRenamed({"n": "n_left"}).join(b, same, "full").where(~F.col("digest").eqNullSafe(F.col("_d")) | ~F.col("n_left").eqNullSafe(F.col("n_right")))
    there = F.col("level").isNotNull()
    named = [F.when(there, F.col(p)).otherwise(F.col(f"_p{i}")).alias(p) for i, p in enumerate(path)]
    return rows.select(F.coalesce("level", "_l").alias("level"), *named, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def located(left: DataFrame, right: DataFrame, path: list[str], id_: str, row: Column) -> DataFrame:
    """Each id whose rows differ: id and kind (missing: only left, added: only right, changed), from differing cells only."""
    leaves = differences(digest_tree(left, path, row), digest_tree(right, path, row), path).where(F.col("level") == len(path)).select(*path)
    leaves = write_once(leaves, "differing").select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(path)])
    within = F.lit(True)
    for i, p in enumerate(path):
        within = within & F.col(p).eqNullSafe(F.col(f"_p{i}"))

    def of(df: DataFrame, name: str) -> DataFrame:
        rows = df.withColumn("_h", row_hash(row)).join(leaves, within, "left_semi")
        return rows.groupBy(F.col(id_).alias(f"_{name}_id")).agg(F.count(F.lit(1)).alias(f"_{name}_n"), F.sum("_h").alias(f"_{name}_h"))

    both = of(left, "l").join(of(right, "r"), F.col("_l_id").eqNullSafe(F.col("_r_id")), "full")
    kind = F.when(F.col("_r_n").isNull(), "missing").when(F.col("_l_n").isNull(), "added").when((F.col("_l_h") != F.col("_r_h")) | (F.col("_l_n") != F.col("_r_n")), "changed")
    return both.select(F.coalesce("_l_id", "_r_id").alias(id_), kind.alias("kind")).where("kind is not null")


def _finding(audit: str, check: str, status: Column, detail: Column) -> Column:
    return F.struct(F.lit(audit).alias("audit"), F.lit(check).alias("check"), status.alias("status"), detail.cast("string").alias("detail"))


def _ok(test: Column, otherwise: str = "FAIL") -> Column:
    return F.when(F.coalesce(test, F.lit(False)), "PASS").otherwise(otherwise)


def _versus(recorded: Column, actual: Column) -> Column:
    return F.concat_ws("/", F.coalesce(recorded.cast("string"), F.lit("-")), F.coalesce(actual.cast("string"), F.lit("-")))


def draw_again(population: DataFrame, arms: list[str], id_: str, forced: Column, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sample that the rule draws, and one row of the edges it rests on: cells are the bins of all arms' scores.

    The edges come from the whole population: arm_low and arm_high of each arm.
    """
    edges = None
    for arm in arms:
        own = stats.tertile_edges(population.where(F.col(arm).isNotNull()), arm).select(F.col("edge_low").alias(f"{arm}_low"), F.col("edge_high").alias(f"{arm}_high"))
        edges = own if edges is None else edges.crossJoin(F.broadcast(own))
    edges = write_once(edges, "edges")
    cell = F.concat_ws("/", *[stats.bin_of(F.col(arm), F.col(f"{arm}_low"), F.col(f"{arm}_high")) for arm in arms])
    rows = population.crossJoin(F.broadcast(edges)).withColumn("cell", cell).drop(*edges.columns)
    return write_once(label.round_robin(rows.withColumn("_in", forced), "cell", id_, F.col("_in"), size, seed).drop("_in"), "redrawn"), edges


def sampling(
    sheet: DataFrame, population: DataFrame, record: DataFrame, arms: list[str], id_: str, question: str, forced: Column, size: int, seed: int, row: Column, expected_questions: int
) -> DataFrame:
    """Findings (audit, check, status, detail) about how a sheet was drawn; each differing row, edge and forced row is one.

    record: one row of what was written down (population, sampled, forced, and arm_low and arm_high of each arm).
    """
    again, edges = draw_again(population, arms, id_, forced, size, seed)
    whole = population.agg(F.count(F.lit(1)).alias("_population"), F.coalesce(F.count_if(forced), F.lit(0)).alias("_forced"))
    spans = sheet.agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(question).alias("_questions"))
    differ = located(again, sheet, ["cell", question], id_, row)
    names = {c: f"_e{i}" for i, c in enumerate(edges.columns)}
    facts = record
    for one in (whole, spans, edges.withColumnsRenamed(names), differ.agg(F.count(F.lit(1)).alias("_differ"))):
        facts = facts.crossJoin(F.broadcast(one))  # one row each
    r, a = F.col, F.col
    checks = [
        _finding("sampling", "population_size", _ok(r("population") == a("_population")), _versus(r("population"), a("_population"))),
        _finding("sampling", "sample_size", _ok(r("sampled") == a("_rows")), _versus(r("sampled"), a("_rows"))),
        _finding("sampling", "forced_count", _ok(r("forced") == a("_forced")), _versus(r("forced"), a("_forced"))),
        *[_finding("sampling", f"edge:{c}", _ok(F.round(r(c), 6) == F.round(a(e), 6)), F.when(F.round(r(c), 6) == F.round(a(e), 6), "same").otherwise("differs")) for c, e in names.items()],
        _finding("sampling", "sample_reproduces", _ok(a("_differ") == 0), a("_differ")),
        _finding("sampling", "spans_questions", _ok(a("_questions") >= expected_questions, "WARN"), a("_questions")),
        _finding("sampling", "not_self_weighting", F.lit("WARN"), _versus(a("_forced"), a("_rows"))),
    ]
    lost = again.where("forced").join(sheet.select(id_), id_, "left_anti").select(F.lit("sampling").alias("audit"), F.lit("forced_row_missing").alias("check"), F.lit("FAIL").alias("status"), F.col(id_).cast("string").alias("detail"))
    named = differ.select(F.lit("sampling").alias("audit"), F.concat(F.lit("row_"), "kind").alias("check"), F.lit("FAIL").alias("status"), F.col(id_).cast("string").alias("detail"))
    return facts.select(F.explode(F.array(*checks)).alias("f")).select("f.*").union(named).union(lost)


def provenance(run: DataFrame, recorded: DataFrame, local: DataFrame | None, path: list[str], row: Column, production: Column, source: Column, wanted: str) -> DataFrame:
    """Which frozen set and which run a sample came from. recorded: one row with n and digest of the set it was drawn from.

    production: a test of each of the run's rows; source: the recorded path, with either slash, that should lie under
    `wanted`; local: the set on this disk, or None. Each differing node of the local set's tree is named.
    """
    tree = write_once(digest_tree(run, path, row), "tree")
    root = tree.where("level = 0").select(F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    flags = run.agg(F.bool_and(production).alias("_production"))
    parts = F.filter(F.split(F.replace(source, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    folder = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")
    facts = recorded.withColumn("_folder", folder).crossJoin(F.broadcast(root)).crossJoin(F.broadcast(flags))
    checks = [
        _finding("provenance", "drawn_from_the_run", _ok((F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n"))), _versus(F.col("n"), F.col("_n"))),
        _finding("provenance", "production_retrieval", F.when(F.col("_production").isNull(), "SKIP").otherwise(_ok(F.col("_production"))), F.col("_production")),
        _finding("provenance", "source_folder", _ok(F.col("_folder") == wanted), F.col("_folder")),
    ]
    out = facts.select(F.explode(F.array(*checks)).alias("f")).select("f.*")
    if local is None:
        return out.union(recorded.select(_finding("provenance", "local_set", F.lit("SKIP"), F.lit(None)).alias("f")).select("f.*"))
    nodes = differences(tree, digest_tree(local, path, row), path)
    total = nodes.agg(_finding("provenance", "local_set", _ok(F.count(F.lit(1)) == 0, "WARN"), F.count(F.lit(1))).alias("f")).select("f.*")
    place = F.concat_ws("/", F.lit("root"), *[F.col(p).cast("string") for p in path])
    return out.union(total).union(nodes.select(F.lit("provenance").alias("audit"), F.lit("node_differs").alias("check"), F.lit("WARN").alias("status"), F.concat_ws(" ", place, _versus(F.col("n_left"), F.col("n_right"))).alias("detail")))


def anchoring(sheet: DataFrame, judged: Column, suggested: Column, shown: Column, withheld: Column, least_hidden: int = 10) -> DataFrame:
    """How far labels follow the suggestion that the annotator saw; shown is null where nobody recorded it.

    Without any suggestion this passes only if every row says that it was withheld. Agreement below 0.85 passes, below
    0.95 warns, above fails.
    """
    rows = sheet.select(judged.alias("j"), suggested.alias("s"), shown.alias("v"), withheld.alias("w")).where("j is not null")
    pair = F.col("s").isNotNull()
    same = F.count_if(pair & (F.col("j") == F.col("s")))
    facts = rows.agg(
        F.count_if(pair).alias("n"), F.count(F.lit(1)).alias("labelled"), F.count_if(F.coalesce("w", F.lit(False))).alias("withheld"), same.alias("same"),
        F.count_if(pair & F.col("v")).alias("shown"), F.count_if(pair & ~F.col("v")).alias("hidden"), F.count_if(pair & F.col("v").isNull()).alias("unknown"),
        F.count_if(pair & (F.col("j") > F.col("s"))).alias("above"), F.count_if(pair & (F.col("j") < F.col("s"))).alias("below"),
    )
    rate = F.round(F.try_divide(F.col("same"), F.col("n")), 4)
    some = F.array(
        _finding("anchoring", "visibility_recorded", _ok(F.col("unknown") == 0, "WARN"), F.concat_ws("/", "shown", "hidden", "unknown")),
        _finding("anchoring", "unanchored_subset", _ok(F.col("hidden") >= least_hidden, "WARN"), F.col("hidden")),
        _finding("anchoring", "distinct_from_suggestion", F.when(rate < 0.85, "PASS").when(rate < 0.95, "WARN").otherwise("FAIL"), F.concat_ws("/", "same", "n", "above", "below")),
    )
    none = F.array(_finding("anchoring", "free_of_anchoring", F.when((F.col("withheld") == F.col("labelled")) & (F.col("labelled") > 0), "PASS").otherwise("SKIP"), F.col("labelled")))
    return facts.select(F.explode(F.when(F.col("n") > 0, some).otherwise(none)).alias("f")).select("f.*")
